"""The graph a reader sees: filtered, collapsed, grouped, labelled and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuetide.functions.text import clean, text_or_blank

# --- filters -------------------------------------------------------------------------------------


def in_bounds(start=None, end=None, min_usd=None, max_usd=None) -> Column:
    """Closed bounds on ``time`` and ``usd_spot``; where a bound is set an unknown value is outside."""
    ok = F.lit(True)
    if start is not None:
        ok &= F.coalesce(F.col("time") >= F.lit(start).cast("timestamp"), F.lit(False))
    if end is not None:
        ok &= F.coalesce(F.col("time") <= F.lit(end).cast("timestamp"), F.lit(False))
    if min_usd is not None:
        ok &= F.coalesce(F.col("usd_spot") >= F.lit(min_usd), F.lit(False))
    if max_usd is not None:
        ok &= F.coalesce(F.col("usd_spot") <= F.lit(max_usd), F.lit(False))
    return ok


def filter_edge_transactions(edge_txs: DataFrame, start=None, end=None, min_usd=None, max_usd=None) -> DataFrame:
    return edge_txs.where(in_bounds(start, end, min_usd, max_usd))


def edge_bucket() -> Column:
    """The type switch that an edge hangs on; null for classes without one."""
    action_class = F.lower(F.trim(text_or_blank("action_class")))
    rebond = F.lower(F.concat_ws(" ", "action_key", "action_label")).contains("rebond")
    return (
        F.when(action_class == "bonds", F.when(rebond, "rebond").otherwise("bond_unbond"))
        .when(action_class == "transfers", "transfer").when(action_class == "swaps", "swap")
    )


def filter_edges_by_chain_type(edges: DataFrame, buckets: list[str], chains: list[str]) -> DataFrame:
    """Edges whose bucket is on (or absent) and one of whose ends' chains (``from_chain``, ``to_chain``) is selected (or both are unknown)."""
    bucket = edge_bucket()
    wanted = [c.strip().upper() for c in chains]
    ends = [F.upper(clean("from_chain")), F.upper(clean("to_chain"))]
    hit = F.coalesce(ends[0].isin(wanted), F.lit(False)) | F.coalesce(ends[1].isin(wanted), F.lit(False)) | (ends[0].isNull() & ends[1].isNull())
    return edges.where((bucket.isNull() | bucket.isin(buckets)) & hit)


def summarize_edge(edges: DataFrame, edge_txs: DataFrame) -> DataFrame:
    """Edges that still have transactions, with their value, ids and heights counted anew."""
    totals = edge_txs.groupBy("edge_id").agg(
        F.sum("usd_spot").alias("usd_spot"), F.count_distinct(F.when(F.col("tx_id") != "", F.col("tx_id"))).alias("tx_count"),
        F.min(F.when(F.col("height") > 0, F.col("height"))).alias("first_height"), F.max(F.when(F.col("height") > 0, F.col("height"))).alias("last_height"),
    )
    return edges.drop("usd_spot", "tx_count", "first_height", "last_height").join(totals, "edge_id")


# --- collapsing ------------------------------------------------------------------------------------


def collapse_actor_addresses(nodes: DataFrame, addresses: DataFrame, expanded: list[int] = ()) -> DataFrame:
    """``key, mapped``: the only address of an actor that is not expanded stands under the actor itself."""
    per_actor = addresses.groupBy(F.col("actor_id").alias("_actor")).agg(F.count("*").alias("_own"))
    owner = F.when((F.col("kind") == "actor_address") & ~F.col("shared") & (F.size("actor_ids") == 1), F.col("actor_ids")[0])
    joined = nodes.withColumn("_owner", owner).join(per_actor, F.col("_owner") == F.col("_actor"), "left")
    alone = F.col("_owner").isNotNull() & (F.coalesce("_own", F.lit(0)) <= 1) & ~F.coalesce(F.col("_owner").isin(list(expanded)), F.lit(False))
    return joined.select("key", F.when(alone, F.concat(F.lit("actor:"), F.col("_owner").cast("string"))).otherwise(F.col("key")).alias("mapped"))


def collapse_external(nodes: DataFrame, activity: DataFrame, min_usd: float, expanded_chains: list[str] = ()) -> DataFrame:
    """``key, mapped``: an unowned outside address with at most one edge and less than ``min_usd`` stands in its chain's cluster.

    ``activity``: key, incident_edges, usd_spot (``aggregate.address_activity``).
    """
    chain = F.coalesce(F.upper(clean("chain")), F.lit("UNKNOWN"))
    joined = nodes.select("key", "kind", "actor_ids", "chain").join(activity.select("key", "incident_edges", F.col("usd_spot").alias("_usd")), "key", "left")
    low = (
        (F.col("kind") == "external_address") & (F.coalesce(F.size("actor_ids"), F.lit(0)) <= 0) & ~chain.isin([c.upper() for c in expanded_chains])
        & (F.coalesce("incident_edges", F.lit(0)) <= 1) & (F.coalesce("_usd", F.lit(0)) < F.lit(max(0.0, min_usd)))
    )
    return joined.select("key", F.when(low, F.concat(F.lit("external_cluster:"), chain)).otherwise(F.col("key")).alias("mapped"))


def status_rank(status: Column) -> Column:
    """available beats error beats any other text."""
    text = F.lower(F.trim(status))
    return F.when(text == "available", 2).when(text == "error", 1).otherwise(0)


def visible_nodes(nodes: DataFrame, mapping: DataFrame, activity: DataFrame) -> DataFrame:
    """One row per mapped node: summed value, least depth, owners of all, number of addresses.

    With ``holdings_usd`` and ``holdings_status`` (``holdings.node_holdings_metrics``) also their sum and the best status.
    """
    held = {"holdings_usd", "holdings_status"} <= set(nodes.columns)
    status = F.struct(status_rank(F.col("holdings_status")).alias("rank"), F.lower(F.trim("holdings_status")).alias("text")) if held else None
    holdings = [F.coalesce(F.sum("holdings_usd"), F.lit(0)).alias("holdings_usd"), F.max(F.when(clean("holdings_status").isNotNull(), status))["text"].alias("holdings_status")] if held else []
    known = nodes.join(mapping, "key").join(activity.select("key", F.col("usd_spot").alias("_usd")), "key", "left")
    own = F.struct((F.col("key") != F.col("mapped")).cast("int"), F.col("depth"), F.col("key"))
    chain = [F.min_by("chain", own).alias("chain")] if "chain" in nodes.columns else []
    return known.groupBy(F.col("mapped").alias("key")).agg(
        F.min_by("kind", own).alias("first_kind"), *chain, F.min("depth").alias("depth"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("actor_ids")))).alias("actor_ids"), F.bool_or("shared").alias("shared"),
        F.count("*").alias("address_count"), F.coalesce(F.sum("_usd"), F.lit(0)).alias("usd_spot"), *holdings,
    ).withColumn(
        "kind", F.when(F.col("key").startswith("external_cluster:"), "external_cluster").when(F.col("key").startswith("actor:"), "actor").otherwise(F.col("first_kind"))
    ).drop("first_kind")


def visible_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between mapped nodes, ownership apart from flows, without self loops.

    A class, key or domain that all share is kept, else it is ``mixed`` or ``multiple``.
    """
    ends = edges.join(mapping.select(F.col("key").alias("from_key"), F.col("mapped").alias("_from")), "from_key").join(
        mapping.select(F.col("key").alias("to_key"), F.col("mapped").alias("_to")), "to_key"
    ).where("_from <> _to")
    ownership = F.lower(F.trim(text_or_blank("action_class"))) == "ownership"

    def single(column: str, other: str) -> Column:
        return F.when(F.min(column).eqNullSafe(F.max(column)), F.min(column)).otherwise(other)

    return ends.groupBy(F.col("_from").alias("from_key"), F.col("_to").alias("to_key"), F.when(ownership, "ownership").otherwise("flow").alias("edge_kind")).agg(
        single("action_class", "mixed").alias("action_class"), single("action_key", "multiple").alias("action_key"), single("action_domain", "multiple").alias("action_domain"),
        F.sum("usd_spot").alias("usd_spot"), F.sum("tx_count").alias("tx_count"), F.count("*").alias("raw_edges"), F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set(edge_bucket())).alias("buckets"), F.count_distinct("action_class").alias("classes"), *_validators(edges),
    )


def _validators(edges: DataFrame) -> list[Column]:
    """How many validators a group of edges names, and the first of them."""
    if "validator_address" not in edges.columns:
        return [F.lit(0).cast("bigint").alias("validators"), F.lit(None).cast("string").alias("validator")]
    label = F.coalesce(clean("validator_label"), clean("validator_address")) if "validator_label" in edges.columns else clean("validator_address")
    return [F.count_distinct(clean("validator_address")).alias("validators"), F.min(label).alias("validator")]


BUCKET_LABELS = {"swap": "Swap", "transfer": "Transfer", "bond_unbond": "Bond / Unbond", "rebond": "Rebond"}


def edge_labels(edges: DataFrame) -> DataFrame:
    """``label`` of visible edges.

    Names of the buckets (``Transactions`` without one), "+n more" after two; the number of transactions where
    several edges, classes or buckets are behind it; then the validator or the number of validators. Ownership has none.
    """
    listed = F.create_map(*[F.lit(x) for kv in BUCKET_LABELS.items() for x in kv])
    names = F.transform("buckets", lambda b: F.coalesce(F.try_element_at(listed, b), b))
    more = F.when(F.size("buckets") > 2, F.concat(F.lit(" +"), (F.size("buckets") - 2).cast("string"), F.lit(" more"))).otherwise("")
    name = F.when(F.size("buckets") == 0, F.lit("Transactions")).otherwise(F.concat(F.array_join(F.slice(names, 1, 2), " + "), more))
    several = (F.col("classes") > 1) | (F.size("buckets") > 1) | (F.col("raw_edges") > 1)
    counted = F.when(several & (F.col("tx_count") > 1), F.concat(F.lit(" ("), F.col("tx_count").cast("string"), F.lit(" txns)"))).otherwise("")
    via = F.when((F.col("validators") == 1) & F.col("validator").isNotNull(), F.concat(F.lit(" via "), "validator")).when(
        F.col("validators") > 1, F.concat(F.lit(" via "), F.col("validators").cast("string"), F.lit(" validators"))
    ).otherwise("")
    return edges.withColumn("label", F.when(F.col("edge_kind") == "ownership", "").otherwise(F.concat(name, counted, via)))


def trimmed_amount(raw: Column) -> Column:
    """Non-negative 1e8-scale amount as decimal text without trailing zeros."""
    digits = raw.cast("decimal(38,0)").cast("string")
    padded = F.when(F.length(digits) < 9, F.lpad(digits, 9, "0")).otherwise(digits)
    text = F.concat(F.left(padded, F.length(padded) - 8), F.lit("."), F.right(padded, F.lit(8)))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def swap_summary(tx_assets: DataFrame) -> DataFrame:
    """``edge_id, summary``: the largest asset in, the largest out, and how many more there are on each side."""
    totals = tx_assets.where("direction IN ('in', 'out')").groupBy("edge_id", "direction", "asset").agg(F.sum("amount_raw").alias("amount"), F.sum("usd_spot").alias("usd"))
    order = F.struct("usd", "amount", "asset")
    side = totals.groupBy("edge_id").pivot("direction", ["in", "out"]).agg(F.max_by("asset", order).alias("asset"), F.max_by("amount", order).alias("amount"), F.count("asset").alias("n"))

    def text(name: str) -> Column:
        more = F.when(F.col(f"{name}_n") > 1, F.concat(F.lit(" +"), (F.col(f"{name}_n") - 1).cast("string"))).otherwise("")
        return F.concat(trimmed_amount(F.col(f"{name}_amount")), F.lit(" "), F.col(f"{name}_asset"), more)

    return side.select("edge_id", F.concat_ws(" → ", text("in"), text("out")).alias("summary"))


def ownership_visible(ownership: DataFrame, nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ownership edges whose mapped ends differ and are both shown."""
    shown = nodes.select(F.col("key").alias("_shown"))
    mapped = ownership.join(mapping.select(F.col("key").alias("from_key"), F.col("mapped").alias("_from")), "from_key").join(
        mapping.select(F.col("key").alias("to_key"), F.col("mapped").alias("_to")), "to_key"
    ).where("_from <> _to")
    return mapped.join(shown, F.col("_from") == F.col("_shown"), "left_semi").join(shown, F.col("_to") == F.col("_shown"), "left_semi").select(
        F.col("_from").alias("from_key"), F.col("_to").alias("to_key")
    ).distinct()


def filter_supporting_actions(actions: DataFrame, buckets: list[str], start=None, end=None, min_usd=None, max_usd=None) -> DataFrame:
    bucket = edge_bucket()
    return actions.where((bucket.isNull() | bucket.isin(buckets)) & in_bounds(start, end, min_usd, max_usd))


# --- merging -----------------------------------------------------------------------------------------


def merge_edge_transactions(*parts: DataFrame) -> DataFrame:
    """The same transaction from several graphs once: least height and time, **greatest** value; merging twice changes nothing."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("edge_id", "tx_id", "source_protocol").agg(
        F.min(F.when(F.col("height") > 0, F.col("height"))).alias("height"), F.min("time").alias("time"), F.max("usd_spot").alias("usd_spot")
    )


def merge_supporting_actions(*parts: DataFrame) -> DataFrame:
    """Actions by protocol, tx, key and ends: greatest value, least height and time."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("source_protocol", "tx_id", "action_key", "src_key", "dst_key").agg(
        F.max("usd_spot").alias("usd_spot"), F.min(F.when(F.col("height") > 0, F.col("height"))).alias("height"), F.min("time").alias("time")
    )


def merge_graphs(nodes: DataFrame, more_nodes: DataFrame, txs: DataFrame, more_txs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of both graphs by key (least depth, all owners), and their transactions merged.

    Keys name the same node in both, so edges need no renaming.
    """
    both = nodes.withColumn("_g", F.lit(0)).unionByName(more_nodes.withColumn("_g", F.lit(1)))
    merged = both.groupBy("key").agg(
        F.min_by("kind", "_g").alias("kind"), F.min("depth").alias("depth"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("actor_ids")))).alias("actor_ids")
    )
    return merged, merge_edge_transactions(txs, more_txs)


def apply_node_updates(nodes: DataFrame, patch: DataFrame, key: str = "key") -> DataFrame:
    """Nodes with the patch's columns where it has a value."""
    own = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"_patch_{c}") for c in own])
    joined = nodes.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"_patch_{c}", c) if c in nodes.columns else F.col(f"_patch_{c}") for c in own}).drop(*[f"_patch_{c}" for c in own])


def refreshable_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with something to look up (pools: their pool, others: their address) whose holdings are not available."""
    open_ = F.lower(F.coalesce(clean("holdings_status"), F.lit(""))) != "available"
    sought = F.when(F.col("kind") == "pool", clean("pool") if "pool" in nodes.columns else clean("key")).otherwise(clean("address"))
    return nodes.where(sought.isNotNull() & open_).dropDuplicates(["key"])


def unavailable_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose holdings were asked for in vain (``error`` or ``unavailable``)."""
    return nodes.where(F.lower(clean("holdings_status")).isin("error", "unavailable")).dropDuplicates(["key"])


def apply_label_annotations(nodes: DataFrame, annotations: DataFrame) -> DataFrame:
    """Nodes whose address bears a custom label, shown under it; addresses are compared in lower case, of several labels the least counts."""
    labels = (
        annotations.where((F.col("kind") == "label") & clean("value").isNotNull())
        .groupBy(F.lower(F.trim("normalized_address")).alias("_labelled")).agg(F.min(F.trim("value")).alias("_label"))
    )
    return nodes.join(labels, F.lower(F.trim("address")) == F.col("_labelled"), "left").withColumn("label", F.coalesce("_label", "label")).drop("_labelled", "_label")


def explorer_visible(nodes: DataFrame, edges: DataFrame, edge_txs: DataFrame, buckets: list[str], chains: list[str], start=None, end=None, min_usd=None, max_usd=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an explored graph under the filters, nothing collapsed; targets stay, other nodes need an edge."""
    shown = summarize_edge(filter_edges_by_chain_type(edges, buckets, chains), filter_edge_transactions(edge_txs, start, end, min_usd, max_usd))
    same = nodes.select("key", F.col("key").alias("mapped"))
    grouped = visible_edges(shown, same)
    ends = grouped.select(F.col("from_key").alias("_end")).unionByName(grouped.select(F.col("to_key").alias("_end"))).distinct()
    linked = nodes.join(ends, F.col("key") == F.col("_end"), "left").where((F.col("kind") == "explorer_target") | F.col("_end").isNotNull()).drop("_end")
    return linked, grouped
