"""Prices, and segments to nodes, edges, transactions and supporting actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valuetide.functions import assets
from valuetide.functions.text import clean, text_or_blank
from valuetide.session import cut_lineage
from valuetide.sources.readers import load_pools

# --- prices -------------------------------------------------------------------


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact ``sorted[n / 2]`` per key.

    Values are first counted per logarithmic bin, so that only the bin holding
    the middle of a (possibly huge) group is ranked value by value.
    """
    counted = (
        df.where(F.col(value) > 0)
        .withColumn("_bin", F.floor(F.log(value) * 32))
        .groupBy(*keys, "_bin", value)
        .agg(F.count("*").alias("_n"))
    )
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_in_bin"))
    by_key = Window.partitionBy(*keys)
    placed = bins.select(
        *keys,
        "_bin",
        "_in_bin",
        F.sum("_in_bin").over(by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.sum("_in_bin").over(by_key).alias("_all"),
    ).withColumn("_before", F.coalesce("_before", F.lit(0)))
    target = F.floor(F.col("_all") / 2)
    middle = placed.where((F.col("_before") <= target) & (target < F.col("_before") + F.col("_in_bin"))).select(
        *keys, "_bin", (target - F.col("_before")).alias("_skip")
    )
    in_bin = Window.partitionBy(*keys).orderBy(value)
    return (
        counted.join(middle, [*keys, "_bin"])
        .withColumn("_upto", F.sum("_n").over(in_bin))
        .where(F.col("_upto") > F.col("_skip"))
        .groupBy(*keys)
        .agg(F.min(value).alias(value))
    )


def stable_assets(df: DataFrame, column: str = "asset") -> DataFrame:
    return df.withColumn("is_stable", assets.is_stable(F.col(column)))


def median_prices(pools: DataFrame) -> DataFrame:
    """Spot price per asset; a protocol's own asset is priced from its stable pools."""
    ready = load_pools(pools)
    listed = upper_median(ready.select("asset", F.col("price_usd").alias("price")), ["asset"], "price")
    ratio = (F.col("asset_depth").cast("double") / 1e8) / (F.col("native_depth").cast("double") / 1e8)
    stable = ready.where((F.col("native_depth") > 0) & (F.col("asset_depth") > 0) & assets.is_stable(F.col("asset")))
    natives = upper_median(stable.select("source_protocol", ratio.alias("price")), ["source_protocol"], "price").select(
        assets.native_asset("source_protocol").alias("asset"), "price"
    )
    return listed.join(natives, "asset", "left_anti").unionByName(natives)


# --- segments to graph ----------------------------------------------------------


def edge_key() -> Column:
    """``from|to|action key``; rebonds are kept apart by validator."""
    key = F.concat_ws("|", "src_key", "dst_key", action_key_or_class())
    by_validator = F.col("validator_address").isNotNull() & F.contains(F.lower(action_key_or_class()), F.lit("rebond"))
    return F.when(by_validator, F.concat(key, F.lit("|validator:"), "validator_address")).otherwise(key)


def action_key_or_class() -> Column:
    return F.coalesce(clean("action_key"), F.col("action_class"))


def first_by(column: str | Column, order: str = "ord") -> Column:
    """Value of the earliest row that has one."""
    value = F.col(column) if isinstance(column, str) else column
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def union_sets(column: str) -> Column:
    """Sorted union of array values; the sets here are owner ids and protocols, which are few."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def edge_tx_assets(segments: DataFrame, prices: DataFrame | None = None, dealt_by: tuple[str, ...] = ("edge_id", "tx_id")) -> DataFrame:
    """Amount and value per edge, tx, protocol, asset and direction.

    A swap contributes what went in and what came out, each priced on its own. Dealt by the edge alone, as
    ``build_edges`` deals the segments, they are summed up to edges without being moved again.
    """
    from valuetide.operators.normalize import usd_value

    swap = F.col("action_class") == "swaps"

    def entry(asset: Column, amount: Column, direction: str | None) -> Column:
        return F.struct(
            F.coalesce(asset, F.lit("THOR.RUNE")).alias("asset"),
            amount.cast("decimal(38,0)").alias("amount_raw"),
            F.lit(direction or "").alias("direction"),
        )

    in_ok = swap & F.col("swap_in_asset").isNotNull() & (F.col("swap_in_amount") > 0)
    out_asset = F.coalesce("swap_out_asset", "asset")
    out_amount = F.coalesce("swap_out_amount", "amount_raw")
    out_ok = swap & out_asset.isNotNull() & (out_amount > 0)
    entries = F.filter(
        F.array(
            F.when(in_ok, entry(F.col("swap_in_asset"), F.col("swap_in_amount"), "in")),
            F.when(out_ok, entry(out_asset, out_amount, "out")),
            F.when(
                ~(F.coalesce(in_ok, F.lit(False)) | F.coalesce(out_ok, F.lit(False))),
                entry(F.col("asset"), F.col("amount_raw"), None),
            ),
        ),
        lambda e: e.isNotNull(),
    )
    rows = segments.select(
        edge_key().alias("edge_id"), text_or_blank("tx_id").alias("tx_id"), "source_protocol", "height", "time", "usd_spot",
        F.explode(entries).alias("e"),
    ).select(
        "edge_id", "tx_id", "source_protocol", "height", "time", F.col("usd_spot").alias("_segment_usd"),
        "e.asset", "e.amount_raw", "e.direction",
    )
    if prices is None:
        rows = rows.withColumn("usd_spot", F.col("_segment_usd"))
    else:
        rows = usd_value(rows, prices).withColumn(
            "usd_spot", F.when(F.col("direction") == "", F.col("_segment_usd")).otherwise(F.col("usd_spot"))
        )
    # dealt by edge and tx, as this grouping, the transactions' and the edges' first one can all be done without another shuffle
    return rows.repartition(*dealt_by).groupBy("edge_id", "tx_id", "source_protocol", "asset", "direction").agg(
        F.sum("amount_raw").cast("decimal(38,0)").alias("amount_raw"),
        F.sum("usd_spot").alias("usd_spot"),
        F.min(F.when(F.col("height") > 0, F.col("height"))).alias("height"),
        F.min("time").alias("time"),
    )


def edge_transactions(tx_assets: DataFrame) -> DataFrame:
    """One row per edge, tx and protocol."""
    return tx_assets.groupBy("edge_id", "tx_id", "source_protocol").agg(
        F.min(F.when(F.col("height") > 0, F.col("height"))).alias("height"),
        F.min("time").alias("time"),
        F.sum("usd_spot").alias("usd_spot"),
    )


#: What edges and their transactions read of segments.
EDGE_READS = (
    "src_key", "dst_key", "action_class", "action_key", "action_label", "action_domain", "validator_address", "validator_label", "contract_type",
    "contract_protocol", "confidence", "actor_ids", "source_protocol", "ord", "tx_id", "height", "time", "usd_spot", "asset", "amount_raw",
    "swap_in_asset", "swap_in_amount", "swap_out_asset", "swap_out_amount",
)


def build_edges(segments: DataFrame, tx_assets: DataFrame, txs: DataFrame | None = None) -> DataFrame:
    """Edges with first-sighting descriptors and summed value; tx rows stay in their own table.

    Heights of 0 or less are unknown. ``txs``: the edge transactions, where they are known already.
    """
    # most edges have few segments: dealt by edge first, a row is sorted once, with one copy of its order and not one for each descriptor
    dealt = segments.withColumn("edge_id", edge_key()).repartition("edge_id")
    described = dealt.groupBy("edge_id").agg(
        first_by("src_key").alias("from_key"),
        first_by("dst_key").alias("to_key"),
        first_by("action_class").alias("action_class"),
        first_by(action_key_or_class()).alias("action_key"),
        first_by("action_label").alias("action_label"),
        first_by("action_domain").alias("action_domain"),
        first_by("validator_address").alias("validator_address"),
        first_by("validator_label").alias("validator_label"),
        first_by("contract_type").alias("contract_type"),
        first_by("contract_protocol").alias("contract_protocol"),
        first_by("confidence").alias("confidence"),
        union_sets("actor_ids").alias("actor_ids"),
        F.array_sort(F.collect_set("source_protocol")).alias("source_protocols"),
    )
    # distinct ids are counted from the tx table's own keys, which are already unique per protocol
    totals = (
        (edge_transactions(tx_assets) if txs is None else txs)
        .groupBy("edge_id", "tx_id")
        .agg(F.min("height").alias("height"), F.sum("usd_spot").alias("usd_spot"))
        .groupBy("edge_id")
        .agg(
            F.sum("usd_spot").alias("usd_spot"),
            F.count_if(F.col("tx_id") != "").alias("tx_count"),
            F.min("height").alias("first_height"),
            F.max("height").alias("last_height"),
        )
    )
    return described.join(totals, "edge_id")


#: What a node has of its first sighting.
FIRSTS = ("id", "kind", "label", "chain", "stage", "address")


def node_reads(firsts: tuple[str, ...] | None = None) -> tuple[str, ...]:
    """What nodes read of segments."""
    names = FIRSTS if firsts is None else firsts
    return ("ord", "source_protocol", *[f"{side}_{f}" for side in ("src", "dst") for f in ("key", *names, "depth", "actor_ids", "shared")])


def build_nodes(segments: DataFrame, firsts: tuple[str, ...] | None = None) -> DataFrame:
    """One row per node key: attributes of the first sighting, least depth, owner union, edge counts.

    With ``firsts`` only these of ``FIRSTS`` are found, and written: ends that agree in them are counted together
    by hash, and only nodes whose ends do not agree are ordered by sighting.
    """
    names = FIRSTS if firsts is None else firsts
    sides = F.array(
        *[
            F.struct(
                *[F.col(f"{side}_{f}").alias(f) for f in ("key", *names, "depth", "actor_ids", "shared")],
                F.lit(side).alias("side"),
            )
            for side in ("src", "dst")
        ]
    )
    seen = segments.select("ord", "source_protocol", F.explode(sides).alias("n")).select(
        "source_protocol", "n.*", F.struct("ord", F.col("n.side") == "dst").alias("sighting")
    )
    first = [first_by(c, "sighting").alias(c) for c in names]
    if firsts is not None:
        return _agreed_nodes(seen, names, first)
    return seen.groupBy("key").agg(
        *first,
        F.min("depth").alias("depth"),
        union_sets("actor_ids").alias("actor_ids"),
        F.bool_or("shared").alias("shared"),
        F.count_if(F.col("side") == "src").alias("out_edges"),
        F.count_if(F.col("side") == "dst").alias("in_edges"),
        F.array_sort(F.collect_set("source_protocol")).alias("source_protocols"),
    )


def _agreed_nodes(seen: DataFrame, names: tuple[str, ...], first: list[Column]) -> DataFrame:
    """Nodes of ``seen``; all sums have buffers of fixed width, so that the ends of a busy node are folded by hash before they are moved."""
    alike = seen.groupBy("key", *names, "actor_ids", "source_protocol").agg(
        F.min("depth").alias("depth"), F.bool_or("shared").alias("shared"),
        F.count_if(F.col("side") == "src").alias("out_edges"), F.count_if(F.col("side") == "dst").alias("in_edges"),
    )
    known = cut_lineage(
        alike.groupBy("key").agg(
            *[F.min(c).alias(c) for c in names], *[F.max(c).alias(f"_max_{c}") for c in names], F.min("depth").alias("depth"),
            union_sets("actor_ids").alias("actor_ids"), F.bool_or("shared").alias("shared"), F.sum("out_edges").alias("out_edges"),
            F.sum("in_edges").alias("in_edges"), F.array_sort(F.collect_set("source_protocol")).alias("source_protocols"),
        )
    )
    differ = F.lit(False)
    for c in names:
        differ |= F.coalesce(F.col(c) != F.col(f"_max_{c}"), F.lit(False))
    plain = [c for c in known.columns if not c.startswith("_max_")]
    torn = known.where(differ).select(F.col("key").alias("_torn"))
    if torn.isEmpty():
        return known.select(*plain)
    found = seen.join(torn, F.col("key").eqNullSafe(F.col("_torn")), "left_semi").groupBy(F.col("key").alias("_key")).agg(
        F.lit(True).alias("_found"), F.struct(*first).alias("_first")
    )
    joined = known.join(found, F.col("key").eqNullSafe(F.col("_key")), "left")
    return joined.withColumns({c: F.when(F.col("_found"), F.col(f"_first.{c}")).otherwise(F.col(c)) for c in names}).select(*plain)


def supporting_actions(segments: DataFrame) -> DataFrame:
    """One row per tx, protocol, key and endpoints (ownership excluded)."""
    firsts = [
        "action_class", "action_label", "action_domain", "validator_address", "validator_label", "contract_type",
        "contract_protocol", "asset", "amount_raw", "height", "time",
    ]
    moved = segments.where("action_class <> 'ownership'").withColumns(
        {"edge_id": edge_key(), "tx_id": text_or_blank("tx_id"), "action_key": action_key_or_class()}
    )
    # hardly two segments have all of this in common: dealt first, as in build_edges
    return moved.repartition("edge_id", "tx_id").groupBy("edge_id", "tx_id", "source_protocol", "action_key", "src_key", "dst_key").agg(
        *[first_by(c).alias("primary_asset" if c == "asset" else c) for c in firsts],
        F.sum("usd_spot").alias("usd_spot"),
        union_sets("actor_ids").alias("actor_ids"),
    )


def graph_stats(nodes: DataFrame, edges: DataFrame, supporting: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """One row of counts; ``reasons`` is (reason, n) of suppressed rows."""
    # each table is read once; one row meets one row
    linked = edges.agg(F.count("*").alias("edge_count"), F.size(F.array_distinct(F.flatten(F.collect_set("source_protocols")))).cast("bigint").alias("source_protocol_count"))
    counts = (
        nodes.agg(F.count_if(F.col("kind") == "actor").alias("actor_count"), F.count("*").alias("node_count"))
        .crossJoin(linked)
        .crossJoin(supporting.agg(F.count("*").alias("supporting_action_count")))
        .select("actor_count", "node_count", "edge_count", "supporting_action_count", "source_protocol_count")
    )
    if reasons is not None:
        for name in ("refund_action", "refund_associated", "liquidity_fee_action", "liquidity_fee_associated", "contract_sub_execution", "calc_strategy_sub_swap"):
            hit = reasons.where(F.col("reason") == name).agg(F.coalesce(F.sum("n"), F.lit(0)))
            counts = counts.withColumn(name, hit.scalar())
    return counts


def graph_filter_bounds(nodes: DataFrame, edge_txs: DataFrame) -> DataFrame:
    """Chains on offer and the extent of times and values, one row."""
    chains = nodes.where(clean("chain").isNotNull()).agg(F.array_sort(F.collect_set(F.upper(F.trim("chain")))))
    return edge_txs.agg(
        F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
        F.min("usd_spot").alias("min_usd"),
        F.max("usd_spot").alias("max_usd"),
    ).withColumn("chains", chains.scalar())


def address_activity(edges: DataFrame) -> DataFrame:
    """Incident edges and value per node."""
    ends = F.array("from_key", "to_key")
    return (
        edges.where("action_class <> 'ownership'")
        .select(F.explode(ends).alias("key"), "usd_spot")
        .groupBy("key")
        .agg(F.count("*").alias("incident_edges"), F.sum("usd_spot").alias("usd_spot"))
    )
