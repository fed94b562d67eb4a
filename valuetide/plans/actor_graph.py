"""Multi-hop value flow around a set of addresses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuetide import constants as K
from valuetide.functions import actions as act
from valuetide.functions.addresses import infer_chain
from valuetide.functions.amounts import USD
from valuetide.operators import aggregate as A
from valuetide.operators import order as D
from valuetide.operators import project as P
from valuetide.operators.normalize import flow_type_filter, time_window_filter, truncate_to_depth
from valuetide.operators.stitch import consume_transfers, stitch_inbound_legs, trace_control_suppression, transfer_key
from valuetide.operators.suppress import fee_only_frontier_filter, suppression_reasons, transfer_reasons, tx_flags
from valuetide.session import cut_lineage


@dataclass
class Ledger:
    """Everything a walk reads. Actions are prepared (``project.prepare_actions``), transfers canonical."""

    book: P.Book
    transfers: DataFrame | None = None
    actions: DataFrame | None = None
    trace: DataFrame | None = None


@dataclass
class Graph:
    """Tables of a graph; those that were not asked for are None."""

    segments: DataFrame
    nodes: DataFrame | None
    edges: DataFrame | None
    edge_txs: DataFrame | None
    tx_assets: DataFrame | None
    supporting: DataFrame | None


def frontier_of(seeds: DataFrame) -> DataFrame:
    """Hop-0 frontier of seeds (chain, address, key), in key order."""
    return seeds.select(
        "key", "address", F.struct(F.lit(0).cast(USD).alias("value"), F.col("key").alias("key")).alias("rank"), F.lit(1).alias("depth")
    )


def expandable(side: str) -> Column:
    """The endpoint may be walked on from."""
    return (
        F.col(f"{side}_kind").isin(*K.EXPANDABLE_KINDS) & F.col(f"{side}_address").isNotNull() & ~F.col(f"{side}_address").isin(*K.MODULE_LABELS)
    )


def expandable_filter(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin(*K.EXPANDABLE_KINDS) & F.col("address").isNotNull() & ~F.col("address").isin(*K.MODULE_LABELS))


def endpoint_key(side: str) -> Column:
    return F.concat_ws("|", infer_chain(f"{side}_chain", f"{side}_address"), f"{side}_address")


# --- the ledger, projected once ---------------------------------------------------------------


@dataclass
class Drawn:
    """A whole clean ledger, and the slim table that a walk reads.

    ``segments``: one wide row per segment of an action, numbered by ``sid`` below 0; ``transfers``: the clean transfers,
    numbered by ``sid`` from 0, whose segments are drawn again where a walk has reached them. ``adjacency``: a row for each
    segment and end at which a frontier can meet it: address, looks (the keys with a chain that meet it beside the address
    itself; null if any key of the address does), sid, uid (short, one per entry), usd_spot, reach (the greater depth of the
    ends), other_key, other_address (null for a loop), open (the other end may be walked on from).
    """

    adjacency: DataFrame
    book: P.Book
    transfers: DataFrame | None = None
    segments: DataFrame | None = None


def transfer_ends(transfers: DataFrame) -> DataFrame:
    """``look, address, uid``: a frontier key with a chain reads that chain only; one without reads all."""

    def end(look: Column, address: str) -> Column:
        return F.struct(look.alias("look"), F.col(address).alias("address"))

    looks = F.array_distinct(F.array(*[end(look, e) for e in ("from", "to") for look in (F.concat_ws("|", f"{e}_chain", e), F.col(e))]))
    return transfers.select(F.inline(looks), transfer_key().alias("uid")).where("look IS NOT NULL AND address IS NOT NULL")


def action_ends(actions: DataFrame) -> DataFrame:
    """Legs are met by address alone; an address that only collects fees does not meet the action."""
    slim = actions.select("uid", "action_class", "source_protocol", "in", "out").withColumn("frontier_address", F.explode(act.leg_addresses()))
    return fee_only_frontier_filter(slim).select(F.concat(F.lit("@"), "frontier_address").alias("look"), F.col("frontier_address").alias("address"), "uid").distinct()


def ledger_ends(ledger: Ledger) -> DataFrame:
    ends = []
    if ledger.transfers is not None:
        ends.append(transfer_ends(ledger.transfers))
    if ledger.actions is not None:
        ends.append(action_ends(ledger.actions))
    return reduce(DataFrame.unionByName, ends)


#: The chains by which a transfer's ends are met; references may show another.
LOOK_CHAINS = ["from_chain", "to_chain"]


def draw_segments(ledger: Ledger, flow_types: list[str] | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """All segments of a clean ledger; ``moved`` marks those of transfers, whose ``LOOK_CHAINS`` stay with them."""
    segments = []
    if ledger.transfers is not None:
        segments.append(P.project_transfers(ledger.transfers, ledger.book, overrides, LOOK_CHAINS))
    if ledger.actions is not None:
        segments.append(P.project_actions(ledger.actions, ledger.book, ledger.trace, overrides).withColumns({c: F.lit(None).cast("string") for c in LOOK_CHAINS} | {"moved": F.lit(False)}))
    all_ = reduce(DataFrame.unionByName, segments)
    return all_.where(F.col("action_class").isin(*flow_types)) if flow_types else all_


def numbered(transfers: DataFrame) -> DataFrame:
    """Transfers with a ``sid``; to be written, so that it stays."""
    return transfers.withColumn("sid", F.monotonically_increasing_id())


def draw(ledger: Ledger, flow_types: list[str] | None = None) -> Drawn:
    """Project a clean ledger in one pass; writes the slim rows that hops read, and the segments of actions.

    A transfer is an entry of one segment, so that its ends are read off the segment and its number stands for its
    uid, and its segment is not written: it is drawn from the transfer in no more than a few small joins. Only actions,
    whose legs are not all ends of their segments, are joined with their segments.
    """
    at_src, at_dst = (F.coalesce(F.col(f"{side}_address") == F.col("address"), F.lit(False)) for side in ("src", "dst"))

    def other(name: str) -> Column:
        return F.when(at_src & ~at_dst, F.col(f"dst_{name}")).when(at_dst & ~at_src, F.col(f"src_{name}"))

    def slim(drawn: DataFrame, *more: str) -> DataFrame:
        return drawn.select(
            "sid", "uid", "src_address", "dst_address", "usd_spot", F.greatest("src_depth", "dst_depth").alias("reach"), *more,
            *[f.alias(f"{side}_{name}") for side in ("src", "dst") for name, f in (("open", expandable(side)), ("ekey", endpoint_key(side)))],
        )

    def rows(near: DataFrame) -> DataFrame:
        return near.select("address", "looks", "sid", "uid", "usd_spot", "reach", other("ekey").alias("other_key"), other("address").alias("other_address"), F.coalesce(other("open"), F.lit(False)).alias("open"))

    parts, transfers, segments = [], ledger.transfers, None
    if transfers is not None:
        if "sid" not in transfers.columns:
            transfers = cut_lineage(numbered(transfers))
        drawn = flow_type_filter(P.project_transfers(transfers, ledger.book, carried=[*LOOK_CHAINS, "sid"]), flow_types)
        keys = {"src": F.concat_ws("|", "from_chain", "src_address"), "dst": F.concat_ws("|", "to_chain", "dst_address")}
        ends = [F.struct(F.col(f"{side}_address").alias("address"), F.array(key).alias("looks")) for side, key in keys.items()]
        both = F.array(F.struct(F.col("src_address").alias("address"), F.array(*keys.values()).alias("looks")))
        met = F.when(F.col("src_address") == F.col("dst_address"), both).otherwise(F.array(*ends))
        own = slim(drawn, *LOOK_CHAINS).where("uid IS NOT NULL").withColumn("uid", F.concat(F.lit("#"), F.col("sid").cast("string")))
        parts.append(rows(own.select("*", F.inline(met)).where("address IS NOT NULL")))
    if ledger.actions is not None:
        drawn = flow_type_filter(P.project_actions(ledger.actions, ledger.book, ledger.trace), flow_types)
        segments = cut_lineage(drawn.withColumn("sid", F.lit(-1) - F.monotonically_increasing_id()))
        near = action_ends(ledger.actions).drop("look").join(slim(segments), "uid").where(at_src | at_dst)
        parts.append(rows(near.withColumn("looks", F.lit(None).cast("array<string>"))))
    return Drawn(cut_lineage(reduce(DataFrame.unionByName, parts)), ledger.book, transfers, segments)


def frontier_looks(frontier: DataFrame) -> DataFrame:
    """(look, item) of a frontier: transfers are met by its keys, actions by its addresses."""
    return frontier.select(F.explode(F.array(F.col("key"), F.concat(F.lit("@"), "address"))).alias("look"), F.struct("rank", "address", "depth").alias("item"))


def frontier_step(adjacency: DataFrame, frontier: DataFrame, max_depth: int, seen: DataFrame | None = None) -> DataFrame:
    """Slim rows of the segments that touch the first frontier item to reach their entry.

    Entries in ``seen`` (uid) were drawn by an earlier hop. Columns: sid, uid, item, usd_spot, other_key,
    ``candidate`` (key, address) of the other end when it can be walked on from, ``counted`` (the entry has a segment on
    which that end is a candidate). Only the adjacency meets the frontier; no segment is moved. A segment has one row per
    address, so no row comes twice for an item.
    """
    items = frontier.select("address", F.col("key").alias("_key"), F.struct("rank", "address", "depth").alias("item"))
    by_key = F.col("looks").isNull() | (F.col("_key") == F.col("address")) | F.array_contains("looks", F.col("_key"))
    hits = adjacency.join(items, "address").where(by_key & (F.col("reach") + F.col("item.depth") <= max_depth))
    near = hits.drop("address", "looks", "reach", "_key")
    if seen is not None:
        near = near.join(seen, "uid", "left_anti")
    first = F.min("item.rank").over(Window.partitionBy("uid"))  # dealt by uid already where an earlier hop was taken out
    mine = near.withColumn("_owner", first).where(F.col("item.rank") == F.col("_owner")).drop("_owner")
    inside = F.col("item.depth") + 1 <= max_depth
    stepped = mine.withColumn("candidate", F.when(inside & F.col("open"), F.struct(F.col("other_key").alias("key"), F.col("other_address").alias("address")))).drop("open", "other_address")
    # said here, where the rows of an entry lie together, so that the next frontier need not gather them again
    return stepped.withColumn("counted", F.max(F.col("candidate").isNotNull()).over(Window.partitionBy("uid", "other_key")))


def _with_depth(side: str) -> Column:
    ref_id = F.col(f"{side}_id")
    head = F.left(ref_id, F.length(ref_id) - F.length(F.substring_index(ref_id, ":", -1)))
    return F.concat(head, (F.col(f"{side}_depth") + F.col("item.depth")).cast("string"))


def frontier_top_k(stepped: DataFrame, queued: DataFrame, top_k: int | None) -> DataFrame:
    """Next frontier: neighbours by the value that flows to them, not yet queued.

    Within an entry a neighbour that is a candidate on one segment counts with all of the entry's
    segments that touch it. Ties go to the smaller key.
    """
    scored = (
        stepped.where("other_key IS NOT NULL AND counted")
        .groupBy(F.col("other_key").alias("key"))
        .agg(F.sum("usd_spot").alias("usd"), F.min("candidate.address").alias("address"), F.min(F.when(F.col("candidate").isNotNull(), F.col("item.depth") + 1)).alias("depth"))
        .join(queued, "key", "left_anti")
    )
    ranked = scored.select("key", "address", F.struct((-F.col("usd")).cast(USD).alias("value"), F.col("key").alias("key")).alias("rank"), "depth")
    return ranked.orderBy("rank").limit(top_k) if top_k else ranked


# --- the walk ---------------------------------------------------------------------------------


def clean_ledger(ledger: Ledger, start=None, end=None) -> tuple[Ledger, DataFrame | None]:
    """Window, dedupe, suppress, stitch and consume once over the whole ledger; also (reason, n) of what was dropped.

    Repeats of one movement go first, so that stitching and consuming see each once. Suppression
    sets come from the whole window, so the result does not depend on the order in which the walk
    meets rows. Clean rows are written: every later step reads them.
    """
    transfers, actions, reasons = ledger.transfers, ledger.actions, None
    if transfers is not None:
        transfers = D.dedupe_transfers(time_window_filter(transfers, start, end))
    if actions is not None:
        if transfers is not None:
            transfers = cut_lineage(transfers)
        actions = time_window_filter(actions, start, end, "ts")
        actions = cut_lineage(D.keep_best(actions, [F.col("uid").alias("_key")], F.struct("source_protocol", F.to_json(F.struct("in", "out")))))
        flags = cut_lineage(tx_flags(actions))
        judged = cut_lineage(suppression_reasons(actions, flags=flags))
        dropped = [judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))]
        if transfers is not None:
            marked = cut_lineage(transfer_reasons(transfers, flags))
            dropped.append(marked.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")))
            transfers = marked.where("reason IS NULL").drop("reason")
        reasons = reduce(DataFrame.unionByName, dropped)
        actions = judged.where("reason IS NULL").drop("reason")
        if ledger.trace is not None:
            actions = trace_control_suppression(actions, ledger.trace)
        if transfers is not None:
            directory = ledger.book.dims.directory
            stitched = stitch_inbound_legs(actions, transfers, directory).drop("stitched_legs")
            transfers, actions = consume_transfers(actions, transfers, directory), stitched
        actions = cut_lineage(actions)
    if transfers is not None:
        transfers = cut_lineage(numbered(transfers))
    return Ledger(ledger.book, transfers, actions, ledger.trace), reasons


def walk(drawn: Drawn, seeds: DataFrame, max_hops: int, top_k: int | None = None) -> DataFrame:
    """Segments reached breadth-first from the seeds, each entry drawn by the first item to reach it.

    The whole frontier is walked unless ``top_k`` asks for its most valuable part. Hops join the frontier
    with the slim adjacency and write which segments they reach; the wide segments are fetched once, after the last hop.
    """
    if max_hops < 1:
        raise ValueError("max_hops must be at least 1")
    max_depth = max_hops + 1
    frontier = cut_lineage(frontier_of(seeds))
    queued = frontier.select("key")
    parts: list[DataFrame] = []
    for hop in range(max_hops):
        seen = reduce(DataFrame.unionByName, [d.select("uid") for d in parts]).distinct() if parts else None
        step = frontier_step(drawn.adjacency, frontier, max_depth, seen).withColumn("hop", F.lit(hop))
        last = hop + 1 == max_hops
        step = cut_lineage(step.select("sid", "hop", "item") if last else step)  # nothing more is asked of the last hop
        parts.append(step)
        if last:
            break
        frontier = cut_lineage(frontier_top_k(step, queued, top_k))
        if frontier.isEmpty():
            break
        queued = queued.unionByName(frontier.select("key"))
    reached = reduce(DataFrame.unionByName, [d.select("sid", "hop", "item") for d in parts])
    return truncate_to_depth(fetch(drawn, reached), max_hops)


def fetch(drawn: Drawn, reached: DataFrame) -> DataFrame:
    """Whole segments of ``reached`` (sid, hop, item), their depths counted from the walk's start.

    Of a transfer only its own few columns are moved; its segment is drawn where they meet.
    """
    parts = []
    if drawn.transfers is not None:
        parts.append(P.project_transfers(drawn.transfers.join(reached.where("sid >= 0"), "sid"), drawn.book, carried=["hop", "item"]).drop("moved"))
    if drawn.segments is not None:
        parts.append(drawn.segments.join(reached.where("sid < 0"), "sid").drop("sid"))
    return reduce(DataFrame.unionByName, parts).withColumns(
        {
            "src_depth": F.col("src_depth") + F.col("item.depth"),
            "dst_depth": F.col("dst_depth") + F.col("item.depth"),
            "src_id": _with_depth("src"),
            "dst_id": _with_depth("dst"),
            "ord": F.col("ord").withField("hop", F.col("hop")).withField("rank", F.col("item.rank")),
        }
    ).drop("hop", "item")


def assemble(segments: DataFrame, prices: DataFrame, reads: tuple[str, ...] | None = None, firsts: tuple[str, ...] | None = None) -> Graph:
    """Nodes, edges, transactions and supporting actions of finished segments.

    With ``reads`` (``aggregate.EDGE_READS``, ``aggregate.node_reads``) no other columns of the segments are written, and
    only the tables that these suffice for may be asked for rows; ``firsts`` as in ``aggregate.build_nodes``.
    """
    kept = D.dedupe_canonical_swaps(segments)
    kept = cut_lineage(kept.select(*reads) if reads else kept)
    known = set(kept.columns)
    nodes = edges = txs = tx_assets = supporting = None
    if known.issuperset(A.node_reads(firsts)):
        nodes = A.build_nodes(kept, firsts)
    if known.issuperset(A.EDGE_READS):
        tx_assets = A.edge_tx_assets(kept, prices, ("edge_id",))  # not written: edges read but a part of it
        txs = A.edge_transactions(tx_assets)
        edges, supporting = A.build_edges(kept, tx_assets, txs), A.supporting_actions(kept)
    return Graph(kept, nodes, edges, txs, tx_assets, supporting)


def actor_flow_graph(
    ledger: Ledger, actors: DataFrame, addresses: DataFrame, seeds: DataFrame, max_hops: int = 4, top_k: int | None = None,
    flow_types: list[str] | None = None, start=None, end=None, reads: tuple[str, ...] | None = None, firsts: tuple[str, ...] | None = None,
) -> tuple[Graph, DataFrame | None]:
    """Ownership plus everything within ``max_hops`` of the actors' addresses; also suppression counts. ``reads``, ``firsts``: see ``assemble``."""
    ready, reasons = clean_ledger(ledger, start, end)
    segments = walk(draw(ready, flow_types), seeds, max_hops, top_k)
    owned = P.ownership_edges(actors, addresses, ledger.book.dims)
    return assemble(segments.unionByName(owned, allowMissingColumns=True), ledger.book.prices, reads, firsts), reasons


def touched_entries(ledger: Ledger, frontier: DataFrame) -> Ledger:
    """The entries of a ledger that a frontier reaches."""
    hits = cut_lineage(ledger_ends(ledger).join(frontier_looks(frontier).select("look").distinct(), "look", "left_semi").select(F.col("uid").alias("_hit")).distinct())
    transfers, actions = ledger.transfers, ledger.actions
    if transfers is not None:
        transfers = transfers.join(hits, transfer_key() == F.col("_hit"), "left_semi")
    if actions is not None:
        actions = actions.join(hits, F.col("uid") == F.col("_hit"), "left_semi")
    return Ledger(ledger.book, transfers, actions, ledger.trace)


def expand_one_hop(ledger: Ledger, seeds: DataFrame, flow_types: list[str] | None = None, start=None, end=None, reads: tuple[str, ...] | None = None) -> Graph:
    """One hop around all given addresses, without ownership. ``reads``: see ``assemble``.

    Only what the addresses touch is projected. Transfers alone are cut to that before they are cleaned, as
    repeats of a movement have the same ends; with actions the suppression sets need the whole window.
    """
    frontier = cut_lineage(frontier_of(seeds))
    if ledger.actions is None:
        ledger = touched_entries(ledger, frontier)
    ready, _ = clean_ledger(ledger, start, end)
    if ledger.actions is not None:
        ready = touched_entries(ready, frontier)
    return assemble(walk(draw(ready, flow_types), seeds, 1), ledger.book.prices, reads)
