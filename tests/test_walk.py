"""The walk: what it writes and moves, and what it reaches on hand-made rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from valuetide.operators import aggregate as A
from valuetide.operators import project as P
from valuetide.operators.classify import Dims
from valuetide.plans import actor_graph as G


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().replace("AdaptiveSparkPlan", "")


def _ledger(spark, pairs):
    transfers = spark.createDataFrame([(f"T{n}", a, b, n + 1) for n, (a, b) in enumerate(pairs)], "tx_id string, from string, to string, n int").select(
        F.lit("ETH").alias("chain"), F.lit("ETH.ETH").alias("asset"), (F.col("n") * 10**8).cast("decimal(38,0)").alias("amount_raw"), "from", "to",
        F.lit("ETH").alias("from_chain"), F.lit("ETH").alias("to_chain"), "tx_id", F.col("n").cast("long").alias("height"), F.lit(None).cast("timestamp").alias("time"), F.lit(0.5).alias("confidence"),
        F.lit("tracker.transfer").alias("action_key"), F.lit("Native Transfer").alias("action_label"),
    )
    owners = spark.createDataFrame([], "key string, actor_ids array<bigint>, actor_name string")
    directory = spark.createDataFrame([], "address string, kind string, chain string, label string, node_address string")
    prices = spark.createDataFrame([("ETH.ETH", 2.0)], "asset string, price double")
    return G.Ledger(P.Book(Dims(owners, directory), prices, prices.select("asset")), transfers)


def _seeds(spark, *addresses):
    return spark.createDataFrame([(a, f"ETH|{a}") for a in addresses], "address string, key string")


def _written(monkeypatch):
    """Columns of each table that a walk writes."""
    written, real = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(set(df.columns)) or real(df))
    return written


def test_walk_writes_no_segment_of_a_transfer(spark, monkeypatch):
    """A transfer's segment is drawn where a hop has reached it; all that lies between is slim."""
    written = _written(monkeypatch)
    ready, _ = G.clean_ledger(_ledger(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y"), ("b", "c")]))
    walked = G.walk(G.draw(ready), _seeds(spark, "a"), 2)
    assert not [c for c in written if "src_label" in c or "ord" in c]
    found = {r.tx_id: (r.src_id, r.dst_id, r.src_depth, r.dst_depth, r.ord.hop, r.usd_spot) for r in walked.collect()}
    assert found == {
        "T0": ("external_address:a:external:1", "external_address:b:external:2", 1, 2, 0, Decimal(2)),
        "T3": ("external_address:d:external:1", "external_address:a:external:2", 1, 2, 0, Decimal(8)),
        "T1": ("external_address:b:external:2", "external_address:c:external:3", 2, 3, 1, Decimal(4)),
        "T5": ("external_address:b:external:2", "external_address:c:external:3", 2, 3, 1, Decimal(12)),
        "T2": ("external_address:c:external:2", "external_address:d:external:3", 2, 3, 1, Decimal(6)),
    }


def test_graph_writes_what_its_tables_read(spark, monkeypatch):
    ledger = _ledger(spark, [("a", "b"), ("a", "b"), ("b", "c")])
    written = _written(monkeypatch)
    graph = G.expand_one_hop(ledger, _seeds(spark, "a", "b"), reads=A.EDGE_READS)
    assert written[-1] == set(A.EDGE_READS)
    assert graph.nodes is None
    assert {r.edge_id: (r.tx_count, r.usd_spot) for r in graph.edges.collect()} == {"a|b|tracker.transfer": (2, Decimal(6)), "b|c|tracker.transfer": (1, Decimal(6))}
    whole = G.expand_one_hop(ledger, _seeds(spark, "a", "b"))
    assert {r.key: (r.depth, r.out_edges, r.in_edges) for r in whole.nodes.collect()} == {"a": (1, 2, 0), "b": (1, 1, 2), "c": (2, 0, 1)}
    assert whole.supporting.count() == 3
    folded = G.assemble(whole.segments, ledger.book.prices, A.node_reads(("kind",)), ("kind",))
    assert folded.edges is None
    assert sorted(map(tuple, folded.nodes.select("key", "kind", "depth", "out_edges", "in_edges").collect())) == sorted(map(tuple, whole.nodes.select("key", "kind", "depth", "out_edges", "in_edges").collect()))


def test_next_frontier_does_not_gather_entries_again(spark):
    """An entry's rows count if one of them has the end as a candidate; that is known before rows are summed by key."""
    rows = [("u1", "k1", 5, True), ("u1", "k1", 2, False), ("u2", "k1", 100, False), ("u2", "k2", 7, True), ("u3", "k1", 1, True), ("u4", "k3", 9, True)]
    adjacency = spark.createDataFrame(rows, "uid string, other_key string, n int, open boolean").select(
        "uid", F.lit("a").alias("address"), F.lit(None).cast("array<string>").alias("looks"), F.monotonically_increasing_id().alias("sid"), F.col("n").cast("decimal(38,10)").alias("usd_spot"),
        F.lit(1).alias("reach"), "other_key", F.concat(F.lit("at "), "other_key").alias("other_address"), "open",
    )
    frontier = G.frontier_of(_seeds(spark, "a"))
    step = G.frontier_step(adjacency, frontier, 4)
    queued = spark.createDataFrame([("k3",)], "key string")
    found = {r.key: (r.address, r.rank.value, r.depth) for r in G.frontier_top_k(step, queued, None).collect()}
    assert found == {"k1": ("at k1", Decimal(-8), 2), "k2": ("at k2", Decimal(-7), 2)}
    landed = G.cut_lineage(step)
    plan = _plan(G.frontier_top_k(landed, queued, None))
    assert "Exchange hashpartitioning(uid" not in plan


def test_edges_sum_up_transactions_where_they_lie(spark):
    """Segments and transactions are moved once each, both by their edge."""
    ledger = _ledger(spark, [("a", "b"), ("a", "b"), ("b", "c")])
    segments = G.cut_lineage(P.project_transfers(ledger.transfers, ledger.book))
    edges = A.build_edges(segments, A.edge_tx_assets(segments, None, ("edge_id",)))
    assert _plan(edges).count("Exchange hashpartitioning") == 2
    assert {(r.from_key, r.to_key): (r.tx_count, r.usd_spot, r.first_height, r.last_height) for r in edges.collect()} == {("a", "b"): (2, Decimal(6), 1, 2), ("b", "c"): (1, Decimal(6), 3, 3)}
