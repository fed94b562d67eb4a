"""Shared steps of the graph: what they shuffle and write, and what they give on hand-made rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from valuetide.catalog import tables
from valuetide.operators import aggregate as A


def _plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.replace("AdaptiveSparkPlan", "")


def test_transactions_of_an_edge_take_one_shuffle(spark):
    rows = [("a", "b", "t1", "X", 5, 7), ("a", "b", "t1", "X", 6, 3), ("a", "b", "t1", "Y", 1, 0), ("a", "c", "", "X", 2, 9)]
    segments = spark.createDataFrame(rows, "src_key string, dst_key string, tx_id string, asset string, n long, height long").select(
        "*", F.lit("transfers").alias("action_class"), F.lit(None).cast("string").alias("action_key"), F.lit(None).cast("string").alias("validator_address"), F.lit("THOR").alias("source_protocol"),
        F.lit(None).cast("timestamp").alias("time"), F.col("n").cast("decimal(38,10)").alias("usd_spot"), F.col("n").cast("decimal(38,0)").alias("amount_raw"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in (("swap_in_asset", "string"), ("swap_in_amount", "decimal(38,0)"), ("swap_out_asset", "string"), ("swap_out_amount", "decimal(38,0)"))],
    )
    txs = A.edge_transactions(A.edge_tx_assets(segments))
    assert _plan(txs).count("Exchange ") == 1
    found = {(r.edge_id, r.tx_id): (r.usd_spot, r.height) for r in txs.collect()}
    assert found == {("a|b|transfers", "t1"): (Decimal(12), 3), ("a|c|transfers", ""): (Decimal(2), 9)}


def test_edges_shuffle_only_what_a_query_reads(spark, monkeypatch):
    """The wide segments are not written between the ledger and the edges."""
    columns = "src_key string, dst_key string, tx_id string, asset string, amount_raw decimal(38,0), usd_spot decimal(38,10)"
    wide = spark.createDataFrame([("a", "b", "t", "X", Decimal(3), Decimal(4))], columns).select(
        "*", F.lit("transfers").alias("action_class"), F.lit("THOR").alias("source_protocol"), F.lit(1).cast("long").alias("height"), F.lit(None).cast("timestamp").alias("time"),
        F.lit(0.5).alias("confidence"), F.lit(1).alias("ord"), F.array(F.lit(1).cast("long")).alias("actor_ids"),
        *[F.lit(None).cast("string").alias(c) for c in ("action_key", "action_label", "action_domain", "validator_address", "validator_label", "contract_type", "contract_protocol", "swap_in_asset", "swap_out_asset")],
        *[F.lit(None).cast("decimal(38,0)").alias(c) for c in ("swap_in_amount", "swap_out_amount")],
    )

    class Book:
        prices = spark.createDataFrame([("X", 2.0)], "asset string, price double")

    landed = []
    monkeypatch.setattr(tables.V, "land_once", lambda spark, name, build: landed.append(name) or build())
    if hasattr(tables, "land_once"):
        monkeypatch.setattr(tables, "land_once", lambda spark, name, build: landed.append(name) or build())
    monkeypatch.setattr(tables.V, "ledger_transfers", lambda spark, sf: wide)
    monkeypatch.setattr(tables.V, "book", lambda spark, sf: Book)
    monkeypatch.setattr(tables.P, "project_transfers", lambda transfers, book: transfers)
    edges = tables.edges(spark, "none").select("edge_id", "from_key", "tx_count", "usd_spot")
    assert landed == []
    assert "collect_set" not in _plan(edges)
    assert [tuple(r) for r in edges.collect()] == [("a|b|transfers", "a", 1, Decimal(4))]


def test_members_meet_their_pools_without_moving(spark, monkeypatch, tmp_path):
    """Only parts and pools are dealt by pool; the rows of all suppliers stay where they arise."""
    from valuetide.catalog import views

    for name, column, keys in (("part", "p_partkey", [1, 101, 102, 205, None]), ("supplier", "s_suppkey", [1, 2, 201, None])):
        spark.createDataFrame([(k,) for k in keys], f"{column} long").write.parquet(f"{tmp_path}/{name}")
        spark.read.parquet(f"{tmp_path}/{name}").createOrReplaceTempView(name)
    monkeypatch.setattr(views, "register_tables", lambda spark, sf: None)
    try:
        members = views.members(spark, "none")
        found = sorted((r.address, r.pool_id, r.units) for r in members.collect())
        plan = _plan(members.groupBy("pool_id").count())
    finally:
        spark.catalog.dropTempView("part")
        spark.catalog.dropTempView("supplier")
    assert found == [("supp1", 1, "37"), ("supp1", 101, "37"), ("supp2", 102, "74"), ("supp201", 1, "7437"), ("supp201", 101, "7437")]
    assert plan.count("Exchange hashpartitioning") == 1  # that of the parts


def test_adjacency_has_one_slim_row_per_end(spark):
    """A key with a chain reads that chain only, one without reads all; an address on two chains is one row."""
    from valuetide.plans import actor_graph as G

    rows = [("#1", "a", ["ETH|a"], 5, "BASE|b", "b"), ("#2", "a", ["BASE|a"], 7, "BASE|c", "c"), ("#3", "a", ["ETH|a", "BASE|a"], 9, None, None), ("act", "a", None, 2, "ETH|d", "d")]
    adjacency = spark.createDataFrame(rows, "uid string, address string, looks array<string>, n long, other_key string, other_address string").select(
        "uid", "address", "looks", F.monotonically_increasing_id().alias("sid"), F.col("n").cast("decimal(38,10)").alias("usd_spot"), F.lit(1).alias("reach"), "other_key", "other_address", F.lit(True).alias("open")
    )

    def met(*keys):
        seeds = spark.createDataFrame([(k, k.split("|")[-1]) for k in keys], "key string, address string")
        return sorted(r.uid for r in G.frontier_step(adjacency, G.frontier_of(seeds), 4).select("uid").collect())

    assert met("ETH|a") == ["#1", "#3", "act"]
    assert met("a") == ["#1", "#2", "#3", "act"]
    assert met("ETH|a", "BASE|a", "a") == ["#1", "#2", "#3", "act"]  # the first key to reach an entry has it, once
    assert met("ETH|b") == []
