"""Column functions and operators on hand-made rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from valuetide.functions import amounts, ids
from valuetide.operators import holdings as H
from valuetide.operators import order as D
from valuetide.operators import visible as Y
from valuetide.operators.components import components
from valuetide.operators.normalize import usd_value


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_amounts(spark):
    assert one(spark, amounts.parse_amount, " 12 btc") == 12
    assert one(spark, amounts.parse_amount, "n/a") == 0
    assert one(spark, amounts.parse_amount, "9" * 50) == Decimal("9" * 38)
    assert one(spark, amounts.parse_amount, "-" + "9" * 50) == Decimal("-" + "9" * 38)
    assert one(spark, amounts.parse_long, "99999999999999999999") == 2**63 - 1
    assert one(spark, lambda c: amounts.scale_amount(c, 18), "1234567890123456789") == 123456789
    assert one(spark, lambda c: amounts.scale_amount(c, 6), "5") == 500


def test_exact_ratio(spark):
    rows = [(10**18 + 7, 3 * 10**18 + 1, 10**18), (5, 7, 2), (1, 1, 0)]
    got = spark.createDataFrame([tuple(map(Decimal, r)) for r in rows], "a decimal(38,0), b decimal(38,0), t decimal(38,0)").select(amounts.exact_floor_ratio(F.col("a"), F.col("b"), F.col("t"))).collect()
    assert [r[0] for r in got] == [a * b // t if t else None for a, b, t in rows]


def test_transaction_ids(spark):
    assert one(spark, ids.clean_tx, " ab01 ") == "AB01" and one(spark, ids.clean_tx, "0000") is None


def test_usd_sums_do_not_depend_on_order(spark):
    prices = spark.createDataFrame([("A.B", 1.37)], "asset string, price double")
    rows = spark.createDataFrame([("A.B", Decimal(k * 7919 + 1)) for k in range(500)], "asset string, amount_raw decimal(38,0)")
    totals = {usd_value(rows.repartition(n), prices).agg(F.sum("usd_spot")).first()[0] for n in (1, 3, 7)}
    assert len(totals) == 1


def test_dedupe_is_idempotent(spark):
    rows = spark.createDataFrame(
        [("ETH", "T1", "a", "b", "ETH.ETH", Decimal(5), 0.9), ("ETH", "T1", "a", "b", "ETH.ETH", Decimal(5), 0.97), ("ETH", "T1", "a", "c", "ETH.ETH", Decimal(5), 0.9)],
        "chain string, tx_id string, `from` string, `to` string, asset string, amount_raw decimal(38,0), confidence double",
    )
    once = D.dedupe_transfers(rows)
    assert sorted(r.confidence for r in once.collect()) == [0.9, 0.97]
    assert sorted(map(tuple, D.dedupe_transfers(once).collect())) == sorted(map(tuple, once.collect()))


def test_global_rank(spark):
    ranked = D.global_rank(spark.range(1000).repartition(7), [F.desc("id")]).collect()
    assert all(r["_rank"] == 1000 - r["id"] for r in ranked)


def test_pages(spark):
    rows = spark.range(120).select(F.timestamp_seconds("id").alias("ts"), F.col("id").alias("height_n"), F.col("id").cast("string").alias("uid"))
    page, facts = D.page_actions(rows, "newest", 0, 1)
    assert sorted(r.height_n for r in page.collect()) == list(range(70, 120))
    assert facts.first().asDict() == {"total": 120, "start_page": 0, "has_more": True, "next_offset": 1}


def test_height_ranges(spark):
    rows = spark.createDataFrame([("x", h) for h in (1, 10, 40, 200)], "k string, height long")
    got = sorted((r.start_height, r.end_height) for r in D.merge_height_ranges(rows, ["k"], padding=0, gap=10).collect())
    assert got == [(1, 10), (40, 40), (200, 200)]


def test_components(spark):
    links = [(f"n{k:02}", f"n{k + 1:02}") for k in range(30)] + [("x", "y"), ("z", "z")]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {**{f"n{k:02}": "n00" for k in range(31)}, "x": "x", "y": "x"}


def test_merge_takes_the_greatest_value(spark):
    rows = spark.createDataFrame([("e", "t", "THOR", 5, None, 2.0), ("e", "t", "THOR", 0, None, 3.0)], "edge_id string, tx_id string, source_protocol string, height long, time timestamp, usd_spot double")
    merged = Y.merge_edge_transactions(rows, rows)
    assert [(r.height, r.usd_spot) for r in merged.collect()] == [(5, 3.0)]
    assert sorted(map(tuple, Y.merge_edge_transactions(merged, rows).collect())) == sorted(map(tuple, merged.collect()))


def test_trimmed_amounts(spark):
    got = [one(spark, Y.trimmed_amount, Decimal(v), "decimal(38,0)") for v in (150000000, 100000000, 1)]
    assert got == ["1.5", "1", "0.00000001"]


def test_provider_health(spark):
    rows = [(k, "p", "C", o, f"2024-01-01 00:0{k}:00") for k, o in enumerate(["success", "failure", "cache_hit", "failure", "failure"])]
    log = spark.createDataFrame(rows, "event_id long, provider string, chain string, outcome string, t string").withColumn("time", F.col("t").cast("timestamp"))
    at = lambda now: H.provider_health(log, now).first()
    assert (at("2024-01-01 00:06:00").consecutive_failures, at("2024-01-01 00:06:00").degraded, at("2024-01-01 00:30:00").degraded) == (3, True, False)


LINKS = "height long, tx_id string, node_address string, old_bond_address string, new_bond_address string"


def test_rebond_chain(spark):
    links = spark.createDataFrame([(3, "C", "n", "w3", "w2"), (1, "A", "n", "w1", "w2"), (1, "B", "n", "w1", "w9"), (2, "D", "n", "x1", "x2"), (5, "E", "n", "w3", "w3"), (6, None, None, None, "w1")], LINKS)
    starts = spark.createDataFrame([("w2",), ("w2",), ("x1",), ("none",), (None,)], "address string")
    got = [(r.start, r.height, r.tx_id) for r in H.rebond_chain(links, starts).collect()]
    assert got == [("w2", 1, "A"), ("w2", 1, "B"), ("w2", 3, "C"), ("x1", 2, "D")]
    assert H.rebond_chain(links.limit(0), starts).count() == 0


def test_replace_rebond_links(spark):
    stored = spark.createDataFrame([(1, "A", "n", "a", "b"), (2, "B", "n", "b", "c"), (3, None, "n", "c", "d"), (4, "C", "n", "d", "e")], LINKS)
    fresh = spark.createDataFrame([(1, "A", "m", "a", "b"), (1, "A", "m", "a", "b"), (4, "C", "n", "d", "e")], LINKS)
    again = spark.createDataFrame([("A",), ("B",)], "tx_id string")
    got = sorted((r.height, r.tx_id, r.node_address) for r in H.replace_rebond_links(stored, fresh, again).collect())
    assert got == [(1, "A", "m"), (3, None, "n"), (4, "C", "n")]
