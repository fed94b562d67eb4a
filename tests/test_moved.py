"""What shared operators move, and what they give on hand-made rows."""

from pyspark.sql import functions as F

from valuetide.operators import order as D
from valuetide.operators import suppress as X
from valuetide.schemas import CANONICAL_LEG


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_rows_move_with_what_is_read_of_them(spark):
    rows = spark.createDataFrame(
        [("a", 2, "x", "w1"), ("a", 1, "y", "w2"), ("a", None, "n", "w3"), (None, 5, "z", "w4"), (None, 4, "q", "w5"), ("b", 1, "v", "w6")], "k string, o int, v string, wide string"
    )
    best = D.keep_best(rows, [F.col("k").alias("_key")], F.struct("o"))
    assert best.columns == rows.columns
    assert sorted(map(str, best.collect())) == sorted(map(str, rows.where("v IN ('n', 'q', 'v')").collect()))
    tied = spark.createDataFrame([("a", 1, n) for n in range(9)], "k string, o int, n int").coalesce(1)
    assert [r.n for smallest in (True, False) for r in D.keep_best(tied, ["k"], F.struct("o"), smallest).collect()] == [8, 8]
    largest = D.keep_best(rows, ["k"], F.struct("o"), smallest=False)
    assert sorted(r.v for r in largest.collect()) == ["v", "x", "z"]
    plan = _plan(D.keep_best(D.cut_lineage(rows), [F.col("k").alias("_key")], F.struct("o")).select("k", "v"))
    assert "wide" not in plan and "min_by" not in plan
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")  # before and after the move


def _actions(spark):
    coins = "array(named_struct('amount', '1', 'asset', 'BTC.BTC'))"
    leg = lambda to: f"array(named_struct('address', '{to}', 'chain', 'BTC', 'txID', 'T', 'tx', 'T', 'coins', {coins}))"
    none = f"CAST(array() AS array<{CANONICAL_LEG}>)"
    rows = [
        (1, "swap", "swaps", "5", "9", leg("a"), leg("b")),
        (2, "send", "transfers", "5", "9", leg("a"), leg("b")),  # the swap's shadow
        (3, "send", "transfers", "6", "9", leg("a"), leg("b")),  # of another height
        (4, "send", "transfers", "", "9", leg("a"), leg("b")),  # a blank height matches
        (5, "Send ", "transfers", "5", "", none, leg("b")),  # no in leg, blank date
        (6, "send", "transfers", "5", "9", leg("c"), leg("b")),  # another in leg
        (7, "send", "transfers", "5", "9", leg("a"), leg("d")),  # another out leg
        (8, "bond", "bonds", "", "", none, leg("e")),
        (9, "send", "transfers", "7", "7", leg("z"), leg("e")),  # shadow of an undated one
        (10, None, "transfers", "5", "9", leg("a"), leg("b")),  # no send
        (11, "swap", "swaps", "5", "9", leg("a"), leg("f")),
    ]
    parts = [
        f"SELECT {n}L AS action_id, {'CAST(NULL AS STRING)' if t is None else repr(t)} AS type, '{c}' AS action_class, '{h}' AS height, '{d}' AS date, {i} AS `in`, {o} AS `out`, 'u{n}' AS uid, CAST(NULL AS TIMESTAMP) AS ts, {n}L AS height_n"
        for n, t, c, h, d, i, o in rows
    ]
    return spark.sql(" UNION ALL ".join(parts))


def test_only_what_shares_a_leg_with_a_send_is_compared(spark, monkeypatch):
    actions, written, real = _actions(spark), [], X.cut_lineage
    monkeypatch.setattr(X, "cut_lineage", lambda df: written.append(df) or real(df))
    kept = X.shadow_send_antijoin(actions)
    assert sorted(r.action_id for r in kept.collect()) == [1, 3, 6, 7, 8, 10, 11]
    assert kept.columns == actions.columns
    sends, others = written
    assert sends.count() == 7 and others.count() == 2  # not that of action 11
    assert dict(sends.dtypes)["_send"] == "binary"


def test_looked_up_actions_are_found_once(spark, monkeypatch):
    actions, written, real = _actions(spark), [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    found = D.lookup_by_tx(actions, spark.createDataFrame([(" t ",), ("other",)], "tx_id string"))
    assert written == [["action_id"], actions.columns]
    assert [r.action_id for r in found.collect()] == [11, 10, 8, 7, 6, 3, 1]
    assert D.lookup_by_tx(actions, spark.createDataFrame([("other",)], "tx_id string")).count() == 0


def _rows_of_transactions(spark):
    return spark.createDataFrame([("a|b|x", "t1", "THOR", 3, None, 2), ("a|b|x", "t2", "THOR", None, None, 1), ("a|c|x", "t1", "THOR", 10, None, 5)], "edge_id string, tx_id string, source_protocol string, height long, time timestamp, n int").select(
        "edge_id", "tx_id", "source_protocol", "height", "time", F.col("n").cast("decimal(38,10)").alias("usd_spot")
    )


def test_streamed_transactions_are_derived_once(spark, monkeypatch):
    from valuetide.catalog import load, streams

    derived = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            derived.add(1)
            yield r

    plain = _rows_of_transactions(spark)
    monkeypatch.setattr(streams, "_txs", lambda spark, sf: spark.createDataFrame(plain.rdd.mapPartitions(counted), plain.schema))
    found = load()[0]["stream_edge_upsert"](spark, "none")
    assert sorted(map(tuple, found.collect())) == [("a|b|x", "t1", 2.0, 3), ("a|b|x", "t2", 2.0, -1), ("a|c|x", "t1", 10.0, 10)]
    assert derived.value == 3


def test_positions_are_written_with_ids_alone(spark, monkeypatch):
    from valuetide.catalog import explorer, load

    acts = spark.createDataFrame([("a", "b", "t2", 2), ("a", "c", "t1", 1), ("a", "b", "t1", 1)], "src_key string, dst_key string, tx_id string, n int").withColumn("time", F.timestamp_seconds("n")).withColumn("wide", F.lit("w"))
    edges = spark.createDataFrame([("a|b|x", 5, "w"), ("a|c|x", 7, "w")], "edge_id string, usd_spot int, wide string")
    monkeypatch.setattr(explorer, "segments", lambda spark, sf: acts)
    monkeypatch.setattr(explorer, "edges", lambda spark, sf: edges)
    monkeypatch.setattr(explorer, "nodes", lambda spark, sf, firsts: acts.selectExpr("1 AS depth", "'s' AS stage", "src_key AS label", "src_key AS key"))
    monkeypatch.setattr(explorer.A, "supporting_actions", lambda rows: rows)
    written, real = [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: written.append(set(df.columns)) or real(df))
    found = load()[0]["sort_outputs"](spark, "none")
    assert written == [{"edge_id", "_id"}, {"tx_id", "edge_id", "_id"}]
    assert sorted(map(tuple, found.collect())) == [("action", "t1 a|b", 1), ("action", "t1 a|c", 2), ("action", "t2 a|b", 3), ("edge", "a|b|x", 2), ("edge", "a|c|x", 1)]
