"""The explorer, page merging, streaming stores and labels on hand-made rows."""

import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from valuetide.operators import order as D
from valuetide.operators import visible as Y
from valuetide.plans import explorer as E
from valuetide.sources.readers import import_actor_lines
from valuetide.streaming import ingest as T
from valuetide.streaming import upsert as U

NODE = "page int, position int, id string, kind string, chain string, address string, pool string, label string, depth int, actor_ids array<bigint>, shared boolean, collapsed boolean"
EDGE = "page int, edge_id string, from_id string, to_id string, action_class string, action_key string, validator_address string, confidence double"
TX = "page int, edge_id string, tx_id string, source_protocol string, height long, time timestamp, usd_spot decimal(38,10)"
PAGE = "page int, loaded_actions long, has_more boolean, next_offset long, total_estimate long"


def node(page, position, id_, kind, chain=None, address=None, pool=None, depth=1, actors=(), collapsed=True):
    return (page, position, id_, kind, chain, address, pool, f"label {id_}", depth, list(actors), False, collapsed)


def test_pages_merge_into_targets(spark):
    nodes = spark.createDataFrame(
        [
            node(0, 0, "t", "explorer_target", "eth", "0xAB", depth=0), node(0, 1, "x", "external_address", "BTC", "bc1q"), node(0, 2, "p", "pool", None, None, "BTC.BTC"), node(0, 3, "a", "actor", actors=[7]),
            node(1, 0, "t1", "external_address", "ETH", "0xab", actors=[3], collapsed=False), node(1, 1, "x1", "external_address", " btc", "BC1Q", depth=3), node(1, 2, "p1", "pool", None, None, "btc.btc"), node(1, 3, "a1", "actor", actors=[7]), node(1, 4, "y", "external_address", "BTC", "0xab"),
            node(2, 0, "x1", "external_address", "LTC", "ltc1"),
        ],
        NODE,
    )
    edges = spark.createDataFrame(
        [(0, "e", "x", "t", "transfers", "tracker", None, 0.5), (1, "e", "x1", "t1", "transfers", "tracker", None, 0.9), (1, "r1", "x", "p1", "bonds", "do.rebond", "v1", 0.9), (0, "r2", "x", "p", "bonds", "do.rebond", "v2", 0.9), (2, "e", "ghost", "t", "transfers", None, None, 0.1)], EDGE
    )
    txs = spark.createDataFrame([(0, "e", "T1", "THOR", 5, None, Decimal(10)), (1, "e", "T1", "THOR", 4, None, Decimal(10)), (1, "e", "T2", "THOR", 0, None, Decimal(1)), (1, "e", "T2", "MAYA", 0, None, Decimal(2))], TX)
    pages = spark.createDataFrame([(0, 50, True, 1, None), (1, 50, True, 2, 90), (1, 50, True, 2, 90), (2, 7, False, None, None)], PAGE)
    merged, links, kept, facts = E.merge_explorer_pages(nodes, edges, txs, pages)
    got = {r.id: r for r in merged.collect()}
    assert set(got) == {"t", "x", "p", "a", "y"}  # x1 stands for two keys, so both are x
    assert (got["t"].kind, got["t"].depth, got["t"].actor_ids, got["t"].collapsed) == ("explorer_target", 0, [3], False)
    named = {r.edge_id: r for r in links.collect()}
    assert set(named) == {"x|t|tracker", "x|p|do.rebond|validator:v1", "x|p|do.rebond|validator:v2", "ghost|t|transfers"}
    assert named["x|t|tracker"].usd_spot == 13 and named["x|t|tracker"].confidence == 0.9 and kept.count() == 3
    assert tuple(facts.first()) == (107, False, 2, 90)


def legs(*pairs):
    return [(a, c, None, None, []) for a, c in pairs]


LEG = "array<struct<address:string,chain:string,txID:string,tx:string,coins:array<struct<amount:string,asset:string>>>>"


def test_preview_counts(spark):
    actions = spark.createDataFrame([("a1", legs(("s1", "ETH")), legs(("s1", "ETH"), ("z", "BTC"))), ("a2", legs(("s2", "BTC")), []), ("a1", legs(("s1", "BTC")), [])], f"uid string, `in` {LEG}, `out` {LEG}")
    transfers = spark.createDataFrame([("eth", "s1", "s1"), ("LTC", "s1", "q"), ("ETH", "q", "s2")], "chain string, `from` string, `to` string")
    seeds = spark.createDataFrame([("s1", "eth"), ("s1", "BTC"), ("s1", "DOGE"), ("s2", "ETH"), ("s3", "ETH"), (None, "ETH"), ("s1", "ETH ")], "address string, chain string")
    summary, runs = E.explorer_preview(actions, transfers, seeds, "oldest")
    assert sorted(tuple(r) for r in summary.collect()) == [("s1", "BTC", 1, 0, True), ("s1", "DOGE", 0, 0, False), ("s1", "ETH", 1, 1, True), ("s2", "ETH", 1, 1, True), ("s3", "ETH", 0, 0, False)]
    assert {r.address: r.run_label for r in runs.collect()} == {"s1": "s1 | BTC/ETH | oldest", "s2": "s2 | ETH | oldest", "s3": "s3 | No active chains | oldest"}
    assert E.explorer_preview(None, None, seeds)[0].where("active").count() == 0


def test_actor_lines_are_trimmed(spark):
    lines = spark.createDataFrame([(1, " 0xabc0 , eth, 0 my, label0 "), (2, "My Wallet"), (3, "0XABC0"), (4, " "), (5, "both"), (6, "bc1q,some label")], "line_no int, line string")
    notes = spark.createDataFrame([("thor1w", "label", " my wallet"), ("a", "label", "both"), ("b", "label", "Both"), ("c", "note", "bc1q")], "normalized_address string, kind string, value string")
    good, bad = import_actor_lines(lines, notes)
    assert sorted(tuple(r) for r in good.collect()) == [("0xabc0", "ETH", "0 my, label0", 1), ("bc1q", None, "some label", 6), ("thor1w", None, " my wallet", 2)]
    assert sorted(r.line_no for r in bad.collect()) == [3, 5]


def test_labels(spark):
    rows = [("flow", ["swap"], 1, 1, 1, 0, None), ("flow", ["rebond", "swap", "transfer"], 3, 9, 3, 0, None), ("flow", ["bond_unbond"], 1, 5, 2, 1, "Node A"), ("flow", [], 1, 1, 1, 2, "v"), ("ownership", [], 1, 0, 1, 0, None)]
    df = spark.createDataFrame(rows, "edge_kind string, buckets array<string>, classes long, tx_count long, raw_edges long, validators long, validator string")
    assert [r.label for r in Y.edge_labels(df).collect()] == ["Swap", "Rebond + Swap +1 more (9 txns)", "Bond / Unbond (5 txns) via Node A", "Transactions via 2 validators", ""]


def test_positions_follow_the_sort(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(7)
    got = {r.k: r.p for r in D.sorted_position(df.orderBy("k"), "p").collect()}
    assert got == {k: k + 1 for k in range(1000)}


MOVE = "chain string, asset string, amount_raw decimal(38,0), `from` string, `to` string, tx_id string, height long, time timestamp, confidence double, source_rank int"


def test_landing_survives_restarts_repeats_and_late_files(spark, tmp_path):
    def move(i, confidence=0.9, rank=1):
        return ("ETH", "ETH.ETH", Decimal(i), f"a{i}", "b", f"t{i}", i, None, confidence, rank)

    source, target, checkpoint = (f"file://{tmp_path}/{n}" for n in ("source", "landed", "checkpoint"))

    def land(*rows):
        spark.createDataFrame(rows, MOVE).write.mode("append").parquet(source)
        T.stream_ingest(T.fresh_transfers(T.file_stream(spark, source, spark.createDataFrame([], MOVE).schema)), target, checkpoint).awaitTermination()

    land(*[move(i) for i in range(20)], move(3))
    land(*[move(i) for i in range(10, 30)], move(5, 0.95, 2), move(6, 0.5, 2))
    land(*[move(i) for i in range(30)])
    assert spark.read.parquet(target).count() == 32
    best = {r.tx_id: (r.confidence, r.source_rank) for r in T.landed_transfers(spark, target).collect()}
    assert len(best) == 30 and best["T5"] == (0.95, 2) and best["T6"] == (0.9, 1)


@pytest.mark.parametrize("fold_every", [0, 1, 2])
def test_edge_store_under_replays(spark, tmp_path, fold_every):
    schema = "edge_id string, tx_id string, source_protocol string, height long, time timestamp, usd_spot decimal(38,10)"
    batches = [[(f"e{i % 3}", f"t{(i * b) % 7}", "THOR", i - 2, None, Decimal(i * b)) for i in range(12)] for b in range(1, 6)]
    frames = [spark.createDataFrame(rows, schema) for rows in batches]
    target = f"file://{tmp_path}/{uuid.uuid4().hex}"
    for n, df in enumerate(frames):
        U.fold_batch(df, n, target, fold_every)
    for n in (4, 1, 3):  # replays, out of order
        U.fold_batch(frames[n], n, target, fold_every)
    want = sorted(map(tuple, Y.merge_edge_transactions(*frames).collect()))
    assert sorted(map(tuple, U.stored_edge_transactions(spark, target, frames[0].schema).collect())) == want
