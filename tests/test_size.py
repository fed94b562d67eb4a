"""Steps that must stay narrow where tables are large."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from valuetide.operators import aggregate as A


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _before_exchange(plan: str) -> list[str]:
    """Sorted or object aggregations that read rows which no exchange has dealt yet."""
    lines = [line for line in plan.splitlines() if re.search(r"(Aggregate|Exchange)\b", line)]
    last = max((i for i, line in enumerate(lines) if "Exchange" in line), default=-1)
    return [line for line in lines[last + 1 :] if "SortAggregate" in line or "ObjectHashAggregate" in line]


def _segments(spark):
    """Node n has two chains and, first, no label; m has a label on its later sighting only; no key is blank but one."""
    rows = [
        (2, "n", "m", "x", "C1", "C2", "L1", None, [1], []), (1, "n", "m", "x", "C3", "C2", None, None, [2, 3], []),
        (3, "m", "n", "x", "C2", "C4", "LM", "L9", [], [1]), (4, None, "o", "x", None, "C5", None, "LO", [], []), (5, "p", "p", "x", "C6", "C7", "a", "b", [4], [4]),
    ]
    raw = spark.createDataFrame(rows, "at int, src_key string, dst_key string, tx_id string, src_chain string, dst_chain string, src_label string, dst_label string, src_actor_ids array<bigint>, dst_actor_ids array<bigint>")
    ends = {f"{s}_{n}": v for s in ("src", "dst") for n, v in (("id", F.col(f"{s}_key")), ("kind", F.lit("address")), ("stage", F.lit("external")), ("address", F.col(f"{s}_key")), ("depth", F.col("at") % 3), ("shared", F.size(f"{s}_actor_ids") > 1))}
    none = F.lit(None).cast("string")
    more = {c: none for c in ("action_domain", "validator_address", "validator_label", "contract_type", "contract_protocol")}
    return raw.withColumns(
        ends | more | {
            "ord": F.struct("at"), "source_protocol": F.when(F.col("at") > 2, "MAYA").otherwise("THOR"), "action_class": F.lit("transfers"), "action_key": F.lit("k"), "action_label": F.lit("K"),
            "confidence": F.col("at") / 10, "actor_ids": F.concat("src_actor_ids", "dst_actor_ids"), "asset": F.lit("A"), "amount_raw": F.lit(1).cast("decimal(38,0)"),
            "usd_spot": F.col("at").cast("decimal(38,10)"), "height": F.col("at").cast("long"), "time": F.lit(None).cast("timestamp"),
            **{c: none for c in ("swap_in_asset", "swap_out_asset")}, **{c: F.lit(None).cast("decimal(38,0)") for c in ("swap_in_amount", "swap_out_amount")},
        }
    )


@pytest.mark.parametrize("firsts", [("kind", "address"), ("chain", "label"), A.FIRSTS])
def test_nodes_folded_by_hash_are_the_nodes(spark, firsts):
    """Also where ends of a node do not agree, or a first value is null."""
    whole = A.build_nodes(_segments(spark))
    folded = A.build_nodes(_segments(spark), firsts)
    columns = ["key", *firsts, "depth", "actor_ids", "shared", "out_edges", "in_edges", "source_protocols"]
    assert folded.columns == columns
    assert sorted(map(str, folded.collect())) == sorted(map(str, whole.select(*columns).collect()))
    assert folded.dtypes == whole.select(*columns).dtypes


def test_ends_of_a_node_are_not_sorted_before_they_are_folded(spark, monkeypatch):
    plans = []
    write = A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: plans.append(_plan(df)) or write(df))
    A.build_nodes(_segments(spark), ("kind", "address"))
    assert len(plans) == 1 and "HashAggregate" in plans[0] and _before_exchange(plans[0]) == []


def test_edges_and_actions_are_dealt_before_they_are_sorted(spark):
    """Each row is sorted once, and moved with one copy of its order."""
    rows = _segments(spark)
    for found in (A.build_edges(rows, A.edge_tx_assets(rows)).select("edge_id", "from_key", "confidence"), A.supporting_actions(rows).select("edge_id", "primary_asset")):
        assert _before_exchange(_plan(found)) == []
    edges = {r.edge_id: (r.from_key, r.confidence, r.tx_count, r.action_label) for r in A.build_edges(rows, A.edge_tx_assets(rows)).collect()}
    assert edges["n|m|k"] == ("n", 0.1, 1, "K") and len(edges) == 4
    assert sorted((r.edge_id, r.height, int(r.usd_spot)) for r in A.supporting_actions(rows).collect())[1] == ("n|m|k", 1, 3)


def test_graph_stats_read_each_table_once(spark):
    """Protocols are counted in the pass that counts edges; empty tables count 0."""
    nodes = spark.range(5).select(F.when(F.col("id") < 2, "actor").otherwise("address").alias("kind"))
    edges = spark.range(3).select(F.when(F.col("id") == 0, F.array(F.lit("THOR"))).when(F.col("id") == 1, F.array(F.lit("MAYA"), F.lit("THOR"))).alias("source_protocols"))
    found = A.graph_stats(nodes, edges, spark.range(7))
    assert [_plan(found).count(f"Range (0, {n}") for n in (5, 3, 7)] == [1, 1, 1]
    assert [tuple(r) for r in found.collect()] == [(2, 5, 3, 7, 2)]
    assert [tuple(r) for r in A.graph_stats(nodes.limit(0), edges.limit(0), spark.range(0)).collect()] == [(0, 0, 0, 0, 0)]


def test_pages_are_written_before_they_are_merged(spark, monkeypatch):
    """Nodes, edges and transactions of the pages read narrow rows; the segments are derived once."""
    from valuetide.catalog import explorer as X

    got = []
    merge = X.E.merge_explorer_pages
    monkeypatch.setattr(X, "segments", lambda spark, sf: _segments(spark).withColumns({"src_key": F.concat(F.lit("cust"), F.col("at")), "dst_key": F.concat(F.lit("supp"), F.col("at"))}))
    monkeypatch.setattr(X.E, "merge_explorer_pages", lambda *tables: got.extend(_plan(t) for t in tables[:3]) or merge(*tables))
    from valuetide.catalog import load

    rows = load()[0]["merge_explorer_pages"](spark, "none").collect()
    assert len(got) == 3 and all("FileScan parquet" in plan and "ExistingRDD" not in plan for plan in got)
    assert sorted((r.from_id, r.to_id, r.usd_spot) for r in rows)[4] == ("A:cust5:0", "A:supp5:0", 5.0)


def test_chains_and_assets_of_unknown_and_finished_names(spark):
    """Unknown formats are judged by one pattern, finished names are not rewritten; results stay."""
    from valuetide.functions.addresses import ANY_CHAIN_PATTERN, infer_chain
    from valuetide.functions.assets import normalize_asset

    rows = [("eth", "0x" + "aB" * 20), (None, "0x" + "12" * 20), ("sol", "So1abc"), (" ", "So1abc"), ("x", "THOR1a"), ("x", " Tabc"), ("x", None), ("x", "rAb"), ("x", "Rab")]
    df = spark.createDataFrame(rows, "hint string, address string")
    assert [r[0] for r in df.select(infer_chain("hint", "address")).collect()] == ["ETH", "ETH", "SOL", None, "THOR", "TRON", "X", "XRP", "X"]
    assert ANY_CHAIN_PATTERN in df.select(infer_chain("hint", "address"))._jdf.queryExecution().analyzed().toString()
    names = ["x/", "X/ btc-btc", "eth.usdc-0x1", "btc-btc", "rune", "x/ruji", "x/a.b", None, " ", "lx.a-b"]
    found = spark.createDataFrame([(n,) for n in names], "n string").select(normalize_asset("n")).collect()
    assert [r[0] for r in found] == [None, "BTC.BTC", "ETH.USDC-0X1", "BTC.BTC", "THOR.RUNE", "THOR.RUJI", "X/A.B", None, None, "LX.A-B"]
