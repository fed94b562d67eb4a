"""Steps whose rows and columns must not grow faster than the tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from valuetide import session
from valuetide.catalog import views as V
from valuetide.operators import stitch as T

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture
def tables(spark, tmp_path):
    """Orders of every kind, one of them twice, one without a key; a line without a part, one without a number, one twice."""
    kinds = [(p, s) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for s in "FOP"]
    orders = [(k, k * 5 % 43, kinds[k % 15][1], 50000.0, kinds[k % 15][0]) for k in range(90)] + [(12, 6, "F", 50000.0, "4-NOT SPECIFIED"), (15, 8, "F", 1.0, "4-NOT SPECIFIED"), (None, 3, "F", 9.0, "1-URGENT"), (700, None, None, None, None)]
    lines = [(k, k % 7 if k != 33 else 99, k % 5, n, 1.0, 10.5 * n + k, 0.0, 0.01 * (n + k % 3), "RAN"[k % 3], "OF"[n % 2], None) for k in range(80) for n in range(1, 4) if (k + n) % 9]
    lines += [lines[40], (None, 1, 1, 1, 1.0, 2.0, 0.0, 0.0, "R", "O", None), (12, 3, None, None, 1.0, None, 0.0, None, None, None, None)]
    made = {
        "orders": spark.createDataFrame(orders, ORDERS), "lineitem": spark.createDataFrame(lines, LINES),
        "part": spark.createDataFrame([(i, f"p{i}", f"Brand#1{i % 2}", "PROMO" if i % 3 else "STD", i, 1.0 + i) for i in range(7)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": spark.createDataFrame([(i, f"s{i}", 0, 1000.0) for i in range(5)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    for name in V.BASE_TABLES:
        made.get(name, spark.range(1)).write.parquet(f"{tmp_path}/{name}.parquet")
    yield str(tmp_path)
    session.forget_landed()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_legs_gathered_by_group_are_the_legs_of_the_view(spark, tables):
    """Also where an order comes twice or has no key; no leg is moved, only orders and lines are."""
    found = V.actions_with_legs(spark, tables)
    got = sorted(
        ((str(r.action_id), side, leg.n, leg.address, leg.txID, str([tuple(c) for c in leg.coins]))
        for r in found.select("action_id", "in", "out").distinct().collect() for side in ("in", "out") for leg in r[side] or ()), key=str
    )
    rows = V.view(spark, tables, "v_leg").where("action_id IS NOT NULL").collect()
    assert got == sorted(((str(r.action_id), r.side, r.n, r.address, r.tx, str([] if r.asset == "" else [(r.amount, r.asset)])) for r in rows), key=str)
    assert found.count() == 94 and found.where("action_id IS NULL AND in IS NULL").count() == 1
    dealt = [line for line in _plan(found).splitlines() if re.search(r"Exchange (hash|Round)", line)]
    assert len(dealt) <= 5 and not any("txID" in line for line in dealt)


def test_only_named_columns_of_prepared_actions_are_derived_and_landed(spark, tables, monkeypatch):
    written = []
    write = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: written.append(df) or write(df))
    whole = V.prepared_actions(spark, tables)
    few = V.prepared_actions(spark, tables, ("action_id", "uid", "ts"))
    assert few.columns == ["action_id", "uid", "ts"] == written[-1].columns and "payout_address" in whole.columns
    assert "regexp_extract_all" not in written[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, few.collect())) == sorted(map(str, whole.select(few.columns).collect()))


@pytest.mark.parametrize("name", ["page_actions_oldest", "fee_suppression", "project_contract_traces"])
def test_queries_land_no_wide_actions(spark, tables, monkeypatch, name):
    from valuetide.catalog import load

    named = []
    land = V.land_once
    monkeypatch.setattr(V, "land_once", lambda spark, name, build: named.append(name) or land(spark, name, build))
    load()[0][name](spark, tables)
    assert f"prepared  {tables}" not in named and not any(n.startswith("v_transfer") for n in named)


def test_keys_are_derived_once_per_action(spark, tables):
    """Actions are kept by what identifies them, and the key is a column before other columns read it."""
    from valuetide.operators.project import prepare_actions

    rows = V.ledger_actions(spark, tables).withColumn("date", F.when(F.col("action_id") != 700, F.col("date"))).withColumn("height", F.when(F.col("action_id") % 3 > 0, F.col("height")))
    found = prepare_actions(rows)
    plan = found.select("uid", "fallback_tx", "trace_tx")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS uid#") == 1 and plan.count("concat_ws(|") == 1
    from valuetide.functions import actions as act

    assert found.count() == rows.where(act.action_key().isNotNull()).count() and found.where("uid IS NULL").count() == 0


def test_traced_movements_are_joined_once(spark, tables, monkeypatch):
    """What is seen of the called txs is written, so that picks and leaves do not join the trace again."""
    written = []
    write = T.cut_lineage
    monkeypatch.setattr(T, "cut_lineage", lambda df: written.append(_plan(df)) or write(df))
    actions = V.prepared_actions(spark, tables)
    found = T.trace_select_transfers(actions, V.trace(spark, tables))
    assert len(written) == 1 and "LeftSemi" in written[0] and "Join" not in _plan(found)


def test_landed_rows_are_remembered_on_disk(spark, tmp_path):
    """State is no map on the heap; a store that the session names stays in use, and its setting as it was."""
    from valuetide.streaming import ingest as I

    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, n int")
    rows.write.parquet(f"{tmp_path}/source")
    for _ in range(2):
        stream = I._fresh(I.file_stream(spark, f"{tmp_path}/source", rows.schema), [F.col("key"), F.col("n")], I.HORIZON)
        I.stream_ingest(stream, f"{tmp_path}/landed", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/landed").select("key", "n").collect())) == [("a", 1), ("b", 2)]
    state = [p.suffix for p in (tmp_path / "checkpoint" / "state").rglob("*") if p.is_file()]
    assert ".delta" not in state and ".zip" in state
    assert spark.conf.get(I.STORE, None) is None


@pytest.mark.parametrize(("name", "column", "value"), [("page_actions_oldest", "source_protocol", "MAYA"), ("project_contract_traces", "type", "contract")])
def test_only_actions_that_a_query_asks_for_are_named_and_landed(spark, tables, monkeypatch, name, column, value):
    """The first table written holds these alone, whole and with all their legs; the condition is judged before legs are made."""
    from valuetide.catalog import load

    whole = sorted(map(str, V.ledger_actions(spark, tables).where(F.col(column) == value).collect()))
    written = []
    write = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: written.append(df) or write(df))
    load()[0][name](spark, tables)
    assert len(whole) > 3 and sorted(map(str, written[0].collect())) == whole
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any(line.lstrip(" :+-").startswith("Filter") and "transform" not in line for line in plan[: next(i for i, line in enumerate(plan) if "Generate explode" in line)])


def test_traces_of_calls_alone_are_the_traces_of_all_actions(spark, tables):
    from valuetide.catalog import load
    from valuetide.catalog.movement import _separate
    from valuetide.operators.project import project_contract_traces

    rows = project_contract_traces(_separate(V.prepared_actions(spark, tables)), V.trace(spark, tables))
    every = rows.select("uid", F.col("src_raw").alias("src"), F.col("dst_raw").alias("dst"), "src_role", "dst_role", "asset", F.col("_amount").alias("amount"), "confidence")
    assert sorted(map(str, load()[0]["project_contract_traces"](spark, tables).collect())) == sorted(map(str, every.collect()))


def test_legs_and_lines_are_sorted_by_their_own_order(spark, tables):
    """No comparison is interpreted for each pair of elements."""
    plan = V.actions_with_legs(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


@pytest.mark.parametrize(("name", "wide"), [("project_contracts", "provider_address"), ("lookup_by_tx", "payout_address"), ("shadow_send_antijoin", "payout_address")])
def test_queries_land_the_actions_and_columns_that_they_read(spark, tables, monkeypatch, name, wide):
    from valuetide.catalog import load

    from valuetide.catalog import movement

    written = []
    write = session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: written.append(df) or write(df))
    monkeypatch.setattr(movement, "_report", lambda spark, sf, raw, actions: raw)
    session.forget_landed()
    load()[0][name](spark, tables)
    prepared = [df for df in written if "uid" in df.columns or "action_class" in df.columns]
    assert prepared and not [df for df in prepared if wide in df.columns]
    if name == "project_contracts":
        assert {r.type for r in prepared[0].select("type").distinct().collect()} == {"contract"}
