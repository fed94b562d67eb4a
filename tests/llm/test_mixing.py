import hashlib
import re

import pytest
from pyspark.sql import functions as F

from valuetide.llm.mixing import mix_report, mix_sources, slot_point, targets, word_count

from .helpers import docs_frame, odd_docs, prose


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: 3.0 * sizes[s] for s in stopped} | share
        stopped |= set(over)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 60, None: 1000}, {"x": 7}, {"a": 0, "b": 10}, {"é": 4, "z": 900, "A": 30, "b": 2, None: 0}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_points_are_spread(spark):
    points = sorted(r[0] for r in spark.range(1000).select(slot_point(F.col("id"))).collect())
    assert max(b - a for a, b in zip(points, points[1:])) < 0.004
    far = spark.range(1).select(slot_point(F.lit(10**12 + 7))).first()[0]
    assert abs(far - ((10**12 + 7) * 11400714819323198485 % 2**64) / 2**64) < 1e-3


def test_report_and_schedule(spark):
    rows = [(k, prose(k, 5 + 37 * k % 300), "en", f"s{k % 4}" if k % 2 else "big") for k in range(300)] + odd_docs()
    docs = docs_frame(spark, rows)
    known, pieces = mix_sources(docs, block=64)
    report = mix_report(docs, block=64).collect()
    assert len(report) == len(rows)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = plain_targets(sizes)
    taken = {}
    by_key = {}
    for doc_id, t, _, s in rows:
        by_key.setdefault((doc_id, words(t)), s)
    for r in report:
        s = by_key[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(want[s] - 1.001 <= taken[s] <= want[s] + 1e-6 for s in want)
    # every slot takes at most a block, and slots of one source follow each other
    slots = pieces.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("words").alias("n"), F.countDistinct("row").alias("d")).collect()
    assert slots and max(r.n for r in slots) <= 64
    again = mix_report(docs.repartition(7), block=64).collect()
    assert sorted(map(tuple, report), key=str) == sorted(map(tuple, again), key=str)
    order = sorted((hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], r.doc_id) for r in report if r.doc_id is not None)
    assert len(order) == len([r for r in rows if r[0] is not None])


def test_empty(spark):
    assert mix_report(docs_frame(spark, [])).count() == 0
    assert [tuple(r) for r in mix_report(docs_frame(spark, [(1, None, "en", None)])).collect()] == [(1, 0, 0, 0.0, 0)]
    assert spark.createDataFrame([(" a\tb c ",)], "t string").select(word_count(F.col("t"))).first()[0] == 2
