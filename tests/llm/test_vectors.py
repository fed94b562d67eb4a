import math
from collections import Counter

import numpy as np

from valuetide.llm import embedding_dedup
from valuetide.llm.embedding_dedup import similar_vectors, window_for

SCHEMA = "vec_id long, embedding array<float>, label int, task long, side int, root long"


def plain(rows):
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = {i: i for i, *_ in rows}
    count = Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and i != j and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                count[i] += 1
                count[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((i, count[i], find(i), find(i) == i) for i, *_ in rows)


def sample(n=400, dims=24, spread=0.03):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((n // 5, dims))
    rows = []
    for k in range(n):
        v = centres[0 if k % 3 == 0 else k % len(centres)]
        v = v / np.linalg.norm(v) + spread * rng.standard_normal(dims)
        rows.append((k, [float(np.float32(x)) for x in v * (1 + k % 4)], k % 2))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, 1, 1) for i, v, lab in rows], SCHEMA)


def test_against_all_pairs(spark):
    rows = sample()
    bad = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 24, 0), (1003, [float("nan")] + [1.0] * 23, 0), (1004, [None] + [1.0] * 23, 0), (1005, [float("inf")] * 24, 0), (1006, rows[0][1], None), (1007, [1.0, 2.0], 0), (1008, rows[0][1], 0)]
    got = sorted(map(tuple, similar_vectors(frame(spark, rows + bad)).collect()))
    assert got == plain(rows + bad)


def test_chunks_give_the_same(spark, monkeypatch):
    rows = sample(300)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    assert sorted(map(tuple, similar_vectors(frame(spark, rows)).collect())) == plain(rows)


def test_repeated_and_empty(spark):
    rows = sample(20)
    twice = similar_vectors(frame(spark, rows + rows)).collect()
    assert Counter(map(tuple, twice)) == Counter({r: 2 for r in plain(rows)})
    assert similar_vectors(frame(spark, [])).count() == 0
    assert [tuple(r) for r in similar_vectors(frame(spark, [(1, None, 1)])).collect()] == [(1, 0, 1, True)]


def test_window_is_calibrated():
    rng = np.random.default_rng(1)
    w = window_for(0.98, 12, 4, 0.99)
    gaps = np.abs(rng.standard_normal((20000, 12))) * math.sqrt(0.04)
    assert abs(((gaps > w).sum(1) < 4).mean() - 0.99) < 0.005


def test_every_length_is_searched(spark):
    rows = sample(200)
    rare = [(5000 + k, v, lab) for k, v, lab in sample(120, dims=17)] + [(6000 + k, [1.0, 2.0 + k / 1000], 0) for k in range(3)] + [(6010, [3.0], 1), (6011, [9.0], 1), (6012, [-9.0], 1)]
    got = sorted(map(tuple, similar_vectors(frame(spark, rows + rare)).collect()))
    assert got == plain(rows + rare)
    assert sum(n for i, n, *_ in got if i >= 5000) > 10 and dict((i, n) for i, n, *_ in got)[6010] == 1


def test_copies_are_searched_as_one(spark, monkeypatch):
    rows = sample(60)
    copies = [(10_000 + k, rows[0][1], 0) for k in range(300)] + [(20_000 + k, rows[0][1], 1) for k in range(3)] + [(30_000 + k, rows[7][1], None) for k in range(5)]
    seen = []
    assign = embedding_dedup._assign
    monkeypatch.setattr(embedding_dedup, "_assign", lambda *a: seen.append(a) or assign(*a))
    got = sorted(map(tuple, similar_vectors(frame(spark, rows + copies)).collect()))
    assert got == plain(rows + copies) and len(seen) == 1
    assert dict((i, n) for i, n, *_ in got)[10_005] >= 300


def test_one_vector_in_half_of_the_rows(spark):
    rows = [(k, [1.0, 2.0, 3.0], 0) for k in range(20_000)] + [(50_000 + k, [float(k % 97), 1.0, float(k % 89)], 1) for k in range(200)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in similar_vectors(frame(spark, rows)).collect()}
    assert all(got[k] == (19_999, 0, k == 0) for k in range(20_000))
