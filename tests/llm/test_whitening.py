import math

import numpy as np
import pytest

from valuetide.llm import whitening
from valuetide.llm.whitening import directions, squared_singular_values, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, dims int, x int, n int, component int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], SCHEMA)


def plain(rows, count=4):
    """(vec_id, component) -> values, by numpy's symmetric eigensolver; one length of vectors."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in good:
        for k in range(min(count, len(sums))):
            y = float((np.array(x) - np.array(sums) / n) @ vectors[:, k]) / math.sqrt(values[k])
            out.append((i, k + 1, n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), y, values[k] / values.sum()))
    return out


def sample(n=300, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    spread = np.diag(2.0 ** -np.arange(dims)) + 0.05 * rng.standard_normal((dims, dims))
    return [(k, [float(np.float32(c)) for c in rng.standard_normal(dims) @ spread]) for k in range(n)]


def compare(got, want):
    got, want = sorted(got, key=lambda r: (r[0], r[1])), sorted(want, key=lambda r: (r[0], r[1]))
    assert [tuple(r[:4]) for r in got] == [tuple(r[:4]) for r in want]
    for k in range(1, 5):
        mine, other = np.array([r[4] for r in got if r[1] == k]), np.array([r[4] for r in want if r[1] == k])
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-9
    assert max(abs(a[5] - b[5]) for a, b in zip(got, want)) < 1e-12
    assert len({r[6] for r in got}) == 1 and 0 <= got[0][6] < 1e-9


def test_against_a_dense_solver(spark):
    rows = sample()
    odd = [(1000, None), (1001, [None] + [1.0] * 11), (1002, [float("nan")] * 12), (1003, [float("-inf")] + [0.0] * 11), (1004, [])]
    repeated = [(2000 + k, rows[0][1]) for k in range(150)]
    compare([tuple(r) for r in whiten(frame(spark, rows + odd + repeated).repartition(5)).collect()], plain(rows + repeated))


def test_many_tasks_merge_to_one_triangle(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE", 3)
    rows = sample(200, 6)
    compare([tuple(r) for r in whiten(frame(spark, rows).repartition(17)).collect()], plain(rows))


def test_lengths_are_fitted_apart(spark):
    rows, short = sample(60, 9), [(500 + k, v) for k, v in sample(40, 2, seed=4)]
    got = [tuple(r) for r in whiten(frame(spark, rows + short)).collect()]
    compare([r for r in got if r[0] < 500], plain(rows))
    assert sorted({r[1] for r in got if r[0] >= 500}) == [1, 2]


def test_nothing_varies_and_empty(spark):
    got = sorted(tuple(r) for r in whiten(frame(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect())
    assert got == [(1, 1, 1, 0, None, None, None), (1, 2, 1, 0, None, None, None), (2, 1, 1, 0, None, None, None), (2, 2, 1, 0, None, None, None)]
    assert whiten(frame(spark, [])).count() == 0 and whiten(frame(spark, [(1, None)])).columns[0] == "vec_id"
    line = whiten(frame(spark, [(None, [0.0, 3.0]), (7, [0.0, 1.0])])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in line if r.component == 1)


def test_huge_entries_have_a_result(spark):
    got = whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(got) == 6 and all(r.deviation is None or r.deviation >= 0 for r in got) and any(r.deviation is None for r in got)


@pytest.mark.parametrize("kind", ["plain", "short", "equal", "copied", "blank", "cluster", "graded"])
def test_directions(kind):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((20 if kind == "short" else 90, 33))
    if kind == "equal":
        m = np.vstack([np.eye(33) * 2] * 3)
    if kind == "copied":
        m[:, 9] = m[:, 4]
    if kind == "blank":
        m[:, [0, 7, 32]] = 0
    if kind in ("cluster", "graded"):
        u, _, vt = np.linalg.svd(m, full_matrices=False)
        m = (u * (np.r_[1 + 1e-11 * np.arange(5), np.full(28, 0.5)] if kind == "cluster" else 10.0 ** -np.arange(33))) @ vt
    values, vectors, trace = directions(np.linalg.qr(m, mode="r"), 4)
    want = np.linalg.svd(m, compute_uv=False) ** 2
    assert np.allclose(values, want[:4], rtol=1e-12, atol=1e-13) and abs(trace - want.sum()) < 1e-12 * want.sum()
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13
    assert np.abs(m.T @ (m @ vectors) - vectors * values).max() < 1e-12 * want[0]


def test_small_singular_values_are_accurate():
    a, b = 10.0 ** -np.arange(12), 0.5 * 10.0 ** -np.arange(11)
    got = np.sqrt(squared_singular_values(a, b))
    assert abs(np.prod(got) / np.prod(a) - 1) < 1e-12  # the product of all is the product of the diagonal, to relative precision
