"""Whitening of vectors: blockwise QR, Householder bidiagonals, dqds singular values, twisted factorisations for directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuetide.llm.common import blocks, stored

COMPONENTS = 4
#: Vector entries become whole steps of 1 / SCALE.
SCALE = 256
#: Triangles that one task merges into one.
MERGE = 16

_EPS = float(np.finfo(np.float64).eps)
_SMALL = (10 * _EPS) ** 2
_WORD = 1 << 32


# --- a bidiagonal matrix's squared singular values and right singular vectors ----------------


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of B = U' R V by Householder reflections from both sides; U is not kept."""
    n = matrix.shape[1]
    r = np.vstack([matrix, np.zeros((max(0, n - len(matrix)), n))])
    v = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        length = np.linalg.norm(x)
        if length == 0 or not np.any(x[1:]):
            return None
        w = x.copy()
        w[0] += np.copysign(length, x[0])
        return w / np.linalg.norm(w)

    for k in range(n):
        w = reflector(r[k:, k])
        if w is not None:
            r[k:, k:] -= 2 * np.outer(w, w @ r[k:, k:])
        if k + 1 < n:
            w = reflector(r[k, k + 1 :])
            if w is not None:
                r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(r).copy(), np.diag(r, 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential quotient-difference step; none if the shift passed the smallest value."""
    d, new_q, new_e, all_d = q[0] - shift, [], [], []
    for i in range(len(e)):
        if d < 0:
            return None
        all_d.append(d)
        total = d + e[i]
        t = q[i + 1] / total if total else 0.0
        new_q.append(total)
        new_e.append(e[i] * t)
        d = d * t - shift
    all_d.append(d)
    return None if d < 0 else ([*new_q, d], new_e, all_d)


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> list[float]:
    """Squared singular values of the bidiagonal with diagonal ``a`` and superdiagonal ``b``, by dqds.

    The shift is Newton's, 1 / trace of the inverse, which the unshifted step gives and which never passes the
    smallest value; where rounding makes a step fail, it is taken without shift.
    """
    work = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    found: list[float] = []
    while work:
        q, e, moved = work.pop()
        if q and 1.5 * q[0] < q[-1]:
            q, e = q[::-1], e[::-1]
        while q:
            n = len(q)
            if n == 1:
                found.append(moved + q[0])
                break
            if e[-1] <= _SMALL * (moved + q[-1]):
                found.append(moved + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= _SMALL * (moved + q[i])), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            q, e, d = _dqds(q, e, 0.0)
            if min(d) > 0:
                shift = (1 - 4 * n * _EPS) / sum(1 / x for x in d)
                step = _dqds(q, e, shift)
                if step is not None and moved + shift > moved:
                    q, e, _ = step
                    moved += shift
    return sorted(found, reverse=True)


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """Vector z with (B'B - value) z = gamma at one place, from a stationary and a progressive factorisation that meet where gamma is least."""
    n, tiny = len(a), np.finfo(np.float64).tiny / _EPS
    d, off, up = a * a, a[:-1] * b, b * b
    s, low, p, high = np.empty(n), np.empty(n - 1), np.empty(n), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        pivot = (s[i] + d[i]) or tiny
        low[i] = off[i] / pivot
        s[i + 1] = up[i] * s[i] / pivot - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = (up[i] + p[i + 1]) or tiny
        high[i] = off[i] / pivot
        p[i] = d[i] * p[i + 1] / pivot - value
    gamma = s + p + value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -low[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -high[i] * z[i]
    return z, float(gamma[k])


def _direction(a: np.ndarray, b: np.ndarray, value: float, near: list[np.ndarray]) -> np.ndarray:
    """The unit vector to ``value``, at right angles to ``near``, the vectors of values that are the same to working precision."""
    if len(a) == 1:
        return np.ones(1)
    z, gamma = _twisted(a, b, value)
    z = z / np.linalg.norm(z)
    for _ in range(2):
        better, gamma = _twisted(a, b, value := value + gamma * float(np.max(np.abs(z))) ** 2)
        if not np.all(np.isfinite(better)):
            break
        z = better / np.linalg.norm(better)
    if near:
        basis = np.array(near)
        z = z - basis.T @ (basis @ z)
        if np.linalg.norm(z) < 0.1:  # too close to be told apart by its twist: inverse iteration beside the vectors already found
            full = np.diag(a * a) + np.diag(np.append(0.0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
            shifted = full - (value + 4 * _EPS * np.abs(full).sum(axis=1).max()) * np.eye(len(a))
            z = np.random.Generator(np.random.PCG64(len(near))).standard_normal(len(a))
            for _ in range(3):
                z = np.linalg.solve(shifted, z - basis.T @ (basis @ z))
                z = z / np.linalg.norm(z)
            z = z - basis.T @ (basis @ z)
        z = z / np.linalg.norm(z)
    return z


def directions(triangle: np.ndarray, count: int) -> tuple[list[float], np.ndarray, float]:
    """(squared singular values, unit right singular vectors in columns) of the ``count`` largest, and the sum of all squared values."""
    scale = float(np.max(np.abs(triangle), initial=0.0))
    n = triangle.shape[1]
    if not scale:
        return [0.0] * min(count, n), np.eye(n)[:, :count], 0.0
    a, b, v = bidiagonal(triangle / scale)
    edges = [0, *(np.flatnonzero(np.abs(b) <= _EPS * (np.abs(a[:-1]) + np.abs(a[1:]))) + 1).tolist(), n]
    pairs = [(value, first, end) for first, end in zip(edges, edges[1:]) for value in squared_singular_values(a[first:end], b[first : end - 1])]
    pairs.sort(key=lambda p: -p[0])
    values, columns = [], []
    for value, first, end in pairs[:count]:
        near = [z for other, start, z in columns if start == first and abs(other - value) <= 1e-7 * pairs[0][0]]
        columns.append((value, first, _direction(a[first:end], b[first : end - 1], value, near)))
        values.append(value * scale * scale)
    placed = np.zeros((n, len(columns)))
    for k, (_, first, z) in enumerate(columns):
        placed[first : first + len(z), k] = z
    return values, v @ placed, float(np.sum([p[0] for p in pairs])) * scale * scale


# --- over tables -----------------------------------------------------------------------------


def whole_steps(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry as a long; entries beyond a long stop at its ends."""
    most = float(2**63)
    step = lambda c: F.floor(F.lit(float(scale)) * c)
    return F.transform(vector, lambda c: F.when(c * scale >= most, F.lit(2**63 - 1)).when(c * scale <= -most, F.lit(-(2**63))).otherwise(step(F.when(F.abs(c * scale) < most, c).otherwise(0.0))).cast("long"))


def _rows(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        dims = batch.column("dims").to_numpy(zero_copy_only=False)
        for d in np.unique(dims).tolist():
            yield d, batch.filter(pa.array(dims == d))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length: rows and the sums of the upper and lower halves of the entries, which fit in longs for 2^31 rows."""
    held: dict[int, list] = {}
    for d, batch in _by_length(batches):
        x = _rows(batch.column("x"))
        was = held.setdefault(d, [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
        was[0] += len(x)
        was[1] += (x >> 32).sum(axis=0)
        was[2] += (x & (_WORD - 1)).sum(axis=0)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([h[0] for h in held.values()]), pa.array([h[1] for h in held.values()]), pa.array([h[2] for h in held.values()])], ["dims", "n", "high", "low"])


def _triangles(means: dict[int, np.ndarray]):
    """The triangle of all centred rows of a task, batch after batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for d, batch in _by_length(batches):
            centred = _rows(batch.column("x")).astype(np.float64) - means[d]
            held[d] = np.linalg.qr(np.vstack([held[d], centred]) if d in held else centred, mode="r")
        for d, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([r.shape[0]]), pa.array([r.ravel()])], ["dims", "height", "triangle"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "task"):
        d = block.column("dims")[0].as_py()
        r = None
        for flat in block.column("triangle"):
            part = np.asarray(flat.values).reshape(-1, d)
            r = np.linalg.qr(part if r is None else np.vstack([r, part]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([r.shape[0]]), pa.array([r.ravel()])], ["dims", "height", "triangle"])


_TRIANGLE = "dims long, height long, triangle array<double>"


def one_triangle(fit: DataFrame, means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The triangle R of the centred rows per length: one per task, then MERGE of them at a time until one is left."""
    parts = stored(fit.mapInArrow(_triangles(means), _TRIANGLE))
    while (most := parts.groupBy("dims").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // MERGE)
        numbered = parts.withColumn("task", F.concat_ws("/", "dims", F.pmod(F.xxhash64("triangle"), F.lit(groups))) if groups > 1 else F.col("dims").cast("string"))
        parts = stored(numbered.repartition("task").sortWithinPartitions("task", "triangle").mapInArrow(_merge, _TRIANGLE))
    return {r["dims"]: np.array(r["triangle"]).reshape(-1, r["dims"]) for r in parts.collect()}


def fit_whitening(fit: DataFrame, count: int = COMPONENTS) -> dict[int, dict]:
    """Per length of ``fit`` (dims, x; distinct rows): n, sums S (exact), the mean, eigenvalues, directions, the trace.

    The driver holds the sums and one triangle per length, both bounded by the vectors' length.
    """
    parts = fit.mapInArrow(_sums, "dims long, n long, high array<long>, low array<long>").select("dims", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "half"))
    whole = F.sum(F.col("half.high").cast("decimal(38,0)") * F.lit(_WORD)) + F.sum(F.col("half.low").cast("decimal(38,0)"))
    totals: dict[int, tuple] = {}
    for r in parts.groupBy("dims", "at").agg(F.sum("n").alias("n"), whole.alias("total")).orderBy("dims", "at").collect():
        totals.setdefault(r["dims"], (r["n"], []))[1].append(int(r["total"]))
    means = {d: np.array([s / n for s in sums]) for d, (n, sums) in totals.items()}
    models = {}
    for d, triangle in one_triangle(fit, means).items():
        n, sums = totals[d]
        values, vectors, trace = directions(triangle, count)
        # what rounding leaves of a direction without variance is no component
        live = [value > trace * (d * _EPS) ** 2 * n for value in values]
        models[d] = {"n": n, "sums": sums, "mean": means[d], "values": np.array(values) / n, "vectors": vectors, "trace": trace / n, "live": np.array(live, bool)}
    return models


def _whiten(models: dict[int, dict], x: np.ndarray) -> np.ndarray:
    model = models[x.shape[1]]
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(model["live"], 1 / np.sqrt(model["values"]), 0.0)
    return (x.astype(np.float64) - model["mean"]) @ (model["vectors"] * scale)


def _moments(models: dict[int, dict], centre: dict[int, np.ndarray] | None):
    """Per task and length the sum of the whitened rows, or of their products once ``centre`` is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for d, batch in _by_length(batches):
            y = _whiten(models, _rows(batch.column("x")))
            part = y.sum(axis=0) if centre is None else (y - centre[d]).T @ (y - centre[d])
            held[d] = held[d] + part if d in held else part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([h.ravel() for h in held.values()])], ["dims", "part"])

    return run


def identity_errors(fit: DataFrame, models: dict[int, dict]) -> dict[int, float | None]:
    """Per length the largest absolute entry of (covariance of the whitened fit rows - identity); null without components."""

    def total(centre):
        parts = fit.mapInArrow(_moments(models, centre), "dims long, part array<double>").select("dims", F.posexplode("part").alias("at", "value"))
        out: dict[int, list[float]] = {}
        for r in parts.groupBy("dims", "at").agg(F.sum("value").alias("total")).orderBy("dims", "at").collect():
            out.setdefault(r["dims"], []).append(r["total"] / models[r["dims"]]["n"])
        return {d: np.array(v) for d, v in out.items()}

    products = total(total(None))
    errors = {}
    for d, flat in products.items():
        live = models[d]["live"]
        gap = np.abs(flat.reshape(len(live), -1) - np.eye(len(live)))[np.ix_(live, live)]
        errors[d] = float(gap.max()) if gap.size else None
    return errors


def _apply(models: dict[int, dict], errors: dict[int, float | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, batch in _by_length(batches):
            model = models[d]
            k, rows = len(model["live"]), batch.num_rows
            y = _whiten(models, _rows(batch.column("x")))
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k)))
            spread = batch.column("deviation").take(pa.array(np.repeat(np.arange(rows), k)))
            dead = np.tile(~model["live"], rows)
            share = model["values"] * model["live"] / model["trace"] if model["trace"] else np.zeros(k)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model["n"], np.int64)), spread,
                    pa.array(y.ravel(), mask=dead), pa.array(np.tile(share, rows), mask=np.full(rows * k, not model["trace"])),
                    pa.array([errors[d]] * (rows * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(vectors: DataFrame, count: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component.

    Entries become whole steps x = floor(scale * c). Each distinct x counts once for the fit: centred rows go block by
    block through QR, the tasks' triangles are merged, the last one is made bidiagonal, its singular values come
    from dqds and its directions from twisted factorisations. ``deviation`` is the exact sum of (n * x - S)^2, null
    beyond a long; ``whitened`` the projection of x - S / n by the root of its variance.

    Rows whose vector is null or holds null or non-finite entries are dropped, empty vectors have no component. Rows that are repeated or share an id or are
    null in it each stay. Each length of vectors is fitted on its own; a short vector has as many components as entries. A component
    without variance (all vectors equal, say) has null for ``whitened`` and 0 for ``explained`` (null where nothing varies). Equal eigenvalues come in either
    order, with directions at right angles. Very long vectors cost the square of their length on the driver, rows never meet there. Other columns are ignored;
    an empty table gives an empty result.
    """
    entries = F.col(vector_col).cast("array<double>")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("embedding")).where(F.col("embedding").isNotNull() & ~bad & (F.size("embedding") > 0))
    rows = stored(usable.select("vec_id", F.size("embedding").cast("long").alias("dims"), whole_steps(F.col("embedding"), scale).alias("x")))
    fit = stored(rows.select("dims", "x").distinct())
    models = fit_whitening(fit, count)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not models:
        return vectors.sparkSession.createDataFrame([], out)
    known = vectors.sparkSession.createDataFrame([(d, m["n"], [str(s) for s in m["sums"]]) for d, m in models.items()], "dims long, n long, sums array<string>")
    known = known.select("dims", F.col("n").cast("decimal(38,0)").alias("n"), F.transform("sums", lambda s: s.cast("decimal(38,0)")).alias("sums"))
    gap = F.zip_with("x", "sums", lambda x, s: F.try_subtract(F.try_multiply(F.col("n"), x.cast("decimal(38,0)")), s).cast("decimal(38,0)"))
    square = lambda g: F.try_multiply(g, g).try_cast("decimal(38,0)")
    deviation = F.aggregate(gap, F.lit(0).cast("decimal(38,0)"), lambda a, g: F.try_add(a, square(g)).try_cast("decimal(38,0)")).try_cast("long")
    spread = rows.join(F.broadcast(known), "dims").select("vec_id", "dims", "x", deviation.alias("deviation"))
    return spread.mapInArrow(_apply(models, identity_errors(fit, models)), out)
