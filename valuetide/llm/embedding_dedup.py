"""Near-duplicate vectors by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuetide.llm.common import blocks, stored
from valuetide.operators.components import components

SIMILARITY = 0.98
#: Groups of projections. A pair that leaves its window in fewer projections than there are groups stays in it throughout one group.
GROUPS = 4
#: Chance that a pair just at the similarity passes the required count.
RECALL = 0.9995
#: Cells are so many windows wide.
CELL_WINDOWS = 3
#: Rows of a cell that one task compares with so many others; larger cells are cut into chunks and compared chunk by chunk.
CHUNK = 1024

_CELLS = "vec_id long, label long, dims int, grp int, cell long, delta int"
_LINKS = "vec_id long, root long, n long"


def projections(dims: int, count: int, seed: int = 7) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((dims, count))


def window_for(similarity: float, count: int, groups: int, recall: float) -> float:
    """Half width of the window in which a pair at ``similarity`` leaves fewer than ``groups`` of ``count`` projections with chance ``recall``.

    The two projections of such a pair differ by a normal variable whose deviation is the vectors' distance.
    """
    distance = math.sqrt(max(0.0, 2 - 2 * similarity))

    def passes(times: float) -> float:
        out = math.erfc(times / math.sqrt(2))
        return sum(math.comb(count, k) * out**k * (1 - out) ** (count - k) for k in range(groups))

    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if passes(middle) >= recall else (middle, high)
    return max(high * distance, 1e-9)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    """The rows of each batch by the length of their vectors."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes).tolist():
            yield batch.filter(pa.array(sizes == dims)), dims


def _assign(count: int, groups: int, window: float):
    """Cells of every group, the home cell and the lower neighbours whose windows reach the vector (delta: the axes moved)."""
    each = count // groups
    width = window * CELL_WINDOWS
    moves = np.array(list(product((0, 1), repeat=each)))
    bits = moves @ (1 << np.arange(each))
    salt = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, each, dtype=np.int64) | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, np.ndarray] = {}
        for batch, dims in _by_length(batches):
            if dims not in axes:
                axes[dims] = projections(dims, count)
            vectors = _matrix(batch.column(2))
            placed = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ axes[dims]
            ids, labels = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for g in range(groups):
                mine = placed[:, g * each : (g + 1) * each]
                home = np.floor(mine / width).astype(np.int64)
                near = mine - window < home * width
                for move, bit in zip(moves, bits):
                    ok = np.flatnonzero((near | (move == 0)).all(axis=1))
                    with np.errstate(over="ignore"):
                        cell = ((home[ok] - move) * salt).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[ok]), pa.array(labels[ok]), pa.array(np.full(len(ok), dims, np.int32)), pa.array(np.full(len(ok), g, np.int32)), pa.array(cell), pa.array(np.full(len(ok), bit, np.int32))],
                        ["vec_id", "label", "dims", "grp", "cell", "delta"],
                    )

    return run


def _compare(count: int, groups: int, window: float, similarity: float):
    each, needed = count // groups, count - groups + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, np.ndarray] = {}
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for block in blocks(batches, "task"):
            dims = int(block.column("dims")[0].as_py())
            if dims not in axes:
                axes[dims] = projections(dims, count)
            got = _links_of(block, axes[dims], each, needed, window, similarity)
            if got is not None:
                out.append(got)
                held += len(got[0])
            if held > 50_000:
                yield _link_batch(out)
                out, held = [], 0
        if out:
            yield _link_batch(out)

    return run


def _link_batch(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["vec_id", "root", "n"])


def _links_of(block: pa.Table, axes: np.ndarray, each: int, needed: int, window: float, similarity: float):
    """(vector, smallest vector reached in the block, links) of the vectors of one block that have links."""
    ids, delta, side, group, label, weight = (block.column(c).to_numpy() for c in ("vec_id", "delta", "side", "grp", "label", "weight"))
    vectors = _matrix(block.column("embedding"))
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    placed = vectors @ axes
    g = int(group[0])
    order = np.argsort(placed[:, g * each], kind="stable")
    ids, delta, side, vectors, placed, label, weight = ids[order], delta[order], side[order], vectors[order], placed[order], label[order], weight[order]
    line = placed[:, g * each]
    both = (side == 2).any()  # all rows of one chunk: every pair; otherwise pairs across the two chunks
    starts, ends = [], []
    upto = np.searchsorted(line, line + window, side="right")  # the window of each row, upwards
    step = 256
    for a in range(0, len(ids), step):
        b = min(a + step, len(ids))
        top = int(upto[b - 1])
        x, y = slice(a, b), slice(a, top)
        near = np.zeros((b - a, top - a), np.int8)
        full = np.zeros((g + 1, b - a, top - a), np.int8)
        for j in range(axes.shape[1]):
            hit = np.abs(placed[x, j][:, None] - placed[y, j][None, :]) <= window
            near += hit
            if j // each <= g:
                full[j // each] += hit
        ok = (near >= needed) & (full[g] == each)
        if g:
            ok &= ~(full[:g] == each).any(axis=0)  # a pair that stays together in an earlier group too belongs there
        ok &= (delta[x][:, None] & delta[y][None, :]) == 0
        ok &= np.arange(a, b)[:, None] < np.arange(a, top)[None, :]
        ok &= (ids[x][:, None] != ids[y][None, :]) & (label[x][:, None] == label[y][None, :])
        if not both:
            ok &= side[x][:, None] != side[y][None, :]
        i, j = np.nonzero(ok)
        if not len(i):
            continue
        if len(i) * 8 > ok.size:
            close = (vectors[x] @ vectors[y].T)[i, j] >= similarity
        else:
            close = np.einsum("ij,ij->i", vectors[a + i], vectors[a + j]) >= similarity
        starts.append(a + i[close])
        ends.append(a + j[close])
    if not starts or not sum(map(len, starts)):
        return None
    i, j = np.concatenate(starts), np.concatenate(ends)
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, weight[j])
    np.add.at(links, j, weight[i])
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (root == before).all():
            break
    has = links > 0
    return ids[has], root[has], links[has].astype(np.int64)


def similar_vectors(vectors: DataFrame, similarity: float = SIMILARITY, groups: int = GROUPS, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Two vectors are linked when their lengths are equal, their labels are equal and not null and their cosine, in double
    precision, is at least ``similarity``. Random projections fall into ``groups`` groups; a pair
    collides in a projection when the other lies in the window around the first. A pair passes
    with ``count - groups + 1`` collisions of ``count``, a number that pairs at the similarity reach with chance
    ``recall``; it then collides throughout at least one group, so pairs are looked for among
    vectors that share a cell of a group's grid, sorted by the group's first projection, and every
    passing pair is checked exactly, in the first group that holds it. Equal vectors of a label are searched
    as one that counts for all of them, so a group of copies costs its number of rows.

    Null, zero and non-finite vectors and those with null components have no links. Each length
    has projections and cells of its own. Rows that share an id are one vector (the smallest by label and
    components). Other columns are ignored; an empty table gives an empty result. The number of
    projections grows with the logarithm of the most rows of one label and length. Tasks return one row per linked
    vector, never pairs; cells above CHUNK rows are compared chunk by chunk in many tasks.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    usable = source.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad).where((norm > 0) & (norm < float("inf")))
    once = usable.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    # doubles as text are exact, so equal digests are equal vectors of one label
    digest = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("array<string>")), 256)
    keyed = stored(once.withColumns({"dims": F.size("embedding"), "same": digest}))
    folded = stored(keyed.groupBy("same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("dims").alias("dims"), F.first("embedding").alias("embedding")))
    ready = folded.select("vec_id", "label", "embedding", "dims", "weight")
    largest = ready.groupBy("label", "dims").count().agg(F.max("count")).first()[0]
    if largest is None:
        return source.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    each = 3 + max(0, math.ceil(math.log(largest / 50_000, 3)))
    count = each * groups
    window = window_for(similarity, count, groups, recall)

    cells = stored(ready.select("vec_id", "label", "embedding").mapInArrow(_assign(count, groups, window), _CELLS))
    shared = cells.groupBy("label", "dims", "grp", "cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / CHUNK))
    own = F.pmod(F.xxhash64("vec_id"), F.col("chunks"))
    chunked = cells.join(shared, ["label", "dims", "grp", "cell"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pair = chunked.select(
        "vec_id", "grp", "delta",
        F.xxhash64("label", "dims", "grp", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") < F.col("other")).cast("int")).alias("side"),
    )
    rows = pair.join(ready.select("vec_id", "label", "embedding", "dims", "weight"), "vec_id")
    tasks = rows.repartition("task").sortWithinPartitions("task")
    found = stored(tasks.mapInArrow(_compare(count, groups, window, similarity), _LINKS))
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    known = links.join(roots, F.col("vec_id") == F.col("node"), "left").select(F.col("vec_id").alias("first"), F.col("n_links").alias("others"), "root")
    told = folded.select("same", F.col("vec_id").alias("first"), "weight").join(known, "first", "left")
    per_group = told.select("same", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "first").alias("root"))
    per_vector = keyed.select("vec_id", "same").join(per_group, "same").select("vec_id", "n_links", "root")
    component = F.coalesce("root", "vec_id")
    return source.select("vec_id").join(per_vector, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
