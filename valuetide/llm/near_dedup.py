"""Near duplicates by weighted MinHash signatures from thrown darts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuetide.llm.common import blocks, mix64, run_hashes, span_hashes, stored, text_parts, word_bounds
from valuetide.operators.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Bands and coordinates per band: two texts of similarity 0.8 share no band with probability (1 - 0.8^5)^24 < 1e-4.
BANDS, ROWS = 24, 5

#: Nodes of a band, or of a loose class, that one task compares with so many others; larger ones are cut into chunks and compared chunk by chunk.
CHUNK = 512
#: Signatures must agree in so many standard deviations less than the similarity; a pair at the similarity fails that once in 10^5.
SPARE = 4.3

_SKETCH = "doc_id long, text_key long, node long, marks binary, bands array<long>"
_STARS = "a long, b long"


def shingle_weights(raw: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, weight) of a slice, by row and hash; the weight is how often the row has the shingle.

    A text of fewer words than ``width`` has one shingle, all its words; one without words has none.
    """
    starts, ends, first = word_bounds(raw, offsets)
    words = span_hashes(raw, starts, ends)
    n = len(offsets) - 1
    counts = np.diff(first)
    row_of = np.repeat(np.arange(n), counts)
    hashes = run_hashes(words, width)
    inside = row_of[: len(hashes)] == row_of[width - 1 :] if len(hashes) else np.zeros(0, bool)
    rows, values = [row_of[: len(hashes)][inside]], [hashes[inside]]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        rows.append(np.array([r]))
        values.append(run_hashes(words[first[r] : first[r + 1]], int(counts[r])) + np.uint64(counts[r]))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n x k) of weighted sets; equal coordinates have the chance of the sets' weighted Jaccard similarity.

    Every element owns an endless strip of darts, at random weights x and times r, that does not
    depend on the set. A set with total weight W looks at the darts with x below the element's
    weight and r up to about (k ln k + 2k) / W, so it sees about as many darts however large it
    is; each dart belongs to one coordinate, and each coordinate keeps its earliest. Where a
    coordinate stays empty the time is doubled.
    """
    out = np.full((n, k), _EMPTY, np.uint64)
    totals = np.bincount(row, weight, n)
    limit = np.divide(k * np.log(k) + 2 * k, totals, out=np.zeros(n), where=totals > 0)
    todo = totals > 0
    while todo.any():
        mine = todo[row]
        _throw(out, row[mine], element[mine], weight[mine], limit, k)
        todo = todo & (out == _EMPTY).any(axis=1)
        limit = limit * 2
    return out


def _throw(out: np.ndarray, row: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int) -> None:
    """Keep the earliest dart of each (row, coordinate). Weights are cut into the strips [0,1), [1,2), [2,4), [4,8), ..."""
    flat = out.reshape(-1)
    strip, low, wide = 0, 0.0, 1.0
    while len(row):
        seed = mix64(element + np.uint64((strip * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
        r, own, top = np.zeros(len(row)), row, weight
        dart = 0
        while len(own):
            dart += 1
            key = mix64(seed + np.uint64((dart * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            r = r - np.log(((key >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / wide
            live = r <= limit[own]
            own, top, seed, r, key = own[live], top[live], seed[live], r[live], key[live]
            spread = mix64(key ^ np.uint64(0xA0761D6478BD642F))
            x = low + wide * ((spread >> np.uint64(40)).astype(np.float64) * 2.0**-24)
            inside = x < top
            place = own[inside] * k + (spread[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) % k
            when = r[inside].astype(np.float32).view(np.uint32).astype(np.uint64)
            np.minimum.at(flat, place, (when << np.uint64(32)) | (key[inside] & np.uint64(0xFFFFFFFF)))
        strip += 1
        low, wide = (1.0, 1.0) if strip == 1 else (low * 2, low * 2)
        more = weight > low
        row, element, weight = row[more], element[more], weight[more]


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, raw, offsets in text_parts(batch.column(2)):
                n = end - at
                row, element, weight = shingle_weights(raw, offsets)
                signature = dart_signatures(row, element, weight, n, bands * rows)
                parts = signature.reshape(n, bands, rows)
                keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
                for j in range(rows):
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
                has = np.bincount(row, minlength=n) > 0
                node = np.zeros(n, np.uint64)  # of all shingles with their weights, in any order
                np.add.at(node, row, mix64(element * np.uint64(2) + weight.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(has * bands))), pa.int32()), pa.array(keys[has].reshape(-1).view(np.int64)))
                marks = mix64(signature).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(mix64(node).view(np.int64), mask=~has),
                        pa.array([m.tobytes() if h else None for m, h in zip(marks, has)], pa.binary()), lists,
                    ],
                    ["doc_id", "text_key", "node", "marks", "bands"],
                )

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def agreements(marks: np.ndarray, x: slice, y: slice) -> np.ndarray:
    """How many coordinates of each row of x agree with each row of y."""
    out = np.zeros((x.stop - x.start, y.stop - y.start), np.int16)
    for k in range(marks.shape[1]):
        out += marks[x, k][:, None] == marks[y, k][None, :]
    return out


def copies_apart(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first, second, ... occurrence of an element as elements of their own: sets whose Jaccard similarity is the weighted one."""
    total = np.repeat(element, weight)
    nth = np.arange(len(total)) - np.repeat(np.cumsum(weight) - weight, weight)
    return mix64(total + nth.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def shared_counts(sets: list[np.ndarray], x: slice, y: slice) -> np.ndarray:
    """Elements that each set of x shares with each of y, through the elements that several sets have, some at a time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[place] > 1
    owner, place = owner[often], place[often]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], np.unique(place[order], return_inverse=True)[1]
    out = np.zeros((x.stop - x.start, y.stop - y.start), np.float32)
    step = 4096
    edges = np.searchsorted(place, np.arange(0, (place[-1] if len(place) else -1) + step + 1, step))
    for a, b in zip(edges, edges[1:]):
        if b > a:
            block = np.zeros((n, step), np.float32)
            block[owner[a:b], place[a:b] - place[a] // step * step] = 1
            out += block[x] @ block[y].T
    return out


def stars(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id that its links reach) of the ids that the links (i, j) touch."""
    root = ids.copy()
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (root == before).all():
            break
    touched = np.unique(np.concatenate((i, j)))
    return ids[touched], root[touched]


def _rows_of(block: pa.Table) -> tuple[np.ndarray, np.ndarray, slice, slice, bool]:
    """(ids, marks, first side, second side, one chunk only) of a task's rows, ordered by side and node."""
    side, ids = block.column("side").to_numpy(), block.column("node").to_numpy()
    marks = np.frombuffer(b"".join(block.column("marks").to_pylist()), np.uint16).reshape(len(ids), -1)
    alone = bool((side == 2).any())
    cut = len(ids) if alone else int((side == 0).sum())
    return ids, marks, slice(0, cut), slice(0, len(ids)) if alone else slice(cut, len(ids)), alone


def _loose_links(rows: int, least: int):
    """Stars of pairs that share a band and agree in ``least`` coordinates, each pair in the first band that it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in blocks(batches, "task"):
            block = block.sort_by([("side", "ascending"), ("node", "ascending")])
            band = int(block.column("no")[0].as_py())
            ids, marks, x, y, alone = _rows_of(block)
            for a in range(x.start, x.stop, 256):
                part = slice(a, min(a + 256, x.stop))
                first = np.ones((part.stop - a, y.stop - y.start), bool)
                for k in range(band):  # an earlier band that they share too has had them
                    first &= ~(marks[part, None, k * rows : (k + 1) * rows] == marks[None, y, k * rows : (k + 1) * rows]).all(axis=2)
                ok = first & (agreements(marks, part, y) >= least)
                if alone:
                    ok &= np.arange(part.start, part.stop)[:, None] < np.arange(y.start, y.stop)[None, :]
                i, j = np.nonzero(ok)
                if len(i):
                    held.append(stars(ids, i + a, j + y.start))
                    size += len(held[-1][0])
            if size > 50_000:
                yield _star_batch(held)
                held, size = [], 0
        if held:
            yield _star_batch(held)

    return run


def _exact_links(similarity: float, least: int):
    """Stars of pairs of one loose class whose whole texts reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in blocks(batches, "task"):
            block = block.sort_by([("side", "ascending"), ("node", "ascending")])
            node = block.column("node").to_numpy()
            block = block.take(pa.array(np.flatnonzero(np.append(True, node[1:] != node[:-1]))))  # repeated rows bring a text again
            ids, marks, x, y, alone = _rows_of(block)
            close = agreements(marks, x, y) >= least
            if alone:
                close &= np.arange(x.stop)[:, None] < np.arange(y.stop)[None, :]
            i, j = np.nonzero(close)
            if not len(i):
                continue
            sets: list[np.ndarray] = []
            for _, _, raw, offsets in text_parts(block.column("text")):
                row, element, weight = shingle_weights(raw, offsets)
                edge = np.searchsorted(row, np.arange(len(offsets)))
                sets += [copies_apart(element[a:b], weight[a:b]) for a, b in zip(edge, edge[1:])]
            length = np.array([len(s) for s in sets])
            if len(i) > 500:
                shared = shared_counts(sets, x, y)[i, j].astype(np.int64)
            else:
                shared = np.array([len(np.intersect1d(sets[a], sets[b + y.start], assume_unique=True)) for a, b in zip(i, j)])
            j = j + y.start
            good = shared >= similarity * (length[i] + length[j] - shared) - 1e-9
            if good.any():
                held.append(stars(ids, i[good], j[good]))
                size += len(held[-1][0])
            if size > 50_000:
                yield _star_batch(held)
                held, size = [], 0
        if held:
            yield _star_batch(held)

    return run


def _star_batch(held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], ["a", "b"])


def dealt_in_chunks(rows: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """``rows`` for each pair of chunks of their group: task, side (0 and 1: first and second chunk, 2: one chunk with itself).

    Groups of one row are dropped. A group of up to ``chunk`` rows is one task; a larger one is
    dealt to a task for each pair of its chunks, so no task holds more than two chunks.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.ceil(F.col("_n") / chunk).alias("_chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("_chunks"))
    each = rows.join(sizes, keys).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 2).otherwise((F.col("_own") > F.col("_other")).cast("int"))
    return each.withColumn("task", F.xxhash64(*keys, F.least("_own", "_other"), F.greatest("_own", "_other"))).withColumn("side", side).drop("_own", "_other", "_chunks")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, class_size, kept`` for every row of ``docs``; class_id is the smallest id of the class.

    Two texts are linked when the weighted Jaccard similarity of their five-word shingles (weight:
    occurrences; words are unchanged) reaches ``similarity``; classes are what links join. Texts
    with the same shingles are one node from the start. Nodes that share a band and whose
    signatures agree well enough form loose classes; inside those every pair whose signatures agree is
    checked on the whole texts. Tasks return for each node the smallest one that it reaches, never
    pairs; large bands and loose classes are compared chunk by chunk in many tasks.

    A text without words (null, empty, blank) is a class of its own row. Repeated rows fall into
    one class; of rows that repeat the kept id, all are kept. Other columns are ignored. An empty
    table gives an empty result. Only candidates' texts are kept after the one shuffle of the texts.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
    sketch = stored(keyed.mapInArrow(_sketch(bands, rows), _SKETCH))
    count = bands * rows
    least = math.ceil(count * similarity - SPARE * math.sqrt(count * similarity * (1 - similarity)))
    firsts = sketch.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    nodes = stored(firsts.select("node", "first.doc_id", "first.text_key"))
    own = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("doc_id", "text_key", "node")]
    marked = stored(sketch.alias("s").join(nodes.alias("n"), own, "left_semi").dropDuplicates(["node"]).select("node", "marks", "bands"))

    banded = marked.select("node", F.posexplode("bands").alias("no", "band"))
    # signatures join only the rows of shared bands
    tasks = dealt_in_chunks(banded, ["no", "band"], CHUNK).select("task", "side", "no", "node").join(marked.select("node", "marks"), "node")
    loose = components(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_loose_links(rows, least), _STARS))

    wanted = stored(loose.join(marked.select("node", "marks"), "node").join(nodes, "node"))
    same = F.col("w.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("w.text_key") == F.col("k.text_key"))
    dealt = dealt_in_chunks(wanted, ["root"], CHUNK)
    tasks = keyed.where("text IS NOT NULL").alias("k").join(dealt.alias("w"), same).select("w.task", "w.side", "w.node", "w.marks", "k.text")
    roots = components(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_exact_links(similarity, least), _STARS))

    rooted = sketch.drop("bands", "marks").join(roots, "node", "left")
    # a text without words stands alone; the others by their class
    classed = rooted.withColumn("class", F.coalesce("root", "node"))
    sizes = classed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    joined = classed.join(sizes, "class", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.when(F.col("class").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )
