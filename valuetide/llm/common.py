"""Shared helpers: written intermediate tables, Arrow text slices, word boundaries and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuetide.session import cut_lineage as stored  # noqa: F401  every intermediate table is written by it

#: A word: a run of bytes that are neither blank nor a control character from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one numpy step works on; a longer single text is one step of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_before(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str, own: str = "_bkt") -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``keys`` that come earlier by (bucket, order).

    ``bucket`` must not decrease along the order. No key's rows meet in one task: each (keys, bucket)
    is summed on its own, and only one sum a bucket is carried over the whole key.
    """
    valued = df.withColumn("_v", value)
    sums = valued.groupBy(*keys, bucket).agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, bucket, F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = valued.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, bucket]]
    joined = local.alias("l").join(base.alias("r"), same, "left")
    return joined.select("l.*", (F.col("r._base") + F.col("l._in")).alias(name)).drop("_v", "_in")


# --- text in Arrow batches -------------------------------------------------------------------


def text_parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of the rows in them) of a string column, about SLICE_BYTES at a time.

    A null is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row with the total at the end) of the words in a slice; no word spans two rows."""
    ink = ~_SPACE[raw]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    edge = offsets[(offsets > 0) & (offsets < len(raw))]
    start[edge] = ink[edge]
    end[edge - 1] = ink[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd 64-bit number and of its inverse, from 0 to at least n - 1."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULT, _MULT_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes have equal hashes wherever they stand."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = values[:n].copy()
    for j in range(1, width):
        out = mix64(out * np.uint64(_MULT) + values[j : n + j])
    return out


def blocks(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows that follow each other with one key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)
