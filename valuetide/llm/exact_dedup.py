"""Exact duplicates through a cuckoo-filter index of live digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuetide.llm.common import stored

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Live digests by 16-bit fingerprints in buckets of four, with the whole digest kept beside each.

    A fingerprint hit counts only after the kept digest is compared. When an insertion
    finds no place within MAX_KICKS moves, the table doubles and is filled again from the
    kept digests, so nothing is lost.
    """

    def __init__(self, buckets: int = 1024):
        self._size = 1 << max(1, (buckets - 1).bit_length())
        self._clear()
        self.resizes = 0
        self.count = 0

    def _clear(self) -> None:
        self._marks = [0] * (self._size * SLOTS)
        self._kept: list[tuple | None] = [None] * (self._size * SLOTS)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self._size - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 3) & (self._size - 1))

    def _slot(self, digest: bytes) -> int | None:
        mark, first, second = self._places(digest)
        for bucket in (first, second) if first != second else (first,):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self._marks[slot] == mark and self._kept[slot][0] == digest:
                    return slot
        return None

    def find(self, digest: bytes):
        slot = self._slot(digest)
        return None if slot is None else self._kept[slot][1]

    def insert(self, digest: bytes, value) -> None:
        """Add a digest that is not live."""
        entry = (digest, value)
        while (entry := self._put(entry)) is not None:
            rest = [e for e in self._kept if e is not None]
            while True:  # until all find a place
                self._size *= 2
                self.resizes += 1
                self._clear()
                if all(self._put(e) is None for e in rest):
                    break
        self.count += 1

    def _put(self, entry: tuple) -> tuple | None:
        """The entry that found no place, if any."""
        mark, first, second = self._places(entry[0])
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self._marks[slot]:
                    self._marks[slot], self._kept[slot] = mark, entry
                    return None
        bucket = second
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + mark) % SLOTS
            (mark, entry), self._marks[slot], self._kept[slot] = (self._marks[slot], self._kept[slot]), mark, entry
            bucket = self._other(bucket, mark)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self._marks[slot]:
                    self._marks[slot], self._kept[slot] = mark, entry
                    return None
        return entry

    def delete(self, digest: bytes) -> bool:
        slot = self._slot(digest)
        if slot is None:
            return False
        self._marks[slot], self._kept[slot] = 0, None
        self.count -= 1
        return True

    def items(self) -> Iterator[tuple]:
        return (e for e in self._kept if e is not None)


_GROUP = "digest binary, keep_id long, group_size long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest of the partition: rows seen and the document that is live in the end."""
    index = CuckooIndex()
    for batch in batches:
        digests, ids, sizes = (batch.column(k).to_pylist() for k in range(3))
        for digest, doc_id, n in zip(digests, ids, sizes):
            live = index.find(digest)
            if live is None:
                index.insert(digest, (doc_id, n))
                continue
            keep = live[0] if doc_id is None or (live[0] is not None and live[0] >= doc_id) else doc_id
            index.delete(digest)
            index.insert(digest, (keep, live[1] + n))
    rows = list(index.items())
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in part], pa.binary()), pa.array([r[1][0] for r in part], pa.int64()), pa.array([r[1][1] for r in part], pa.int64())],
            ["digest", "keep_id", "group_size"],
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` (id only) with the row of its group of equal texts that stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` and no other column of the input.
    Texts are equal when they are identical; a null text is an empty one. The row with the
    largest id stays; a null id is smaller than any. Rows that repeat the id that stays are all
    marked kept. An empty table gives an empty result; very long texts only cost their digest.

    Each scan task merges its own copies in a cuckoo index before the shuffle, so that a group
    reaches a shard with one row a task; the shards merge those rows in an index again.
    """
    digests = stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"))
    )
    local = digests.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")).mapInArrow(_merge, _GROUP)
    groups = local.repartition("digest").mapInArrow(_merge, _GROUP)
    return digests.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = """SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  coalesce(doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""
