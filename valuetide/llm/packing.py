"""Packing token documents into fixed windows: bounded-space best fit, then merging of leftovers."""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuetide.llm.common import stored

WINDOW = 2048
#: Windows that stay open in a task.
OPEN_WINDOWS = 32
#: A window with at most so many free places is given out as it is; one with more is first filled with the head of the next text.
SLACK = 24
#: Tasks whose leftovers meet in one merging task.
FAN_IN = 64
#: The id that ends each document.
END_ID = 1
#: Blanks in a row from which a text is not left to the faster encoder, whose pattern search gives up at some hundred thousand.
LONG_BLANK = 10_000
_LONG_RUN = re.compile(rf"\s{{{LONG_BLANK}}}")

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, open boolean"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"]


#: Fixed value: how the vocabulary's kind cuts a text into pieces.
_PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _visible_bytes() -> dict[str, int]:
    """The character by which such vocabulary files write each byte: itself if it is visible, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of a byte-level vocabulary file as little-endian 32-bit bytes, the same as ``tokenizers`` gives.

    Texts go to a faster encoder where it gives equal ids: the file's merges stand in the order of
    their ids, each token's bytes alone merge to that token, and the piece pattern sorts all code
    points as the file's own cutter does (tests check all three). Texts that hold an added token
    or a run of LONG_BLANK blanks go to ``tokenizers`` itself. With ``special_as_text`` the
    strings of added tokens are ordinary text; without it they are treated as the file says.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec.get("added_tokens", ())}
        code = _visible_bytes()
        ranks = {bytes(code[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in added}
        self._coder = tiktoken.Encoding("vocabulary", pat_str=_PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = special_as_text
        self._added = () if special_as_text else tuple(added)

    def _simple(self, text: str) -> bool:
        return not any(t in text for t in self._added) and (len(text) < LONG_BLANK or not _LONG_RUN.search(text))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self._simple(text):
            return self._coder.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Packer:
    """Open windows by their free places; a window is a list of (doc_id, start, bytes, doc_tokens)."""

    def __init__(self, first_id: int, window: int, open_windows: int, slack: int):
        self.window, self.most, self.slack = window, open_windows, slack
        self.next_id, self.free, self.rows = first_id, [], []

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        at = 0
        while total - at >= self.window:
            self._emit([(doc_id, at, ids[at * 4 : (at + self.window) * 4], total)])
            at += self.window
        if at < total:
            self._place((doc_id, at, ids[at * 4 :], total))

    def _place(self, piece: tuple) -> None:
        """Into the window that it fills best; if none has room, the fullest goes out, with the head of the piece if much is free."""
        size = len(piece[2]) // 4
        k = bisect.bisect_left(self.free, size, key=lambda w: w[0])
        if k < len(self.free):
            room, pieces = self.free.pop(k)
            pieces.append(piece)
            if room == size:
                self._emit(pieces)
            else:
                bisect.insort(self.free, (room - size, pieces), key=lambda w: w[0])
            return
        if len(self.free) >= self.most:
            room, pieces = self.free.pop(0)
            if room > self.slack:
                doc_id, start, ids, total = piece
                pieces.append((doc_id, start, ids[: room * 4], total))
                piece = (doc_id, start + room, ids[room * 4 :], total)
            self._emit(pieces)
            size = len(piece[2]) // 4
        bisect.insort(self.free, (self.window - size, [piece]), key=lambda w: w[0])

    def _emit(self, pieces: list[tuple], still_open: bool = False) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, at, still_open))
            at += len(ids) // 4
        self.next_id += 1

    def close(self) -> None:
        """Run the open windows together: all but the last are full, the last stays open for other tasks' leftovers."""
        now, room = [], self.window
        for _, pieces in self.free:
            for doc_id, start, ids, total in pieces:
                while ids:
                    head = ids[: room * 4]
                    now.append((doc_id, start, head, total))
                    start, ids, room = start + len(head) // 4, ids[room * 4 :], room - len(head) // 4
                    if not room:
                        self._emit(now)
                        now, room = [], self.window
        self.free = []
        if now:
            self._emit(now, still_open=True)

    def taken(self, least: int) -> list[tuple]:
        if len(self.rows) < least:
            return []
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _NAMES)


def _pack_tasks(path: str, window: int, open_windows: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, special_as_text=False)
        end = END_ID.to_bytes(4, "little")
        packer = _Packer(TaskContext.get().partitionId() << 40, window, open_windows, slack)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packer.add(doc_id, encoder.ids(text or "") + end)
                if rows := packer.taken(10_000):
                    yield _batch(rows)
        packer.close()
        if rows := packer.taken(1):
            yield _batch(rows)

    return run


def _merge_windows(pieces, window: int):
    """Leftover windows of one group of tasks, fullest first, each into the window that it fills best."""
    sizes = pieces.groupby("sequence_id")["length"].sum().sort_values(ascending=False, kind="stable")
    free: list[tuple[int, int]] = []
    into: dict[int, tuple[int, int]] = {}
    for sequence, size in sizes.items():
        k = bisect.bisect_left(free, size, key=lambda w: w[0])
        room, target = free.pop(k) if k < len(free) else (window, sequence)
        into[sequence] = (target, window - room)
        bisect.insort(free, (room - int(size), target), key=lambda w: w[0])
    shift = pieces["sequence_id"].map(lambda s: into[s][1])
    target = pieces["sequence_id"].map(lambda s: into[s][0])
    return pieces.assign(offset=pieces["offset"] + shift, sequence_id=target)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, slack: int = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every text of ``docs`` in sequences of at most ``window`` tokens.

    A document is its text's ids as ``tokenizers`` gives them, added tokens in the text included (a
    null text has none), and END_ID. Whole windows are cut from
    its front. What is left goes, uncut, into the open window that it fills best; if none of the
    ``open_windows`` of a task has room, the fullest is given out, filled first with the piece's
    head when more than ``slack`` places are free. In the end a task runs its open windows
    together and leaves one; those of FAN_IN tasks at a time are merged, best fit, until one group
    is left. Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Repeated rows are packed as often as they come; an empty table gives no piece; other columns
    are ignored. A task holds its open windows and one text. Pieces are written once, so sequence
    ids cannot change when a task runs again.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(source.mapInArrow(_pack_tasks(path or vocabulary_path(), window, open_windows, slack), _PIECES))
    done = pieces.where("NOT open").drop("open")
    left = pieces.where("open").drop("open")
    groups = max(1, source.rdd.getNumPartitions())
    while True:
        groups = -(-groups // FAN_IN)
        left = merge_leftovers(left, groups, window)
        if groups == 1:
            break
        left = stored(left)
    return done.unionByName(left)


def merge_leftovers(left: DataFrame, groups: int, window: int) -> DataFrame:
    group = F.pmod(F.xxhash64("sequence_id"), F.lit(groups))

    def run(key, pieces):
        return _merge_windows(pieces, window)

    return left.groupBy(group.alias("g")).applyInPandas(run, left.schema)


def sequence_lengths(spark: SparkSession, pieces: DataFrame) -> DataFrame:
    """Tokens, padding and pieces of each sequence."""
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), (F.lit(WINDOW) - F.sum("length")).alias("padding"), F.count("*").alias("pieces"))
