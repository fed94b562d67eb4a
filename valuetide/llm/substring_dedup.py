"""Repeated word passages through FM-indexes of content-dealt shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuetide.llm.common import mix64, powers, span_hashes, stored, text_parts, word_bounds

#: Consecutive words of a window.
WINDOW = 20
#: Words of the grams among which a window's anchor, its smallest hash, is chosen.
GRAM = 6
#: Words of segments that share an FM-index.
SHARD_WORDS = 300_000
#: Different segments of an anchor beyond which its windows are dealt out one by one, by all their words.
HOT_SEGMENTS = 8_000
#: They are counted over every so-manieth different segment by its hash; that decides the way of dealing only, never a result.
COUNTED = 64
#: Hot anchors that are sent to all tasks (8 bytes each); more are joined.
HOT_BROADCAST = 1_000_000

_ANCHORS = "anchor long, place long, pos int, kind int"
_SEGMENTS = "anchor long, doc_id long, text_key long, start int, windows int, words string"
_SPANS = "doc_id long, text_key long, start int, stop int"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


# --- segments: runs of windows with one anchor -----------------------------------------------


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    n = len(words) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for j in range(1, gram):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += words[j : n + j]
    return mix64(total)


def window_anchors(hashes: np.ndarray, wide: int) -> np.ndarray:
    """Place of the smallest of each ``wide`` consecutive hashes, the leftmost of equal ones."""
    value, place, size = hashes, np.arange(len(hashes)), 1
    while size < wide:
        step = min(size, wide - size)
        a, b = value[:-step], value[step:]
        later = b < a
        value, place = np.where(later, b, a), np.where(later, place[step:], place[:-step])
        size += step
    return place


def segments_of(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Of a slice: (row, anchor hash, anchor's word, first window's word, windows) of every segment, and the word bounds."""
    starts, ends, first = word_bounds(raw, offsets)
    counts = np.diff(first)
    row_of = np.repeat(np.arange(len(counts)), counts)
    n = len(starts) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return (empty, np.zeros(0, np.uint64), empty, empty, empty), starts, ends, first
    hashes = gram_hashes(span_hashes(raw, starts, ends), gram)
    place = window_anchors(hashes, window - gram + 1)[:n]
    inside = row_of[:n] == row_of[window - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (row_of[1:n] != row_of[: n - 1])
    at = np.flatnonzero(new)
    upto = np.cumsum(inside)
    windows = np.diff(np.append(upto[at] - 1, upto[-1])) if len(at) else at
    return (row_of[at], hashes[place[at]], place[at], at, windows), starts, ends, first


def _anchor_rows(window: int, gram: int, counted: int):
    """One row per segment. Its kind: 1 if the batch has the anchor once; else 2 for the first one and 0 for the others; and 4 more for a counted one, which no equal one precedes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, anchors, places, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for at, _, raw, offsets in text_parts(batch.column(1)):
                (row, anchor, place, start, windows), starts, ends, first = segments_of(raw, offsets, window, gram)
                rows.append(row + at)
                anchors.append(anchor)
                places.append(place - first[row])
                words.append(span_hashes_of_runs(raw, starts, ends, start, start + windows + window - 2))
            row, anchor, place, words = np.concatenate(rows), np.concatenate(anchors), np.concatenate(places), np.concatenate(words)
            order = np.lexsort((words, anchor))
            row, anchor, place, words = row[order], anchor[order], place[order], words[order]
            kind = np.zeros(len(row), np.int64)
            if len(row):
                new = np.append(True, anchor[1:] != anchor[:-1])
                other = np.append(True, words[1:] != words[:-1]) | new
                kind = np.where(new, np.where(np.append(new[1:], True), 1, 2), 0) + np.where(other & (words % np.uint64(counted) == 0), 4, 0)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(row), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[s].view(np.int64)), pa.array(ids[row[s]]), pa.array(place[s].astype(np.int32)), pa.array(kind[s].astype(np.int32))], ["anchor", "place", "pos", "kind"]
                )

    return run


def _segment_rows(window: int, gram: int):
    """The segments of texts whose anchors are listed, with their words; of equal ones in a batch the later come without words.

    A segment of a hot anchor comes as its windows, each with a hash of its words for an anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, lists, warm = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(3), batch.column(4)
            parts, texts = [], []
            for at, end, raw, offsets in text_parts(batch.column(2)):
                (row, anchor, place, start, windows), starts, ends, first = segments_of(raw, offsets, window, gram)
                wanted = np.zeros(len(starts) + 1, bool)
                for r in range(end - at):
                    places = np.array(lists[at + r].as_py(), np.int64) + first[r]
                    wanted[places[places < first[r + 1]]] = True  # other texts of the same id may be longer
                keep = np.flatnonzero(wanted[place])
                row, anchor, start, windows = row[keep], anchor[keep], start[keep], windows[keep]
                # by value: a place may stand for several texts
                hot = np.isin(anchor.view(np.int64), np.array(sorted({a for r in range(at, end) for a in warm[r].as_py()}), np.int64))
                if hot.any():
                    times = np.where(hot, windows, 1)
                    each = np.repeat(np.arange(len(row)), times)
                    start = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                    row, anchor, windows, hot = row[each], anchor[each], np.where(hot, 1, windows)[each], hot[each]
                    own_words = span_hashes_of_runs(raw, starts, ends, start[hot], start[hot] + window - 1)
                    anchor[hot] = mix64(own_words ^ np.uint64(0x94D049BB133111EB))
                last = start + windows + window - 2
                parts.append((row + at, anchor, start - first[row], windows, span_hashes_of_runs(raw, starts, ends, start, last)))
                data = raw.tobytes()
                texts += [data[s:e] for s, e in zip(starts[start], ends[last])]
            if not texts:
                continue
            row, anchor, own, windows, words = (np.concatenate(x) for x in zip(*parts))
            doc = ids[row]
            # equal words: the earliest by (document, start) keeps them
            order = np.lexsort((own, doc, windows, words))
            new = np.ones(len(order), bool)
            new[1:] = (words[order[1:]] != words[order[:-1]]) | (windows[order[1:]] != windows[order[:-1]])
            leader = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            again = np.zeros(len(order), bool)
            again[order] = (doc[order] != doc[leader]) | (own[order] != own[leader])
            kept = np.flatnonzero(~again)
            # the others need no shard: those that follow each other are joined, and dealt out by document
            late = np.flatnonzero(again)
            late = late[np.lexsort((own[late], row[late]))]
            split = np.ones(len(late), bool)
            split[1:] = (row[late[1:]] != row[late[:-1]]) | (own[late[1:]] > own[late[:-1]] + windows[late[:-1]])
            heads, tails = late[split], late[np.append(np.flatnonzero(split)[1:] - 1, len(late) - 1)] if len(late) else late
            spread = mix64(doc[heads].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + own[heads].astype(np.uint64))
            out = [
                np.concatenate((anchor[kept], spread)).view(np.int64), np.concatenate((doc[kept], doc[heads])), keys[np.concatenate((row[kept], row[heads]))],
                np.concatenate((own[kept], own[heads])).astype(np.int32), np.concatenate((windows[kept], own[tails] + windows[tails] - own[heads])).astype(np.int32),
            ]
            lines = [texts[k].decode() for k in kept] + [None] * len(heads)
            for a in range(0, len(lines), 20_000):
                s = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays([*[pa.array(c[s]) for c in out], pa.array(lines[s], pa.string())], ["anchor", "doc_id", "text_key", "start", "windows", "words"])

    return run


def span_hashes_of_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words first..last, whatever blanks stand between them."""
    words = span_hashes(raw, starts, ends)
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix64((total[last + 1] - total[first]) * down[first])


# --- the index of a shard --------------------------------------------------------------------


class FMIndex:
    """Backward search over the Burrows-Wheeler transform of a symbol text, kept as a wavelet matrix of packed bits.

    Suffixes are sorted by their first ``depth`` symbols, equal ones by place, so searches may
    have up to ``depth`` symbols and the first place of a result is the earliest in the text.
    Symbols are counted from 1; 0 separates texts and ends the last.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, size = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while size < depth:
            step = min(size, depth - size)
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            size += step
        self.places = np.argsort(rank, kind="stable").astype(np.int32)
        symbols = text[self.places - 1].astype(np.int64)
        top = int(text.max()) + 1 if n else 1
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top)))).astype(np.int64)
        self.levels = []
        for bit in range(max(1, int(top - 1).bit_length()) - 1, -1, -1):
            one = (symbols >> bit & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            bits = np.packbits(one, bitorder="little")
            packed[: len(bits)] = bits
            packed = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed))[:-1])).astype(np.int64)
            zeros = int(n - one.sum())
            self.levels.append((bit, packed, before, zeros))
            symbols = np.concatenate((symbols[~one], symbols[one]))
        self.first = self._through(np.arange(top), np.zeros(top, np.int64))

    def _through(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, before, zeros in self.levels:
            block = at >> 6
            ones = before[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Suffixes that begin with the symbol before one that stands before ``at``."""
        return self.below[symbol] + self._through(symbol, at) - self.first[symbol]

    def search(self, text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indices k for which text[at[k] : at[k] + length] stands elsewhere too, first and end of their range in ``places``)."""
        alive = np.arange(len(at))
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.places), np.int64)
        for j in range(length - 1, -1, -1):
            symbol = text[at[alive] + j].astype(np.int64)
            low, high = self.step(symbol, low), self.step(symbol, high)
            more = high - low > 1
            alive, low, high = alive[more], low[more], high[more]
        return alive, low, high


def repeated_windows(segments: list[tuple], window: int) -> list[tuple]:
    """(doc_id, text_key, start, stop) spans of words whose windows also start earlier.

    ``segments``: (anchor, doc_id, text_key, start, windows, words) of whole anchors; words may be
    null, which says that an equal segment with words stands earlier.
    """
    out, seen, left = [], {}, []
    per_anchor: dict[int, int] = {}
    for anchor, doc_id, key, start, windows, text in segments:  # by anchor, document and start
        if text is None:
            out.append((doc_id, key, start, start + windows + window - 1))
            continue
        words = tuple(text.encode().split())
        known = seen.get((anchor, words))
        if known is None:
            known = seen[anchor, words] = (doc_id, start, anchor, {key}, windows, words)
            left.append(known)
            per_anchor[anchor] = per_anchor.get(anchor, 0) + 1
        elif known[:2] < (doc_id, start):
            out.append((doc_id, key, start, start + windows + window - 1))
        else:  # another text of the same document: judged with the first
            known[3].add(key)
    left = [s for s in left if per_anchor[s[2]] > 1]
    if not left:
        return out
    left.sort(key=lambda s: (s[0], s[1]))
    symbols: dict[bytes, int] = {}
    text, starts = [], []
    for s in left:
        starts.append(len(text))
        text += [symbols.setdefault(w, len(symbols) + 1) for w in s[5]]
        text.append(0)
    text = np.array(text, np.int32)
    index = FMIndex(text, window)
    counts = np.array([s[4] for s in left])
    owner = np.repeat(np.arange(len(left)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.array(starts)[owner] + nth
    doc, begin = np.array([s[0] for s in left], np.int64)[owner], np.array([s[1] for s in left], np.int64)[owner] + nth
    # windows by document and start; those of several texts of one document at one start are equally old
    order = np.lexsort((begin, doc))
    new = np.append(True, (doc[order[1:]] != doc[order[:-1]]) | (begin[order[1:]] != begin[order[:-1]]))
    age = np.zeros(len(text) + 1, np.int64)
    age[at[order]] = np.cumsum(new)
    hit, low, high = index.search(text, at, window)
    if not len(hit):
        return out
    # equal windows have one range in the index, others have ranges apart from it
    ranges, pick, mine = np.unique(low, return_index=True, return_inverse=True)
    edges = np.column_stack((ranges, high[pick])).reshape(-1)
    oldest = np.minimum.reduceat(np.append(age[index.places], 0), edges)[::2]
    for k in hit[age[at[hit]] > oldest[mine]].tolist():
        here = int(begin[k])
        out += [(int(doc[k]), key, here, here + window) for key in left[owner[k]][3]]
    return out


def _search_shards(window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        words, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if words >= most and row[0] != last:
                    yield from _span_batches(repeated_windows(held, window))
                    held, words = [], 0
                held.append(row)
                last = row[0]
                words += row[4] + window
        if held:
            yield from _span_batches(repeated_windows(held, window))

    return run


def _span_batches(spans: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(spans), 50_000):
        cols = list(zip(*spans[a : a + 50_000]))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["doc_id", "text_key", "start", "stop"])


# --- results ---------------------------------------------------------------------------------


def keep_words(text: str | None, spans: list) -> tuple[list[bytes], int]:
    """(kept words, removed words) of a text without the words in the spans."""
    words = (text or "").encode().split()  # at blanks and control characters from tab to carriage return
    if not spans:
        return words, 0
    gone = np.zeros(len(words) + 1, np.int32)
    for start, stop in spans:
        gone[start] += 1
        gone[stop] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    return [w for w, c in zip(words, covered) if not c], int(covered.sum())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, digests = [], [], []
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                kept, gone = keep_words(text, [(s["start"], s["stop"]) for s in spans or ()])
                total.append(len(kept) + gone)
                removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


_NO_ID = -(1 << 63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (null: the smallest number), text, a key of the text, and place, the id or for a null the text's key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.col(id_col).cast("long")
    return docs.select(F.coalesce(own, F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), F.coalesce(own, F.xxhash64(text)).alias("place"))


def _wanted_places(anchors: DataFrame, hot_segments: int) -> DataFrame:
    """place, places of the segments whose anchor occurs more than once, and those anchors of them that are hot."""
    # counted over one row an anchor and batch, so no anchor is hot here
    firsts = anchors.where("kind % 4 > 0").withColumn("n", F.count("*").over(Window.partitionBy("anchor")))
    shared = firsts.where("n > 1 OR kind % 4 = 2").select("anchor", "place", "pos").unionByName(anchors.where("kind % 4 = 0").select("anchor", "place", "pos"))
    hot = stored(anchors.where("kind >= 4").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") * COUNTED > hot_segments).select("anchor", F.col("anchor").alias("hot")))
    found = hot.count()
    if not found:
        return shared.groupBy("place").agg(F.collect_set("pos").alias("places")).withColumn("hot", F.array().cast("array<long>"))
    marked = shared.join(F.broadcast(hot) if found <= HOT_BROADCAST else hot, "anchor", "left")
    return marked.groupBy("place").agg(F.collect_set("pos").alias("places"), F.collect_set("hot").alias("hot"))  # one document's own


def repeated_spans(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, hot_segments: int = HOT_SEGMENTS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, text_key, start, stop``: words covered by windows whose words also start earlier.

    Windows are dealt to shards by their anchor, the smallest hash among their grams of ``gram``
    words, so equal windows meet. Runs of windows with one anchor make a segment. Anchors that
    occur once are dropped; the segments of the others go to their shards with their words, equal
    ones of a batch once. Windows of an anchor with more than ``hot_segments`` different segments
    (a frequent phrase with ever other words around it) are dealt by all their words instead, so no
    phrase fills a shard. A shard indexes its segments (``FMIndex``) and streams them through
    backward search; a window is reported if the earliest of its places belongs to a smaller
    document or an earlier start.
    """
    keyed = _keyed(docs, id_col, text_col)
    anchors = stored(keyed.select("place", "text").mapInArrow(_anchor_rows(window, gram, COUNTED), _ANCHORS))
    texts = keyed.join(_wanted_places(anchors, hot_segments), "place").select("doc_id", "text_key", "text", "places", "hot")
    segments = texts.mapInArrow(_segment_rows(window, gram), _SEGMENTS)
    dealt = segments.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    return dealt.mapInArrow(_search_shards(window, shard_words), _SPANS)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row of ``docs`` after removing repeated passages.

    A word goes if a window of ``window`` consecutive words covers it whose words also start
    earlier: in a smaller document, or earlier in the same one; windows are judged on the input.
    kept_sha256 is of the kept words joined by one blank. Null and empty texts have no words. A
    null id is smaller than any; rows that share an id are one document with several texts, whose
    windows at the same start do not count as earlier. Other columns are ignored, whatever their
    names, an empty table gives an empty result, a text of any length is one row's work.
    """
    spans = repeated_spans(docs, window, id_col=id_col, text_col=text_col)
    place = F.when(F.col("doc_id") == _NO_ID, F.col("text_key")).otherwise(F.col("doc_id")).alias("place")
    by_place = spans.distinct().groupBy(place).agg(F.collect_list(F.struct("text_key", "start", "stop")).alias("spans"))
    mine = F.filter("spans", lambda s: s["text_key"] == F.col("text_key"))
    # by place again, so that the texts are shuffled once for both joins
    rows = _keyed(docs, id_col, text_col).join(by_place, "place", "left").select("doc_id", "text", mine.alias("spans"))
    done = rows.mapInArrow(_digest, _RESULT)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
