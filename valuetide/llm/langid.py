"""Language identification by cross-parsing against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuetide.llm.common import text_parts

#: Bound of the learning sample: rows per language, then UTF-8 bytes per language.
SAMPLE_ROWS = 64
SAMPLE_BYTES = 50_000
#: Symbols that are parsed side by side as one block; phrases run on over the edges of blocks.
BLOCK = 512

_OUTPUT = "doc_id long, held_out boolean, lang_pred string, score double"


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def _run_on(table: np.ndarray, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, nth: np.ndarray, end: np.ndarray, count: np.ndarray) -> None:
    """Mend ``end`` and ``count`` of blocks parsed from the start state, so that each goes on from the state its predecessor ended in.

    Both parses of a block go side by side until they are in the same state, mostly after a phrase
    or two; from there on the block is right as it is. Blocks that never get there have another end,
    and their successors are mended once more, in order, so the work stays in proportion to the text.
    """
    later = np.flatnonzero(nth > 0)
    entry = np.zeros_like(end)
    entry[later] = end[later - 1]
    live, old, new, j = later, np.zeros(len(later), end.dtype), entry[later], 0
    moved = []
    while len(live):
        c = symbols[start[live] + j].astype(np.int32)
        old, new = table.take((old >> 1) + c), table.take((new >> 1) + c)
        count[live] += (new & 1) - (old & 1)
        j += 1
        apart, over = (old >> 1) != (new >> 1), size[live] == j
        end[live[apart & over]] = new[apart & over]
        moved.append(live[apart & over])
        on = apart & ~over
        live, old, new = live[on], old[on], new[on]
    cells = memoryview(table)
    for at in np.sort(np.concatenate(moved)).tolist() if moved else []:
        at += 1
        while at < len(nth) and nth[at] and end[at - 1] >> 1 != entry[at] >> 1:
            before, now, more = int(entry[at]), int(end[at - 1]), 0
            entry[at] = now
            for c in symbols[start[at] : start[at] + size[at]].tolist():
                before, now = cells[(before >> 1) + c], cells[(now >> 1) + c]
                more += (now & 1) - (before & 1)
                if before >> 1 == now >> 1:
                    break
            else:
                end[at] = now
            count[at] += more
            at += 1


class CrossParser:
    """One automaton per language over the bytes of lower-cased text, every run of other ASCII being one blank."""

    def __init__(self, samples: dict[str, list[str]], max_bytes: int = SAMPLE_BYTES):
        self.langs = sorted(samples)
        raws = [" \n ".join(samples[lang]).encode()[:max_bytes] for lang in self.langs]
        code = np.zeros(256, np.int64)
        seen = np.unique(np.frombuffer(b"".join(raws), np.uint8)) if raws else np.zeros(0, np.uint8)
        used = sorted({*range(97, 123)} | {int(b) for b in seen if b >= 128})
        for k, byte in enumerate(used, 1):
            code[byte] = k
        code[128:][code[128:] == 0] = len(used) + 1  # bytes that no sample has
        code[65:91] = code[97:123]
        self.code, self.width = code, len(used) + 2
        self.tables, self.cost = [], []
        for raw in raws:
            symbols, _ = self.symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            moves = suffix_automaton(symbols.tolist())
            table = np.full((len(moves), self.width), -1, np.int64)
            for state, out in enumerate(moves):
                table[state, list(out)] = list(out.values())
            start = np.where(table[0] < 0, 0, table[0])
            missing = table < 0
            missing[0] = True  # a phrase begins at the start state
            flat = np.where(table < 0, start[None, :], table) * self.width * 2 + missing
            self.tables.append(flat.astype(np.int32).reshape(-1))
            self.cost.append(float(np.log2(len(symbols) + 2)))

    def symbols(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with blanks collapsed, and each row's offsets in them."""
        all_ = self.code[raw]
        keep = all_ > 0
        keep[1:] |= all_[:-1] > 0
        keep[offsets[(offsets < len(raw))]] = all_[offsets[offsets < len(raw)]] > 0  # no blank at a row's start
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        return all_[keep], at[offsets]

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each row against each language: a phrase is the longest match with the sample, then a new one begins.

        The blocks of a row are parsed side by side as if a phrase began at each; ``_run_on`` then mends their heads.
        """
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        row = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[row] + nth * BLOCK
        size = np.minimum(sizes[row] - nth * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        begin, falling = start[order], -size[order]
        active = np.searchsorted(falling, -np.arange(BLOCK), side="left")
        out = np.zeros((len(self.langs), n), np.int64)
        states = [np.zeros(len(row), np.int32) for _ in self.langs]
        counts = [np.zeros(len(row), np.int32) for _ in self.langs]
        for j in range(int(-falling[0]) if len(row) else 0):
            m = int(active[j])
            c = symbols[begin[:m] + j].astype(np.int32)
            for table, state, count in zip(self.tables, states, counts):
                got = table.take((state[:m] >> 1) + c)
                count[:m] += got & 1
                state[:m] = got
        place = np.argsort(order)
        for k, table in enumerate(self.tables):
            end, count = states[k][place], counts[k][place]
            _run_on(table, symbols, start, size, nth, end, count)
            out[k] = np.bincount(row, count, n).astype(np.int64)
        return out

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        symbols, at = self.symbols(raw, offsets)
        n = len(offsets) - 1
        if not self.langs or not len(symbols):
            return ["und"] * n, np.zeros(n)
        bits = self.phrases(symbols, at) * np.array(self.cost)[:, None]
        best = bits.argmin(axis=0)
        low = bits[best, np.arange(n)]
        bits[best, np.arange(n)] = np.inf
        second = bits.min(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isfinite(second), 1 - low / second, 1.0)
        return [self.langs[k] for k in best], np.nan_to_num(score)


def language_samples(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> dict[str, list[str]]:
    """At most ``rows`` labelled texts per language, the same ones at every run."""
    pick = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    slots = labelled.groupBy(F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(rows)).alias("slot")).agg(F.min(pick).alias("pick"))
    picks = {(r.lang, r.pick) for r in slots.collect()}  # rows x languages at most
    if not picks:
        return {}
    chosen = labelled.where(pick.isin([p for _, p in picks])).select(F.col(lang_col).alias("lang"), pick.alias("pick"), F.col(text_col).alias("text"))
    once = chosen.groupBy("lang", "pick").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(once.collect(), key=lambda r: (r.lang, r.pick)):
        if (r.lang, r.pick) in picks:
            out.setdefault(r.lang, []).append(r.text)
    return out


def identify_language(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out=None) -> DataFrame:
    """The language of every whole text of ``docs``: ``doc_id, held_out, lang_pred, score``.

    ``learn`` gives the labelled texts; a bounded sample of them is read (SAMPLE_ROWS texts and
    SAMPLE_BYTES bytes per language). Each text is parsed greedily into the longest phrases that
    a language's sample holds; the language with the fewest phrases, each weighted with the
    logarithm of the sample's length, wins; ties go to the smaller language name. ``score`` is
    the share by which it beats the next one (1 if there is no other).

    A null text, one without a letter, or an empty ``learn`` gives ``und`` with score 0. Repeated
    rows each get their row; further columns of the input are ignored; very long texts are parsed
    whole, and phrases run over any place. There is no shuffle: the automata go to the tasks, bounded by the sample.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(CrossParser(language_samples(learn, id_col, text_col, lang_col, SAMPLE_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = model.value
        for batch in batches:
            langs, scores = [], []
            lettered = batch.column(3)
            for _, _, raw, offsets in text_parts(batch.column(1)):
                names, score = parser.predict(raw, offsets)
                langs += names
                scores.append(score)
            known = np.array(lettered.to_pylist(), bool) if len(lettered) else np.zeros(0, bool)
            score = np.concatenate(scores) if scores else np.zeros(0)
            names = [lang if ok else "und" for lang, ok in zip(langs, known)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    held = F.lit(False) if held_out is None else held_out
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"), lettered.alias("lettered")).mapInArrow(run, _OUTPUT)


def fold_two() -> object:
    """The rows that the language query holds out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
