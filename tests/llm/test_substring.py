import hashlib

import numpy as np

from valuetide.llm import substring_dedup as module
from valuetide.llm.substring_dedup import FMIndex, repeated_spans, substring_dedup, window_anchors

from .helpers import docs_frame, odd_docs, prose


def plain(rows, window=20):
    texts = [((-1 if i is None else i), (t or "").encode().split(), i) for i, t, *_ in rows]
    first = {}
    for i, words, _ in texts:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, words, own in texts:
        gone = np.zeros(len(words), bool)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < (i, k):
                gone[k : k + window] = True
        out.append((own, len(words), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def held(spark, rows):
    assert sorted(map(tuple, substring_dedup(docs_frame(spark, rows)).collect()), key=str) == plain(rows)


def test_odd_cases(spark):
    held(spark, odd_docs())
    assert substring_dedup(docs_frame(spark, [])).count() == 0


def test_repeats(spark):
    shared = [prose(k, 45) for k in range(4)]
    rows = [(k, " ".join([prose(100 + k, 30), shared[k % 4], prose(200 + k, 8), shared[(k * 7) % 4][: 120 + k]]), "en", "a") for k in range(60)]
    rows += [(500 + k, "x y " * 30 + "z", "en", "a") for k in range(5)] + [(600, "q " * 19, "en", "a"), (601, "q " * 19, "en", "a"), (602, "q " * 20, "en", "a"), (603, "q\t" * 20, "en", "a")]
    held(spark, rows)
    held(spark, [(1, "same id " + shared[0], "en", "a"), (1, "other " + shared[0], "en", "a"), (2, shared[1], "en", "a"), (2, shared[1], "en", "a")])


def test_small_shards_give_the_same(spark):
    rows = odd_docs() + [(50 + k, prose(1, 120), "en", "a") for k in range(10)]
    one = repeated_spans(docs_frame(spark, rows)).distinct().count()
    assert repeated_spans(docs_frame(spark, rows), shard_words=1).distinct().count() == one > 0


def test_hot_phrase_is_dealt_by_windows(spark, monkeypatch):
    phrase = "this form was filled in by"
    rows = [(k, f"{prose(k, 12)} {phrase} {prose(1000 + k % 90, 25)}", "en", "a") for k in range(240)]
    rows += [(300 + k, f"{prose(700, 16)} {phrase} {prose(800, 16)} {prose(900 + k, 20)}", "en", "a") for k in range(6)]
    rows += [(310, rows[0][1], "en", "a"), (310, rows[3][1], "en", "a"), (0, rows[5][1], "en", "a")]
    docs = docs_frame(spark, rows)
    want = {(d, k, w) for d, k, a, b in map(tuple, repeated_spans(docs).collect()) for w in range(a, b)}
    for most, counted in ((0, 1), (1, 1), (20, 1), (200, 1), (20, 8)):
        monkeypatch.setattr(module, "COUNTED", counted)
        got = repeated_spans(docs, hot_segments=most).collect()
        assert {(d, k, w) for d, k, a, b in map(tuple, got) for w in range(a, b)} == want
    held(spark, rows)


def test_hot_phrase_against_plain(spark, monkeypatch):
    monkeypatch.setattr(module, "COUNTED", 1)
    monkeypatch.setattr(repeated_spans, "__defaults__", (20, 6, 300_000, 2, "doc_id", "text"))
    held(spark, odd_docs())
    shared = [prose(k, 45) for k in range(4)]
    held(spark, [(k, " ".join([prose(100 + k, 30), shared[k % 4], prose(200 + k, 8), shared[(k * 7) % 4][: 120 + k]]), "en", "a") for k in range(60)])


def test_many_rows_without_id(spark):
    same = prose(1, 60)
    rows = [(None, same, "en", "a")] * 1500 + [(None, f"{prose(k, 30)} {same}", "en", "a") for k in range(2, 300)] + [(7, f"{prose(2000, 9)} {same}", "en", "a")]
    held(spark, rows)


def test_backward_search():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 300).astype(np.int32)
    text[::41] = 0
    text[-1] = 0
    index = FMIndex(text, 6)
    at = np.array([k for k in range(294) if 0 not in text[k : k + 6]])
    hit, low, _ = index.search(text, at, 6)
    first = dict(zip(at[hit].tolist(), index.places[low].tolist()))
    for k in at.tolist():
        e = first.get(k, -1)
        where = [j for j in range(295) if (text[j : j + 6] == text[k : k + 6]).all()]
        assert e == (where[0] if len(where) > 1 else -1)


def test_leftmost_smallest():
    values = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 0], np.uint64)
    for wide in range(1, 9):
        assert window_anchors(values, wide).tolist() == [k + int(values[k : k + wide].argmin()) for k in range(len(values) - wide + 1)]
