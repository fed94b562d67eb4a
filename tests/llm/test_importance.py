import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import docs_frame, odd_docs, prose
from valuetide.llm.importance import cutoff_key, resample


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [zlib.crc32(w.encode()) % 10000 for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)]


def plain(docs, target, percent=10):
    """(doc_id, n_features, weight, score, rank); equal rows may swap ranks."""
    s = Counter(b for _, t in docs for b in features(t))
    t = Counter(b for x in target for b in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(float((t[b] + 1) * (S + 10000)) / float((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    open_ = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(open_[: percent * len(open_) // 100]):
        ranks.setdefault(r, []).append(k + 1)
    return Counter((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in rows)


def run(spark, rows, target, **options):
    corpus = docs_frame(spark, rows).withColumnRenamed("bands", "buckets").withColumnRenamed("node", "score")
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    return Counter(tuple(r) for r in resample(corpus, wanted, **options).collect())


def test_odd_documents(spark):
    rows, target = odd_docs(), [prose(2, 100), None, "été ÎLE Été"]
    for percent in (0, 10, 50, 100):
        assert run(spark, rows, target, percent=percent) == plain([r[:2] for r in rows], target, percent)


def test_ranks_with_ties_and_a_hot_group(spark):
    rows = [(k, prose(k, 30), "en", "a") for k in range(200)] + [(5000, prose(1, 25), "en", "a")] * 150 + [(None, prose(1, 25), "en", "a")] * 3
    rows.append((6000, prose(3, 100_000), "en", "a"))
    assert run(spark, rows, [prose(1, 50)], percent=30) == plain([r[:2] for r in rows], [prose(1, 50)], 30)


def test_empty_tables(spark):
    assert not run(spark, [], ["a b"])
    assert run(spark, odd_docs(), []) == plain([r[:2] for r in odd_docs()], [])


@pytest.mark.parametrize("wanted", [1, 2, 333, 999, 1000])
def test_the_cutoff_is_exact(spark, wanted):
    keys = [((k * 7919) % 50, k % 7 == 0, (k * 31) % 40, k) for k in range(1000)]
    table = spark.createDataFrame([(s, int(n), d, r) for s, n, d, r in keys], "score long, no_id long, doc_id long, row long").repartition(7)
    best = sorted(((s, int(n), d, r) for s, n, d, r in keys), key=lambda k: (-k[0], *k[1:]))
    assert cutoff_key(table, wanted, last_keys=3) == best[wanted - 1]
