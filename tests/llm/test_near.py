from collections import Counter

import numpy as np

from valuetide.operators.components import components
from valuetide.llm.near_dedup import dart_signatures, near_duplicates, weighted_jaccard

from .helpers import docs_frame, odd_docs, prose


def classes(rows, limit=0.8):
    """Smallest id by row, from all pairs."""
    bags = []
    for _, text, *_ in rows:
        w = (text or "").split()
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            shared = sum((bags[a] & bags[b]).values())
            total = sum((bags[a] | bags[b]).values())
            if total and shared / total >= limit:
                root[max(find(a), find(b))] = min(find(a), find(b))
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(rows[k][0])
    return {k: (min((i for i in members[find(k)] if i is not None), default=None), len(members[find(k)])) for k in range(len(rows))}


def held(spark, rows):
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in near_duplicates(docs_frame(spark, rows)).collect())
    want = Counter((rows[k][0], c if rows[k][0] is not None or c is not None else None, n) for k, (c, n) in classes(rows).items())
    assert got == want


def test_odd_cases(spark):
    held(spark, odd_docs())
    assert near_duplicates(docs_frame(spark, [])).count() == 0


def test_groups_and_chains(spark):
    rows = []
    for g in range(6):
        words = prose(g, 150).split()
        for k in range(12):  # copies that drift: neighbours are near, the ends are not
            words = [*words]
            words[(7 + 11 * k) % 150] = f"g{g}k{k}"
            rows.append((100 * g + k, " ".join(words), "en", "a"))
    held(spark, rows + [(1000 + k, prose(50 + k, 90), "en", "a") for k in range(40)])


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(3)
    elements = rng.integers(1, 2**62, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    wa[:40] = 0
    a, b = elements[wa > 0], elements
    row = np.concatenate((np.zeros(len(a), int), np.ones(len(b), int)))
    signature = dart_signatures(row, np.concatenate((a, b)), np.concatenate((wa[wa > 0], wb)), 2, 1024)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((signature[0] == signature[1]).mean() - want) < 0.06
    order = np.argsort(elements)
    assert abs(weighted_jaccard((np.sort(a), wa[wa > 0][np.argsort(a)]), (elements[order], wb[order])) - want) < 1e-12


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 300), (5, 5), (100, 300), (1, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
