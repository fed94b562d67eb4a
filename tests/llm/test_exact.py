import hashlib
import os

from valuetide.llm.exact_dedup import CuckooIndex, exact_dedup

from .helpers import docs_frame, odd_docs


def test_index_against_a_dict():
    index, live = CuckooIndex(buckets=2), {}
    digests = [hashlib.sha256(str(k % 700).encode()).digest() for k in range(3000)]
    for k, d in enumerate(digests):
        if k % 3 == 2 and d in live:
            assert index.delete(d)
            del live[d]
        elif d not in live:
            index.insert(d, k)
            live[d] = k
        assert index.find(d) == live.get(d)
    assert dict(index.items()) == live and index.count == len(live) and index.resizes > 0
    assert not index.delete(os.urandom(32))


def test_groups(spark):
    rows = odd_docs()
    got = sorted(map(tuple, exact_dedup(docs_frame(spark, rows)).collect()), key=str)
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert exact_dedup(docs_frame(spark, [])).count() == 0


def test_a_group_of_most_rows(spark):
    got = exact_dedup(docs_frame(spark, [(i, "same" if i % 3 else f"t{i}", "en", "a") for i in range(600)]))
    assert {r.keep_id for r in got.where("group_size > 1").collect()} == {599}
    assert got.where("kept").count() == 201
