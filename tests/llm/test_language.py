import zlib

import numpy as np
from pyspark.sql import functions as F

from valuetide.llm.catalog import op1_language_id
from valuetide.llm.langid import CrossParser, identify_language, suffix_automaton

from .helpers import docs_frame, odd_docs, prose

SF = "/root/testdata/sf0.01"


def accepts(moves, word):
    state = 0
    for c in word:
        if c not in moves[state]:
            return False
        state = moves[state][c]
    return True


def test_automaton_accepts_exactly_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    moves = suffix_automaton(text)
    parts = {tuple(text[a:b]) for a in range(len(text)) for b in range(a, len(text) + 1)}
    assert all(accepts(moves, p) for p in parts)
    assert not any(accepts(moves, p) for p in [(3, 3), (2, 2), (1, 1, 1), (4,)])


def plain_phrases(parser, samples, text):
    def norm(t):
        return parser.symbols(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist()

    sample, got = norm(" \n ".join(samples)), norm(text)
    held = {tuple(sample[a:b]) for a in range(len(sample)) for b in range(a + 1, min(len(sample), a + 60) + 1)}
    n = at = 0
    while at < len(got):
        size = 1
        while at + size < len(got) and tuple(got[at : at + size + 1]) in held:
            size += 1
        n += 1
        at += size
    return n


def counted(parser, texts):
    raws = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raws])
    return parser.phrases(*parser.symbols(np.frombuffer(b"".join(raws), np.uint8), offsets))


def test_phrases_against_plain_search():
    samples = {"en": ["the cat and the dog ran over the hill"], "fr": ["le chat et le chien sur la colline où"]}
    parser = CrossParser(samples)
    texts = ["the dog and the cat", "Le CHAT, et 12 le chien!", "zzz", "où où", "", "the " * 400, "the dog ran over le chat et " * 300, "sur la "]
    got = counted(parser, texts)
    for k, lang in enumerate(parser.langs):
        assert got[k].tolist() == [plain_phrases(parser, samples[lang], t) for t in texts]


def test_phrases_run_over_blocks():
    pick = np.random.default_rng(5)
    samples = {"few": ["aaaaa"], "odd": ["abcabcaab", "ccc"], "two": ["".join(pick.choice(list("ab"), 300))]}
    parser = CrossParser(samples)
    texts = ["a" * n for n in (511, 512, 513, 1024, 5003)]  # phrases of five never fall in step with a block
    texts += ["".join(pick.choice(list("abc"), n)) for n in (700, 3000, 10_000)] + ["ab" * 2000, "aaaab" * 900 + "c" * 600]
    got = counted(parser, texts)
    for k, lang in enumerate(parser.langs):
        assert got[k].tolist() == [plain_phrases(parser, samples[lang], t) for t in texts]


def test_odd_cases(spark):
    rows = odd_docs()
    docs = docs_frame(spark, rows)
    got = identify_language(docs, docs.where("lang IS NOT NULL")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (4, 5, 6, 11))
    assert by_id[13].lang_pred == "fr" and all(0 <= r.score <= 1 for r in got)
    none = identify_language(docs, docs.where("false")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert identify_language(docs.where("false"), docs).count() == 0
    one = identify_language(docs_frame(spark, [(1, prose(1, 5), "en", "a")]), docs.where("lang = 'en'")).first()
    assert (one.lang_pred, one.score) == ("en", 1.0)


def test_held_out_accuracy(spark):
    rows = op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    changed = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    a = identify_language(docs, docs.where(~held)).orderBy("doc_id").collect()
    b = identify_language(changed, changed.where(~held)).orderBy("doc_id").collect()
    assert a == b
