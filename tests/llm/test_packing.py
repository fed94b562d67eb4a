import zlib

import numpy as np
import pytest

from valuetide.llm.packing import _PIECE_PATTERN, WINDOW, Encoder, pack, sequence_lengths, vocabulary_path

from .helpers import docs_frame, odd_docs


def reference_ids(texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary_path())
    coder.encode_special_tokens = True
    return [np.array([*e.ids, 1], "<u4") for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, rows):
    ids = {}
    for (doc_id, *_), want in zip(rows, reference_ids([r[1] for r in rows])):
        ids.setdefault(doc_id, []).append(want)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids.keys()
    for doc_id, copies in ids.items():
        want = copies[0]
        seen = np.zeros(len(want), int)
        for p in by_doc[doc_id]:
            assert p.doc_tokens == len(want) and zlib.crc32(want[p.start : p.start + p.length].tobytes()) == p.ids_crc32
            seen[p.start : p.start + p.length] += 1
        assert (seen == len(copies)).all()
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= WINDOW
    return by_sequence


def test_odd_cases(spark):
    rows = odd_docs()
    check(pack(docs_frame(spark, rows)).collect(), rows)
    assert pack(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("tasks", [1, 70])
def test_whole_table(spark, tasks):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(tasks, "doc_id").select("doc_id", "text")
    pieces = pack(docs)
    sequences = check(pieces.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    total = sequence_lengths(spark, pieces).groupBy().sum("tokens", "padding").first()
    assert total[1] / (total[0] + total[1]) < 0.03 and len(sequences) > 100


def test_ids_of_odd_texts():
    coder = Encoder(vocabulary_path())
    texts = ["a  b\n\n c\t", "don't we'll", "<|endoftext|> x", "漢字 été ñ x", "x" * 3000, " \n ", "\r\n1 2  3"]
    assert [coder.ids(t) for t in texts] == [w[:-1].tobytes() for w in reference_ids(texts)]


def plain_ids(texts):
    """Of the unmodified reference."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary_path())
    return [np.array(coder.encode(t, add_special_tokens=False).ids, "<u4") for t in texts]


HARD = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "a" + " " * 1_000_000 + "b", "\n \t" * 5_000, "\u3000" * 20_000 + "x", " " * 9_999 + "x"]


def test_added_tokens_and_long_blanks():
    coder = Encoder(vocabulary_path(), special_as_text=False)
    assert [coder.ids(t) for t in HARD] == [w.tobytes() for w in plain_ids(HARD)]
    assert np.frombuffer(coder.ids(HARD[0]), "<u4").tolist() == [64, 220, 50256, 275]


def test_packed_added_tokens(spark):
    rows = [(k, t, "en", "a") for k, t in enumerate(HARD)]
    pieces = pack(docs_frame(spark, rows)).collect()
    for k, want in enumerate(plain_ids(HARD)):
        want = np.append(want, 1).astype("<u4")
        mine = sorted((p for p in pieces if p.doc_id == k), key=lambda p: p.start)
        assert sum(p.length for p in mine) == len(want)
        assert all(p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(want[p.start : p.start + p.length].tobytes()) for p in mine)


def test_faster_encoder_gives_the_same_ids():
    """Merges in the order of ids, tokens that merge to themselves, and every code point of the same kind: what equality rests on."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary_path(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    assert made == sorted(set(made)) and not model["ignore_merges"]
    coder = Tokenizer.from_file(vocabulary_path())
    assert all(len(coder.model.tokenize(t)) == 1 for t in vocab)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for before in "a1!":  # a letter, a number, neither: which of them takes the code point into its piece
        ranks = {bytes([b]): b for b in range(256)}
        for c in points:
            word = (before + c).encode()
            for k in range(2, len(word) + 1):
                ranks.setdefault(word[:k], len(ranks))
        fast = tiktoken.Encoding("kinds", pat_str=_PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [c for c in points if (len(fast.encode_ordinary(before + c)) == 1) != (len(coder.pre_tokenizer.pre_tokenize_str(before + c)) == 1)] == []
