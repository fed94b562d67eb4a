"""Small fixtures: documents with every odd case."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands int, node string, row int, size int, grp string, words string, `_id` int"


def docs_frame(spark, rows):
    """Rows of (doc_id, text, lang, source) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", 2, 3, "g", "w", 4) for i, t, lang, s in rows], DOC_SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_docs():
    base = prose(1, 120)
    near = base.replace("w", "w", 1).split()
    near[60] = "changed"
    passage = prose(2, 60)
    return [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(near), "en", "a"),
        (4, None, "en", None),
        (5, "", None, "b"),
        (6, " \t\n ", "en", "b"),
        (7, "one two three", "de", "b"),
        (7, "one two three", "de", "b"),
        (8, prose(3, 50) + "\n" + passage + "\n" + prose(4, 30), "en", "a"),
        (9, prose(5, 10) + " " + passage.replace(" ", "  "), "fr", "c"),
        (10, prose(6, 6000), "en", "a"),
        (11, "123 456 !!!", "en", "c"),
        (12, "a " * 80, "en", None),
        (None, prose(7, 40), "en", "a"),
        (13, "été à la plage avec une île ñandú 漢字", "fr", "d"),
    ]
