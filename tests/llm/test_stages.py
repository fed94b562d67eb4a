import hashlib
import random
from collections import Counter

import corpus_pipeline
from valuetide.llm.packing import Encoder, vocabulary_path
from valuetide.llm.stages import dedup_exact, dedup_near, mix

from .helpers import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample():
    rows = [(k, prose(k, 40 + 7 * k), "en", "abc"[k % 3]) for k in range(12)]
    changed = rows[11][1].split()
    changed[50] = "changed"
    rows += [rows[1]] * 4 + [rows[2]] * 2
    rows += [(3, prose(33, 33), "en", "a"), (3, prose(34, 51), "en", "a"), (3, rows[3][1], "en", "a")]  # one id, several texts
    rows += [(None, prose(40 + k, 20 + k), "en", "b") for k in range(3)] + [(None, rows[4][1], "en", "b")] * 3 + [(None, prose(41, 21), "en", "b")]
    rows += [(90, " ".join(changed), "en", "c"), (None, " ".join(changed[:-1]), "en", None), (91, None, "en", "a"), (92, "", "en", "a")]
    random.Random(1).shuffle(rows)
    return [(*r, len(r[1] or "")) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    return Counter(map(tuple, df.collect()))


def exact(rows):
    best = {}
    for r in rows:
        kept = best.get(r[1] or "")
        if kept is None or (-1 if kept[0] is None else kept[0]) < (-1 if r[0] is None else r[0]):
            best[r[1] or ""] = r
    return list(best.values())


def near(rows):
    def shingles(text):
        words = (text or "").split()
        return Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))

    bags = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            either = sum((bags[a] | bags[b]).values())
            if either and sum((bags[a] & bags[b]).values()) >= 0.8 * either:
                root[find(a)] = find(b)
    best = {}
    for k, r in enumerate(rows):
        kept = best.get(find(k))
        if kept is None or (kept[0] is None, kept[0] or 0) > (r[0] is None, r[0] or 0):
            best[find(k)] = r
    return list(best.values())


def quotas(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    fixed = {}
    while True:  # a source that would pass 3 times its size stops there
        free = [s for s in names if s not in fixed]
        level = (sum(sizes.values()) - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return sizes, {s: fixed.get(s, int(level * weight[s] + 1e-6)) for s in names}
        fixed |= {s: 3 * sizes[s] for s in over}


def mixed(rows):
    out = Counter()
    sizes, quota = quotas(rows)
    for source, left in quota.items():
        mine = [r for r in rows if r[3] == source]
        mine.sort(key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], r[0] is not None, r[0] or 0, len((r[1] or "").split())))
        while left:
            for r in mine:
                words = (r[1] or "").split()[:left]
                left -= len(words)
                if words:
                    text = r[1] if len(words) == len(r[1].split()) else " ".join(words)
                    out[(r[0], text, r[2], r[3], len(text))] += 1
    return out


def test_stages_with_repeated_rows_and_null_ids(spark):
    rows = sample()
    once = plain(dedup_exact(spark, frame(spark, rows), ""))
    assert once == Counter(exact(rows)) and sum(once.values()) < len(rows)
    assert plain(dedup_near(spark, frame(spark, rows), "")) == Counter(near(rows))
    for some in (rows, [(1, prose(1, 16), "en", "a", 0)] * 2 + [(2, prose(2, 100), "en", "b", 0)]):
        got = plain(mix(spark, frame(spark, [(*r[:4], len(r[1] or "")) for r in some]), ""))
        assert got == mixed(some)
        words = Counter()
        for r, n in got.items():
            words[r[3]] += n * len(r[1].split())
        assert words == {s: n for s, n in quotas(some)[1].items() if n}


def test_whole_pipeline(spark, tmp_path):
    rows = sample()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")  # nothing is called toxic
    coder = Encoder(vocabulary_path(), special_as_text=False)
    want, got = Counter(), Counter()
    for r, n in mixed(near(exact(rows))).items():
        want[r[0]] += n * (len(coder.ids(r[1])) // 4 + 1)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[p.doc_id] += p.length
    assert got == want


CLASH = SCHEMA + ", _size int, _text string, _words string, _first string, _stage_row string, _row int, `row` string, `words` string, `used` string, _class int, _gone string"


def odd_frame(spark, rows):
    extra = (5, "own text", "own words", "own first", "own row", 7, "r", "w", "u", 3, "g")
    return spark.createDataFrame([(*r, *extra) for r in rows], CLASH), extra


def labelled(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_every_stage_keeps_clashing_columns(spark, tmp_path):
    from valuetide.llm.stages import drop_toxic

    rows = sample()
    docs, extra = odd_frame(spark, rows)
    home = labelled(spark, tmp_path, [(k, 1, 0) for k in range(12)])
    for stage in (drop_toxic, dedup_exact, dedup_near, mix):
        out = stage(spark, docs, home)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got, want = out.collect(), stage(spark, frame(spark, rows), home).collect()
        assert all(tuple(r[5:]) == extra for r in got)
        assert Counter(tuple(r[1:5]) for r in got) == Counter(tuple(r[1:5]) for r in want)


def test_every_stage_takes_an_empty_table_and_a_long_text(spark, tmp_path):
    from valuetide.llm.stages import drop_toxic

    home = labelled(spark, tmp_path, [(1, 1, 0)])
    long = (1, prose(1, 150_000), "en", "a", 9)
    for stage in (drop_toxic, dedup_exact, dedup_near, mix):
        assert stage(spark, frame(spark, []), home).count() == 0
        kept = stage(spark, frame(spark, [long, (2, prose(2, 60), "en", "a", 5)]), home).where("doc_id = 1").collect()
        assert kept and all(r.text == long[1] for r in kept)


def test_the_toxicity_stage_with_labels(spark, tmp_path):
    from valuetide.llm.stages import drop_toxic

    rows = [(k, prose(k, 60) + (" vile hateful slur scum" * 3 if k % 4 == 0 else ""), "en", "a", 1) for k in range(400)] + [(900, None, "en", "a", 0), (901, "", "en", "a", 0)]
    home = labelled(spark, tmp_path, [(k, 1, int(k % 4 == 0)) for k in range(300)])
    kept = {r.doc_id for r in drop_toxic(spark, frame(spark, rows), home).collect()}
    assert not {k for k in range(300, 400) if k % 4 == 0} & kept and {900, 901} <= kept
    assert len({k for k in range(300, 400) if k % 4} - kept) <= 2
