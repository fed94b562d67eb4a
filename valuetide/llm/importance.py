"""Target-distribution importance resampling: array-scored weights, then selection by weighted medians of partition medians."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuetide.llm.common import stored

#: A word after A-Z are lower-cased: digits, a to z, and all beyond ASCII.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10000
SEED = 2024
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
DRAWN_PERCENT = 10
#: So many keys at most are sorted in one task when the search for the cutoff ends.
LAST_KEYS = 4096

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = ["score", "no_id", "doc_id", "row"]


def feature_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each word of the text, repeats included; null has none."""
    words = F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(f"({FEATURE_WORD})"), F.lit(1))
    return F.coalesce(F.transform(words, lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int")), F.array().cast("array<int>"))


def bucket_counts(featured: DataFrame) -> DataFrame:
    """``bucket, n``; summed in each task first, so at most one row per bucket and task is shuffled."""
    return featured.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, ``gains``: for each bucket the floored 1000-fold logarithm of its smoothed share in the target by that in the corpus.

    Its size depends on the number of buckets alone.
    """
    grid = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = grid.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    counts = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    row = counts.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"), F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("cells"))
    ratio = lambda c: ((c["t"] + 1).cast("double") * (F.col("all_s") + buckets)) / ((c["s"] + 1).cast("double") * (F.col("all_t") + buckets))
    return row.select(F.transform("cells", lambda c: F.floor(F.lit(1000.0) * F.log(ratio(c))).cast("long")).alias("gains"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A document's fixed Gumbel noise, in floored thousandths."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((F.conv(digits, 16, 10).cast("long") + 0.5) / 4294967296.0))).cast("long")


def _partition_median(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The middle key of a partition, best first, and the number of its keys."""
    parts = [np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]) for b in batches if b.num_rows]
    if not parts:
        return
    score, no_id, doc_id, row = np.concatenate(parts, axis=1)
    n = len(score)
    middle = (n - 1) // 2
    value = -np.partition(-score, middle)[middle]
    ties = np.flatnonzero(score == value)
    at = ties[np.lexsort((row[ties], doc_id[ties], no_id[ties]))[middle - int((score > value).sum())]]
    yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (score[at], no_id[at], doc_id[at], row[at], n)], [*_KEY, "n"])


def _order(key: tuple) -> tuple:
    return (-key[0], *key[1:])


def _before(key: tuple, same: bool) -> Column:
    """Whether a row's key comes before ``key``, or is it."""
    score, no_id, doc_id, row = (F.col(k) for k in _KEY)
    last = row <= key[3] if same else row < key[3]
    by_id = (no_id < key[1]) | ((no_id == key[1]) & ((doc_id < key[2]) | ((doc_id == key[2]) & last)))
    return (score > key[0]) | ((score == key[0]) & by_id)


def cutoff_key(keys: DataFrame, wanted: int, last_keys: int = LAST_KEYS) -> tuple | None:
    """The ``wanted``-th best key of ``keys`` (score falling; no_id, doc_id, row rising), exactly; null for none.

    Each round every partition gives its median; the median of these, weighted by the partitions'
    remaining keys, has at least a quarter of the remaining keys on either side, so a quarter at least
    goes. Keys are only filtered and counted, never moved; the driver sees one key per partition. Not more than
    ``last_keys`` are left to sort in the end. Keys are distinct, as ``row`` is.
    """
    if wanted <= 0:
        return None
    left, above = keys.select(*_KEY), 0
    while True:
        medians = [tuple(r) for r in left.mapInArrow(_partition_median, "score long, no_id long, doc_id long, row long, n long").collect()]
        total = sum(m[4] for m in medians)
        if total <= last_keys:
            return tuple(left.orderBy(F.desc("score"), "no_id", "doc_id", "row").limit(wanted - above).agg(F.max(F.struct(-F.col("score"), "no_id", "doc_id", "row")).alias("k")).select(-F.col("k.col1"), "k.no_id", "k.doc_id", "k.row").first())
        seen = 0
        for *key, n in sorted(medians, key=lambda m: _order(m[:4])):
            seen += n
            if 2 * seen >= total:
                break
        pivot = tuple(key)
        upper = left.where(_before(pivot, same=True)).count()
        if above + upper >= wanted:
            left = left.where(_before(pivot, same=True))
        else:
            left, above = left.where(~_before(pivot, same=True)), above + upper


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... by their keys, sorted in ranges; only a count per range is carried over."""
    placed = stored(rows.repartitionByRange(F.desc("score"), "no_id", "doc_id", "row").sortWithinPartitions(F.desc("score"), "no_id", "doc_id", "row").withColumn("place", F.monotonically_increasing_id()))
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for c in counts:
        starts.append((c["part"], before))
        before += c["n"]
    offsets = rows.sparkSession.createDataFrame(starts, "part long, start long")
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("start") + inside + 1).drop("part", "start", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; rank is null where a row is not drawn.

    Documents are drawn without replacement, more likely the more their words are the target's: ``target``'s and the corpus's words
    are counted by hashed bucket over all rows, each bucket's gain is the logarithm of the smoothed shares, a
    document's weight the floored mean of its words' gains, its score that and fixed Gumbel noise. Of the rows
    with ``least_words`` words, ``percent`` of a hundred with the highest scores are drawn (rounded down).

    Texts are read once; the words' buckets are written and the rest works on them. A null or wordless text has no
    features and weight 0. Ties go to the smaller id, a null id after all others (its noise is that of the word null),
    then to the row that stands first in the written table, so that repeated rows count and are drawn each on its own.
    Very long texts are one array of bucket numbers. An empty corpus gives an empty result, an empty target equal shares.
    Other columns are ignored. No key gathers rows: words are counted in each task before they are shuffled, and the cutoff is searched without a shuffle.
    """
    featured = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), feature_buckets(F.col(text_col), buckets).alias("buckets")).withColumn("row", F.monotonically_increasing_id()))
    wanted = target.select(feature_buckets(F.col(text_col), buckets).alias("buckets"))
    gains = stored(bucket_gains(bucket_counts(featured), bucket_counts(wanted), buckets))
    scored = featured.join(F.broadcast(gains)).select(
        "doc_id", "row", F.size("buckets").cast("long").alias("n_features"), F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get("gains", b)).alias("gain")
    )
    mean = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features"))
    rows = stored(
        scored.withColumn("weight", mean).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).select("doc_id", "row", "n_features", "weight", "score")
    ).withColumn("no_id", F.col("doc_id").isNull().cast("long"))
    open_ = rows.where(F.col("n_features") >= least_words).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    cutoff = cutoff_key(open_, open_.count() * percent // 100)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    if cutoff is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*names)
    drawn = (F.col("n_features") >= least_words) & _before(cutoff, same=True)
    keyed = rows.withColumn("kept_id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    winners = _ranked(keyed.where(drawn))
    rest = keyed.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return winners.unionByName(rest).withColumn("doc_id", F.col("kept_id")).select(*names)


OP12_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
m AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
cs AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM d) GROUP BY word),
ct AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM m) GROUP BY word),
crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS cells FROM range(256) r(i)),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM cs UNION SELECT word FROM ct)),
b AS (SELECT word, xor(list_reduce(list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT), lambda c, y: xor(cells[(xor(c, y) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM h, crc),
s AS (SELECT bucket, sum(n) AS n FROM cs JOIN b USING (word) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS n FROM ct JOIN b USING (word) GROUP BY bucket),
g AS (SELECT i AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
w AS (SELECT doc_id, sum(gain * n) AS gain, sum(n) AS n FROM (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL) JOIN b USING (word) JOIN g USING (bucket) GROUP BY doc_id),
z AS (SELECT d.doc_id, CAST(coalesce(w.n, 0) AS BIGINT) AS n_features, CAST(CASE WHEN w.n IS NULL THEN 0 ELSE (w.gain - ((w.gain % w.n) + w.n) % w.n) // w.n END AS BIGINT) AS weight,
  CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS open FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 10 * open // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)"""
