"""Mixing sources to target weights with a low-discrepancy schedule of equal blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuetide.llm.common import WORD, running_before, stored

#: Words of a block, that is of a slot of the schedule.
BLOCK = 1024
#: A source gives at most so many times its own size.
MOST_TIMES = 3
#: Cells of the unit interval in which a slot looks up its source.
CELLS = 4096
#: Rows of one piece of a source's shuffled order.
BUCKET_ROWS = 1024

_GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from one row per source (source, source_size).

    Weights are 1, 2, 3, repeating in code point order, null last. Targets share all sizes by
    weight; one that would pass MOST_TIMES its source's size stops there and the excess is shared
    among the others: with sources sorted by limit / weight, those before the first whose share
    fits are the ones that stop. Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("limit", F.col("source_size") * MOST_TIMES)
    by_limit = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before, rest, all_ = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = named.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
    share = F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(all_)["level"]
    target = F.least(F.col("limit").cast("double"), share * F.col("weight"))
    return levelled.select("source", "source_size", F.coalesce(target, F.col("limit").cast("double")).alias("target"))


def slot_point(slot: Column) -> Column:
    """The slot's place in [0, 1): multiples of the golden ratio, whole numbers cut off; the slot is split so that no digits are lost."""
    high, low = F.floor(slot / (1 << 20)), slot % (1 << 20)
    step = (_GOLDEN * (1 << 20)) % 1.0
    point = (high * F.lit(step)) % 1.0 + (low * F.lit(_GOLDEN)) % 1.0
    return point % 1.0


def schedule(goals: DataFrame, total: int, block: int) -> DataFrame:
    """``slot, source, rank, first_word, words``: which words of each source's repeated stream a slot takes.

    ``goals``: source, quota (whole words). ``total`` / ``block`` slots fall on sources by their
    place in the cumulated quotas. A source's slots take its stream block by block; the last one
    stops at the quota, and where the slots do not reach the quota, closing slots take the rest.
    """
    spark = goals.sparkSession
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    upto = F.sum("quota").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("quota").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranges = goals.where("quota > 0").select("source", "quota", ((upto - F.col("quota")) / all_).alias("low"), (upto / all_).alias("high"))
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    n = max(total // block, 0)
    slots = spark.range(n).select(F.col("id").alias("slot"), slot_point(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    drawn = slots.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "source")
    drawn = drawn.withColumn("_bkt", F.floor(F.col("slot") / BUCKET_ROWS))
    ranked = stored(running_before(drawn, ["source"], "_bkt", ["slot"], F.lit(1).cast("long"), "rank").select("slot", "source", "rank"))
    counts = ranked.groupBy("source").agg(F.count("*").alias("slots"))
    full = ranges.alias("r").join(counts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")), "left").select("r.source", "r.quota", F.coalesce("c.slots", F.lit(0)).alias("slots"))
    needed = F.ceil(F.col("quota") / block)
    closing = full.where(F.col("slots") < needed).select(F.lit(None).cast("long").alias("slot"), "source", F.explode(F.sequence(F.col("slots"), needed - 1)).alias("rank"))
    both = ranked.unionByName(closing)
    joined = both.alias("s").join(full.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")))
    first = F.col("s.rank") * block
    words = F.least(F.lit(block), F.col("f.quota") - first)
    return joined.select("s.slot", "s.source", "s.rank", first.alias("first_word"), words.alias("words")).where("words > 0")


def shuffled_order(doc_id: Column) -> Column:
    """A fixed pseudo-random place of a document, from 0 to 2^60."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix_sources(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sized documents, pieces) of a mix of ``docs`` to the target weights.

    The first: ``row, doc_id, size, source, source_size, target``, one row per input row (``row`` is
    ``row_col``, unique numbers, if named). The second, in which slot which words of which document stand: ``row, doc_id, slot, rank, epoch,
    start, words``; ``slot`` is null in closing slots. A source's documents stand in a fixed
    shuffled order, end to end, and repeat up to MOST_TIMES times; slots take blocks of that
    stream (see ``schedule``).

    A null text has no words, a null source is one of its own, repeated rows count each; an
    empty table gives empty results. Reruns agree: nothing depends on how rows are dealt out.
    Only the sizes are shuffled, never texts. No source meets in one task: its order is cut into
    buckets of about BUCKET_ROWS rows.
    """
    sized = stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
        .withColumn("place", shuffled_order(F.col("doc_id")))
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    goals = stored(targets(sizes.select("source", "source_size")))
    facts = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count("*").alias("rows")).first()
    width = max(1, (1 << 60) // max(1, -(-facts["rows"] // BUCKET_ROWS)))
    placed = sized.withColumn("_bkt", F.floor(F.col("place") / width))
    offset = running_before(placed, ["source"], "_bkt", ["place", "doc_id", "size", "row"], F.col("size"), "before")
    same = F.col("d.source").eqNullSafe(F.col("g.source"))
    known = offset.alias("d").join(goals.alias("g"), same).select("d.row", "d.doc_id", "d.size", "d.source", "d.before", "g.source_size", "g.target", F.floor(F.col("g.target") + 1e-6).alias("quota"))
    known = stored(known)
    plan = schedule(goals.select("source", F.floor(F.col("target") + 1e-6).alias("quota")), int(facts["words"]), block)
    epochs = known.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_TIMES - 1))))
    stream = epochs.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("before")).where("at < quota")
    blocks = stream.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    both = blocks.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.rank") == F.col("p.rank")))
    low = F.greatest(F.col("b.at"), F.col("p.first_word"))
    high = F.least(F.col("b.at") + F.col("b.size"), F.col("p.first_word") + F.col("p.words"))
    pieces = both.select("b.row", "b.doc_id", "p.slot", "p.rank", "b.epoch", (low - F.col("b.at")).alias("start"), (high - low).alias("words")).where("words > 0")
    return known, pieces


def mix_report(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``."""
    known, pieces = mix_sources(docs, block)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return known.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


OP5_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size AS lim, (SELECT sum(source_size) FROM s) AS total FROM s),
k AS (SELECT *, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
f AS (SELECT min_by(level, lim / weight) AS share FROM k WHERE level * weight <= lim),
t AS (SELECT source, source_size, CAST(least(lim, coalesce(share, lim) * weight) AS DOUBLE) AS target FROM k, f),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 1e-6) AS BIGINT) AS quota,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - before)) END AS BIGINT) AS taken FROM b"""
