"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuetide.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from valuetide.llm.common import WORD, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model fitted on ``labels`` calls toxic.

    Null and empty texts are not toxic and stay, repeated rows are judged alike, an empty table (of documents or labels) drops nothing; whole texts
    count, however long; no column is added or replaced.
    """
    return toxicity.drop_toxic_rows(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest id (null is smaller than any), of several any one."""
    rows, key = _keyed(docs)
    judged = exact_dedup.exact_dedup(rows, id_col=key).select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("_class"), F.col("group_size").alias("_size"))
    return _one_each(rows, key, judged, F.max(F.struct(F.col("doc_id"), F.col("_row")))).select(*_names(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the smallest id (null is larger than any), of several any one."""
    rows, key = _keyed(docs)
    judged = near_dedup.near_duplicates(rows, id_col=key).select(F.col("doc_id").alias("_row"), F.col("class_id").alias("_class"), F.col("class_size").alias("_size"))
    return _one_each(rows, key, judged, F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")))).select(*_names(docs))


def _names(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its rows (ids may repeat or be null), written so that the keys stay; and the key's name, which no column of ``docs`` has."""
    key, taken = "_stage_row", {c.lower() for c in docs.columns}
    while key in taken:
        key += "_"
    return stored(docs.withColumn(key, F.monotonically_increasing_id())), key


def _one_each(rows: DataFrame, key: str, judged: DataFrame, best: Column) -> DataFrame:
    """``rows`` without those of a class (_row, _class, _size) that are not its ``best``, a struct of doc_id and _row."""
    members = stored(judged.where("_size > 1").join(rows.select(F.col(key).alias("_row"), "doc_id"), "_row"))
    stay = members.groupBy("_class").agg(best.alias("_best")).select(F.col("_best._row").alias("_row"))
    gone = members.select("_row").join(stay, "_row", "left_anti")
    return rows.join(gone.withColumnRenamed("_row", key), key, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each time that a row of ``docs`` is used, whole or as its first words.

    A document of which no word is taken goes, so null and empty texts do. Where a document is cut, its text is the taken
    words, one blank between them, and n_chars their length; all other columns stay, whatever they are called. Repeated rows are
    used each on its own; a very long text is cut like any other; an empty table gives an empty result.
    """
    rows, key = _keyed(docs)
    known, pieces = mixing.mix_sources(rows, row_col=key)
    uses = pieces.groupBy("row", "epoch").agg(F.min("start").alias("first"), F.sum("words").alias("words"))
    sized = uses.join(known.select("row", "size"), "row").select("row", "size", "first", "words")
    # a document travels as one struct, so its columns cannot clash with those of its use
    whole = rows.select(F.col(key).alias("row"), F.struct(*_names(docs)).alias("doc")).join(sized, "row")
    text = F.col("doc").getField("text")
    taken = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.col("first") + 1, F.col("words")), " ")
    cut = F.col("words") < F.col("size")
    used = whole.withColumn("used", F.when(cut, taken).otherwise(text))
    swapped = {"text": F.col("used")}
    if "n_chars" in docs.columns:
        swapped["n_chars"] = F.when(cut, F.length("used").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc").getField("n_chars"))
    return used.select(*[swapped.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; see ``packing.pack``.

    Null and empty texts are their end token alone, rows that share an id are packed each, columns beyond id and text are ignored, an empty
    table gives an empty result.
    """
    return packing.pack(docs)
