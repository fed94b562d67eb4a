"""Landing of actions and transfers from a stream of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from valuetide.functions import actions as act
from valuetide.operators import normalize as N
from valuetide.operators.order import dedupe_transfers, keep_best
from valuetide.operators.stitch import transfer_key

#: How long a repeat of a landed row is recognised; later ones land again and go when the table is read.
HORIZON = "30 days"

STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def _fresh(rows: DataFrame, identity: list[Column], horizon: str) -> DataFrame:
    """Rows not seen within ``horizon`` of their landing.

    The watermark runs on the time of landing, which the offset log fixes for each batch, and not on the
    rows' own times: a history that arrives late is never late by that clock, so nothing is dropped but repeats.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in identity])
    # the digest's bytes, as state holds one for every row that landed
    marked = rows.withColumns({"landed_at": F.current_timestamp(), "_identity": F.unhex(F.sha2(text, 256))})
    return marked.withWatermark("landed_at", horizon).dropDuplicatesWithinWatermark(["_identity"]).drop("_identity")


def fresh_transfers(stream: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Canonical transfers with their ``key``; the same movement with another confidence or source rank is a row of its own."""
    rows = N.canonical_transfers(stream).withColumn("key", transfer_key())
    return _fresh(rows, [F.col(c) for c in ("key", "confidence", "source_rank", "time") if c in rows.columns], horizon)


def fresh_actions(stream: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Canonical actions with their ``key`` and typed time and height; rows without identity go."""
    rows = N.with_action_columns(N.canonical_actions(stream)).withColumn("key", act.action_key()).where("key IS NOT NULL")
    return _fresh(rows, [F.col("key"), F.col("source_protocol"), F.to_json(F.struct("in", "out"))], horizon)


def stream_ingest(fresh: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append ``fresh`` rows to the parquet table at ``target`` until all files that are there have been read.

    The file sink and the checkpoint land each row exactly once, also when a run ends in the middle and is started again.
    What has landed is remembered on disk unless the session names another store: it grows with the table, the heap does not.
    """
    conf = fresh.sparkSession.conf
    before = conf.get(STORE, None)
    if before is None:
        conf.set(STORE, ON_DISK)
    try:
        return fresh.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(STORE)


def landed_transfers(spark: SparkSession, target: str) -> DataFrame:
    """The landed table with one row per movement, whatever order its copies came in."""
    return dedupe_transfers(spark.read.parquet(target))


def landed_actions(spark: SparkSession, target: str) -> DataFrame:
    """The landed table with one row per action: of several protocols' copies the first by name, then by content."""
    return keep_best(spark.read.parquet(target), [F.col("key").alias("_key")], F.struct("source_protocol", F.to_json(F.struct("in", "out"))))
