"""Session helpers: builder defaults and written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "valuetide") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; below the warehouse where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Loops keep short plans, a lost executor re-reads instead of recomputing earlier
    steps, and the optimizer knows the size of what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_LANDED: dict[tuple[str, str], DataFrame] = {}


def land_once(spark: SparkSession, name: str, build) -> DataFrame:
    """A derived table, written when it is first asked for in an application.

    ``name`` says what the rows are derived from (its folder included). Inputs are taken to stay
    as they are; call ``forget_landed`` when they change.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _LANDED:
        _LANDED[key] = cut_lineage(build())
    return _LANDED[key]


def forget_landed() -> None:
    """Derive every landed table anew at its next use."""
    _LANDED.clear()
