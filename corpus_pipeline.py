"""The corpus pipeline: documents in, packed sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuetide.llm.common import stored, table
from valuetide.llm.stages import dedup_exact, dedup_near, drop_toxic, mix, pack_sequences

#: (name, function of (spark, docs, sf_dir)); each stage's rows are written and read again as the next one's docs.
STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: SQL has neither the learned model, the signatures nor the tokenizer; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
