"""The corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codonloom.llm import jaccard, language, mixing, packing, toxicity
from codonloom.llm.common import deleted, fresh_path, scratch, staged, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("language", language.stage),
    ("near_duplicates", jaccard.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]
#: Trained models and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows are written; what a stage wrote for itself, and the rows of the stage before, are deleted once they have been read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            deleted(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
