"""FASTA in and out as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import normalize_dna


def read_fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(seq_id, header, seq) of the good records, and the records refused with a reason. The file is split at records."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    started = F.input_file_block_start() == 0
    record = F.regexp_replace("value", r"^>", "")
    rows = raw.select(record.alias("record"), F.col("value").startswith(">").alias("first"), started.alias("at_start"))
    header = F.trim(F.regexp_extract("record", r"^([^\r\n]*)", 1))
    parsed = rows.select(
        F.regexp_extract(header, r"^(\S*)", 1).alias("seq_id"), header.alias("header"), normalize_dna(F.regexp_replace("record", r"^[^\r\n]*", "")).alias("seq")
    ).filter((F.col("header") != "") | (F.col("seq") != ""))
    reason = F.when(F.col("seq_id") == "", "missing_id").when(F.col("seq") == "", "empty_record")
    judged = parsed.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def fasta_lines(records: DataFrame, width: int = 80) -> DataFrame:
    """One text row per record (header, seq), the sequence wrapped at width; write with .write.text()."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return records.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), wrapped).alias("value"))
