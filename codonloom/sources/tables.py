"""Tables in files of other forms: codon tables as JSON with a manifest, delimited results, JSON lines, quantities by sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_codon_table(spark: SparkSession, path: str) -> DataFrame:
    """codon, aa, frequency of a JSON object with `codons` by name; an entry without a residue or a number is skipped, a file without `codons` is an error."""
    text = spark.read.text(path, wholetext=True)
    codons = F.from_json("value", "codons map<string,string>")["codons"]
    held = F.when(codons.isNull(), F.raise_error(F.lit("a codon table has no 'codons'"))).otherwise(codons)
    entries = text.select(F.explode(held).alias("codon", "entry"))
    entry = F.from_json("entry", "aa string, frequency double")
    return entries.select("codon", entry["aa"].alias("aa"), entry["frequency"].alias("frequency")).filter("length(aa) = 1 and frequency is not null")


def write_codon_table(table: DataFrame, path: str, source: str) -> DataFrame:
    """Writes codon, aa, frequency (64 rows) as one JSON object and gives its manifest: source, n_codons, sha256 of the text."""
    entry = F.struct(F.col("aa").alias("aa"), F.col("frequency").alias("frequency"))
    rows = F.sort_array(F.collect_list(F.struct("codon", entry.alias("e"))))
    whole = table.agg(rows.alias("r")).select(F.size("r").alias("n_codons"), F.to_json(F.struct(F.lit(source).alias("source"), F.map_from_entries("r").alias("codons"))).alias("value"))
    whole.select("value").coalesce(1).write.mode("overwrite").text(path)
    written = table.sparkSession.read.text(path, wholetext=True)  # what was written, read back
    kept = F.regexp_replace("value", r"\n$", "")
    return written.select(F.lit(source).alias("source"), F.size(F.map_keys(F.from_json("value", "codons map<string,string>")["codons"])).alias("n_codons"), F.sha2(kept, 256).alias("sha256"))


def write_delimited(rows: DataFrame, path: str, columns: Sequence[str], sep: str = "\t") -> None:
    """A header and the columns in this order, in as many files as there are partitions."""
    rows.select(*columns).write.mode("overwrite").csv(path, sep=sep, header=True, escape='"')


def read_delimited(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, sep: str | None = None) -> DataFrame:
    """A delimited file, a comma for .csv and else a tab; only the columns asked for are parsed."""
    sep = sep or ("," if path.lower().endswith(".csv") else "\t")
    rows = spark.read.schema(schema).csv(path, sep=sep, header=True, escape='"')
    return rows.select(*columns) if columns else rows


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a line; blank lines are skipped, a line that is no object is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def merged_quantities(spark: SparkSession, folder: str, metric: str, samples: Sequence[str], file: str = "quant.sf") -> DataFrame:
    """Name and a column a sample, "0" where a sample lacks the name: folder/<sample>/<file>, tab-separated. A file without the metric is an error."""
    rows = spark.read.csv([f"{folder}/{s}/{file}" for s in samples], sep="\t", header=True, enforceSchema=False)
    if metric not in rows.columns:
        raise ValueError(f"{metric} is not a column of {file}")
    sample = F.element_at(F.split(F.input_file_name(), "/"), -2)
    wide = rows.select("Name", F.col(metric).alias("_m"), sample.alias("_sample")).groupBy("Name").pivot("_sample", list(samples)).agg(F.last("_m"))
    return wide.na.fill("0", list(samples))


def confident(rows: DataFrame, psm: str, fdr: str, sequence: str, order: str, least_psm: float = 0.0, most_fdr: float = 1.0) -> DataFrame:
    """(order, sequence): rows of more than least_psm matches and less than most_fdr, the first by `order` of each sequence.

    Numbers come as text: an empty one is 0 matches and a rate of 1, one that cannot be read drops its row. Sequences lose white space and are upper-cased; empty ones go.
    """
    number = lambda c, empty: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(empty)).otherwise(F.expr(f"try_cast(trim(`{c}`) as double)"))
    clean = F.upper(F.regexp_replace(F.coalesce(F.col(sequence), F.lit("")), r"\s", ""))
    good = rows.select(F.col(order), number(psm, 0.0).alias("_p"), number(fdr, 1.0).alias("_f"), clean.alias("sequence")).filter((F.col("_p") > least_psm) & (F.col("_f") < most_fdr) & (F.col("sequence") != ""))
    return good.groupBy("sequence").agg(F.min(order).alias(order)).select(order, "sequence")
