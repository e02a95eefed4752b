"""Scores of whole sequences under several codon tables and profiles, and tables blended of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import dinucleotide_score, gc_percent
from ..sources.corpus import settled
from .usage import log_means, log_weights

#: By profile the weights of codon adaptation, GC, folding energy, dinucleotides and language model, and the GC band; null is the host's.
PROFILES = [
    ("balanced", 0.5, 0.3, 0.2, 0.0, 0.0, None, None), ("high_cai", 0.8, 0.1, 0.1, 0.0, 0.0, None, None), ("gc_target", 0.1, 0.7, 0.2, 0.0, 0.0, None, None),
    ("assembly_friendly", 0.3, 0.4, 0.3, 0.0, 0.0, None, None), ("ramp", 0.4, 0.3, 0.3, 0.0, 0.0, None, None),
    ("viral_delivery", 0.35, 0.35, 0.3, 0.0, 0.0, 37.5, 57.5), ("ml_enhanced", 0.35, 0.25, 0.15, 0.0, 0.25, None, None),
]
COLUMNS = "profile string, w_cai double, w_gc double, w_mfe double, w_dinuc double, w_lm double, gc_low double, gc_high double"
COMPONENTS = ("cai", "gc", "mfe", "dinuc", "lm")


def profiles(spark: SparkSession, low: float = 40.0, high: float = 47.0, target_gc: float | None = None) -> DataFrame:
    """The profiles with their bands: the host's (low, high) where a profile has none of its own, five points around target_gc for gc_target."""
    rows = spark.createDataFrame(PROFILES, COLUMNS).withColumns({"gc_low": F.coalesce("gc_low", F.lit(low)), "gc_high": F.coalesce("gc_high", F.lit(high))})
    if target_gc is None:
        return rows
    aimed = F.col("profile") == "gc_target"
    return rows.withColumns({"gc_low": F.when(aimed, target_gc - 5.0).otherwise(F.col("gc_low")), "gc_high": F.when(aimed, target_gc + 5.0).otherwise(F.col("gc_high"))})


def filled_weights(golden: DataFrame, working: DataFrame) -> DataFrame:
    """codon, w: the golden set's weight, else the working table's frequency over its residue's greatest, else null. Stops have none. Both: 64 rows of codon, aa and w or frequency."""
    top = F.max("frequency").over(Window.partitionBy("aa"))
    own = working.filter("aa <> '*'").select("codon", F.nullif(F.col("frequency") / F.nullif(top, F.lit(0.0)), F.lit(0.0)).alias("v"))
    return own.join(F.broadcast(golden.select("codon", F.when(F.col("w") > 0, F.col("w")).alias("g"))), "codon", "left").select("codon", F.coalesce("g", "v").alias("w"))


def golden_cai(seqs: DataFrame, weights: DataFrame, column: str = "dna", places: int | None = 3) -> DataFrame:
    """Adds cai: the geometric mean over the codons that have a weight; others are skipped. 0 out of frame, or where none has one."""
    rows = log_means(seqs, log_weights(weights), True, column, skip=True)
    value = F.when(F.length(column) % 3 == 0, F.coalesce(F.exp("_mean"), F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("cai", value if places is None else F.round(value, places)).drop("_mean")


def composite(rows: DataFrame, table: DataFrame, column: str = "dna", fade: float = 20.0, cpg: float = 0.0, tpa: float = 1.0, mfe: Column | None = None, lm: Column | None = None) -> DataFrame:
    """Rows with cai, one for each profile of profiles(): adds profile and score (3 places, ties to even).

    What is not to be had (mfe or lm null) leaves the sum, and the other weights share its part; a score of nothing is 0.
    """
    missing = F.lit(None).cast("double")
    scored = settled(rows.withColumns({"_gc": gc_percent(F.col(column)), "_dinuc": dinucleotide_score(F.col(column), cpg, tpa), "_mfe": missing if mfe is None else mfe, "_lm": missing if lm is None else lm}), "_gc").join(F.broadcast(table))
    away = F.greatest(F.col("gc_low") - F.col("_gc"), F.col("_gc") - F.col("gc_high"), F.lit(0.0))
    values = {"cai": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cai"))), "gc": F.greatest(F.lit(0.0), 1 - away / fade), "mfe": F.col("_mfe"), "dinuc": F.col("_dinuc"), "lm": F.col("_lm")}
    weight = lambda c: F.when(values[c].isNotNull(), F.col(f"w_{c}")).otherwise(0.0)
    total = sum((weight(c) for c in COMPONENTS[1:]), weight(COMPONENTS[0]))
    worth = sum((weight(c) * F.coalesce(values[c], F.lit(0.0)) for c in COMPONENTS[1:]), weight("cai") * values["cai"])
    return scored.withColumn("score", F.coalesce(F.bround(worth / F.nullif(total, F.lit(0.0)), 3), F.lit(0.0))).select(*rows.columns, "profile", "score")


def blended(high: DataFrame, empirical: DataFrame, ratio: float = 0.7) -> DataFrame:
    """codon, aa, frequency (4 places, a residue's sum is 1), per_thousand, preferred: the high-expression frequency at `ratio` and the empirical one (the high one where it is missing) at the rest."""
    if not 0.0 <= ratio <= 1.0:
        raise ValueError("ratio must be within 0-1")
    met = high.select("codon", "aa", F.col("frequency").alias("h")).join(F.broadcast(empirical.select("codon", F.col("frequency").alias("e"))), "codon", "left")
    mixed = met.select("codon", "aa", (F.lit(ratio) * F.col("h") + F.lit(1 - ratio) * F.coalesce("e", "h")).alias("f"))
    by = Window.partitionBy("aa")
    total = F.sum("f").over(by)
    # Rounded as the scaled double, as SQL does: the decimal digits of a quotient just below a half would go down.
    rounded = lambda x, scale: F.round(x * scale) / scale
    rows = mixed.withColumn("frequency", F.when(total > 0, rounded(F.col("f") / total, F.lit(10000.0))).otherwise(F.col("f")))
    first = F.min(F.struct((-F.col("frequency")).alias("f"), "codon")).over(by)["codon"]
    return rows.select("codon", "aa", "frequency", rounded(F.col("frequency") * 1000 / F.count(F.lit(1)).over(by), F.lit(10.0)).alias("per_thousand"), first.alias("preferred"))
