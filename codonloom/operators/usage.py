"""Corpus filters and codon usage."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.codes import STOPS, code, code_table
from ..functions.scalar import internal_stops
from ..sources.staging import staged
from . import batches
from .batches import Texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def organellar(header: Column) -> Column:
    return F.lower(header).rlike("chloroplast|plastid|mitochondria|chrc|chrm")


def row_tested(seqs: DataFrame, least: int) -> DataFrame:
    """Adds cds, the sequence without a last stop, and reason, the first test on the row alone that it fails."""
    cds = F.regexp_replace("dna", "(TAA|TAG|TGA)$", "")
    frame = F.length("dna") % 3 == 0
    return seqs.withColumn("cds", F.when(frame, cds).otherwise(F.col("dna"))).withColumn(
        "reason",
        F.when(F.col("dna").rlike("[^ACGT]"), "non_atgc")
        .when(~frame, "length_mod3")
        .when(F.length("cds") < least, "too_short")
        .when(internal_stops(F.concat("cds", F.lit("AAA"))) > 0, "internal_stop")
        .when(organellar(F.col("header")), "organellar"),
    )


def kept_cds(seqs: DataFrame, least: int = 60) -> DataFrame:
    """seq_id, gene, cds of the records that cds_filter() keeps. Records go through the tests on the row first, so only those that pass are exchanged, and the sequences are read once."""
    good = row_tested(seqs, least).filter("reason is null").select("seq_id", "gene", F.length("cds").alias("n"), "cds")
    firsts = good.groupBy(F.sha2("cds", 256)).agg(F.min(F.struct("seq_id", "gene", "n", "cds")).alias("f")).select("f.*")
    alone = F.when(F.col("gene").isNull(), F.col("seq_id"))
    best = firsts.groupBy("gene", alone.alias("_alone")).agg(F.max(F.struct("n", (-F.col("seq_id")).alias("m"), "cds")).alias("b"))
    return best.select((-F.col("b.m")).alias("seq_id"), "gene", "b.cds")


def cds_filter(seqs: DataFrame, least: int = 60) -> DataFrame:
    """Adds `reason`, the first test that a record fails, and `cds`, its sequence without a last stop; null reasons are kept records.

    Tests on the row alone come first, then duplicates of kept sequences (the
    first by seq_id stays), then shorter isoforms of a gene.
    """
    row = row_tested(seqs, least)
    # Ids of the first of equal sequences, and of the longest of a gene's: narrow rows are grouped, the bases stay where they are.
    narrow = row.filter("reason is null").select("seq_id", "gene", F.sha2("cds", 256).alias("h"), F.length("cds").alias("n"))
    firsts = narrow.groupBy("h").agg(F.min(F.struct("seq_id", "gene", "n")).alias("f")).select("f.seq_id", "f.gene", "f.n")
    longest = longest_of(firsts).withColumn("_longest", F.lit(True))
    marks = firsts.join(longest, "seq_id", "left").select(F.col("seq_id").alias("_first"), (F.col("gene").isNull() | F.col("_longest").isNotNull()).alias("_longest"))
    late = F.when(F.col("_first").isNull(), "duplicate").when(~F.col("_longest"), "isoform_shorter")
    return row.join(marks, F.col("seq_id") == F.col("_first"), "left").withColumn("reason", F.coalesce("reason", late)).drop("_first", "_longest")


def longest_of(rows: DataFrame) -> DataFrame:
    """seq_id of each gene's longest sequence (n), the first of equal ones; without a gene none. Summed within tasks, so a gene of any size is a row a task."""
    best = rows.filter("gene is not null").groupBy("gene").agg(F.max(F.struct("n", (-F.col("seq_id")).alias("m"))).alias("b"))
    return best.select((-F.col("b.m")).alias("seq_id"))


#: By base its place in TCAG, for batches.read_codes(); the places of stops, and that of a codon with another letter.
PLACE = np.full(256, 64)
PLACE[[*b"TCAG"]] = range(4)
WORDS, OTHER = list(code()), 64
STOP = np.array([c in STOPS for c in WORDS] + [False])


def read_places(texts: list[str | None]) -> Texts:
    """Whole codons as places in the code, from 0; OTHER for one with another letter."""
    return batches.read_codes(Texts.of(texts), PLACE, 0, OTHER)


def codon_counts(seqs: DataFrame, column: str = "cds") -> DataFrame:
    """codon, aa, n for all 64 codons: counted within slices of a task before the shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(OTHER + 1, np.int64)
        for batch in parts:
            for part in batches.slices(batch, column):
                n += np.bincount(read_places(part.column(column).to_pylist()).letters, minlength=OTHER + 1)
        yield pa.RecordBatch.from_arrays([pa.array(WORDS), pa.array(n[:OTHER])], ["codon", "n"])

    seen = seqs.select(column).mapInArrow(run, "codon string, n long").groupBy("codon").agg(F.sum("n").alias("n"))
    return code_table(seqs.sparkSession).join(seen, "codon", "left").select("codon", "aa", F.coalesce("n", F.lit(0)).alias("n"))


def usage_profile(counts: DataFrame) -> DataFrame:
    """codon, aa, frequency (Laplace, stops 0), per_thousand, w (relative adaptiveness, stops null)."""
    aa = Window.partitionBy("aa")
    every = Window.partitionBy(F.lit(0))
    stop = F.col("aa") == "*"
    return (
        counts.withColumn("frequency", F.when(stop, F.lit(0.0)).otherwise(F.round((F.col("n") + 1) / (F.sum("n").over(aa) + F.count(F.lit(1)).over(aa)).cast("double"), 6)))
        .withColumn("per_thousand", F.round(F.when(stop, 0.0).otherwise(F.col("n")) * 1000.0 / F.nullif(F.sum(F.when(~stop, F.col("n"))).over(every), F.lit(0)), 4))
        .withColumn("w", F.when(~stop, F.col("frequency") / F.max("frequency").over(aa)))
        .select("codon", "aa", "n", "frequency", "per_thousand", "w")
    )


def log_weights(weights: DataFrame, missing: float | None = None) -> np.ndarray:
    """Logarithms of the 64 weights by place, then that of any other codon: of `missing` where there is none, or not a number."""
    known = {r["codon"]: r["w"] for r in weights.select("codon", "w").collect()}  # 64 rows
    worth = [w if (w := known.get(c)) and w > 0 else missing for c in [*WORDS, None]]
    return np.array([log(w) if w else np.nan for w in worth])


def log_means(seqs: DataFrame, logs: np.ndarray, stops: bool, column: str, skip: bool = False, name: str = "_mean") -> DataFrame:
    """Adds the mean of logarithms over a sequence's whole codons, with or without stops; null where a codon has none, or is skipped instead, and where no codon is left."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        places = read_places(batch.column(column).to_pylist())
        if not stops:
            places = places.kept(~STOP[places.letters])
        if skip:
            places = places.kept(~np.isnan(logs[places.letters]))
        n = places.lengths
        mean = batches.sums(logs[places.letters], places) / np.maximum(n, 1)
        return {name: [None if bad else m for bad, m in zip(((n == 0) | np.isnan(mean)).tolist(), mean.tolist())]}

    return batches.mapped(seqs, column, {name: pa.float64()}, run)


def cai(seqs: DataFrame, weights: DataFrame, column: str = "dna") -> DataFrame:
    """seq_id, cai: the geometric mean of the weights of sense codons; 0 where the frame is broken or a codon has no weight."""
    rows = log_means(seqs.select("seq_id", column), log_weights(weights), False, column)
    return rows.select("seq_id", F.when(F.length(column) % 3 == 0, F.coalesce(F.exp("_mean"), F.lit(0.0))).otherwise(0.0).alias("cai"))


def sequence_counts(seqs: DataFrame, column: str = "dna") -> DataFrame:
    """seq_id, used (codon, n): one row for an id. A row's codons are counted where it is read and written; only rows whose id is null or repeated are exchanged."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch, column):
                raw = [(t or "").encode("utf-32-le") for t in part.column(column).to_pylist()]
                whole = np.array([len(r) // 12 for r in raw], np.int64)
                letters = np.frombuffer(b"".join([r[: 12 * n] for r, n in zip(raw, whole.tolist())]), np.uint32).astype(np.uint64).reshape(-1, 3)
                known, codon = np.unique(letters[:, 0] << np.uint64(42) | letters[:, 1] << np.uint64(21) | letters[:, 2], return_inverse=True)
                key, n = np.unique(np.repeat(np.arange(len(raw)), whole) * max(1, len(known)) + codon, return_counts=True)
                row, codon = np.divmod(key, max(1, len(known)))
                names = pa.array(["".join(chr(x >> s & 0x1FFFFF) for s in (42, 21, 0)) for x in known.tolist()], pa.string())
                ends = pa.array(np.searchsorted(row, np.arange(len(raw) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (names.take(pa.array(codon)), pa.array(n.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([part.column("seq_id"), *lists], ["seq_id", "codon", "n"])

    schema = StructType([seqs.schema["seq_id"], *[StructField(c, ArrayType(t)) for c, t in (("codon", StringType()), ("n", LongType()))]])
    counted = seqs.select("seq_id", column).mapInArrow(run, schema)
    rows = staged(counted.select("seq_id", F.arrays_zip("codon", "n").alias("used")), "used-codons")
    twice = staged(rows.groupBy("seq_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("seq_id").alias("_twice")), "repeated-ids")
    if not twice.head(1):
        return rows
    same = F.col("seq_id").eqNullSafe(F.col("_twice"))
    each = rows.join(twice, same, "left_semi").select("seq_id", F.explode("used").alias("u")).groupBy("seq_id", F.col("u.codon").alias("codon")).agg(F.sum("u.n").alias("n"))
    return rows.join(twice, same, "left_anti").union(each.groupBy("seq_id").agg(F.collect_list(F.struct("codon", "n")).alias("used")))


def sequence_usage(seqs: DataFrame, column: str = "dna") -> DataFrame:
    """seq_id, codon, count, frequency among the sequence's codons."""
    total = F.aggregate("used", F.lit(0).cast("long"), lambda t, u: t + u["n"]).cast("double")
    rows = sequence_counts(seqs, column).withColumn("_total", total).select("seq_id", "_total", F.explode("used").alias("u"))  # the total once a row
    return rows.select("seq_id", "u.codon", "u.n", (F.col("u.n") / F.col("_total")).alias("frequency"))


def top_codons(seqs: DataFrame, most: int, column: str = "dna") -> DataFrame:
    """seq_id, codon, n of each sequence's most frequent codons, the first by letters of equal ones."""
    ranked = F.array_sort(F.transform("used", lambda u: F.struct((-u["n"]).alias("m"), u["codon"].alias("codon"))))
    rows = sequence_counts(seqs, column).select("seq_id", F.explode(F.slice(ranked, 1, most)).alias("u"))
    return rows.select("seq_id", "u.codon", (-F.col("u.m")).alias("n"))


def mean_weight(seqs: DataFrame, weights: DataFrame, missing: float | None = None, stops: bool = True, column: str = "dna", keep: list[str] | None = None) -> DataFrame:
    """seq_id, cai: the geometric mean of the weights of all whole codons, with or without stops.

    A codon without a weight counts `missing`, or makes the result 0 if that is null; so does a sequence without codons.
    """
    rows = log_means(seqs.select("seq_id", *{*(keep or []), column}), log_weights(weights, missing), stops, column)
    return rows.select("seq_id", *(keep or []), F.coalesce(F.exp("_mean"), F.lit(0.0)).alias("cai"))
