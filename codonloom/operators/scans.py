"""Motif and region scans: one row per finding, made in the sequence's own row."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import POLYA, STOPS, TYPE_IIS
from ..functions.scalar import codons, hydropathy
from . import batches
from .batches import Texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Parts that places() takes at once.
CHUNK = 64


def places(parts: Column) -> Column:
    """array<struct<start, end, part>>: where parts that follow each other lie, from 0. Taken in chunks, so that no long array is copied once a part."""
    kind = "array<struct<start:int,end:int,part:string>>"
    at = lambda s, x: F.struct(s["end"].alias("start"), (s["end"] + F.length(x)).alias("end"), x.alias("part"))
    grown = lambda s, x: F.struct((s["end"] + F.length(x)).alias("end"), F.concat(s["found"], F.array(at(s, x))).alias("found"))
    chunk = lambda s, c: F.aggregate(F.slice(parts, c * CHUNK + 1, CHUNK), F.struct(s["end"].alias("end"), F.array().cast(kind).alias("found")), grown)
    both = lambda s, r: F.struct(r["end"].alias("end"), F.concat(s["found"], F.array(r["found"])).alias("found"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{kind}>").alias("found"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int"))
    return F.flatten(F.aggregate(chunks, start, lambda s, c: F.get(F.transform(F.array(chunk(s, c)), lambda r: both(s, r)), F.lit(0)), lambda s: s["found"]))


def starts_of(s: Column, motif: str) -> Column:
    """array<int>: where the text is cut by a look-ahead for the motif, overlapping hits too."""
    cut = F.transform(F.filter(places(F.split(s, f"(?={motif})")), lambda p, k: (k > 0) | s.startswith(motif)), lambda p: p["start"])
    return F.when(s.contains(motif), cut).otherwise(F.array().cast("array<int>"))


def motif_hits(seqs: DataFrame, motifs: dict[str, str], column: str = "dna") -> DataFrame:
    """(seq_id, motif, name, start): literal hits, overlapping ones too, from 0, found in the sequence's own row. Motifs are letters."""
    found = [F.struct(F.lit(m).alias("motif"), F.lit(n).alias("name"), starts_of(F.col(column), m).alias("starts")) for m, n in sorted(motifs.items())]
    hits = seqs.select("seq_id", F.explode(F.filter(F.array(*found), lambda h: F.size(h["starts"]) > 0)).alias("h"))
    return hits.select("seq_id", "h.motif", "h.name", F.explode("h.starts").alias("start"))


def spans_of(s: Column, pattern: str) -> Column:
    """array<struct<start, end, part>>: what a left-to-right search for the pattern finds. The text must not hold '|'."""
    parts = F.split(F.regexp_replace(s, pattern, "|$0|"), r"\|")
    return F.when(s.rlike(pattern), F.filter(places(parts), lambda p, k: k % 2 == 1)).otherwise(F.array().cast("array<struct<start:int,end:int,part:string>>"))


def spans(seqs: DataFrame, pattern: str, column: str = "dna") -> DataFrame:
    """(seq_id, start, end, match) of spans_of, made in the sequence's own row."""
    return seqs.select("seq_id", F.explode(spans_of(F.col(column), pattern)).alias("p")).select("seq_id", "p.start", "p.end", F.col("p.part").alias("match"))


def polya(seqs: DataFrame) -> DataFrame:
    return motif_hits(seqs, POLYA).withColumnRenamed("name", "tier")


def polya_clusters(seqs: DataFrame, window: int = 30) -> DataFrame:
    """(seq_id, start, patterns): windows that wholly hold two or more different signals. The windows are of a sequence's own hits, in its own row."""
    span = lambda i: F.sequence(F.greatest(F.lit(0), i + 6 - window), F.least(i, F.col("n") - window))
    inside = lambda i: F.greatest(F.lit(0), i + 6 - window) <= F.least(i, F.col("n") - window)
    held = [F.array_distinct(F.flatten(F.transform(F.filter(starts_of(F.col("dna"), m), inside), span))) for m in POLYA]
    rows = seqs.filter(F.length("dna") >= window).withColumn("n", F.length("dna")).select("seq_id", F.explode(F.array(F.sort_array(F.flatten(F.array(*held))))).alias("all"))
    counted = F.transform(F.array_distinct("all"), lambda i: F.struct(i.alias("start"), F.size(F.filter("all", lambda x: x == i)).cast("long").alias("patterns")))
    return rows.filter("size(all) > 1").select("seq_id", F.inline(F.filter(counted, lambda c: c["patterns"] >= 2)))


def at_runs(seqs: DataFrame) -> DataFrame:
    return spans(seqs, "[AT]{6,}").withColumn("severity", F.when(F.length("match") >= 8, "high").otherwise("medium"))


def homopolymers(seqs: DataFrame, least: int = 8, high: int = 10) -> DataFrame:
    pattern = "|".join(f"{b}{{{least},}}" for b in "ACGT")
    return spans(seqs, pattern).withColumn("severity", F.when(F.length("match") >= high, "high").otherwise("medium"))


def windows_of(s: Column, width: int) -> Column:
    """array<string>: the window at each place."""
    return F.regexp_extract_all(s, F.lit(f"(?=(.{{{width}}}))"), F.lit(1))


def repeats(seqs: DataFrame, k: int = 15) -> DataFrame:
    """(seq_id, kmer, count, first, starts): k-mers that a sequence holds twice or more. Equal ones meet by sorting in the sequence's own row."""
    placed = F.sort_array(F.transform(windows_of(F.col("dna"), k), lambda w, i: F.struct(w.alias("kmer"), i.alias("at"))))
    near = lambda x, i, step: F.coalesce(F.get(F.col("_k"), i + step)["kmer"] == x["kmer"], F.lit(False))
    twice = F.filter("_k", lambda x, i: near(x, i, 1) | ((i > 0) & near(x, F.greatest(i - 1, F.lit(0)), 0)))
    rows = seqs.select("seq_id", F.explode(F.array(placed)).alias("_k")).select("seq_id", F.explode(F.array(twice)).alias("_t"))
    own = lambda m: F.transform(F.filter("_t", lambda x: x["kmer"] == m), lambda x: x["at"])
    each = rows.select("seq_id", F.explode(F.transform(F.array_distinct(F.transform("_t", lambda x: x["kmer"])), lambda m: F.struct(m.alias("kmer"), own(m).alias("starts")))).alias("r"))
    return each.select("seq_id", "r.kmer", F.size("r.starts").cast("long").alias("count"), F.get("r.starts", F.lit(0)).alias("first"), "r.starts")


def tandem_repeats(seqs: DataFrame, shortest: int = 2, longest: int = 6, copies: int = 3) -> DataFrame:
    """(seq_id, start, end, motif, copies): motifs of each length that follow each other `copies` times or more, from left to right as many as there are; a span that two lengths find counts for the shorter one."""
    each = lambda m: F.transform(spans_of(F.col("dna"), f"(.{{{m}}})\\1{{{copies - 1},}}"), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(m).alias("m"), F.substring(p["part"], 1, m).alias("motif")))
    found = F.sort_array(F.flatten(F.array(*[each(m) for m in range(shortest, longest + 1)])))
    rows = seqs.select("seq_id", F.explode(F.array(found)).alias("f"))
    before = lambda i: F.get(F.col("f"), F.greatest(i - 1, F.lit(0)))
    first = F.filter("f", lambda x, i: (i == 0) | (before(i)["start"] != x["start"]) | (before(i)["end"] != x["end"]))
    return rows.select("seq_id", F.inline(first)).select("seq_id", "start", "end", "motif", ((F.col("end") - F.col("start")) / F.col("m")).cast("int").alias("copies"))


def gc_windows(seqs: DataFrame, size: int = 60, step: int = 30) -> DataFrame:
    """(seq_id, start, gc): windows each `step`, a last one at the end; a shorter sequence is one window."""
    last = F.greatest(F.length("dna") - size, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    rows = seqs.filter(F.length("dna") > 0).select("seq_id", "dna", F.explode(starts).alias("start"))
    part = F.expr(f"substring(dna, start + 1, {size})")
    return rows.select("seq_id", "start", (F.length(F.regexp_replace(part, "[^GC]", "")) * 100.0 / F.length(part)).cast("double").alias("gc"))


def type_iis(seqs: DataFrame) -> DataFrame:
    return motif_hits(seqs, {site: enzyme for enzyme, sites in TYPE_IIS.items() for site in sites}).withColumnRenamed("name", "enzyme")


def splice_pairs(seqs: DataFrame, near: int = 20, far: int = 200) -> DataFrame:
    """(seq_id, donor, acceptor): donors GT[AG]AG and acceptors [CT]AG at a distance in the band, met in the sequence's own row."""
    at = lambda pattern: F.transform(spans_of(F.col("dna"), pattern), lambda p: p["start"])
    each = seqs.select("seq_id", at("GT[AG]AG").alias("d"), at("[CT]AG").alias("a")).filter("size(d) > 0 and size(a) > 0")
    pairs = each.select("seq_id", F.explode("d").alias("donor"), "a")
    return pairs.select("seq_id", "donor", F.explode(F.filter("a", lambda x: (x - F.col("donor")).between(near, far))).alias("acceptor"))


def marks(seqs: DataFrame, column: str, pieces: Column) -> DataFrame:
    """(seq_id, n, pos, x): one row per element of `pieces`, from 0; n is the length of the column."""
    return seqs.select("seq_id", F.length(column).alias("n"), F.posexplode(pieces).alias("pos", "x"))


def sliding(rows: DataFrame, flag: Column, width: int, name: str) -> DataFrame:
    """Adds the sum of `flag` over the `width` rows from each place on, within a sequence."""
    w = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(0, width - 1)
    return rows.withColumn(name, F.sum(flag).over(w))


def gc_extremes(seqs: DataFrame, width: int = 50, low: int = 25, high: int = 75) -> DataFrame:
    """(seq_id, n_low, n_high): windows, one per base, whose GC percent is below or above; counted in the sequence's own row."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        t = Texts.of(batch.column("dna").to_pylist())
        gc, row = batches.window_sums(batches.is_gc(t), t, width)
        n = len(t.lengths)
        return {"n_low": np.bincount(row[gc * 100 < low * width], minlength=n), "n_high": np.bincount(row[gc * 100 > high * width], minlength=n)}

    rows = seqs.filter(F.length("dna") >= width).select("seq_id", "dna")
    return batches.mapped(rows, "dna", {"n_low": pa.int64(), "n_high": pa.int64()}, run, drop=("dna",))


def dinucleotide_hotspots(seqs: DataFrame, width: int = 50, per_window: float = 0.05) -> DataFrame:
    """(seq_id, n_cpg, n_tpa): windows with more than `per_window` pairs a base; a sequence shorter than a window is one window."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        t = Texts.of(batch.column("dna").to_pylist())
        n, x = len(t.lengths), t.letters
        inner = (t.places() + 1 < np.repeat(t.lengths, t.lengths))[: max(len(x) - 1, 0)]
        size = np.minimum(t.lengths, width)

        def hot(a: str, b: str) -> np.ndarray:
            pair = np.append((x[:-1] == ord(a)) & (x[1:] == ord(b)) & inner, False) if len(x) else np.zeros(0, bool)
            held, row = batches.window_sums(pair, t, size - 1, size)
            return np.bincount(row[held / size[row].astype(float) > per_window], minlength=n)

        return {"n_cpg": hot("C", "G"), "n_tpa": hot("T", "A")}

    rows = seqs.filter(F.length("dna") >= 2).select("seq_id", "dna")
    return batches.mapped(rows, "dna", {"n_cpg": pa.int64(), "n_tpa": pa.int64()}, run, drop=("dna",))


def local_gc(seqs: DataFrame, width: int = 50) -> DataFrame:
    """seq_id, value: twice the G and C in each window of so many bases (50: percent), from left to right, separated by blanks; counted within the row."""
    numbers = np.array([str(2 * k) for k in range(width + 1)], object)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        t = Texts.of(batch.column("dna").to_pylist())
        gc, row = batches.window_sums(batches.is_gc(t), t, width)
        ends = np.searchsorted(row, np.arange(len(t.lengths) + 1)).tolist()
        words = numbers[gc].tolist()
        return {"value": [" ".join(words[a:b]) for a, b in zip(ends, ends[1:])]}

    made = batches.mapped(seqs.select("seq_id", "dna"), "dna", {"value": pa.string()}, run)
    return made.select("seq_id", F.when(F.col("dna").isNotNull(), F.col("value")).alias("value"))


def islands(rows: DataFrame) -> DataFrame:
    """(seq_id, start, length): runs of consecutive `pos`."""
    w = Window.partitionBy("seq_id").orderBy("pos")
    grouped = rows.withColumn("island", F.col("pos") - F.row_number().over(w)).groupBy("seq_id", "island")
    return grouped.agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length")).drop("island")


def rare_codon_runs(seqs: DataFrame, weights: DataFrame, least: int = 3, rare: float = 0.3) -> DataFrame:
    """(seq_id, codon_index, run_length, severity): runs of sense codons of low weight; one without a weight counts as rare. Sequences out of frame give none."""
    table = weights.filter("w is not null").select(F.col("codon").alias("x"), "w")
    rows = marks(seqs.filter(F.length("dna") % 3 == 0), "dna", codons(F.col("dna"))).filter(~F.col("x").isin(*STOPS))
    low = rows.join(F.broadcast(table), "x", "left").filter(F.coalesce("w", F.lit(0.0)) < rare)
    runs = islands(low).filter(F.col("length") >= least)
    return runs.select("seq_id", F.col("start").alias("codon_index"), F.col("length").alias("run_length"), F.when(F.col("length") >= 5, "high").otherwise("medium").alias("severity"))


def tm_segments(proteins: DataFrame, width: int = 19, tenths: int = 16) -> DataFrame:
    """(seq_id, tm_count): windows of mean hydropathy of 1.6 or more, merged where they meet or overlap. Summed in tenths, so exactly."""
    rows = marks(proteins, "aa", F.split("aa", "")).filter(F.col("n") >= width)
    warm = sliding(rows, hydropathy(F.col("x")), width, "kd").filter((F.col("pos") <= F.col("n") - width) & (F.col("kd") >= tenths * width))
    before = F.lag("pos").over(Window.partitionBy("seq_id").orderBy("pos"))
    first = warm.withColumn("first", before.isNull() | (F.col("pos") > before + width))
    return first.groupBy("seq_id").agg(F.count(F.when(F.col("first"), 1)).alias("tm_count"))
