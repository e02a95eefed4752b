"""What a sequence that comes in is, whether it can be worked on, and the report on a candidate made for it."""

from __future__ import annotations

import sys
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import RESIDUES, STOPS
from ..functions.scalar import codons, gc_percent, internal_stops, normalize_dna, translate_dna
from ..sources.corpus import settled
from . import batches, usage
from .batches import Texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters that DNA may have, that are a protein's alone, and that any input may have; the length from which DNA is believed.
DNA, DNA_OR_M, PROTEIN_ONLY, EVERY = "ATGCN", "ATGCM", "DEFHIKLPQRSVWY", "ACDEFGHIKLMNPQRSTVWY*"
SHORTEST_DNA = 6
#: Ambiguous bases.
AMBIGUOUS = "NRYSWKMBDHV"


def letters_beyond(s: Column, allowed: str, apart: str = ",") -> Column:
    """The letters of a text that are not allowed, sorted, each once."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(s, f"[{allowed}]", ""), ""))), apart)


def detected_type(s: Column) -> Column:
    """dna, protein or ambiguous of a cleaned text: a protein's own letters decide; DNA must be long enough and in frame."""
    in_frame = (F.length(s) >= SHORTEST_DNA) & (F.length(s) % 3 == 0)
    return (
        F.when(s == "", "ambiguous").when(s.rlike(f"[{PROTEIN_ONLY}]"), "protein")
        .when(~s.rlike(f"[^{DNA}]"), F.when(in_frame, "dna").otherwise("ambiguous"))
        .when(~s.rlike(f"[^{DNA_OR_M}]"), "ambiguous").otherwise("protein")
    )


def resolved(rows: DataFrame, column: str, expected: Column | str = "auto") -> DataFrame:
    """Adds sequence (upper case, no white space), detected, resolved (dna or protein) and refused: empty, invalid: and the letters, or expected one type, detected the other."""
    wanted = F.lit(expected) if isinstance(expected, str) else expected
    clean = settled(rows.withColumn("sequence", F.upper(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s", ""))), "sequence")
    s, found = F.col("sequence"), F.col("detected")
    odd = letters_beyond(s, EVERY.replace("*", r"\*"))
    in_frame = (F.length(s) >= SHORTEST_DNA) & (F.length(s) % 3 == 0)
    auto = F.when(found != "ambiguous", found).when(in_frame, "dna").otherwise("protein")
    refused = (
        F.when(s == "", "empty").when(odd != "", F.concat(F.lit("invalid: "), odd))
        .when((wanted != "auto") & (found != "ambiguous") & (wanted != found), F.concat(F.lit("expected "), wanted, F.lit(", detected "), found))
    )
    judged = clean.withColumn("detected", detected_type(s)).withColumn("refused", refused)
    return judged.withColumn("resolved", F.when(F.col("refused").isNull(), F.when(wanted == "auto", auto).otherwise(wanted)))


def context(rows: DataFrame, column: str) -> DataFrame:
    """Rows of one plain sequence or one FASTA record, told apart into coding sequences and proteins.

    Adds header, sequence, input_type (cds, protein), protein, frame_valid, start_present, stop_codon, internal_stops, gc,
    generation_allowed, errors and warnings (arrays). What cannot be read has refused set (empty, many_records,
    header_not_first, invalid: and the letters, inner_stop_mark, no_residue) and no type. Null is empty.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), r"\r\n|\r|\n"), strip), lambda x: x != "")
    read = settled(rows.withColumn("_lines", lines), "_lines")
    first, heads = F.get("_lines", F.lit(0)), F.size(F.filter("_lines", lambda x: x.startswith(">")))
    headed = F.coalesce(first.startswith(">"), F.lit(False))
    body = F.when(headed, F.slice("_lines", 2, F.size("_lines"))).otherwise(F.col("_lines"))
    read = read.withColumns({"header": F.when(headed, strip(F.substring(first, F.lit(2), F.length(first)))), "_heads": heads, "_headed": headed, "sequence": F.upper(F.regexp_replace(F.array_join(body, ""), r"\s", ""))})
    read = settled(read, "sequence")
    s = F.col("sequence")
    is_dna, odd = (s != "") & ~s.rlike("[^ACGT]"), letters_beyond(s, EVERY.replace("*", r"\*"), ", ")
    refused = (
        F.when(F.col("_heads") > 1, "many_records").when((F.col("_heads") == 1) & ~F.col("_headed"), "header_not_first").when(s == "", "empty")
        .when(~is_dna & (odd != ""), F.concat(F.lit("invalid: "), odd)).when(~is_dna & s.rlike(r"\*."), "inner_stop_mark").when(s == "*", "no_residue")
    )
    read = read.withColumn("refused", refused)
    kind = F.when(F.col("refused").isNull(), F.when(is_dna, "cds").otherwise("protein"))
    read = read.withColumn("input_type", kind)
    cds, whole = F.col("input_type") == "cds", F.floor(F.length(s) / 3).cast("int") * 3
    last = F.when(whole > 0, F.substring(s, whole - 2, F.lit(3)))
    frame, stop = F.length(s) % 3 == 0, F.when(last.isin(*STOPS), last)
    read = read.withColumns({
        "frame_valid": F.when(cds, frame), "start_present": F.when(cds, F.coalesce((whole > 0) & s.startswith("ATG"), F.lit(False))), "stop_codon": F.when(cds, stop),
        "internal_stops": F.when(cds, internal_stops(F.substring(s, F.lit(1), whole))), "gc": F.when(cds, F.round(gc_percent(s), 1)),
    })
    made = F.when(frame, F.when(F.col("stop_codon").isNotNull(), translate_dna(F.substring(s, F.lit(1), whole - 3))).otherwise(translate_dna(s))).otherwise("")
    kept = lambda *of: F.filter(F.array(*of), lambda x: x.isNotNull())
    read = read.withColumns({
        "protein": F.when(cds, made).when(F.col("input_type") == "protein", F.regexp_replace(s, r"\*$", "")),
        "errors": kept(F.when(cds & ~frame, "frame"), F.when(F.col("internal_stops") > 0, "internal_stop")),
        "warnings": kept(F.when(cds & ~F.col("start_present"), "no_start"), F.when(cds & F.col("stop_codon").isNull(), "no_stop")),
    })
    return read.withColumn("generation_allowed", F.col("refused").isNull() & (F.size("errors") == 0)).drop("_lines", "_heads", "_headed")


def checked_dna(rows: DataFrame, column: str, trim: bool = False) -> DataFrame:
    """Adds the input checks of DNA: sequence (trimmed to whole codons, if asked), gc (2 places), stop_positions (codons, from 1), errors and warnings with their codes, level (error, warning, ok).

    Codes: INVALID_DNA_CHARS, AMBIGUOUS_DNA, FRAME_ERROR, INTERNAL_STOP (any stop but one at the end), EXTREME_GC (below 30 or above 70).
    """
    clean = settled(rows.withColumn("_all", F.upper(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s", ""))), "_all")
    a, s = F.col("_all"), F.col("sequence")
    cut = F.substring(a, F.lit(1), F.length(a) - F.length(a) % 3) if trim else a
    clean = clean.withColumn("sequence", cut)
    places = F.transform(F.filter(F.transform(codons(s), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].isin(*STOPS)), lambda x: x["i"] + 1)
    clean = settled(clean.withColumn("stop_positions", places), "stop_positions")
    stops, size = F.col("stop_positions"), F.floor(F.length(s) / 3)
    inner = (F.size(stops) > 1) | ((F.size(stops) == 1) & (F.get(stops, F.lit(0)) != size))
    kept = lambda *of: F.filter(F.array(*of), lambda x: x.isNotNull())
    judged = clean.withColumns({
        "gc": F.round(gc_percent(s), 2),
        "errors": kept(F.when(a.rlike(f"[^ACGT{AMBIGUOUS}]"), "INVALID_DNA_CHARS")),
        "warnings": kept(F.when(a.rlike(f"[{AMBIGUOUS}]"), "AMBIGUOUS_DNA"), F.when(F.length(a) % 3 != 0, "FRAME_ERROR"), F.when(inner, "INTERNAL_STOP"), F.when(~gc_percent(s).between(30.0, 70.0), "EXTREME_GC")),
    })
    return judged.withColumn("level", F.when(F.size("errors") > 0, "error").when(F.size("warnings") > 0, "warning").otherwise("ok")).drop("_all")


#: Names of a report's measures, in order.
MEASURES = ("identity", "gc", "gc_window_min", "gc_window_max", "gc_window_outliers", "first_30_gc", "first_60_gc", "first_90_gc", "internal_stops", "invalid_codons", "forbidden_motifs", "homopolymers", "repeats")
WHOLE = MEASURES[4:5] + MEASURES[8:]


def identity(expected: str | None, made: str) -> float | None:
    """Equal places over the expected length, as scalar.aa_identity()."""
    if expected is None:
        return None
    if made.endswith("*") and not expected.endswith("*"):
        made = made[:-1]
    return 0.0 if not expected else 1.0 if expected == made else sum(map(eq, expected, made)) / len(expected)


def validation_report(
    candidates: DataFrame, protein: str = "aa", column: str = "cds", window: int = 60, low: float = 30.0, high: float = 70.0,
    forbidden: tuple[str, ...] = (), forbidden_fail: bool = False, longest_run: int = 6, shortest_unit: int = 2, longest_unit: int = 6, copies: int = 3,
) -> DataFrame:
    """Candidates with MEASURES, errors, warnings and passed, made in the candidate's own row.

    Repeats are tandem ones: units of each length that follow each other `copies` times or more; a span that two lengths find counts once.
    """
    patterns = [m.encode() for m in forbidden if m]

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        texts, proteins = batch.column("_s").to_pylist(), batch.column("_aa").to_pylist()
        t, codes = Texts.of(texts), usage.read_places(texts)
        share, row = batches.window_shares(t, window)
        ends, n = np.searchsorted(row, np.arange(len(texts))), len(texts)
        gc, at = batches.upto(batches.is_gc(t)), t.starts
        first = {f"first_{k}_gc": batches.percent(gc[at + np.minimum(k, t.lengths)] - gc[at], np.minimum(k, t.lengths)) for k in (30, 60, 90)}
        made = Texts(np.frombuffer((RESIDUES + "X").encode(), np.uint8)[codes.letters], codes.lengths).texts()
        inner = usage.STOP[codes.letters] & (codes.places() < np.repeat(codes.lengths - 1, codes.lengths))
        of, _, length = batches.letter_runs(t)
        spans: list[set[tuple[int, int]]] = [set() for _ in texts]
        for unit in range(shortest_unit, longest_unit + 1):
            for r, start, end in batches.tandems(t, unit, copies):
                spans[r].add((start, end))
        return {
            "identity": [0.0 if s == "" else identity(a, m) for s, a, m in zip(texts, proteins, made)], "gc": batches.percent(batches.counts(batches.is_gc(t), t), t.lengths),
            "gc_window_min": np.minimum.reduceat(share, ends), "gc_window_max": np.maximum.reduceat(share, ends),
            "gc_window_outliers": np.where(t.lengths > 0, np.bincount(row[(share < low) | (share > high)], minlength=n), 0), **first,
            "internal_stops": batches.counts(inner, codes), "invalid_codons": batches.counts(codes.letters == usage.OTHER, codes) + (t.lengths % 3 > 0),
            "forbidden_motifs": batches.site_counts(t, patterns), "homopolymers": np.bincount(of[length >= longest_run], minlength=n), "repeats": [len(x) for x in spans],
        }

    kinds = {m: pa.int32() if m in WHOLE else pa.float64() for m in MEASURES}
    rows = candidates.withColumns({"_s": normalize_dna(F.coalesce(F.col(column), F.lit(""))), "_aa": F.col(protein)})
    rows, s = batches.mapped(rows, "_s", kinds, run, drop=("_aa",)), F.col("_s")
    some = lambda c: F.col(c) > 0
    motifs = F.when(some("forbidden_motifs"), "forbidden_motifs")
    kept = lambda *of: F.filter(F.array(*of), lambda x: x.isNotNull())
    errors = [F.when(s == "", "empty"), F.when(F.length(s) % 3 != 0, "frame"), F.when(F.col("identity") < 1.0, "identity"), F.when(some("invalid_codons"), "invalid_codons"), F.when(some("internal_stops"), "internal_stops")]
    warnings = [F.when(some("gc_window_outliers"), "gc_windows"), F.when(some("homopolymers"), "homopolymers"), F.when(some("repeats"), "repeats")]
    if forbidden_fail:
        errors.append(motifs)
    else:
        warnings.insert(1, motifs)
    judged = rows.withColumns({"errors": kept(*errors), "warnings": kept(*warnings)})
    return judged.withColumn("passed", F.size("errors") == 0).drop("_s")
