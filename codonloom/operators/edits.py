"""Sites taken out of coding sequences by synonymous codons, in rounds.

A round makes one edit in a sequence that still has a pending hit: of the
codons that the hit touches, in order, and their synonyms, by frequency, the first that breaks the hit
and brings no new one. What cannot be edited is remembered with its reason, so later hits get their turn. A sequence's
rounds follow each other in its own task, so nothing is written between them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import ASSEMBLY, STOPS, code
from ..functions.scalar import normalize_dna
from . import batches
from .scans import starts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sites that no edit may bring in, by name and forward strand.
BUILT_IN = {"BsaI": "GGTCTC", "BpiI": "GAAGAC", "BsmBI": "CGTCTC"}
#: The lengths that a custom site may have.
SHORTEST, LONGEST = 4, 12

HIT = "struct<position:int,name:string,strand:string,pattern:string>"
REMOVED = ("name", "position", "substitution")
UNRESOLVED = ("name", "position", "strand", "reason")
NO_BASES = str.maketrans("", "", "ACGT")


def complement(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def site_table(spark: SparkSession, sites: list[tuple[str | None, str | None]]) -> tuple[DataFrame, DataFrame]:
    """(name, sequence) of the sites that can be used, and the refused ones with a reason.

    Sequences are normalised, a missing name is the sequence itself; a name or sequence that was given before is refused.
    """
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(sites)], "ord int, name string, sequence string")
    rows = rows.withColumn("sequence", normalize_dna(F.coalesce("sequence", F.lit("")))).withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("sequence")))
    again = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("ord")) > 1
    reason = (
        F.when(F.col("sequence") == "", "empty").when(F.col("sequence").rlike("[^ACGT]"), "invalid_base")
        .when(~F.length("sequence").between(SHORTEST, LONGEST), "length").when(F.col("again_name"), "duplicate_name").when(F.col("again_sequence"), "duplicate_sequence")
    )
    judged = rows.withColumns({"again_name": again("name"), "again_sequence": again("sequence")}).withColumn("reason", reason)
    return judged.filter("reason is null").select("name", "sequence"), judged.filter("reason is not null").select("name", "sequence", "reason")


def patterns_of(sites: dict[str, str], both: bool = True) -> list[tuple[str, str, str]]:
    """(name, strand, pattern): a site's own and, unless it is its own, its reverse complement."""
    return [(n, strand, p) for n, s in sites.items() for strand, p in (("fwd", s), ("rc", complement(s))) if strand == "fwd" or both and p != s]


def hits_of(s: Column, patterns: list[tuple[str, str, str]]) -> Column:
    """array<HIT> by position, name and strand."""
    hit = lambda n, strand, p: lambda x: F.struct(x.cast("int").alias("position"), F.lit(n).alias("name"), F.lit(strand).alias("strand"), F.lit(p).alias("pattern"))
    return F.sort_array(F.flatten(F.array(*[F.transform(starts_of(s, x[2]), hit(*x)) for x in patterns]))).cast(f"array<{HIT}>")


def synonyms(frequencies: dict[str, float]) -> dict[str, list[str]]:
    """By codon the others of its residue, the most frequent first, equal ones by letters. Stops have none."""
    table = code()
    ordered = sorted(table, key=lambda c: (-(frequencies.get(c) or 0.0), c))
    return {c: [x for x in ordered if x != c and table[x] == a] for c, a in table.items() if a != "*"}


def unfit(s: str) -> str | None:
    """Why a sequence is not edited at all: frame, invalid_base, internal_stop; None if it is."""
    if len(s) % 3:
        return "frame"
    if s.translate(NO_BASES):
        return "invalid_base"
    inner = any(k % 3 == 0 and k < len(s) - 3 for stop in STOPS for k in found_in(s, stop))
    return "internal_stop" if inner else None


def found_in(s: str, pattern: str) -> Iterator[int]:
    """Every place of the pattern, overlapping ones too."""
    k = s.find(pattern)
    while k >= 0:
        yield k
        k = s.find(pattern, k + 1)


def editable_end(s: str) -> int:
    """Where editing ends: before a last stop codon."""
    return len(s) - (3 if s[-3:] in STOPS else 0)


def edit_of(cds: str, position: int, pattern: str, others: dict[str, list[str]], guarded: list[str]) -> tuple[int, str] | None:
    """(start, codon) of the first edit that breaks the hit and brings no new one, by the codons that it touches and their synonyms in order."""

    def brings(k: int, alt: str, p: str) -> bool:
        """Whether the pattern stands somewhere across the new codon where it did not stand before."""
        low, high = max(0, k - len(p) + 1), k + 2 + len(p)
        was = cds[low:high]
        return any(was[i : i + len(p)] != p for i in found_in(cds[low:k] + alt + cds[k + 3 : high], p))

    end = min(position + len(pattern), editable_end(cds) - 2)
    for k in range(position - position % 3, end, 3):
        for alt in others.get(cds[k : k + 3], ()):
            broken = not (cds[:k] + alt + cds[k + 3 :]).startswith(pattern, position)
            if broken and not any(brings(k, alt, p) for p in guarded):
                return k, alt
    return None


def edited(cds: str, own: list[tuple[str, str, str]], guarded: list[str], others: dict[str, list[str]], rounds: int) -> tuple[str, list[tuple], list[tuple]]:
    """(cds, removed, unresolved) after at most `rounds` actions, each on the first hit that is not given up."""
    removed, unresolved, given_up = [], [], set()
    for k in range(rounds + 1):
        hits = sorted((i, n, strand, p) for n, strand, p in own for i in found_in(cds, p))
        pending = [h for h in hits if (h[1], h[0], h[2]) not in given_up]
        if k == rounds:
            unresolved += [(n, i, strand, "max_iter_reached") for i, n, strand, _ in pending]
        if k == rounds or not pending:
            break
        i, n, strand, p = pending[0]
        outside = i + len(p) > editable_end(cds)
        edit = None if outside else edit_of(cds, i, p, others, guarded)
        if edit is None:
            given_up.add((n, i, strand))
            unresolved.append((n, i, strand, "outside_cds" if outside else "no_synonymous_substitution"))
        else:
            at, alt = edit
            removed.append((n, i, f"{cds[at : at + 3]}->{alt}"))
            cds = cds[:at] + alt + cds[at + 3 :]
    return cds, removed, unresolved


def without_sites(seqs: DataFrame, sites: dict[str, str], frequencies: dict[str, float], rounds: int = 10, both: bool = True, built_in: dict[str, str] | None = None) -> DataFrame:
    """seq_id, cds, error, removed, unresolved of (seq_id, cds): the sites edited away, at most one action a round.

    Reasons of what stays: outside_cds, no_synonymous_substitution, max_iter_reached. A sequence out of frame, with other
    letters or an inner stop is left as it is, with its error. Protein and length never change.
    """
    own = patterns_of(sites, both)
    guarded = sorted({p for _, _, p in own + patterns_of(BUILT_IN if built_in is None else built_in)})
    others = synonyms(frequencies)

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        rows = []
        for s in batch.column("cds").to_pylist():
            error = unfit(s) if s is not None else None
            rows.append((s, error, [], []) if s is None or error else (lambda c, r, u: (c, None, r, u))(*edited(s, own, guarded, others, rounds)))
        named = lambda k, names: [[dict(zip(names, x)) for x in r[k]] for r in rows]
        return {"cds": [r[0] for r in rows], "error": [r[1] for r in rows], "removed": named(2, REMOVED), "unresolved": named(3, UNRESOLVED)}

    kind = lambda names: pa.list_(pa.struct([(n, pa.int32() if n == "position" else pa.string()) for n in names]))
    return batches.mapped(seqs.select("seq_id", "cds"), "cds", {"cds": pa.string(), "error": pa.string(), "removed": kind(REMOVED), "unresolved": kind(UNRESOLVED)}, run)


def domesticated(seqs: DataFrame, standard: str, frequencies: dict[str, float], rounds: int = 100) -> DataFrame:
    """without_sites() for the listed strands of an assembly standard, whose own sites are the only ones guarded."""
    sites = {f"{enzyme}{'' if k == 0 else '_rc'}": s for enzyme, both in ASSEMBLY[standard].items() for k, s in enumerate(both)}
    return without_sites(seqs, sites, frequencies, rounds, both=False, built_in={})


def new_findings(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("seq_id", "name", "position", "strand")) -> DataFrame:
    """The findings of `after` that `before` has not: what edits brought in."""
    return after.join(before.select(*keys).distinct(), list(keys), "left_anti")


def findings(seqs: DataFrame, sites: dict[str, str], column: str = "cds") -> DataFrame:
    """seq_id, name, position, strand, pattern: every hit of the sites, on both strands."""
    return seqs.select("seq_id", F.inline(hits_of(F.col(column), patterns_of(sites)))).select("seq_id", "name", "position", "strand", "pattern")
