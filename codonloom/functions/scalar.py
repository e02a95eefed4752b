"""Per-sequence metrics as Column builders: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import HYDROPATHY, RESIDUES, STOPS, codon_place


def normalize_dna(s: Column) -> Column:
    """Upper case, U as T, no white space."""
    return F.regexp_replace(F.translate(F.upper(s), "U", "T"), r"\s", "")


def codons(s: Column) -> Column:
    """Whole codons; a partial tail is left out. One pass over the text: substring() would walk from its start for every codon."""
    return F.regexp_extract_all(s, F.lit("(?s).{3}"), F.lit(0))


def translate_dna(s: Column) -> Column:
    """One letter per whole codon; X for a codon that is not in the code."""
    return translate_places(F.transform(codons(s), codon_place))


def translate_places(places: Column) -> Column:
    """One letter per codon place; X for null."""
    letters = F.array(*[F.lit(a) for a in RESIDUES])
    return F.array_join(F.transform(places, lambda k: F.coalesce(F.get(letters, k - 1), F.lit("X"))), "")


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def gc_percent(s: Column) -> Column:
    return F.coalesce(gc_count(s) * F.lit(100.0).cast("double") / F.nullif(F.length(s), F.lit(0)), F.lit(0.0))


def gc_count(s: Column) -> Column:
    return 2 * F.length(s) - F.length(F.replace(s, F.lit("G"), F.lit(""))) - F.length(F.replace(s, F.lit("C"), F.lit("")))


def internal_stops(s: Column) -> Column:
    """Stop codons before the last codon."""
    c = codons(s)
    inner = F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    return F.size(F.filter(inner, lambda x: x.isin(*STOPS)))


def count_of(s: Column, motif: str) -> Column:
    """Occurrences, overlapping ones too."""
    return F.when(s.contains(motif), F.regexp_count(s, F.lit(f"(?={motif})"))).otherwise(F.lit(0))


def dinucleotide_ratio(s: Column, pair: str) -> Column:
    """Observed over expected: obs / (n1 * n2 / n); 0 where nothing is expected."""
    each = [F.length(s) - F.length(F.replace(s, F.lit(x))) for x in pair]
    expected = each[0] * each[1] / F.nullif(F.length(s), F.lit(0)).cast("double")
    return F.coalesce(count_of(s, pair) / F.nullif(expected, F.lit(0.0)), F.lit(0.0))


def gc_band_score(gc: Column, low: float, high: float, fade: float = 20.0) -> Column:
    """1 inside the band, falling to 0 over `fade` points outside."""
    away = F.greatest(F.lit(low) - gc, gc - F.lit(high), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - away / fade)


def aa_identity(expected: Column, observed: Column) -> Column:
    """Equal places over the expected length; one trailing stop of `observed` is dropped if `expected` has none."""
    trimmed = F.when(observed.endswith("*") & ~expected.endswith("*"), F.substring(observed, F.lit(1), F.length(observed) - 1)).otherwise(observed)
    same = F.aggregate(F.zip_with(F.split(expected, ""), F.split(trimmed, ""), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda t, x: t + x)
    return F.when(F.length(expected) == 0, F.lit(0.0)).when(expected == trimmed, F.lit(1.0)).otherwise(same / F.length(expected).cast("double"))


def sequence_type(s: Column) -> Column:
    """fasta, dna, protein or unknown, in this order of tests; unambiguous DNA first, protein before ambiguous DNA."""
    return (
        F.when(F.ltrim(s).startswith(">"), "fasta")
        .when(s.rlike("^[ACGTU]+$"), "dna")
        .when(s.rlike(r"^[ACDEFGHIKLMNPQRSTVWY*]+$"), "protein")
        .when(s.rlike("^[ACGTUNRYSWKMBDHV]+$"), "dna")
        .otherwise("unknown")
    )


def hydropathy(residue: Column) -> Column:
    """Kyte-Doolittle value in tenths; 0 for other letters."""
    table = F.create_map(*[x for a, v in HYDROPATHY.items() for x in (F.lit(a), F.lit(v))])
    return F.coalesce(table[residue], F.lit(0))


def mean_hydropathy(s: Column) -> Column:
    """The mean over all residues; null for an empty protein. Counted letter by letter, so no array is made."""
    total = sum(((F.length(s) - F.length(F.replace(s, F.lit(a)))) * v for a, v in HYDROPATHY.items()), F.lit(0))
    return total / (F.nullif(F.length(s), F.lit(0)) * 10).cast("double")


def invalid_codons(s: Column) -> Column:
    """array<struct<pos, codon, reason>>: a partial tail, or a codon with another letter than ACGT; pos from 0."""
    every = F.regexp_extract_all(s, F.lit("(?s).{1,3}"), F.lit(0))
    reason = lambda c: F.when(F.length(c) < 3, "partial").when(c.rlike("[^ACGT]"), "invalid_base")
    judged = F.transform(every, lambda c, i: F.struct(i.alias("pos"), c.alias("codon"), reason(c).alias("reason")))
    return F.filter(judged, lambda r: r["reason"].isNotNull())


def dinucleotide_score(s: Column, cpg: float = 0.0, tpa: float = 1.0) -> Column:
    """1 without the pairs, falling to 0 at twice the expected count; 1 below six bases."""
    part = lambda pair: F.greatest(F.lit(0.0), 1 - dinucleotide_ratio(s, pair) / 2.0)
    mean = (part("CG") * F.lit(cpg) + part("TA") * F.lit(tpa)) / F.lit(cpg + tpa) if cpg + tpa else F.lit(1.0)
    return F.when(F.length(s) < 6, F.lit(1.0)).otherwise(mean)


def risk(tm_count: Column, mean_kd: Column, signal: Column, least: float = 0.3) -> Column:
    """HIGH, MEDIUM or LOW from membrane segments, hydropathy and the signal-peptide flag."""
    return F.when((tm_count >= 3) | ((tm_count >= 1) & (mean_kd >= least) & ~signal), "HIGH").when(tm_count >= 1, "MEDIUM").otherwise("LOW")


def gene_id(header: Column) -> Column:
    """The gene= or gene: tag after a boundary, in any case; else the first token, without its transcript: mark and its version; null if nothing is left."""
    tag = lambda mark: F.nullif(F.regexp_extract(header, rf"(?i)(?:^|[\s;|])gene{mark}([^\s;|]+)", 1), F.lit(""))
    first = F.regexp_extract(header, r"^\s*(\S*)", 1)
    name = F.regexp_replace(first, "(?i)^transcript:", "")
    return F.coalesce(tag("="), tag(":"), F.nullif(F.regexp_replace(name, r"\.[0-9]+$", ""), F.lit("")))
