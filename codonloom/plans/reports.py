"""Registered queries of input contexts, validation reports, composite scores, blended tables, splits and dinucleotides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dinucleotides, generate, intake, ranges, scoring, usage
from ..operators.intake import AMBIGUOUS, DNA, DNA_OR_M, PROTEIN_ONLY
from ..sources.corpus import SEQUENCES_SQL, sequences, settled
from ..sources.tables import confident
from .designs import TABLES_SQL, spelt
from .queries import CODONS_SQL, RESULTS_SQL, _gc, pinned, proteins, query, results

RAW_SQL = f"""raw AS (SELECT seq_id, CASE (seq_id // 1000000 + seq_id) % 8 WHEN 0 THEN lower(dna) || ' ' WHEN 1 THEN '> ' || header || chr(10) || substr(dna, 1, 60) || chr(13) || chr(10) || substr(dna, 61)
  WHEN 2 THEN aa WHEN 3 THEN aa || '*' WHEN 4 THEN substr(aa, 1, 3) || '*' || aa WHEN 5 THEN '  ' || chr(10) WHEN 6 THEN '>a' || chr(10) || dna || chr(10) || '>b' || chr(10) || dna
  ELSE 'ATG' || substr(replace(dna, 'N', 'A'), 1, CAST(length(dna) - length(dna) % 3 AS INT)) || 'TAA' END AS raw FROM seqs)"""


def raw_inputs(spark: SparkSession, d: str) -> DataFrame:
    """seq_id, raw: sequences as users hand them in, eight forms: bases, FASTA, proteins with and without stop marks, blanks, two records, whole reading frames."""
    whole = F.concat(F.lit("ATG"), F.substring(F.replace("dna", F.lit("N"), F.lit("A")), F.lit(1), F.length("dna") - F.length("dna") % 3), F.lit("TAA"))
    fasta = F.concat(F.lit("> "), "header", F.lit("\n"), F.substring("dna", 1, 60), F.lit("\r\n"), F.substring(F.col("dna"), F.lit(61), F.length("dna")))
    forms = [F.concat(F.lower("dna"), F.lit(" ")), fasta, F.col("aa"), F.concat("aa", F.lit("*")), F.concat(F.substring("aa", 1, 3), F.lit("*"), "aa"), F.lit("  \n"), F.concat(F.lit(">a\n"), "dna", F.lit("\n>b\n"), "dna")]
    kind = (F.floor(F.col("seq_id") / 1000000) + F.col("seq_id")) % 8
    raw = whole
    for k, form in enumerate(forms):
        raw = F.when(kind == k, form).otherwise(raw)
    return settled(sequences(spark, d).select("seq_id", raw.alias("raw")), "raw")


_every = "ACDEFGHIKLMNPQRSTVWY*"
_stops = "len(list_filter(range(0, length({0}) // 3 - 1), lambda i: substr({0}, 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA')))"


@query("p22_resolved_types", f"""SELECT seq_id, detected, refused, CASE WHEN refused IS NULL THEN CASE WHEN detected <> 'ambiguous' THEN detected WHEN length(s) >= 6 AND length(s) % 3 = 0 THEN 'dna' ELSE 'protein' END END AS resolved FROM (
  SELECT *, CASE WHEN s = '' THEN 'empty' WHEN odd <> '' THEN 'invalid: ' || odd END AS refused,
    CASE WHEN s = '' THEN 'ambiguous' WHEN regexp_matches(s, '[{PROTEIN_ONLY}]') THEN 'protein' WHEN NOT regexp_matches(s, '[^{DNA}]') THEN CASE WHEN length(s) >= 6 AND length(s) % 3 = 0 THEN 'dna' ELSE 'ambiguous' END WHEN NOT regexp_matches(s, '[^{DNA_OR_M}]') THEN 'ambiguous' ELSE 'protein' END AS detected
  FROM (SELECT seq_id, s, coalesce(array_to_string(list_sort(list_distinct(string_split(regexp_replace(s, '[{_every}]', '', 'g'), ''))), ','), '') AS odd FROM (SELECT seq_id, upper(regexp_replace(raw, '\\s', '', 'g')) AS s FROM raw)))""", f"{SEQUENCES_SQL}, {RAW_SQL}")
def p22(spark: SparkSession, d: str) -> DataFrame:
    return intake.resolved(raw_inputs(spark, d), "raw").select("seq_id", "detected", "refused", "resolved")


@query("p23_input_context", f"""SELECT seq_id, header, refused, input_type, frame_valid, start_present, stop_codon, internal_stops, gc, CASE WHEN input_type = 'protein' THEN length(rtrim(s, '*')) WHEN input_type = 'cds' THEN CASE WHEN frame_valid THEN length(s) // 3 - (stop_codon IS NOT NULL)::INT ELSE 0 END END AS protein_length,
  concat_ws(',', CASE WHEN NOT frame_valid THEN 'frame' END, CASE WHEN internal_stops > 0 THEN 'internal_stop' END) AS errors, concat_ws(',', CASE WHEN NOT start_present THEN 'no_start' END, CASE WHEN input_type = 'cds' AND stop_codon IS NULL THEN 'no_stop' END) AS warnings,
  refused IS NULL AND coalesce(frame_valid, true) AND coalesce(internal_stops, 0) = 0 AS generation_allowed
FROM (SELECT *, CASE WHEN cds THEN length(s) % 3 = 0 END AS frame_valid, CASE WHEN cds THEN starts_with(s, 'ATG') END AS start_present, CASE WHEN cds AND substr(s, CAST(3 * (length(s) // 3) - 2 AS INT), 3) IN ('TAA', 'TAG', 'TGA') THEN substr(s, CAST(3 * (length(s) // 3) - 2 AS INT), 3) END AS stop_codon,
    CASE WHEN cds THEN CAST({_stops.format('s')} AS INTEGER) END AS internal_stops, CASE WHEN cds THEN round({_gc.format('s')}, 1) END AS gc FROM (
  SELECT *, input_type = 'cds' AS cds FROM (SELECT *, CASE WHEN refused IS NULL THEN CASE WHEN dna THEN 'cds' ELSE 'protein' END END AS input_type FROM (
    SELECT *, CASE WHEN heads > 1 THEN 'many_records' WHEN s = '' THEN 'empty' WHEN NOT dna AND odd <> '' THEN 'invalid: ' || odd WHEN NOT dna AND regexp_matches(s, '\\*.') THEN 'inner_stop_mark' WHEN s = '*' THEN 'no_residue' END AS refused FROM (
      SELECT seq_id, s, heads, CASE WHEN heads > 0 THEN trim(substr(lines[1], 2)) END AS header, s <> '' AND NOT regexp_matches(s, '[^ACGT]') AS dna, coalesce(array_to_string(list_sort(list_distinct(string_split(regexp_replace(s, '[{_every}]', '', 'g'), ''))), ', '), '') AS odd FROM (
        SELECT seq_id, lines, len(list_filter(lines, lambda x: starts_with(x, '>'))) AS heads, upper(coalesce(array_to_string(CASE WHEN starts_with(coalesce(lines[1], ''), '>') THEN lines[2:] ELSE lines END, ''), '')) AS s FROM (
          SELECT seq_id, list_filter(list_transform(string_split(replace(raw, chr(13), ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM raw)))))))""", f"{SEQUENCES_SQL}, {RAW_SQL}")
def p23(spark: SparkSession, d: str) -> DataFrame:
    rows = intake.context(raw_inputs(spark, d), "raw")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("seq_id", "header", "refused", "input_type", "frame_valid", "start_present", "stop_codon", "internal_stops", "gc", F.length("protein").cast("long").alias("protein_length"), joined("errors"), joined("warnings"), "generation_allowed")


@query("r01_input_checks", f"""SELECT seq_id, round({_gc.format('s')}, 2) AS gc, stops AS stop_positions, errors, warnings, CASE WHEN errors <> '' THEN 'error' WHEN warnings <> '' THEN 'warning' ELSE 'ok' END AS level FROM (
  SELECT *, CASE WHEN regexp_matches(a, '[^ACGT{AMBIGUOUS}]') THEN 'INVALID_DNA_CHARS' ELSE '' END AS errors,
    concat_ws(',', CASE WHEN regexp_matches(a, '[{AMBIGUOUS}]') THEN 'AMBIGUOUS_DNA' END, CASE WHEN length(a) % 3 <> 0 THEN 'FRAME_ERROR' END, CASE WHEN places > 1 OR places = 1 AND stops <> CAST(length(s) // 3 AS VARCHAR) THEN 'INTERNAL_STOP' END, CASE WHEN NOT {_gc.format('s')} BETWEEN 30 AND 70 THEN 'EXTREME_GC' END) AS warnings
  FROM (SELECT seq_id, a, s, len(p) AS places, coalesce(array_to_string(p, ' '), '') AS stops FROM (SELECT *, list_transform(list_filter(range(0, length(s) // 3), lambda i: substr(s, 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA')), lambda i: i + 1) AS p FROM (
    SELECT seq_id, a, substr(a, 1, CAST(length(a) - length(a) % 3 AS INT)) AS s FROM (SELECT seq_id, CASE WHEN (seq_id // 1000000) % 11 = 0 THEN replace(dna, 'N', 'X') ELSE dna END AS a FROM seqs)))))""")
def r01(spark: SparkSession, d: str) -> DataFrame:
    odd = F.floor(F.col("seq_id") / 1000000) % 11 == 0
    rows = sequences(spark, d).select("seq_id", F.when(odd, F.replace("dna", F.lit("N"), F.lit("X"))).otherwise(F.col("dna")).alias("dna"))
    return intake.checked_dna(rows, "dna", trim=True).select("seq_id", "gc", F.array_join("stop_positions", " ").alias("stop_positions"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "level")


@query("r03_validation_report")
def r03(spark: SparkSession, d: str) -> DataFrame:
    """Random codings of the proteins, every seventh document's cut out of frame."""
    made = generate.random_synonymous(proteins(spark, d), replicates=1).select("seq_id", "aa", generate.spelt(F.col("codes")).alias("cds"))
    odd = F.floor(F.col("seq_id") / 1000000) % 7 == 3
    rows = made.withColumn("cds", F.when(odd, F.substring(F.col("cds"), F.lit(2), F.length("cds"))).otherwise(F.col("cds")))
    return intake.validation_report(rows, forbidden=("AATAAA", "ATTTA", "GGTCTC")).select("seq_id", *intake.MEASURES, "errors", "warnings", "passed")


GOLDEN_SQL = TABLES_SQL.rstrip() + """,
filled AS MATERIALIZED (SELECT p.codon, coalesce(CASE WHEN g.frequency >= 0.1 THEN g.w END, p.frequency / nullif(max(p.frequency) OVER (PARTITION BY p.aa), 0)) AS w FROM plain_freq p JOIN profile g ON g.codon = p.codon WHERE p.aa <> '*'),
""" + CODONS_SQL + """,
golden AS MATERIALIZED (SELECT q.seq_id, q.dna, coalesce(CASE WHEN length(q.dna) % 3 = 0 THEN exp(avg(ln(nullif(f.w, 0)))) END, 0) AS cai FROM seqs q LEFT JOIN cod c ON c.seq_id = q.seq_id LEFT JOIN filled f ON f.codon = c.codon GROUP BY 1, 2)"""


def plain_table(spark: SparkSession, d: str) -> DataFrame:
    """The codon table of all sequences: 64 rows, held as literals."""
    rows = usage.usage_profile(usage.codon_counts(sequences(spark, d), "dna"))
    return spark.createDataFrame(rows.collect(), rows.schema)


def golden(spark: SparkSession, d: str, places: int | None) -> DataFrame:
    """Of the golden set the codons below a tenth of their residue are left out; the table of all sequences stands in for them."""
    kept = pinned(spark, d).select("codon", F.when(F.col("frequency") >= 0.1, F.col("w")).alias("w"))
    return scoring.golden_cai(sequences(spark, d).select("seq_id", "dna"), scoring.filled_weights(kept, plain_table(spark, d)), places=places)


@query("p11_golden_cai", "SELECT seq_id, round(cai, 3) AS cai FROM golden", GOLDEN_SQL)
def p11(spark: SparkSession, d: str) -> DataFrame:
    return golden(spark, d, 3).select("seq_id", "cai")


_band = "greatest(0.0::DOUBLE, 1 - greatest(low - {0}, {0} - high, 0.0::DOUBLE) / 20.0::DOUBLE)"
_weights = ", ".join(f"('{n}', {c}::DOUBLE, {g}::DOUBLE, {dn}::DOUBLE, {40.0 if lo is None else lo}::DOUBLE, {47.0 if hi is None else hi}::DOUBLE)" for n, c, g, _, dn, _, lo, hi in scoring.PROFILES).replace("0.7::DOUBLE, 0.0::DOUBLE, 40.0::DOUBLE, 47.0::DOUBLE", "0.7::DOUBLE, 0.0::DOUBLE, 40.0::DOUBLE, 50.0::DOUBLE")


@query("p18_composite_scores", f"SELECT seq_id, profile, round_even((wc * least(cai, 1.0::DOUBLE) + wg * {_band.format('gc')}) / (wc + wg), 3) AS score FROM (SELECT seq_id, cai, {_gc.format('dna')} AS gc FROM golden), (VALUES {_weights}) AS p(profile, wc, wg, wd, low, high)", GOLDEN_SQL)
def p18(spark: SparkSession, d: str) -> DataFrame:
    """Without folding energies and language model, whose weights the others share; gc_target aims at 45 percent."""
    return scoring.composite(golden(spark, d, None), scoring.profiles(spark, target_gc=45.0)).select("seq_id", "profile", "score")


@query("j07_blended_table", """SELECT codon, aa, frequency, round(frequency * 1000 / count(*) OVER (PARTITION BY aa), 1) AS per_thousand, first_value(codon) OVER (PARTITION BY aa ORDER BY frequency DESC, codon) AS preferred FROM (
  SELECT codon, aa, CASE WHEN t > 0 THEN round(f / t, 4) ELSE f END AS frequency FROM (SELECT *, sum(f) OVER (PARTITION BY aa) AS t FROM (SELECT p.codon, p.aa, 0.7::DOUBLE * p.frequency + 0.3::DOUBLE * e.frequency AS f FROM profile p JOIN plain_freq e ON e.codon = p.codon)))""", TABLES_SQL)
def j07(spark: SparkSession, d: str) -> DataFrame:
    return scoring.blended(pinned(spark, d), plain_table(spark, d))


@query("w04_best_candidate", "SELECT seq_id, method, replicate, cai FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY multi_pass DESC, cai DESC, replicate, method) AS r FROM results) WHERE r = 1", RESULTS_SQL)
def w04(spark: SparkSession, d: str) -> DataFrame:
    """The best of a sequence's candidates by one aggregation, which combines in tasks; the earlier replicate wins a tie."""
    order = F.struct((~F.col("multi_pass")).alias("bad"), (-F.col("cai")).alias("cai"), "replicate", "method")
    best = results(spark, d).groupBy("seq_id").agg(F.min(order).alias("b"))
    return best.select("seq_id", "b.method", "b.replicate", (-F.col("b.cai")).alias("cai"))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Places of all rows in one order, sorted in ranges."""
    return ranges.numbered(rows.withColumn("_all", F.lit(0)), "_all", order)


@query("w07_random_split", "SELECT seq_id, CASE WHEN r <= n * 9 // 10 THEN 'train' ELSE 'eval' END AS split FROM (SELECT seq_id, row_number() OVER (ORDER BY md5('42|' || seq_id), seq_id) AS r, count(*) OVER () AS n FROM seqs)")
def w07(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).select("seq_id", F.md5(F.concat(F.lit("42|"), F.col("seq_id").cast("string"))).alias("_o"))
    return ranked(rows, ["_o", "seq_id"]).select("seq_id", F.expr("CASE WHEN r <= n * 9 div 10 THEN 'train' ELSE 'eval' END").alias("split"))


@query("w08_length_split", "SELECT seq_id, CASE WHEN n > 1 AND (r - 1) % 10 = 0 THEN 'eval' ELSE 'train' END AS split FROM (SELECT seq_id, row_number() OVER (ORDER BY length(aa), seq_id) AS r, count(*) OVER () AS n FROM seqs)")
def w08(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).select("seq_id", F.length("aa").alias("_o"))
    return ranked(rows, ["_o", "seq_id"]).select("seq_id", F.expr("CASE WHEN n > 1 AND (r - 1) % 10 = 0 THEN 'eval' ELSE 'train' END").alias("split"))


@query("f05_confident_proteins", """SELECT min(seq_id) AS seq_id, aa AS sequence FROM (SELECT seq_id, aa, CASE seq_id % 6 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN NULL ELSE (tpm % 9)::DOUBLE END AS p, CASE seq_id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN NULL ELSE (tpm % 4) / 100.0::DOUBLE END AS f FROM seqs) WHERE p > 2 AND f < 0.03::DOUBLE AND aa <> '' GROUP BY aa""")
def f05(spark: SparkSession, d: str) -> DataFrame:
    """Matches and rates as text, some empty, some no numbers."""
    n = F.col("seq_id")
    psm = F.when(n % 6 == 0, "").when(n % 6 == 1, "n/a").otherwise((F.col("tpm") % 9).cast("string"))
    fdr = F.when(n % 5 == 0, " ").when(n % 5 == 1, "-").otherwise((F.col("tpm") % 4 / F.lit(100.0)).cast("string"))
    rows = sequences(spark, d).select("seq_id", psm.alias("psm"), fdr.alias("fdr"), F.concat(F.lower("aa"), F.lit(" ")).alias("peptide"))
    return confident(rows, "psm", "fdr", "peptide", "seq_id", 2.0, 0.03)


@query("g20_fewer_dinucleotides")
def g20(spark: SparkSession, d: str) -> DataFrame:
    made = spelt(generate.random_synonymous(proteins(spark, d), replicates=1))
    rows = pinned(spark, d).collect()
    frequencies, weights = ({r["codon"]: r[c] for r in rows if r[c] is not None} for c in ("frequency", "w"))
    return dinucleotides.fewer_pairs(made, frequencies, weights, mode="balanced", cai_floor=0.6)
