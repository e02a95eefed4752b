"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as p
from ..functions.codes import POLYA, RESIDUES, TYPE_IIS
from ..operators import generate, ranges, scans, usage
from ..sources.corpus import SEQUENCES_SQL, sequences
from ..sources.fasta import fasta_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CODE_SQL = f"""code AS (
  SELECT substr('TCAG', 1 + i // 16, 1) || substr('TCAG', 1 + (i // 4) % 4, 1) || substr('TCAG', 1 + i % 4, 1) AS codon, substr('{RESIDUES}', i + 1, 1) AS aa
  FROM (SELECT CAST(range AS INT) AS i FROM range(64)))"""
CODONS_SQL = "cod AS (SELECT seq_id, i AS pos, substr(dna, 3 * i + 1, 3) AS codon FROM seqs, unnest(range(0, length(dna) // 3)) AS t(i))"
FILTER_SQL = """tried AS (
  SELECT *, CASE WHEN regexp_matches(dna, '[^ACGT]') THEN 'non_atgc' WHEN length(dna) % 3 <> 0 THEN 'length_mod3' WHEN length(cds) < 60 THEN 'too_short'
    WHEN len(list_filter(range(0, length(cds) // 3), lambda i: substr(cds, 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA'))) > 0 THEN 'internal_stop'
    WHEN regexp_matches(lower(header), 'chloroplast|plastid|mitochondria|chrc|chrm') THEN 'organellar' END AS r1
  FROM (SELECT *, CASE WHEN length(dna) % 3 = 0 THEN regexp_replace(dna, '(TAA|TAG|TGA)$', '') ELSE dna END AS cds FROM seqs)),
uniq AS (SELECT *, CASE WHEN r1 IS NULL AND row_number() OVER (PARTITION BY cds, r1 IS NULL ORDER BY seq_id) > 1 THEN 'duplicate' ELSE r1 END AS r2 FROM tried),
judged AS (SELECT *, CASE WHEN r2 IS NULL AND row_number() OVER (PARTITION BY gene, r2 IS NULL ORDER BY length(cds) DESC, seq_id) > 1 THEN 'isoform_shorter' ELSE r2 END AS reason FROM uniq)"""
COUNTS_SQL = """seen AS (SELECT substr(cds, 3 * i + 1, 3) AS codon FROM judged, unnest(range(0, length(cds) // 3)) AS t(i) WHERE reason IS NULL),
counts AS (SELECT c.codon, c.aa, count(s.codon) AS n FROM code c LEFT JOIN seen s ON s.codon = c.codon GROUP BY 1, 2)"""
USAGE_SQL = """freq AS (SELECT *, CASE WHEN aa = '*' THEN 0.0::DOUBLE ELSE round((n + 1) / (sum(n) OVER (PARTITION BY aa) + count(*) OVER (PARTITION BY aa))::DOUBLE, 6) END AS frequency FROM counts),
profile AS (SELECT codon, aa, n, frequency,
  round(CASE WHEN aa = '*' THEN 0.0::DOUBLE ELSE n::DOUBLE END * 1000.0::DOUBLE / nullif(sum(n) FILTER (WHERE aa <> '*') OVER (), 0), 4) AS per_thousand,
  CASE WHEN aa <> '*' THEN frequency / max(frequency) OVER (PARTITION BY aa) END AS w FROM freq)"""
PROFILE_SQL = ",\n".join([SEQUENCES_SQL, CODE_SQL, FILTER_SQL, COUNTS_SQL, USAGE_SQL])


def query(name: str, sql: str | None = None, ctes: str = SEQUENCES_SQL) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {ctes}\n{sql}" if ctes else sql  # ctes may begin with RECURSIVE
        return f

    return add


def metric(name: str, value: Callable[[], F.Column] | None, sql: str, ctes: str = SEQUENCES_SQL, rows: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A query of one value per sequence, by an expression or by a function that makes seq_id, value of the sequences."""
    made = rows or (lambda seqs: seqs.select("seq_id", value().alias("value")))
    query(name, f"SELECT seq_id, {sql} AS value FROM seqs", ctes)(lambda spark, d: made(sequences(spark, d)))


_gc = "coalesce(length(regexp_replace({0}, '[^GC]', '', 'g')) * 100.0::DOUBLE / nullif(length({0}), 0), 0.0::DOUBLE)"
_count = "CAST(len(list_filter(range(1, length({0}) - length('{1}') + 2), lambda i: substr({0}, i, length('{1}')) = '{1}')) AS INTEGER)"
_ratio = f"coalesce({_count} / nullif((length(dna) - length(replace(dna, '{{2}}', ''))) * (length(dna) - length(replace(dna, '{{3}}', ''))) / nullif(length(dna), 0)::DOUBLE, 0), 0.0::DOUBLE)"
dna = lambda: F.col("dna")

metric("p01_normalize_dna", lambda: p.normalize_dna(F.concat(F.lit(" "), F.lower(F.translate("dna", "T", "U")), F.lit("\n"))), "dna")
metric("p02_codons", lambda: F.array_join(p.codons(dna()), " "), "coalesce(array_to_string(list_transform(range(0, length(dna) // 3), lambda i: substr(dna, 3 * i + 1, 3)), ' '), '')")
metric("p03_translate", lambda: p.translate_dna(dna()), "coalesce((SELECT string_agg(coalesce(c.aa, 'X'), '' ORDER BY i) FROM unnest(range(0, length(dna) // 3)) AS t(i) LEFT JOIN code c ON c.codon = substr(dna, 3 * i + 1, 3)), '')", f"{SEQUENCES_SQL}, {CODE_SQL}")
metric("p04_reverse_complement", lambda: p.reverse_complement(dna()), "reverse(translate(dna, 'ACGT', 'TGCA'))")
metric("p05_gc_percent", lambda: p.gc_percent(dna()), _gc.format("dna"))
for k in (30, 60, 90):
    metric(f"p06_gc_first_{k}", lambda k=k: p.gc_percent(F.substring("dna", 1, k)), _gc.format(f"substr(dna, 1, {k})"))
metric("p08_internal_stops", lambda: p.internal_stops(dna()), "CAST(len(list_filter(range(0, length(dna) // 3 - 1), lambda i: substr(dna, 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA'))) AS INTEGER)")
metric("p14_cpg_ratio", lambda: p.dinucleotide_ratio(dna(), "CG"), _ratio.format("dna", "CG", "C", "G"))
metric("p14_tpa_ratio", lambda: p.dinucleotide_ratio(dna(), "TA"), _ratio.format("dna", "TA", "T", "A"))
metric("p16_gc_band_score", lambda: F.round(p.gc_band_score(p.gc_percent(dna()), 40.0, 47.0), 6), f"round(greatest(0.0::DOUBLE, 1 - greatest(40.0::DOUBLE - {_gc.format('dna')}, {_gc.format('dna')} - 47.0::DOUBLE, 0.0::DOUBLE) / 20.0::DOUBLE), 6)")
metric("p21_sequence_type", lambda: p.sequence_type(F.col("aa")), "CASE WHEN ltrim(aa) LIKE '>%' THEN 'fasta' WHEN regexp_full_match(aa, '[ACGTU]+') THEN 'dna' WHEN regexp_full_match(aa, '[ACDEFGHIKLMNPQRSTVWY*]+') THEN 'protein' WHEN regexp_full_match(aa, '[ACGTUNRYSWKMBDHV]+') THEN 'dna' ELSE 'unknown' END")
metric("p32_signal_peptide", lambda: F.substring(F.upper("aa"), 1, 30).rlike("[ILVAMFW]{7}"), "regexp_matches(substr(upper(aa), 1, 30), '[ILVAMFW]{7}')")
metric("f08_valid_orf", lambda: F.length("dna").between(150, 5000) & (F.length("dna") % 3 == 0) & F.col("dna").rlike("^ATG[ACGT]*(TAA|TAG|TGA)$"), "length(dna) BETWEEN 150 AND 5000 AND length(dna) % 3 = 0 AND regexp_full_match(dna, 'ATG[ACGT]*(TAA|TAG|TGA)')")
metric("s03_fasta_sink", lambda: F.regexp_replace("dna", "(.{80})(?=.)", "$1\n"), "coalesce(array_to_string(list_transform(range(0, (length(dna) + 79) // 80), lambda i: substr(dna, 80 * i + 1, 80)), chr(10)), '')")


@query("f01_cds_filter", "SELECT seq_id, coalesce(reason, 'kept') AS reason FROM judged", f"{SEQUENCES_SQL}, {FILTER_SQL}")
def f01(spark: SparkSession, d: str) -> DataFrame:
    return usage.cds_filter(sequences(spark, d)).select("seq_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("f01_reason_counts", "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1", f"{SEQUENCES_SQL}, {FILTER_SQL}")
def f01_counts(spark: SparkSession, d: str) -> DataFrame:
    return f01(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def profile(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_profile(usage.codon_counts(usage.kept_cds(sequences(spark, d))))


@query("a01_codon_counts", "SELECT codon, aa, n FROM counts", ",\n".join([SEQUENCES_SQL, CODE_SQL, FILTER_SQL, COUNTS_SQL]))
def a01(spark: SparkSession, d: str) -> DataFrame:
    return usage.codon_counts(usage.kept_cds(sequences(spark, d)))


@query("a02_usage_profile", "SELECT codon, aa, n, frequency, per_thousand FROM profile", PROFILE_SQL)
def a02(spark: SparkSession, d: str) -> DataFrame:
    return profile(spark, d).drop("w")


@query("a03_adaptiveness", "SELECT codon, aa, round(w, 6) AS w FROM profile WHERE w IS NOT NULL", PROFILE_SQL)
def a03(spark: SparkSession, d: str) -> DataFrame:
    return profile(spark, d).filter("w is not null").select("codon", "aa", F.round("w", 6).alias("w"))


@query("a04_best_codon", "SELECT aa, codon FROM (SELECT aa, codon, row_number() OVER (PARTITION BY aa ORDER BY w DESC, codon) AS r FROM profile WHERE w IS NOT NULL) WHERE r = 1", PROFILE_SQL)
def a04(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("aa").orderBy(F.desc("w"), "codon")
    return profile(spark, d).filter("w is not null").withColumn("r", F.row_number().over(w)).filter("r = 1").select("aa", "codon")


@query("a05_sequence_usage", "SELECT seq_id, codon, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY seq_id)::DOUBLE AS frequency FROM cod GROUP BY 1, 2", f"{SEQUENCES_SQL}, {CODONS_SQL}")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return usage.sequence_usage(sequences(spark, d))


@query("p10_cai", """SELECT seq_id, round(CASE WHEN length(dna) % 3 <> 0 OR bad OR n = 0 THEN 0.0::DOUBLE ELSE exp(s / n) END, 6) AS cai FROM (
  SELECT q.seq_id, q.dna, count(c.codon) AS n, coalesce(bool_or(c.codon IS NOT NULL AND (f.w IS NULL OR f.w <= 0)), false) AS bad, sum(ln(nullif(f.w, 0))) AS s
  FROM seqs q LEFT JOIN cod c ON c.seq_id = q.seq_id AND c.codon NOT IN ('TAA', 'TAG', 'TGA') LEFT JOIN profile f ON f.codon = c.codon GROUP BY 1, 2)""", f"{PROFILE_SQL},\n{CODONS_SQL}")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return usage.cai(sequences(spark, d), pinned(spark, d)).select("seq_id", F.round("cai", 6).alias("cai"))


def _hits_sql(motifs: dict[str, str], name: str) -> str:
    values = ", ".join(f"('{m}', '{n}')" for m, n in motifs.items())
    return f"""SELECT q.seq_id, m.motif, m.name AS {name}, CAST(i AS INTEGER) AS start FROM seqs q, (VALUES {values}) AS m(motif, name), unnest(range(0, greatest(length(q.dna) - length(m.motif) + 1, 0))) AS t(i)
WHERE substr(q.dna, CAST(i AS INT) + 1, length(m.motif)) = m.motif"""


@query("m01_polya", _hits_sql(POLYA, "tier"))
def m01(spark: SparkSession, d: str) -> DataFrame:
    return scans.polya(sequences(spark, d))


@query("m02_polya_clusters", f"""SELECT seq_id, CAST(s AS INTEGER) AS start, count(DISTINCT motif) AS patterns FROM ({_hits_sql(POLYA, 'tier')}) h JOIN (SELECT seq_id AS k, length(dna) AS n FROM seqs) l ON l.k = h.seq_id,
unnest(range(greatest(0, h.start - 24), least(h.start, l.n - 30) + 1)) AS t(s) WHERE l.n >= 30 GROUP BY 1, 2 HAVING count(DISTINCT motif) >= 2""")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return scans.polya_clusters(sequences(spark, d))


@query("m03_are", _hits_sql({"ATTTA": "ARE"}, "name"))
def m03(spark: SparkSession, d: str) -> DataFrame:
    return scans.motif_hits(sequences(spark, d), {"ATTTA": "ARE"})


def _spans_sql(pattern: str, high: int) -> str:
    return f"""SELECT seq_id, CAST(place AS INTEGER) AS start, CAST(place + length(m) AS INTEGER) AS "end", m AS match, CASE WHEN length(m) >= {high} THEN 'high' ELSE 'medium' END AS severity FROM (
  SELECT seq_id, m, sum(length(x)) OVER (PARTITION BY seq_id ORDER BY k) + coalesce(sum(length(m)) OVER (PARTITION BY seq_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM (
    SELECT seq_id, unnest(string_split_regex(dna, '{pattern}')) AS x, unnest(regexp_extract_all(dna, '{pattern}')) AS m, generate_subscripts(string_split_regex(dna, '{pattern}'), 1) AS k FROM seqs)) WHERE m IS NOT NULL"""


@query("m04_at_runs", _spans_sql("[AT]{6,}", 8))
def m04(spark: SparkSession, d: str) -> DataFrame:
    return scans.at_runs(sequences(spark, d))


@query("m05_homopolymers", _spans_sql("A{8,}|C{8,}|G{8,}|T{8,}", 10))
def m05(spark: SparkSession, d: str) -> DataFrame:
    return scans.homopolymers(sequences(spark, d))


@query("m08_repeats", """SELECT seq_id, substr(dna, CAST(i AS INT) + 1, 15) AS kmer, count(*) AS count, CAST(min(i) AS INTEGER) AS first, list(CAST(i AS INTEGER) ORDER BY i) AS starts FROM seqs, unnest(range(0, greatest(length(dna) - 14, 0))) AS t(i) GROUP BY 1, 2 HAVING count(*) > 1""")
def m08(spark: SparkSession, d: str) -> DataFrame:
    return scans.repeats(sequences(spark, d))


_windows = """wins AS (SELECT DISTINCT seq_id, dna, s FROM (SELECT seq_id, dna, unnest(range(0, greatest(length(dna) - 60, 0) + 1, 30)) AS s FROM seqs WHERE length(dna) > 0
  UNION ALL SELECT seq_id, dna, greatest(length(dna) - 60, 0) FROM seqs WHERE length(dna) > 0)),
gcw AS (SELECT seq_id, CAST(s AS INTEGER) AS start, length(regexp_replace(substr(dna, CAST(s AS INT) + 1, 60), '[^GC]', '', 'g')) * 100.0::DOUBLE / length(substr(dna, CAST(s AS INT) + 1, 60)) AS gc FROM wins)"""


@query("m11_gc_windows", "SELECT seq_id, start, round(gc, 6) AS gc FROM gcw", f"{SEQUENCES_SQL}, {_windows}")
def m11(spark: SparkSession, d: str) -> DataFrame:
    return scans.gc_windows(sequences(spark, d)).withColumn("gc", F.round("gc", 6))


@query("m12_gc_window_outliers", "SELECT seq_id, round(min(gc), 6) AS low, round(max(gc), 6) AS high, count(*) FILTER (WHERE gc < 30 OR gc > 70) AS outliers FROM gcw GROUP BY 1", f"{SEQUENCES_SQL}, {_windows}")
def m12(spark: SparkSession, d: str) -> DataFrame:
    out = F.count(F.when((F.col("gc") < 30) | (F.col("gc") > 70), 1)).alias("outliers")
    return scans.gc_windows(sequences(spark, d)).groupBy("seq_id").agg(F.round(F.min("gc"), 6).alias("low"), F.round(F.max("gc"), 6).alias("high"), out)


@query("m21_type_iis", _hits_sql({s: e for e, pair in TYPE_IIS.items() for s in pair}, "enzyme"))
def m21(spark: SparkSession, d: str) -> DataFrame:
    return scans.type_iis(sequences(spark, d))


@query("w01_longest_isoform", "SELECT seq_id, gene FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY length(dna) DESC, seq_id) AS r FROM seqs) WHERE r = 1 OR gene IS NULL")
def w01(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d).select("seq_id", "gene", F.length("dna").alias("n"))
    lone = rows.filter("gene is null").select("seq_id", "gene")
    return rows.join(usage.longest_of(rows), "seq_id", "left_semi").select("seq_id", "gene").unionByName(lone)


@query("w02_dedup", "SELECT min(seq_id) AS seq_id, count(*) AS copies FROM seqs GROUP BY dna")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).groupBy(F.sha2("dna", 256)).agg(F.min("seq_id").alias("seq_id"), F.count(F.lit(1)).alias("copies")).select("seq_id", "copies")


@query("w09_top_codons", "SELECT seq_id, codon, n FROM (SELECT seq_id, codon, count(*) AS n, row_number() OVER (PARTITION BY seq_id ORDER BY count(*) DESC, codon) AS r FROM cod GROUP BY 1, 2) WHERE r <= 5", f"{SEQUENCES_SQL}, {CODONS_SQL}")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_codons(sequences(spark, d), 5)


BEST_SQL = "best AS (SELECT aa, codon FROM (SELECT aa, codon, row_number() OVER (PARTITION BY aa ORDER BY w DESC, codon) AS r FROM profile WHERE w IS NOT NULL) WHERE r = 1)"


def proteins(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).filter("aa <> ''").select("seq_id", "aa")


@query("g01_greedy_cai", "SELECT q.seq_id, string_agg(b.codon, '' ORDER BY i) AS cds FROM seqs q, unnest(range(1, length(q.aa) + 1)) AS t(i) JOIN best b ON b.aa = substr(q.aa, CAST(i AS INT), 1) GROUP BY 1", f"{PROFILE_SQL},\n{BEST_SQL}")
def g01(spark: SparkSession, d: str) -> DataFrame:
    return generate.greedy(proteins(spark, d), pinned(spark, d)).select("seq_id", generate.spelt(F.col("codes")).alias("cds"))


CHOICES_SQL = "choices AS (SELECT aa, list(codon ORDER BY codon) AS cs FROM code GROUP BY aa)"
RANDOM_SQL = """SELECT q.seq_id, CAST(r AS INTEGER) AS replicate, string_agg(c.cs[1 + ('0x' || substr(md5('320|' || q.seq_id || '|' || r || '|' || ((i - 1) // 8)), 1 + 4 * CAST((i - 1) % 8 AS INT), 4))::BIGINT % len(c.cs)], '' ORDER BY i) AS cds
FROM seqs q, unnest(range(0, 3)) AS u(r), unnest(range(1, length(q.aa) + 1)) AS t(i) JOIN choices c ON c.aa = substr(q.aa, CAST(i AS INT), 1) GROUP BY 1, 2"""


@query("g02_random_synonymous", RANDOM_SQL, f"{SEQUENCES_SQL}, {CODE_SQL}, {CHOICES_SQL}")
def g02(spark: SparkSession, d: str) -> DataFrame:
    return generate.random_synonymous(proteins(spark, d)).select("seq_id", "replicate", generate.spelt(F.col("codes")).alias("cds"))


def pinned(spark: SparkSession, d: str) -> DataFrame:
    """The profile's 64 rows, computed once and held as literals by the queries that use them more than once."""
    rows = profile(spark, d)
    return spark.createDataFrame(rows.collect(), rows.schema)


def results(spark: SparkSession, d: str) -> DataFrame:
    weights, aa = pinned(spark, d), proteins(spark, d)
    return generate.score(generate.greedy(aa, weights).unionByName(generate.random_synonymous(aa)), weights)


def held_once(ctes: str) -> str:
    """The same common tables, each computed once."""
    return re.sub(r"^(\w+) AS \((?=\s*SELECT)|(?<=,)(\s*)(\w+) AS \((?=\s*SELECT)", lambda m: f"{m[2] or ''}{m[1] or m[3]} AS MATERIALIZED (", ctes, flags=re.M)


def count_sql(text: str, motif: str) -> str:
    """Occurrences, overlapping ones too. Where a motif ends with the letter that it begins with, that letter is doubled in the text, so that none overlap any more; a longer overlap needs a list of places."""
    x = motif[0]
    if any(motif.startswith(motif[-k:]) for k in range(2, len(motif))):
        return _count.format(text, motif)
    if motif[-1] == x:
        doubled, inner = f"replace({text}, '{x}', '{x}{x}')", x + motif[1:-1].replace(x, x + x) + x
        return f"(length({doubled}) - length(replace({doubled}, '{inner}', ''))) // {len(inner)}"
    return f"(length({text}) - length(replace({text}, '{motif}', ''))) // {len(motif)}"


_sites = " + ".join(count_sql("cds", s) for pair in TYPE_IIS.values() for s in pair)
#: One row per codon, then one pass over them.
SCORES_SQL = f"""
made AS (SELECT p.seq_id, p.method, p.replicate, string_agg(p.codon, '' ORDER BY p.i) AS cds, string_agg(f.aa, '' ORDER BY p.i) AS back, round(exp(avg(ln(f.w))), 6) AS cai
  FROM picks p JOIN profile f ON f.codon = p.codon GROUP BY 1, 2, 3),
results AS (SELECT *, biological_pass AND assembly_pass AND gc_pass AS multi_pass FROM (
  SELECT seq_id, method, replicate, cai, sites, gc, back = aa AND NOT contains(left(back, length(back) - 1), '*') AS biological_pass, sites = 0 AS assembly_pass, gc BETWEEN 40 AND 47 AS gc_pass
  FROM (SELECT *, {_sites} AS sites, round({_gc.format("cds")}, 2) AS gc FROM made JOIN (SELECT seq_id, aa FROM seqs) USING (seq_id))))"""
RESULTS_SQL = held_once(f"""{PROFILE_SQL},
{BEST_SQL},
{CHOICES_SQL},
hex AS (SELECT seq_id, r, b, md5('320|' || seq_id || '|' || r || '|' || b) AS h FROM seqs, unnest(range(0, 3)) AS u(r), unnest(range(0, (length(aa) + 7) // 8)) AS t(b)),
picks AS (
  SELECT q.seq_id, 'greedy_cai' AS method, 0 AS replicate, i, b.codon FROM seqs q, unnest(range(0, length(q.aa))) AS t(i) JOIN best b ON b.aa = substr(q.aa, CAST(i AS INT) + 1, 1)
  UNION ALL SELECT q.seq_id, 'random_synonymous', CAST(x.r AS INTEGER), 8 * x.b + j, c.cs[1 + ('0x' || substr(x.h, 1 + 4 * CAST(j AS INT), 4))::BIGINT % len(c.cs)]
    FROM hex x JOIN seqs q USING (seq_id), unnest(range(0, 8)) AS t(j) JOIN choices c ON c.aa = substr(q.aa, CAST(8 * x.b + j AS INT) + 1, 1)),
{SCORES_SQL}""")


@query("r04_benchmark_scores", "SELECT seq_id, method, replicate, cai, sites, gc, biological_pass, assembly_pass, gc_pass, multi_pass FROM results", RESULTS_SQL)
def r04(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("seq_id", "method", "replicate", "cai", "sites", "gc", "biological_pass", "assembly_pass", "gc_pass", "multi_pass")


@query("a08_method_summary", """SELECT method, count(DISTINCT seq_id) AS n_ok, count(*) AS n_rows, round(avg(biological_pass::INT), 4) AS biological_rate, round(avg(assembly_pass::INT), 4) AS assembly_rate,
  round(avg(gc_pass::INT), 4) AS gc_rate, round(avg(multi_pass::INT), 4) AS multi_rate, round(avg(cai), 4) AS mean_cai FROM results GROUP BY 1""", RESULTS_SQL)
def a08(spark: SparkSession, d: str) -> DataFrame:
    return generate.summary(results(spark, d))


@query("a10_failure_attribution", """SELECT method, category, round(sum(n) / any_value(k), 6) AS weight FROM (SELECT method, category, 0 AS n FROM (SELECT DISTINCT method FROM results), (VALUES ('passed'), ('biological'), ('gc_and_sites'), ('gc_only'), ('sites_only')) AS c(category)
  UNION ALL SELECT method, category, 1 FROM (SELECT method, CASE WHEN multi_pass THEN 'passed' WHEN NOT biological_pass THEN 'biological' WHEN NOT gc_pass AND NOT assembly_pass THEN 'gc_and_sites' WHEN NOT gc_pass THEN 'gc_only' ELSE 'sites_only' END AS category FROM results))
  JOIN (SELECT method, count(*) / count(DISTINCT seq_id)::DOUBLE AS k FROM results GROUP BY 1) USING (method) GROUP BY 1, 2""", RESULTS_SQL)
def a10(spark: SparkSession, d: str) -> DataFrame:
    return generate.failures(results(spark, d))


@query("a18_cai_distribution", "SELECT method, round(quantile_cont(cai, 0.25), 6) AS q1, round(quantile_cont(cai, 0.5), 6) AS q2, round(quantile_cont(cai, 0.75), 6) AS q3 FROM results GROUP BY 1", RESULTS_SQL)
def a18(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("cai", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return results(spark, d).groupBy("method").agg(q.alias("q")).select("method", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])


@query("w05_expression_quintiles", "SELECT seq_id, CAST(ntile(5) OVER (PARTITION BY gene ORDER BY tpm, seq_id) AS INTEGER) AS bin FROM seqs")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return ranges.numbered(sequences(spark, d).select("seq_id", "gene", "tpm"), "gene", ["tpm", "seq_id"]).select("seq_id", ranges.tile(5).alias("bin"))


@query("s04_batch_fasta", "SELECT '>' || header || chr(10) || coalesce(array_to_string(list_transform(range(0, (length(dna) + 79) // 80), lambda i: substr(dna, 80 * i + 1, 80)), chr(10)), '') AS value FROM seqs")
def s04(spark: SparkSession, d: str) -> DataFrame:
    return fasta_lines(sequences(spark, d).select("header", F.col("dna").alias("seq")))
