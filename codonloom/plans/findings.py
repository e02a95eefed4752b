"""Registered queries of findings, reviews, splits and comparisons, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as p
from ..functions.codes import ASSEMBLY, HYDROPATHY, POLYA, codon_place
from ..operators import generate, ranges, review, scans, usage
from ..sources.corpus import SEQUENCES_SQL, sequences
from ..sources.staging import staged
from ..streaming import events as stream
from .queries import CODE_SQL, CODONS_SQL, COUNTS_SQL, FILTER_SQL, PROFILE_SQL, RESULTS_SQL, _count, _gc, _hits_sql, _ratio, _spans_sql, count_sql, held_once, metric, pinned, profile, proteins, query, results

STOP_SQL = "('TAA', 'TAG', 'TGA')"
PLAIN_CODONS = "list_transform(range(0, length(dna) // 3), lambda i: substr(dna, 3 * i + 1, 3))"
KD_SQL = "kd AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {v})" for a, v in HYDROPATHY.items()) + ") AS t(aa, kd))"
BASES_SQL = "bases AS (SELECT seq_id, length(dna) AS n, CAST(i AS INT) AS pos, substr(dna, CAST(i AS INT) + 1, 1) AS x FROM seqs, unnest(range(0, length(dna))) AS t(i))"


def col(name: str) -> Column:
    return F.col(name)


# Per-sequence values.
metric("p15_dinucleotide_score", lambda: F.round(p.dinucleotide_score(col("dna")), 6), f"round(CASE WHEN length(dna) < 6 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - {_ratio.format('dna', 'TA', 'T', 'A')} / 2.0::DOUBLE) END, 6)")
metric("p24_foreign_letters", lambda: F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace("dna", "[ACGT]", ""), ""))), ""), "coalesce(array_to_string(list_sort(list_distinct(string_split(regexp_replace(dna, '[ACGT]', '', 'g'), ''))), ''), '')")
metric("p25_fingerprint", lambda: F.concat(F.lit("sha256:"), F.substring(F.sha2("dna", 256), 1, 16)), "'sha256:' || substr(sha256(dna), 1, 16)")
metric("p27_codon_tokens", lambda: F.array_join(F.filter(p.codons(col("dna")), lambda c: ~c.isin("TAA", "TAG", "TGA")), " "), f"coalesce(array_to_string(list_filter({PLAIN_CODONS}, lambda c: c NOT IN {STOP_SQL}), ' '), '')")
metric("p28_token_ids", lambda: F.array_join(F.transform(p.codons(col("dna")), lambda c: F.coalesce(codon_place(c) + 3, F.lit(3)).cast("string")), " "),
       f"coalesce(array_to_string(list_transform({PLAIN_CODONS}, lambda c: CASE WHEN c LIKE '%N%' THEN 3 ELSE 4 + 16 * (instr('TCAG', substr(c, 1, 1)) - 1) + 4 * (instr('TCAG', substr(c, 2, 1)) - 1) + instr('TCAG', substr(c, 3, 1)) - 1 END), ' '), '')")
metric("p29_gene_id", lambda: p.gene_id(col("header")), r"""coalesce(nullif(regexp_extract(header, '(?:^|[\s;|])gene=([^\s;|]+)', 1, 'i'), ''), nullif(regexp_extract(header, '(?:^|[\s;|])gene:([^\s;|]+)', 1, 'i'), ''),
  nullif(regexp_replace(regexp_replace(regexp_extract(header, '^\s*(\S*)', 1), '^transcript:', '', 'i'), '\.[0-9]+$', ''), ''))""")
metric("m07_longest_run", lambda: F.coalesce(F.array_max(F.transform(F.regexp_extract_all("dna", F.lit(r"([ACGT])\1*"), F.lit(0)), F.length)), F.lit(0)), "CAST(coalesce(list_max(list_transform(regexp_extract_all(dna, 'A+|C+|G+|T+'), lambda m: length(m))), 0) AS INTEGER)")
metric("m16_polya_missing", lambda: ~F.col("dna").rlike("|".join(POLYA)), f"NOT regexp_matches(dna, '{'|'.join(POLYA)}')")
metric("r01_input_warnings", lambda: F.concat_ws(",", F.when(F.col("dna").contains("N"), "ambiguous"), F.when(F.length("dna") % 3 != 0, "frame"), F.when(p.internal_stops(col("dna")) > 0, "internal_stop"), F.when(~p.gc_percent(col("dna")).between(30.0, 70.0), "extreme_gc")),
       f"concat_ws(',', CASE WHEN contains(dna, 'N') THEN 'ambiguous' END, CASE WHEN length(dna) % 3 <> 0 THEN 'frame' END, CASE WHEN len(list_filter(range(0, length(dna) // 3 - 1), lambda i: substr(dna, 3 * i + 1, 3) IN {STOP_SQL})) > 0 THEN 'internal_stop' END, CASE WHEN NOT {_gc.format('dna')} BETWEEN 30 AND 70 THEN 'extreme_gc' END)")


@query("p09_invalid_codons", f"""SELECT seq_id, CAST(i AS INTEGER) AS pos, substr(dna, 3 * CAST(i AS INT) + 1, 3) AS codon, CASE WHEN length(substr(dna, 3 * CAST(i AS INT) + 1, 3)) < 3 THEN 'partial' ELSE 'invalid_base' END AS reason
FROM seqs, unnest(range(0, (length(dna) + 2) // 3)) AS t(i) WHERE length(substr(dna, 3 * CAST(i AS INT) + 1, 3)) < 3 OR contains(substr(dna, 3 * CAST(i AS INT) + 1, 3), 'N')""")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("seq_id", F.inline(p.invalid_codons(col("dna"))))


@query("p26_buckets", f"""SELECT size, gc, count(*) AS n FROM (SELECT CASE WHEN length(dna) < 100 THEN '<100' WHEN length(dna) < 300 THEN '100-300' WHEN length(dna) < 1000 THEN '300-1000' ELSE '>1000' END AS size,
  CASE WHEN {_gc.format('dna')} < 40 THEN '<40' WHEN {_gc.format('dna')} <= 47 THEN '40-47' ELSE '>47' END AS gc FROM seqs) GROUP BY 1, 2""")
def p26(spark: SparkSession, d: str) -> DataFrame:
    n, gc = F.length("dna"), p.gc_percent(col("dna"))
    size = F.when(n < 100, "<100").when(n < 300, "100-300").when(n < 1000, "300-1000").otherwise(">1000")
    return sequences(spark, d).groupBy(size.alias("size"), F.when(gc < 40, "<40").when(gc <= 47, "40-47").otherwise(">47").alias("gc")).agg(F.count(F.lit(1)).alias("n"))


# Filters.
@query("f02_dataset_filter", f"SELECT min(seq_id) AS seq_id FROM seqs WHERE NOT contains(dna, 'N') AND length(dna) % 3 = 0 AND aa <> '' AND len(list_filter(range(0, length(dna) // 3 - 1), lambda i: substr(dna, 3 * i + 1, 3) IN {STOP_SQL})) = 0 GROUP BY dna")
def f02(spark: SparkSession, d: str) -> DataFrame:
    good = sequences(spark, d).filter(~F.col("dna").rlike("[^ACGT]") & (F.length("dna") % 3 == 0) & (F.col("aa") != "") & (p.internal_stops(col("dna")) == 0))
    return good.groupBy(F.sha2("dna", 256)).agg(F.min("seq_id").alias("seq_id")).select("seq_id")


@query("f04_percentile_filter", """SELECT seq_id, tpm FROM seqs WHERE tpm >= (SELECT tpm FROM (SELECT tpm, row_number() OVER (ORDER BY tpm) - 1 AS r, count(*) OVER () AS n FROM seqs WHERE tpm > 0) WHERE r = least(n * 75 // 100, n - 1))""")
def f04(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff is found in a histogram of distinct values, never in a sort of all rows."""
    rows = sequences(spark, d).filter("tpm > 0").select("seq_id", "tpm")
    steps = rows.groupBy("tpm").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("tpm"))).withColumn("n", F.sum("k").over(Window.partitionBy(F.lit(0))))
    cut = steps.filter(F.expr("upto > least(n * 75 div 100, n - 1)")).agg(F.min("tpm").alias("cut"))
    return rows.join(F.broadcast(cut), F.col("tpm") >= F.col("cut")).select("seq_id", "tpm")


# Scans.
@query("m06_expression_runs", _spans_sql("A{6,}|C{6,}|G{6,}|T{6,}|N{6,}", 10))
def m06(spark: SparkSession, d: str) -> DataFrame:
    return scans.spans(sequences(spark, d), r"(.)\1{5,}").withColumn("severity", F.when(F.length("match") >= 10, "high").otherwise("medium"))


@query("m09_repeated_kmers", "SELECT seq_id, count(*) AS n FROM (SELECT seq_id, substr(dna, CAST(i AS INT) + 1, 18) AS kmer FROM seqs, unnest(range(0, length(dna) - 17)) AS t(i) WHERE length(dna) >= 36 GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def m09(spark: SparkSession, d: str) -> DataFrame:
    return scans.repeats(sequences(spark, d).filter(F.length("dna") >= 36), 18).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))


@query("m14_gc_extremes", """SELECT seq_id, count(*) FILTER (WHERE gc * 100 < 1250) AS n_low, count(*) FILTER (WHERE gc * 100 > 3750) AS n_high FROM (
  SELECT seq_id, n, pos, sum(CASE WHEN x IN ('G', 'C') THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS gc FROM bases WHERE n >= 50) WHERE pos <= n - 50 GROUP BY 1""", f"{SEQUENCES_SQL}, {BASES_SQL}")
def m14(spark: SparkSession, d: str) -> DataFrame:
    return scans.gc_extremes(sequences(spark, d))


@query("m15_splice_pairs", f"""SELECT d.seq_id, d.start AS donor, a.start AS acceptor FROM ({_spans_sql('GT[AG]AG', 99)}) d JOIN ({_spans_sql('[CT]AG', 99)}) a ON a.seq_id = d.seq_id AND a.start - d.start BETWEEN 20 AND 200""")
def m15(spark: SparkSession, d: str) -> DataFrame:
    return scans.splice_pairs(sequences(spark, d))


_hot = "sum((pair = '{}')::INT) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 48 FOLLOWING)"


@query("m17_dinucleotide_hotspots", f"""SELECT seq_id, count(*) FILTER (WHERE coalesce(cpg, 0) / size::DOUBLE > 0.05::DOUBLE) AS n_cpg, count(*) FILTER (WHERE coalesce(tpa, 0) / size::DOUBLE > 0.05::DOUBLE) AS n_tpa FROM (
  SELECT *, least(n, 50) AS size, {_hot.format('CG')} AS cpg, {_hot.format('TA')} AS tpa FROM (SELECT *, x || lead(x) OVER (PARTITION BY seq_id ORDER BY pos) AS pair FROM bases)) WHERE n >= 2 AND pos <= n - size GROUP BY 1""", f"{SEQUENCES_SQL}, {BASES_SQL}")
def m17(spark: SparkSession, d: str) -> DataFrame:
    return scans.dinucleotide_hotspots(sequences(spark, d))


@query("m18_rare_codon_runs", f"""SELECT seq_id, CAST(min(pos) AS INTEGER) AS codon_index, count(*) AS run_length, CASE WHEN count(*) >= 5 THEN 'high' ELSE 'medium' END AS severity FROM (
  SELECT c.seq_id, c.pos, c.pos - row_number() OVER (PARTITION BY c.seq_id ORDER BY c.pos) AS g FROM cod c JOIN seqs q USING (seq_id) LEFT JOIN profile f ON f.codon = c.codon
  WHERE length(q.dna) % 3 = 0 AND c.codon NOT IN {STOP_SQL} AND coalesce(f.w, 0) < 0.3) GROUP BY seq_id, g HAVING count(*) >= 3""", f"{PROFILE_SQL},\n{CODONS_SQL}")
def m18(spark: SparkSession, d: str) -> DataFrame:
    return scans.rare_codon_runs(sequences(spark, d), pinned(spark, d))


SITES = {s: ",".join(f"{standard}:{enzyme}" for standard, of in ASSEMBLY.items() for enzyme, sites in of.items() if s in sites) for s in sorted({s for of in ASSEMBLY.values() for sites in of.values() for s in sites})}
OVERHANGS = {"AATG": "forward", "GCTT": "forward", "CATT": "reverse", "AAGC": "reverse"}


@query("m19_assembly_sites", _hits_sql(SITES, "site"))
def m19(spark: SparkSession, d: str) -> DataFrame:
    return scans.motif_hits(sequences(spark, d), SITES).withColumnRenamed("name", "site")


@query("m23_overhang_collisions", _hits_sql(OVERHANGS, "strand"))
def m23(spark: SparkSession, d: str) -> DataFrame:
    return scans.motif_hits(sequences(spark, d), OVERHANGS).withColumnRenamed("name", "strand")


@query("a26_violations", f"""SELECT seq_id, check_id, count(*) AS n FROM (SELECT seq_id, 'polya' AS check_id FROM ({_hits_sql(POLYA, 'tier')}) UNION ALL SELECT seq_id, 'are' FROM ({_hits_sql({'ATTTA': 'ARE'}, 'name')})
  UNION ALL SELECT seq_id, 'at_run' FROM ({_spans_sql('[AT]{6,}', 8)}) UNION ALL SELECT seq_id, 'homopolymer' FROM ({_spans_sql('A{8,}|C{8,}|G{8,}|T{8,}', 10)})) GROUP BY 1, 2""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    seqs = sequences(spark, d)
    found = {"polya": scans.polya(seqs), "are": scans.motif_hits(seqs, {"ATTTA": "ARE"}), "at_run": scans.at_runs(seqs), "homopolymer": scans.homopolymers(seqs)}
    parts = [df.select("seq_id", F.lit(name).alias("check_id")) for name, df in found.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("seq_id", "check_id").agg(F.count(F.lit(1)).alias("n"))


TM_SQL = f"""{KD_SQL}, residues AS (SELECT seq_id, length(aa) AS n, CAST(i AS INT) AS pos, substr(aa, CAST(i AS INT) + 1, 1) AS x FROM seqs, unnest(range(0, length(aa))) AS t(i)),
warm AS (SELECT * FROM (SELECT seq_id, n, pos, sum(coalesce(kd, 0)) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 18 FOLLOWING) AS s FROM residues LEFT JOIN kd ON kd.aa = x) WHERE pos <= n - 19 AND s >= 304),
tm AS (SELECT seq_id, count(*) FILTER (WHERE b IS NULL OR pos > b + 19) AS tm_count FROM (SELECT *, lag(pos) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM warm) GROUP BY 1)"""


@query("m25_tm_segments", "SELECT seq_id, tm_count FROM tm", f"{SEQUENCES_SQL}, {TM_SQL}")
def m25(spark: SparkSession, d: str) -> DataFrame:
    return scans.tm_segments(proteins(spark, d))


@query("p33_risk", """SELECT seq_id, round(kd, 6) AS mean_kd, tm_count, CASE WHEN tm_count >= 3 OR (tm_count >= 1 AND kd >= 0.3 AND NOT sp) THEN 'HIGH' WHEN tm_count >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (
  SELECT q.seq_id, coalesce(tm.tm_count, 0) AS tm_count, m.kd, regexp_matches(substr(q.aa, 1, 30), '[ILVAMFW]{7}') AS sp FROM seqs q
  JOIN (SELECT seq_id, sum(coalesce(kd, 0)) / (count(*) * 10)::DOUBLE AS kd FROM residues LEFT JOIN kd ON kd.aa = x GROUP BY 1) m USING (seq_id) LEFT JOIN tm USING (seq_id))""", f"{SEQUENCES_SQL}, {TM_SQL}")
def p33(spark: SparkSession, d: str) -> DataFrame:
    rows = proteins(spark, d)
    tm, kd = F.coalesce("tm_count", F.lit(0)), p.mean_hydropathy(col("aa"))
    return rows.join(scans.tm_segments(rows), "seq_id", "left").select("seq_id", F.round(kd, 6).alias("mean_kd"), tm.alias("tm_count"), p.risk(tm, kd, F.substring("aa", 1, 30).rlike("[ILVAMFW]{7}")).alias("risk"))


# Codon tables.
@query("a06_weighted_rscu", f"SELECT codon, aa, n, round(n / nullif(avg(n) OVER (PARTITION BY aa), 0), 6) AS rscu FROM (SELECT c.codon, c.aa, CAST(coalesce(sum(q.tpm), 0) AS BIGINT) AS n FROM code c LEFT JOIN cod ON cod.codon = c.codon LEFT JOIN seqs q ON q.seq_id = cod.seq_id GROUP BY 1, 2)", f"{SEQUENCES_SQL}, {CODE_SQL}, {CODONS_SQL}")
def a06(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences(spark, d)
    seen = rows.select("tpm", F.explode(p.codons(col("dna"))).alias("codon")).groupBy("codon").agg(F.sum("tpm").alias("n"))
    table = usage.code_table(spark).join(seen, "codon", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return table.withColumn("rscu", F.round(F.col("n") / F.nullif(F.avg("n").over(Window.partitionBy("aa")), F.lit(0.0)), 6))


@query("a14_weight_correlation", "SELECT round(corr(f.w, a.w), 6) AS r FROM profile f JOIN (SELECT codon, n / nullif(max(n) OVER (PARTITION BY aa), 0)::DOUBLE AS w FROM (SELECT c.codon, c.aa, count(cod.codon) AS n FROM code c LEFT JOIN cod ON cod.codon = c.codon GROUP BY 1, 2) WHERE aa <> '*') a USING (codon)", f"{PROFILE_SQL},\n{CODONS_SQL}")
def a14(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the kept records against plain weights of all sequences."""
    plain = usage.codon_counts(sequences(spark, d), "dna").filter("aa <> '*'").select("codon", (F.col("n") / F.nullif(F.max("n").over(Window.partitionBy("aa")), F.lit(0)).cast("double")).alias("v"))
    return profile(spark, d).join(F.broadcast(plain), "codon").agg(F.round(F.corr("w", "v"), 6).alias("r"))


@query("w03_codon_ranks", "SELECT aa, codon, CAST(row_number() OVER (PARTITION BY aa ORDER BY w DESC, codon) AS INTEGER) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY aa) AS k FROM profile WHERE w IS NOT NULL) WHERE k >= 2", PROFILE_SQL)
def w03(spark: SparkSession, d: str) -> DataFrame:
    kept = profile(spark, d).filter("w is not null").withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("aa"))).filter("k >= 2")
    return kept.select("aa", "codon", F.row_number().over(Window.partitionBy("aa").orderBy(F.desc("w"), "codon")).alias("rank"))


@query("g12_gc_bounds", "SELECT q.seq_id, CAST(sum(b.low) AS BIGINT) AS low, CAST(sum(b.high) AS BIGINT) AS high FROM seqs q, unnest(range(1, length(q.aa) + 1)) AS t(i) JOIN (SELECT aa, min(g) AS low, max(g) AS high FROM (SELECT aa, length(regexp_replace(codon, '[AT]', '', 'g')) AS g FROM code) GROUP BY 1) b ON b.aa = substr(q.aa, CAST(i AS INT), 1) GROUP BY 1", f"{SEQUENCES_SQL}, {CODE_SQL}")
def g12(spark: SparkSession, d: str) -> DataFrame:
    low, high = generate.gc_bounds(col("aa"))
    return proteins(spark, d).select("seq_id", low.alias("low"), high.alias("high"))


# Benchmark tables.
@query("a11_cofailure", "SELECT method, gc_pass, assembly_pass, round(sum(1.0::DOUBLE / k), 6) AS weight FROM results JOIN (SELECT method, seq_id, count(*) AS k FROM results GROUP BY 1, 2) USING (method, seq_id) GROUP BY 1, 2, 3", RESULTS_SQL)
def a11(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("method", "seq_id")))
    return rows.groupBy("method", "gc_pass", "assembly_pass").agg(F.round(F.sum(F.lit(1.0) / F.col("k")), 6).alias("weight"))


@query("a12_input_audit", "SELECT method, count(*) AS n_rows, count(DISTINCT seq_id) AS n_sequences, count(DISTINCT replicate) AS n_replicates FROM results GROUP BY 1", RESULTS_SQL)
def a12(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("seq_id").alias("n_sequences"), F.countDistinct("replicate").alias("n_replicates"))


@query("a19_candidate_summary", "SELECT method, count(*) AS n, round(avg(gc), 4) AS mean_gc, round(median(gc), 4) AS median_gc, min(gc) AS min_gc, max(gc) AS max_gc, round(stddev_pop(cai), 4) AS sd_cai FROM results GROUP BY 1", RESULTS_SQL)
def a19(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("gc"), 4).alias("mean_gc"), F.round(F.median("gc"), 4).alias("median_gc"), F.min("gc").alias("min_gc"), F.max("gc").alias("max_gc"), F.round(F.stddev_pop("cai"), 4).alias("sd_cai"))


REVIEW_SQL = held_once(f"""{RESULTS_SQL},
wins AS (SELECT DISTINCT seq_id, method, replicate, cds, s FROM (SELECT seq_id, method, replicate, cds, unnest(range(0, greatest(length(cds) - 60, 0) + 1, 30)) AS s FROM made UNION ALL SELECT seq_id, method, replicate, cds, greatest(length(cds) - 60, 0) FROM made)),
local AS (SELECT seq_id, method, replicate, min(g) AS low, max(g) AS high FROM (SELECT seq_id, method, replicate, {_gc.format('substr(cds, CAST(s AS INT) + 1, 60)')} AS g FROM wins) GROUP BY 1, 2, 3),
kmers AS (SELECT seq_id, method, replicate, len(list_distinct(list_filter(s, lambda x, i: i > 1 AND s[i - 1] = x))) AS repeats FROM (
  SELECT seq_id, method, replicate, list_sort(list_transform(range(1, length(cds) - 16), lambda i: substr(cds, CAST(i AS INT), 18))) AS s FROM made WHERE length(cds) >= 36)),
observed AS (SELECT seq_id, method, replicate, r.cai, {_gc.format('m.cds')} AS overall, low, high, r.sites, coalesce(repeats, 0) AS repeats,
    coalesce(list_max(list_transform(regexp_extract_all(m.cds, 'A+|C+|G+|T+'), lambda x: length(x))), 0) AS run, {" + ".join(count_sql("m.cds", x) for x in ("AATAAA", "GTAAGT", "ATTTA"))} AS motifs
  FROM made m JOIN results r USING (seq_id, method, replicate) JOIN local USING (seq_id, method, replicate) LEFT JOIN kmers USING (seq_id, method, replicate)),
matrix AS (SELECT seq_id, method, replicate, criterion, mode, low, high, CASE WHEN mode = 'ignored' THEN 'IGNORED' WHEN passed THEN 'PASS' WHEN mode = 'required' THEN 'FAIL' ELSE 'WARN' END AS result FROM (
  SELECT seq_id, method, replicate, 'cai' AS criterion, 'preferred' AS mode, cai AS low, cai AS high, cai >= 0.8 AS passed FROM observed
  UNION ALL SELECT seq_id, method, replicate, 'overall_gc', 'required', overall, overall, overall BETWEEN 40 AND 47 FROM observed
  UNION ALL SELECT seq_id, method, replicate, 'local_gc', 'preferred', low, high, low >= 30 AND high <= 70 FROM observed
  UNION ALL SELECT seq_id, method, replicate, 'type_iis', 'required', sites, sites, sites = 0 FROM observed
  UNION ALL SELECT seq_id, method, replicate, 'repeats', 'preferred', repeats, repeats, repeats <= 0 FROM observed
  UNION ALL SELECT seq_id, method, replicate, 'homopolymers', 'preferred', run, run, run <= 6 FROM observed
  UNION ALL SELECT seq_id, method, replicate, 'forbidden_motifs', 'ignored', motifs, motifs, motifs = 0 FROM observed)),
decided AS (SELECT *, CASE WHEN required_failures > 0 THEN 'FAIL' WHEN preferred_warnings > 0 THEN 'CONDITIONAL_PASS' ELSE 'PASS' END AS decision FROM (
  SELECT seq_id, method, replicate, count(*) FILTER (WHERE result = 'FAIL') AS required_failures, count(*) FILTER (WHERE result = 'WARN') AS preferred_warnings,
    coalesce(string_agg(criterion, ', ' ORDER BY list_position(['cai', 'overall_gc', 'local_gc', 'type_iis', 'repeats', 'homopolymers', 'forbidden_motifs'], criterion)) FILTER (WHERE result IN ('FAIL', 'WARN')) || ' require review.', 'All active acceptance criteria passed.') AS explanation FROM matrix GROUP BY 1, 2, 3))""")
KEYS = ("seq_id", "method", "replicate")


def reviewed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The benchmark's candidates under the default criteria with overrides; one override cannot stand."""
    changed = [("overall_gc", "required", 40.0, 47.0, None, None), ("homopolymers", None, None, 6.0, None, None), ("forbidden_motifs", "ignored", None, None, None, None), ("cai", "blocking", None, None, None, None)]
    rules, _ = review.criteria(spark, spark.createDataFrame(changed, review.CRITERIA))
    return review.review(results(spark, d), rules, KEYS)


@query("r07_review_matrix", "SELECT seq_id, method, replicate, criterion, mode, round(low, 6) AS low, round(high, 6) AS high, result FROM matrix", REVIEW_SQL)
def r07(spark: SparkSession, d: str) -> DataFrame:
    return reviewed(spark, d)[0].withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("r07_review_decisions", "SELECT * FROM decided", REVIEW_SQL)
def r07_decisions(spark: SparkSession, d: str) -> DataFrame:
    return reviewed(spark, d)[1]


@query("r08_dispositions", """SELECT seq_id, method, replicate, decision, disposition, CASE WHEN disposition IS NULL OR decision = 'FAIL' AND disposition = 'accept' AND reason IS NULL THEN NULL WHEN decision = 'FAIL' AND disposition = 'accept' THEN 'MANUALLY_ACCEPTED' WHEN disposition = 'accept' THEN 'ACCEPTED' ELSE 'REJECTED' END AS final_state
  FROM (SELECT *, CASE seq_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'accept' WHEN 2 THEN 'reject' END AS disposition, CASE WHEN seq_id % 4 = 1 THEN 'as agreed' END AS reason FROM decided)""", REVIEW_SQL)
def r08(spark: SparkSession, d: str) -> DataFrame:
    decisions = staged(reviewed(spark, d)[1], "decisions")  # read twice
    kind = F.col("seq_id") % 4
    said = decisions.filter(kind < 3).select(*KEYS, F.when(kind < 2, " Accept ").otherwise("reject").alias("disposition"), F.when(kind == 1, "as agreed").otherwise(" ").alias("reason"))
    return review.disposed(decisions, said, KEYS)[0].drop("reason")


# Groups, splits, sets.
@query("a24_cluster_sizes", "SELECT count(*) AS total, count(*) FILTER (WHERE k = 1) AS singletons, min(k) AS smallest, max(k) AS largest, round(avg(k), 6) AS mean_size FROM (SELECT count(*) AS k FROM seqs GROUP BY dna)")
def a24(spark: SparkSession, d: str) -> DataFrame:
    sizes = sequences(spark, d).groupBy(F.sha2("dna", 256)).agg(F.count(F.lit(1)).alias("k"))
    return sizes.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("k") == 1, 1)).alias("singletons"), F.min("k").alias("smallest"), F.max("k").alias("largest"), F.round(F.avg("k"), 6).alias("mean_size"))


SPLIT_SQL = """split AS (SELECT *, CASE WHEN r <= n * 70 // 100 THEN 'train' WHEN r <= n * 70 // 100 + n * 10 // 100 THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY gene ORDER BY md5('320|' || seq_id), seq_id) AS r, count(*) OVER (PARTITION BY gene) AS n FROM seqs))"""


def split(seqs: DataFrame, seed: int = 320) -> DataFrame:
    """70/10/20 inside each gene, by hash order; floors, the rest goes to test. Ranks are taken of narrow rows, the others meet them by id."""
    narrow = seqs.select("seq_id", "gene", F.md5(F.concat(F.lit(f"{seed}|"), F.col("seq_id").cast("string"))).alias("_o"))
    ranks = ranges.numbered(narrow, "gene", ["_o", "seq_id"])
    named = ranks.select("seq_id", F.expr("CASE WHEN r <= n * 70 div 100 THEN 'train' WHEN r <= n * 70 div 100 + n * 10 div 100 THEN 'val' ELSE 'test' END").alias("split"))
    return seqs.join(named, "seq_id")


@query("w06_stratified_split", "SELECT seq_id, split FROM split", f"{SEQUENCES_SQL}, {SPLIT_SQL}")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return split(sequences(spark, d)).select("seq_id", "split")


@query("a25_split_report", "SELECT split, count(*) AS n, CAST(sum(length(dna) // 3) AS BIGINT) AS codons, round(sum(length(regexp_replace(dna, '[^GC]', '', 'g'))) * 100.0::DOUBLE / sum(length(dna)), 6) AS gc, count(*) FILTER (WHERE length(dna) % 3 <> 0) AS bad_lengths, CAST(sum(len(list_filter(range(0, length(dna) // 3 - 1), lambda i: substr(dna, 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA')))) AS BIGINT) AS premature_stops FROM split GROUP BY 1", f"{SEQUENCES_SQL}, {SPLIT_SQL}")
def a25(spark: SparkSession, d: str) -> DataFrame:
    gc = F.sum(F.length(F.regexp_replace("dna", "[^GC]", ""))) * F.lit(100.0) / F.sum(F.length("dna"))
    return split(sequences(spark, d)).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.expr("length(dna) div 3")).alias("codons"), F.round(gc, 6).alias("gc"), F.count(F.when(F.length("dna") % 3 != 0, 1)).alias("bad_lengths"), F.sum(p.internal_stops(col("dna")).cast("long")).alias("premature_stops"))


@query("u02_split_overlaps", "SELECT a.split AS a, b.split AS b, count(*) AS shared FROM (SELECT DISTINCT dna, split FROM split) a JOIN (SELECT DISTINCT dna, split FROM split) b ON a.dna = b.dna AND a.split < b.split GROUP BY 1, 2", f"{SEQUENCES_SQL}, {SPLIT_SQL}")
def u02(spark: SparkSession, d: str) -> DataFrame:
    """Sequences that two splits share: the splits of each are a set of at most three, so no pair of rows is made."""
    sets = split(sequences(spark, d)).groupBy(F.sha2("dna", 256).alias("h")).agg(F.sort_array(F.collect_set("split")).alias("s")).filter("size(s) > 1")
    first = sets.select("s", F.explode("s").alias("a"))
    return first.select("a", F.explode(F.filter("s", lambda b: b > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


@query("t02_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", "")
def t02(spark: SparkSession, d: str) -> DataFrame:
    return stream.window_counts(stream.read_events(spark, d)).withColumn("start", F.col("start").cast("timestamp_ntz"))
