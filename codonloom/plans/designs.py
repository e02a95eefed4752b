"""Registered queries of generation methods, the frontier, edits and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, edits, frontier, generate, usage
from ..operators.generate import PREFERRED_70, SIXTEEN
from ..sources.corpus import SEQUENCES_SQL, dealt, sequences
from ..sources.staging import staged
from .queries import BEST_SQL, CHOICES_SQL, CODE_SQL, PROFILE_SQL, RESULTS_SQL, count_sql, held_once, pinned, proteins, query, results

#: Three ways of weighing codons stand for codon tables: the kept records', those of all sequences, and the kept records' with every weight raised to a half.
PROFILES = ("kept", "plain", "flat")
LAYERS = {"L0": "random_synonymous", "L1": "greedy_cai", "L2": "gc_target", "L3": "ablation_cai_type_iis", "L4": "ablation_cai_gc_type_iis", "L5": "assembly_friendly"}
RANGES = {"40-47": (40.0, 47.0), "40-55": (40.0, 55.0), "40-65": (40.0, 65.0)}
CUSTOM_SITES = {"EcoRI": "GAATTC", "XhoI": "CTCGAG", "NdeI": "CATATG"}


def spelt(made: DataFrame) -> DataFrame:
    return made.select("seq_id", generate.spelt(F.col("codes")).alias("cds"))


def weights_of(spark: SparkSession, d: str, column: str = "w") -> dict[str, float]:
    """By codon, of the 64 rows of the profile."""
    return {r["codon"]: r[column] for r in pinned(spark, d).select("codon", column).collect() if r[column] is not None}


PICKS_SQL = held_once(f"{PROFILE_SQL},\n{BEST_SQL}")
#: By residue the codons with their whole frequencies, and the upper bounds of their draws.
SHARES_SQL = f"""freqs AS MATERIALIZED (SELECT aa, codon, greatest(CAST(round(frequency * 1000000) AS BIGINT), 1) AS f FROM profile WHERE w IS NOT NULL),
shares AS MATERIALIZED (SELECT aa, codon, {{0}} + ({SIXTEEN} - {{0}}) * sum(f) OVER (PARTITION BY aa ORDER BY f DESC, codon) // sum(f) OVER (PARTITION BY aa) AS upto,
  row_number() OVER (PARTITION BY aa ORDER BY f DESC, codon) AS r FROM freqs)"""


@query("g06_high_frequency", "SELECT q.seq_id, string_agg(b.codon, '' ORDER BY i) AS cds FROM seqs q, unnest(range(1, length(q.aa) + 1)) AS t(i) JOIN (SELECT aa, codon FROM (SELECT aa, codon, row_number() OVER (PARTITION BY aa ORDER BY per_thousand DESC, codon) AS r FROM profile WHERE w IS NOT NULL) WHERE r = 1) b ON b.aa = substr(q.aa, CAST(i AS INT), 1) GROUP BY 1", PICKS_SQL)
def g06(spark: SparkSession, d: str) -> DataFrame:
    """The golden set's weights are here the kept records' shares per thousand."""
    return spelt(generate.greedy(proteins(spark, d), pinned(spark, d), "high_cai", "per_thousand"))


@query("g07_gc_target", """SELECT seq_id, string_agg(codon, '' ORDER BY i) AS cds FROM walk WHERE i > 0 GROUP BY 1""", "RECURSIVE " + PICKS_SQL + """,
best_of AS MATERIALIZED (SELECT aa, codon, g, f FROM (SELECT aa, codon, length(regexp_replace(codon, '[AT]', '', 'g')) AS g, frequency AS f, row_number() OVER (PARTITION BY aa, length(regexp_replace(codon, '[AT]', '', 'g')) ORDER BY frequency DESC, codon) AS r FROM profile WHERE w IS NOT NULL) WHERE r = 1),
walk AS (SELECT seq_id, aa, 0 AS i, 0 AS gc, '' AS codon FROM seqs WHERE aa <> ''
  UNION ALL SELECT seq_id, aa, i, gc, codon FROM (
    SELECT w.seq_id, w.aa, w.i + 1 AS i, w.gc + b.g AS gc, b.codon, row_number() OVER (PARTITION BY w.seq_id ORDER BY abs(round((w.gc + b.g) * 100.0::DOUBLE / (3 * w.i + 3), 2) - 43.5::DOUBLE), b.f DESC, b.codon) AS r
    FROM walk w JOIN best_of b ON b.aa = substr(w.aa, w.i + 1, 1)) WHERE r = 1)""")
def g07(spark: SparkSession, d: str) -> DataFrame:
    return spelt(generate.gc_target(proteins(spark, d), pinned(spark, d)))


def _draws_sql(seed: str, attempts: int) -> str:
    return f"hex AS MATERIALIZED (SELECT seq_id, n, b, md5('{seed}|' || seq_id || '|' || n || '|' || b) AS h FROM seqs, unnest(range(0, {attempts})) AS u(n), unnest(range(0, (length(aa) + 7) // 8)) AS t(b))"


@query("g08_balanced", """SELECT seq_id, cds FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY CASE WHEN gc BETWEEN 40 AND 47 THEN 0.0::DOUBLE ELSE abs(gc - 43.5::DOUBLE) END, n) AS r FROM (
  SELECT seq_id, n, cds, round((2 * length(cds) - length(replace(cds, 'G', '')) - length(replace(cds, 'C', ''))) * 100.0::DOUBLE / length(cds), 2) AS gc FROM (
    SELECT p.seq_id, p.n, string_agg(s.codon, '' ORDER BY p.i) AS cds FROM places p JOIN shares s ON s.aa = p.a AND p.d < s.upto AND p.d >= coalesce(s.least, 0) GROUP BY 1, 2))) WHERE r = 1""",
       PICKS_SQL + ",\n" + SHARES_SQL.format(PREFERRED_70).replace("shares AS MATERIALIZED (", "bounds AS MATERIALIZED (") + """,
shares AS MATERIALIZED (SELECT aa, codon, upto, lag(upto) OVER (PARTITION BY aa ORDER BY r) AS least FROM bounds),
""" + _draws_sql("balanced|320", 10) + """,
places AS (SELECT q.seq_id, x.n, 8 * x.b + j AS i, substr(q.aa, CAST(8 * x.b + j AS INT) + 1, 1) AS a, ('0x' || substr(x.h, 1 + 4 * CAST(j AS INT), 4))::BIGINT AS d FROM hex x JOIN seqs q USING (seq_id), unnest(range(0, 8)) AS t(j) WHERE 8 * x.b + j < length(q.aa))""")
def g08(spark: SparkSession, d: str) -> DataFrame:
    return spelt(generate.balanced(proteins(spark, d), pinned(spark, d)))


def methods(weights: DataFrame) -> dict:
    """Every method that makes sequences of proteins, by name."""
    return {
        "random_synonymous": generate.random_synonymous,
        "greedy_cai": lambda p: generate.greedy(p, weights),
        "high_cai": lambda p: generate.greedy(p, weights, "high_cai", "per_thousand"),
        "gc_target": lambda p: generate.gc_target(p, weights),
        "balanced": lambda p: generate.balanced(p, weights),
        "assembly_friendly": lambda p: generate.assembly_friendly(p, weights),
    }


def raw_proteins(spark: SparkSession, d: str) -> DataFrame:
    """seq_id, aa: as proteins(), but of every thirteenth document with the letters that are no residues left in."""
    rows = sequences(spark, d).filter("aa <> ''")
    odd = F.pmod(F.floor(F.col("seq_id") / 1000000), F.lit(13)) == 0
    return rows.select("seq_id", F.when(odd, F.translate("dna", "N", "X")).otherwise(F.col("aa")).alias("aa"))


@query("b01_method_runs")
def b01(spark: SparkSession, d: str) -> DataFrame:
    """All methods over all proteins, the sequences' own bases beside them, with error rows."""
    weights, aa = pinned(spark, d), staged(raw_proteins(spark, d), "proteins")
    rows = generate.run_methods(aa, weights, methods(weights), sequences(spark, d).select("seq_id", "dna"), bases=False)
    return rows.drop("aa")


@query("a09_ablation_layers")
def a09(spark: SparkSession, d: str) -> DataFrame:
    """Layers from no constraint to all of them."""
    weights, aa = pinned(spark, d), staged(raw_proteins(spark, d), "proteins")
    of = methods(weights) | {"ablation_cai_type_iis": lambda p: generate.weighted_clean(p, weights), "ablation_cai_gc_type_iis": lambda p: generate.steered_clean(p, weights)}
    made = generate.run_methods(aa, weights, {m: of[m] for m in LAYERS.values()}, bases=False).drop("aa")
    return compare.layer_summary(staged(made, "results"), LAYERS)  # read three times


@query("g10_ramp")
def g10(spark: SparkSession, d: str) -> DataFrame:
    weights = pinned(spark, d)
    return spelt(generate.ramped(generate.balanced(proteins(spark, d), weights), weights))


@query("g11_second_codon", """SELECT q.seq_id, CASE WHEN length(q.aa) >= 2 AND s.codon IS NOT NULL AND substr(g.cds, 4, 1) <> 'G' THEN substr(g.cds, 1, 3) || s.codon || substr(g.cds, 7) ELSE g.cds END AS cds
FROM (SELECT q.seq_id, string_agg(b.codon, '' ORDER BY i) AS cds FROM seqs q, unnest(range(1, length(q.aa) + 1)) AS t(i) JOIN best b ON b.aa = substr(q.aa, CAST(i AS INT), 1) GROUP BY 1) g JOIN seqs q USING (seq_id)
LEFT JOIN (SELECT aa, codon FROM (SELECT aa, codon, row_number() OVER (PARTITION BY aa ORDER BY starts_with(codon, 'GC') DESC, frequency DESC, codon) AS r FROM profile WHERE w IS NOT NULL AND codon LIKE 'G%') WHERE r = 1) s ON s.aa = substr(q.aa, 2, 1)""", PICKS_SQL)
def g11(spark: SparkSession, d: str) -> DataFrame:
    weights = pinned(spark, d)
    return spelt(generate.second_codon(generate.greedy(proteins(spark, d), weights), weights))


@query("g13_frontier_ranges")
def g13(spark: SparkSession, d: str) -> DataFrame:
    """Per protein and GC range the greatest CAI that any sequence of it has."""
    return frontier.ranges_of(proteins(spark, d), frontier.Kinds(weights_of(spark, d)), RANGES).withColumn("cai", F.round("cai", 6))


@query("g15_frontier_sequences")
def g15(spark: SparkSession, d: str) -> DataFrame:
    """A best sequence of 40 to 47 percent GC for each protein that has one."""
    return frontier.best_sequences(proteins(spark, d), frontier.Kinds(weights_of(spark, d)), *RANGES["40-47"])


def in_frame(spark: SparkSession, d: str) -> DataFrame:
    """seq_id, cds: the greedy sequences."""
    return spelt(generate.greedy(proteins(spark, d), pinned(spark, d)))


@query("g17_domesticated")
def g17(spark: SparkSession, d: str) -> DataFrame:
    """Random codons, without the sites of golden gate assembly."""
    made = generate.random_synonymous(proteins(spark, d), replicates=1)
    return edits.domesticated(spelt(made), "golden_gate", weights_of(spark, d, "frequency"), rounds=20)


@query("g18_custom_sites")
def g18(spark: SparkSession, d: str) -> DataFrame:
    made = generate.random_synonymous(proteins(spark, d), replicates=1)
    return edits.without_sites(spelt(made), CUSTOM_SITES, weights_of(spark, d, "frequency"))


def _site_hits_sql(sites: dict[str, str]) -> str:
    values = ", ".join(f"('{n}', '{strand}', '{p}')" for n, strand, p in edits.patterns_of(sites))
    return f"""SELECT q.seq_id, m.name, CAST(i AS INTEGER) AS position, m.strand, m.pattern FROM seqs q, (VALUES {values}) AS m(name, strand, pattern), unnest(range(0, greatest(length(q.dna) - length(m.pattern) + 1, 0))) AS t(i)
WHERE substr(q.dna, CAST(i AS INT) + 1, length(m.pattern)) = m.pattern"""


@query("m20_custom_sites", _site_hits_sql(CUSTOM_SITES))
def m20(spark: SparkSession, d: str) -> DataFrame:
    return edits.findings(sequences(spark, d), CUSTOM_SITES, "dna")


@query("u03_new_findings")
def u03(spark: SparkSession, d: str) -> DataFrame:
    """Sites of the guarded enzymes that edits of the custom sites have brought in: none."""
    made = staged(spelt(generate.random_synonymous(proteins(spark, d), replicates=1)), "made")
    edited = edits.without_sites(made, CUSTOM_SITES, weights_of(spark, d, "frequency"))
    every = CUSTOM_SITES | edits.BUILT_IN
    return edits.new_findings(edits.findings(made, every), edits.findings(edited, every))


@query("a13_bootstrap", """SELECT what, round(observed, 6) AS observed, round(lower, 6) AS lower, round(upper, 6) AS upper FROM (
  SELECT o.method AS what, o.observed, quantile_cont(r.rate, 0.025) AS lower, quantile_cont(r.rate, 0.975) AS upper FROM rates r JOIN observed o USING (method) GROUP BY 1, 2
  UNION ALL SELECT 'greedy_cai - random_synonymous', any_value(x.observed - y.observed), quantile_cont(a.rate - b.rate, 0.025), quantile_cont(a.rate - b.rate, 0.975)
  FROM rates a JOIN rates b ON b.r = a.r AND a.method = 'greedy_cai' AND b.method = 'random_synonymous' JOIN observed x ON x.method = a.method JOIN observed y ON y.method = b.method)""",
       RESULTS_SQL + """,
means AS MATERIALIZED (SELECT method, seq_id, avg(multi_pass::INT) AS v FROM results GROUP BY 1, 2),
observed AS (SELECT method, avg(v) AS observed FROM means GROUP BY 1),
drawn AS (SELECT method, r, v, CAST('0x' || substr(md5('boot|320|' || seq_id || '|' || r), 1, 8) AS BIGINT) AS d FROM means, unnest(range(0, 200)) AS t(r)),
rates AS MATERIALIZED (SELECT method, r, sum(k * v) / sum(k) AS rate FROM (SELECT method, r, v, len(list_filter([""" + ", ".join(map(str, compare.POISSON)) + """], lambda p: d >= p)) AS k FROM drawn) WHERE k > 0 GROUP BY 1, 2)""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    rows = compare.bootstrap(results(spark, d), 200, against={"greedy_cai": ["random_synonymous"]})
    return rows.select("what", *[F.round(c, 6).alias(c) for c in ("observed", "lower", "upper")])


def profile_weights(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, codon, aa, w, frequency, per_thousand of the three codon tables: 192 rows."""
    kept = pinned(spark, d)
    plain = usage.usage_profile(usage.codon_counts(sequences(spark, d), "dna"))
    plain = spark.createDataFrame(plain.collect(), plain.schema)
    flat = kept.withColumn("w", F.round(F.sqrt("w"), 6))
    tables = [t.withColumn("profile_id", F.lit(p)) for p, t in zip(PROFILES, (kept, plain, flat))]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


TABLES_SQL = held_once(f"{PROFILE_SQL}").rstrip() + """,
plain_counts AS MATERIALIZED (SELECT c.codon, c.aa, count(s.codon) AS n FROM code c LEFT JOIN (SELECT substr(dna, 3 * i + 1, 3) AS codon FROM seqs, unnest(range(0, length(dna) // 3)) AS t(i)) s ON s.codon = c.codon GROUP BY 1, 2),
plain_freq AS MATERIALIZED (SELECT codon, aa, CASE WHEN aa = '*' THEN 0.0::DOUBLE ELSE round((n + 1) / (sum(n) OVER (PARTITION BY aa) + count(*) OVER (PARTITION BY aa))::DOUBLE, 6) END AS frequency FROM plain_counts),
tables AS MATERIALIZED (SELECT 'kept' AS profile_id, codon, aa, w FROM profile UNION ALL SELECT 'plain', codon, aa, CASE WHEN aa <> '*' THEN frequency / max(frequency) OVER (PARTITION BY aa) END FROM plain_freq UNION ALL SELECT 'flat', codon, aa, round(sqrt(w), 6) FROM profile)"""


@query("j08_weight_correlations", "SELECT a.profile_id AS profile, " + ", ".join(f"round(corr(a.w, b.w) FILTER (WHERE b.profile_id = '{p}'), 6) AS {p}" for p in PROFILES) + " FROM tables a JOIN tables b ON a.codon = b.codon GROUP BY 1", TABLES_SQL)
def j08(spark: SparkSession, d: str) -> DataFrame:
    return compare.correlations(profile_weights(spark, d), PROFILES)


@query("w03_rank_shifts", "SELECT aa, codon, " + ", ".join(f"max(rank) FILTER (WHERE profile_id = '{p}') AS rank_{p}" for p in PROFILES) + ", " + ", ".join(f"max(rank) FILTER (WHERE profile_id = '{p}') - max(rank) FILTER (WHERE profile_id = 'kept') AS rank_shift_{p}_vs_kept" for p in PROFILES[1:])
       + " FROM (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id, aa ORDER BY w DESC, codon) AS INTEGER) AS rank, count(*) OVER (PARTITION BY profile_id, aa) AS k FROM tables WHERE w IS NOT NULL) WHERE k >= 2 GROUP BY 1, 2", TABLES_SQL)
def w03_shifts(spark: SparkSession, d: str) -> DataFrame:
    return compare.rank_shifts(profile_weights(spark, d), PROFILES)


def profile_metrics(spark: SparkSession, d: str) -> DataFrame:
    """profile_id, method, metric, value: the sequences made of the kept records' table, scored under each codon table."""
    tables, aa = profile_weights(spark, d), proteins(spark, d)
    by = {p: tables.filter(F.col("profile_id") == p) for p in PROFILES}
    made = generate.greedy(aa, by[PROFILES[0]]).unionByName(generate.random_synonymous(aa))
    # Only codon adaptation differs between the tables: a sequence is made and scored once.
    rows = generate.score(made, by[PROFILES[0]], bases=False, others={p: by[p] for p in PROFILES[1:]})
    means = staged(generate.summary(rows, [f"cai_{p}" for p in PROFILES[1:]]), "means")  # a row a method
    named = lambda p: means.withColumn("mean_cai", F.col("mean_cai" if p == PROFILES[0] else f"mean_cai_{p}")).drop(*[f"mean_cai_{x}" for x in PROFILES[1:]]).withColumn("profile_id", F.lit(p))
    return compare.long_metrics(reduce(DataFrame.unionByName, map(named, PROFILES)))


METRICS_SQL = RESULTS_SQL.rstrip() + ",\n" + TABLES_SQL[TABLES_SQL.index("plain_counts") :] + """,
cais AS MATERIALIZED (SELECT t.profile_id, p.method, p.seq_id, p.replicate, coalesce(round(exp(avg(ln(t.w))), 6), 0) AS cai FROM picks p JOIN tables t ON t.codon = p.codon GROUP BY 1, 2, 3, 4),
means AS MATERIALIZED (SELECT profile_id, method, round(avg(cai), 4) AS mean_cai FROM cais GROUP BY 1, 2),
rates AS MATERIALIZED (SELECT method, round(avg(multi_pass::INT), 4) AS multi_rate FROM results GROUP BY 1)"""


@query("a17_cai_shifts", "SELECT method, " + ", ".join(f"max(mean_cai) FILTER (WHERE profile_id = '{p}') AS mean_cai_{p}" for p in PROFILES) + ", "
       + ", ".join(f"round(max(mean_cai) FILTER (WHERE profile_id = '{p}') - max(mean_cai) FILTER (WHERE profile_id = 'kept'), 4) AS shift_{p}_vs_kept" for p in PROFILES[1:]) + " FROM means GROUP BY 1", METRICS_SQL)
def a17(spark: SparkSession, d: str) -> DataFrame:
    return compare.shifts(profile_metrics(spark, d), PROFILES)


@query("a16_pass_rates_wide", "SELECT method, " + ", ".join(f"multi_rate AS {p}" for p in PROFILES) + " FROM rates", METRICS_SQL)
def a16(spark: SparkSession, d: str) -> DataFrame:
    return compare.wide(profile_metrics(spark, d), "multi_rate", PROFILES)


@query("j03_frozen_fresh", """SELECT method, 'mean_cai' AS metric, max(mean_cai) FILTER (WHERE profile_id = 'kept') AS frozen, max(mean_cai) FILTER (WHERE profile_id = 'plain') AS fresh,
  round(max(mean_cai) FILTER (WHERE profile_id = 'plain') - max(mean_cai) FILTER (WHERE profile_id = 'kept'), 6) AS diff, abs(round(max(mean_cai) FILTER (WHERE profile_id = 'plain') - max(mean_cai) FILTER (WHERE profile_id = 'kept'), 6)) <= 0 AS match FROM means GROUP BY 1
UNION ALL SELECT method, 'multi_rate', multi_rate, multi_rate, 0.0::DOUBLE, true FROM rates""", METRICS_SQL)
def j03(spark: SparkSession, d: str) -> DataFrame:
    """One codon table's metrics as frozen, another's as fresh."""
    metrics = staged(profile_metrics(spark, d).filter(F.col("metric").isin("mean_cai", "multi_rate")), "metrics")
    of = lambda p: metrics.filter(F.col("profile_id") == p)
    return compare.differences(of("kept"), of("plain"))
