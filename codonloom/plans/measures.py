"""Registered queries of further metrics, filters, reports and text audits, each with its SQL."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as p
from ..functions.codes import RESIDUES, codon_place
from ..operators import batches, scans, usage
from ..operators.batches import Texts
from ..sources.corpus import SEQUENCES_SQL, dealt, sequences
from ..streaming import events as stream
from .findings import PLAIN_CODONS, STOP_SQL
from .queries import CODE_SQL, CODONS_SQL, POLYA, PROFILE_SQL, _gc, _hits_sql, _spans_sql, metric, pinned, query

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The GC bands of the host that has its own, and of all others.
HOST_BANDS, OTHER_BAND = {"nbenthamiana": (40.0, 47.0)}, (55.0, 65.0)
#: The four languages stand for hosts.
HOSTS = {"en": "nbenthamiana", "de": "ntabacum"}
FORBIDDEN = ("GGATCC", "TTTTT", "")
#: Families of expressions that an audit looks for, in any case, and what excuses a line.
AUDITED, EXCUSED = {"claim": "guarantee|proven|superior", "license": "licen[sc]e|copyright", "contact": r"[a-z0-9._]+@[a-z0-9.]+"}, "apache|example"

_translated = "coalesce((SELECT string_agg(coalesce(c.aa, 'X'), '' ORDER BY i) FROM unnest(range(0, length(dna) // 3)) AS t(i) LEFT JOIN code c ON c.codon = substr(dna, 3 * i + 1, 3)), '')"
_codes = f"{SEQUENCES_SQL}, {CODE_SQL}"
_gcs = "(2 * length({0}) - length(replace({0}, 'G', '')) - length(replace({0}, 'C', '')))"


def same_codons(a: Column, b: Column) -> Column:
    """Percent of equal codons of two sequences of one length; 0 for other lengths or no codon."""
    same = F.size(F.filter(F.zip_with(p.codons(a), p.codons(b), lambda x, y: x == y), lambda e: e))
    return F.when(F.length(a) != F.length(b), F.lit(0.0)).otherwise(F.coalesce(same * F.lit(100.0).cast("double") / F.nullif(F.floor(F.length(a) / 3), F.lit(0)), F.lit(0.0)))


def mfe_score(mfe: Column, n: Column) -> Column:
    """A given folding energy per base, between -0.40 and -0.15, on a scale from 0 to 1; 0.5 for an empty sequence, null without an energy."""
    each = F.greatest(F.lit(-0.40), F.least(F.lit(-0.15), mfe / F.nullif(n, F.lit(0)).cast("double")))
    return F.when(mfe.isNull(), None).when(n == 0, F.lit(0.5)).otherwise((each + 0.40) / 0.25)


def output_errors(seqs: DataFrame) -> DataFrame:
    """seq_id, value: what makes a coding sequence (dna) unfit for its protein (aa), joined by commas: frame, invalid codons, an inner stop, another protein."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        texts, proteins = batch.column("dna").to_pylist(), batch.column("aa").to_pylist()
        codes = usage.read_places(texts)
        made = Texts(np.frombuffer((RESIDUES + "X").encode(), np.uint8)[codes.letters], codes.lengths).texts()
        odd = batches.counts(codes.letters == usage.OTHER, codes) > 0

        def errors(s: str | None, a: str | None, m: str, bad: bool) -> str:
            if s is None:
                return ""
            frame, other = len(s) % 3 > 0, a is not None and a.rstrip("*") != m.rstrip("*")
            tail = bool(s[len(s) - len(s) % 3 :].strip("ACGT"))
            return ",".join(e for e, there in (("frame", frame), ("invalid_codons", frame or bad or tail), ("internal_stop", "*" in m[:-1]), ("aa_mismatch", other)) if there)

        return {"value": [*map(errors, texts, proteins, made, odd.tolist())]}

    return batches.mapped(seqs.select("seq_id", "aa", "dna"), "dna", {"value": pa.string()}, run, drop=("aa", "dna"))


_stop_inside = "contains(left(t, greatest(length(t) - 1, 0)), '*')"
metric("p17_mfe_score", lambda: F.round(mfe_score(p.gc_count(F.col("dna")) * F.lit(-0.7), F.length("dna")), 6), f"round((greatest(-0.4::DOUBLE, least(-0.15::DOUBLE, {_gcs.format('dna')} * -0.7::DOUBLE / length(dna))) + 0.4::DOUBLE) / 0.25::DOUBLE, 6)")
metric("p20_codon_identity", lambda: F.round(same_codons(F.col("dna"), p.reverse_complement(F.col("dna"))), 6),
       "round(coalesce(len(list_filter(range(0, length(dna) // 3), lambda i: substr(dna, 3 * i + 1, 3) = substr(reverse(translate(dna, 'ACGT', 'TGCA')), 3 * i + 1, 3))) * 100.0::DOUBLE / nullif(length(dna) // 3, 0), 0.0::DOUBLE), 6)")
metric("p30_organellar", lambda: usage.organellar(F.col("header")), "regexp_matches(lower(header), 'chloroplast|plastid|mitochondria|chrc|chrm')")
metric("m13_local_gc", None, f"coalesce(array_to_string(list_transform(range(1, greatest(length(dna) - 48, 1)), lambda i: {_gcs.format('substr(dna, i, 50)')} * 2), ' '), '')", rows=scans.local_gc)
metric("r02_output_check", None,
       f"(SELECT concat_ws(',', CASE WHEN length(dna) % 3 <> 0 THEN 'frame' END, CASE WHEN length(dna) % 3 <> 0 OR contains(dna, 'N') THEN 'invalid_codons' END, CASE WHEN {_stop_inside} THEN 'internal_stop' END, CASE WHEN rtrim(aa, '*') <> rtrim(t, '*') THEN 'aa_mismatch' END) FROM (SELECT {_translated} AS t))", _codes, output_errors)
metric("f11_length_limits", lambda: F.when(F.col("dna").rlike("^[ACGTUN]+$"), F.when(F.length("dna") > 1000, "dna_too_long")).when(F.length("dna") > 300, "protein_too_long"), "CASE WHEN length(dna) > 1000 THEN 'dna_too_long' END")
metric("t01_review", lambda: stream.verdict(F.col("dna")), f"CASE WHEN length(dna) % 3 <> 0 THEN 'FRAME' WHEN len(list_filter(range(0, length(dna) // 3 - 1), lambda i: substr(dna, 3 * i + 1, 3) IN {STOP_SQL})) > 0 THEN 'STOP' WHEN {_gc.format('dna')} BETWEEN 40 AND 47 THEN 'PASS' ELSE 'GC' END")


def _cai_sql(weight: str, sense: str) -> str:
    return f"""SELECT q.seq_id, round(CASE WHEN count(c.codon) = 0 OR coalesce(bool_or(c.codon IS NOT NULL AND {weight} IS NULL), false) THEN 0.0::DOUBLE ELSE exp(avg(ln({weight})) FILTER (WHERE c.codon IS NOT NULL)) END, 6) AS cai
FROM seqs q LEFT JOIN cod c ON c.seq_id = q.seq_id AND {sense} LEFT JOIN profile f ON f.codon = c.codon GROUP BY 1"""


@query("p12_cai_floor", _cai_sql("coalesce(nullif(f.w, 0), 0.001::DOUBLE)", f"c.codon NOT IN {STOP_SQL}"), f"{PROFILE_SQL},\n{CODONS_SQL}")
def p12(spark: SparkSession, d: str) -> DataFrame:
    """Codons without a weight count 0.001, stops are skipped."""
    return usage.mean_weight(sequences(spark, d), pinned(spark, d), missing=0.001, stops=False).select("seq_id", F.round("cai", 6).alias("cai"))


@query("p13_cai_strict", _cai_sql("nullif(f.w, 0)", "true"), f"{PROFILE_SQL},\n{CODONS_SQL}")
def p13(spark: SparkSession, d: str) -> DataFrame:
    """Any codon without a weight, stops among them, makes it 0."""
    return usage.mean_weight(sequences(spark, d), pinned(spark, d)).select("seq_id", F.round("cai", 6).alias("cai"))


@query("p34_host_bands", "SELECT seq_id, CASE WHEN gene LIKE 'en\\_%' ESCAPE '\\' THEN 40.0::DOUBLE ELSE 55.0::DOUBLE END AS low, CASE WHEN gene LIKE 'en\\_%' ESCAPE '\\' THEN 43.5::DOUBLE ELSE 60.0::DOUBLE END AS mid FROM seqs")
def p34(spark: SparkSession, d: str) -> DataFrame:
    bands = F.broadcast(spark.createDataFrame([(lang, *HOST_BANDS.get(host, OTHER_BAND)) for lang, host in HOSTS.items()], "lang string, low double, high double"))
    rows = sequences(spark, d).select("seq_id", F.split_part("gene", F.lit("_"), F.lit(1)).alias("lang")).join(bands, "lang", "left")
    low, high = F.coalesce("low", F.lit(OTHER_BAND[0])), F.coalesce("high", F.lit(OTHER_BAND[1]))
    return rows.select("seq_id", low.alias("low"), ((low + high) / 2).alias("mid"))


@query("m22_forbidden", _hits_sql({m: m for m in FORBIDDEN if m}, "name").replace("m.name AS name, ", "").replace("SELECT q.seq_id, m.motif, ", 'SELECT q.seq_id, m.motif, CAST(i + length(m.motif) AS INTEGER) AS "end", '))
def m22(spark: SparkSession, d: str) -> DataFrame:
    hits = scans.motif_hits(sequences(spark, d), {m: m for m in FORBIDDEN if m})
    return hits.select("seq_id", "motif", "start", (F.col("start") + F.length("motif")).alias("end"))


def _kinds_sql() -> str:
    each = {"poly_a": "A{6,}", "splice_like": "GT[ACGT]{2,20}AG", "homopolymer": "A{6,}|C{6,}|G{6,}|T{6,}"}
    return " UNION ALL ".join(f"""SELECT seq_id, '{kind}' AS kind, start, "end" FROM ({_spans_sql(pattern, 99)})""" for kind, pattern in each.items())


@query("m26_simple_scans", _kinds_sql())
def m26(spark: SparkSession, d: str) -> DataFrame:
    """Three scans in one pass over the sequences."""
    each = {"poly_a": "A{6,}", "splice_like": "GT[ACGT]{2,20}AG", "homopolymer": "A{6,}|C{6,}|G{6,}|T{6,}"}
    found = F.array(*[F.struct(F.lit(kind).alias("kind"), scans.spans_of(F.col("dna"), pattern).alias("spans")) for kind, pattern in each.items()])
    rows = sequences(spark, d).select("seq_id", F.explode(found).alias("f"))
    return rows.select("seq_id", "f.kind", F.explode("f.spans").alias("s")).select("seq_id", "kind", "s.start", "s.end")


@query("f03_training_pairs", f"""SELECT seq_id, array_to_string({PLAIN_CODONS}, ' ') AS tokens FROM seqs JOIN ({_cai_sql('nullif(f.w, 0)', 'true')}) USING (seq_id) WHERE cai >= 0.55""", f"{PROFILE_SQL},\n{CODONS_SQL}")
def f03(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of a strict CAI (to 6 places) of 0.55 or more, as codon tokens."""
    rows = usage.mean_weight(sequences(spark, d), pinned(spark, d), keep=["dna"]).filter(F.round("cai", 6) >= 0.55)
    return rows.select("seq_id", F.array_join(p.codons(F.col("dna")), " ").alias("tokens"))


@query("f09_protein_records", f"SELECT seq_id, regexp_replace(t, '\\*$', '') AS protein FROM (SELECT seq_id, dna, {_translated} AS t FROM seqs) WHERE length(dna) % 3 = 0 AND NOT contains(dna, 'N') AND NOT contains(regexp_replace(t, '\\*$', ''), '*')", _codes)
def f09(spark: SparkSession, d: str) -> DataFrame:
    good = sequences(spark, d).filter((F.length("dna") % 3 == 0) & ~F.col("dna").rlike("[^ACGT]"))
    return good.select("seq_id", F.regexp_replace(p.translate_dna(F.col("dna")), r"\*$", "").alias("protein")).filter(~F.col("protein").contains("*"))


@query("f10_truncation", "SELECT count(*) AS n, count(*) FILTER (WHERE length(aa) > 400) AS truncated, CAST(sum(length(substr(aa, 1, 400))) AS BIGINT) AS residues FROM seqs")
def f10(spark: SparkSession, d: str) -> DataFrame:
    cut = F.substring("aa", 1, 400)
    return sequences(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.length("aa") > 400, 1)).alias("truncated"), F.sum(F.length(cut)).alias("residues"))


@query("a07_effective_codons", """SELECT gene, round(CASE WHEN f2 > 0 AND f3 > 0 AND f4 > 0 AND f6 > 0 THEN least(61.0::DOUBLE, greatest(20.0::DOUBLE, 2 + 9 / f2 + 1 / f3 + 5 / f4 + 3 / f6)) END, 6) AS enc FROM (
  SELECT gene, avg(h) FILTER (WHERE k = 2) AS f2, avg(h) FILTER (WHERE k = 3) AS f3, avg(h) FILTER (WHERE k = 4) AS f4, avg(h) FILTER (WHERE k = 6) AS f6 FROM (
    SELECT * FROM (SELECT gene, aa, any_value(k) AS k, CASE WHEN sum(n) > 1 THEN (sum(n * n) - sum(n)) / (sum(n) * (sum(n) - 1))::DOUBLE END AS h FROM (
      SELECT q.gene, c.aa, c.k, c.codon, count(*) AS n FROM cod JOIN seqs q USING (seq_id) JOIN (SELECT codon, aa, count(*) OVER (PARTITION BY aa) AS k FROM code WHERE aa <> '*') c ON c.codon = cod.codon GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)
    WHERE h > 0) GROUP BY 1) WHERE gene IS NOT NULL""", f"{_codes}, {CODONS_SQL}")
def a07(spark: SparkSession, d: str) -> DataFrame:
    """Per gene; counts are summed within tasks first, so a gene of any number of sequences is 64 rows a task."""
    counts = sequences(spark, d).filter("gene is not null").select("gene", F.explode(p.codons(F.col("dna"))).alias("codon")).groupBy("gene", "codon").agg(F.count(F.lit(1)).alias("n"))
    aa = F.get(F.array(*map(F.lit, RESIDUES)), codon_place(F.col("codon")) - 1)
    k = F.get(F.array(*[F.lit(RESIDUES.count(a)) for a in RESIDUES]), codon_place(F.col("codon")) - 1)
    known = counts.withColumn("aa", aa).withColumn("k", k).filter("aa <> '*'")
    n = F.sum("n")
    h = F.when(n > 1, (F.sum(F.col("n") * F.col("n")) - n) / (n * (n - 1)).cast("double")).alias("h")
    families = known.groupBy("gene", "aa", "k").agg(h)
    means = families.groupBy("gene").agg(*[F.avg(F.when((F.col("k") == i) & (F.col("h") > 0), F.col("h"))).alias(f"f{i}") for i in (2, 3, 4, 6)])
    enc = F.lit(2) + F.lit(9) / F.col("f2") + F.lit(1) / F.col("f3") + F.lit(5) / F.col("f4") + F.lit(3) / F.col("f6")  # null without one of the four
    some = families.filter("h > 0").select("gene").distinct()
    return means.join(some, "gene").select("gene", F.round(F.when(enc.isNotNull(), F.least(F.lit(61.0), F.greatest(F.lit(20.0), enc))), 6).alias("enc"))


@query("a20_identity_summary", """SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS low, max(value) AS high, round(avg((value >= 90)::INT) * 100, 6) AS pct_above_90, round(avg((value >= 95)::INT) * 100, 6) AS pct_above_95, round(avg((value >= 99)::INT) * 100, 6) AS pct_above_99 FROM ident""",
       f"{SEQUENCES_SQL}, ident AS (SELECT seq_id, round(coalesce(len(list_filter(range(0, length(dna) // 3), lambda i: substr(dna, 3 * i + 1, 3) = substr(reverse(translate(dna, 'ACGT', 'TGCA')), 3 * i + 1, 3))) * 100.0::DOUBLE / nullif(length(dna) // 3, 0), 0.0::DOUBLE), 6) AS value FROM seqs)")
def a20(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    rows = sequences(spark, d).select(F.round(same_codons(F.col("dna"), p.reverse_complement(F.col("dna"))), 6).alias("value"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"), *[F.round(F.avg((v >= k).cast("int")) * 100, 6).alias(f"pct_above_{k}") for k in (90, 95, 99)])


@query("a22_panel_audit", f"SELECT split_part(gene, '_', 1) AS profile, count(*) AS n, round(avg({_gc.format('dna')}), 6) AS mean_gc, min(length(dna))::INTEGER AS shortest, max(length(dna))::INTEGER AS longest FROM seqs GROUP BY 1")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).groupBy(F.split_part("gene", F.lit("_"), F.lit(1)).alias("profile")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(p.gc_percent(F.col("dna"))), 6).alias("mean_gc"), F.min(F.length("dna")).alias("shortest"), F.max(F.length("dna")).alias("longest"))


@query("a28_token_ratios", "SELECT round(avg(length(dna) / (length(dna) // 3)::DOUBLE), 6) AS codon_ratio, round(avg(length(dna) / length(dna)::DOUBLE), 6) AS base_ratio FROM seqs WHERE length(dna) >= 3")
def a28(spark: SparkSession, d: str) -> DataFrame:
    """Bases a token, of codon tokens and of single bases."""
    n = F.length("dna").cast("double")
    return sequences(spark, d).filter(F.length("dna") >= 3).agg(F.round(F.avg(n / F.size(p.codons(F.col("dna")))), 6).alias("codon_ratio"), F.round(F.avg(n / F.length("dna")), 6).alias("base_ratio"))


@query("a29_top_codon_lists", "SELECT seq_id, string_agg(codon || ':' || n, ' ' ORDER BY n DESC, codon) AS codons FROM (SELECT seq_id, codon, count(*) AS n, row_number() OVER (PARTITION BY seq_id ORDER BY count(*) DESC, codon) AS r FROM cod GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1", f"{SEQUENCES_SQL}, {CODONS_SQL}")
def a29(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent codons of each sequence, in its own row: codons are sorted, and each one's count is taken from the sorted list."""
    every = F.sort_array(p.codons(F.col("dna")))
    rows = sequences(spark, d).filter(F.length("dna") >= 3).select("seq_id", F.explode(F.array(every)).alias("c"))
    counted = F.transform(F.array_distinct("c"), lambda x: F.struct((-F.size(F.filter("c", lambda y: y == x))).alias("n"), x.alias("codon")))
    return rows.select("seq_id", F.array_join(F.transform(F.slice(F.sort_array(counted), 1, 5), lambda x: F.concat(x["codon"], F.lit(":"), (-x["n"]).cast("string"))), " ").alias("codons"))


_checks = ("polya", "are", "at_run", "homopolymer")


@query("r09_check_report", f"SELECT s.seq_id, k.check_id, coalesce(v.n, 0) AS finding_count, CASE WHEN coalesce(v.n, 0) = 0 THEN 'PASS' ELSE 'WARNING' END AS status FROM seqs s CROSS JOIN (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in _checks)}) AS k(check_id) LEFT JOIN (SELECT seq_id, check_id, count(*) AS n FROM (SELECT seq_id, 'polya' AS check_id FROM ({_hits_sql(POLYA, 'tier')}) UNION ALL SELECT seq_id, 'are' FROM ({_hits_sql({'ATTTA': 'ARE'}, 'name')}) UNION ALL SELECT seq_id, 'at_run' FROM ({_spans_sql('[AT]{6,}', 8)}) UNION ALL SELECT seq_id, 'homopolymer' FROM ({_spans_sql('A{8,}|C{8,}|G{8,}|T{8,}', 10)})) GROUP BY 1, 2) v ON v.seq_id = s.seq_id AND v.check_id = k.check_id")
def r09(spark: SparkSession, d: str) -> DataFrame:
    """All checks of every sequence, those without findings too, in the sequence's own row."""
    s = F.col("dna")
    n = {"polya": sum((F.size(scans.starts_of(s, m)) for m in POLYA), F.lit(0)), "are": F.size(scans.starts_of(s, "ATTTA")), "at_run": F.size(scans.spans_of(s, "[AT]{6,}")), "homopolymer": F.size(scans.spans_of(s, "|".join(f"{b}{{8,}}" for b in "ACGT")))}
    rows = sequences(spark, d).select("seq_id", F.explode(F.create_map(*[x for c in _checks for x in (F.lit(c), n[c].cast("long"))])).alias("check_id", "finding_count"))
    return rows.withColumn("status", F.when(F.col("finding_count") == 0, "PASS").otherwise("WARNING"))


def _lines_sql() -> str:
    return "lines AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS line, l FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


def lines(spark: SparkSession, d: str) -> DataFrame:
    docs = dealt(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))


@query("r16_text_audit", " UNION ALL ".join(f"SELECT doc_id, line, '{family}' AS family FROM lines WHERE regexp_matches(l, '{rule}', 'i') AND NOT regexp_matches(l, '{EXCUSED}', 'i')" for family, rule in AUDITED.items()), _lines_sql())
def r16(spark: SparkSession, d: str) -> DataFrame:
    """Lines with an expression of a family, unless something in the line excuses it."""
    hit = F.filter(F.array(*[F.when(F.col("l").rlike(f"(?i){rule}"), family) for family, rule in AUDITED.items()]), lambda f: f.isNotNull())
    return lines(spark, d).filter(~F.col("l").rlike(f"(?i){EXCUSED}")).select("doc_id", "line", F.explode(hit).alias("family"))


#: Numbers that a register knows, and what excuses a line from the audit.
REGISTERED, ALLOWED = ("0.0", "1.0", "2.0"), "version|example"


@query("r17_parameter_audit", f"SELECT m AS value, CASE WHEN m IN {REGISTERED} THEN 'registered' ELSE 'unregistered' END AS status, count(DISTINCT doc_id) AS documents, count(*) AS hits FROM (SELECT DISTINCT doc_id, line, m FROM (SELECT doc_id, line, unnest(regexp_extract_all(l, '[0-9]+[.][0-9]+')) AS m FROM lines WHERE NOT regexp_matches(l, '{ALLOWED}', 'i'))) GROUP BY 1, 2", _lines_sql())
def r17(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a decimal point, each once a line, of lines that nothing excuses: registered or not, in how many documents and lines."""
    found = lines(spark, d).filter(~F.col("l").rlike(f"(?i){ALLOWED}")).select("doc_id", "line", F.explode(F.array_distinct(F.regexp_extract_all("l", F.lit("[0-9]+[.][0-9]+"), F.lit(0)))).alias("value"))
    each = found.groupBy("value", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    status = F.when(F.col("value").isin(*REGISTERED), "registered").otherwise("unregistered")
    return each.groupBy("value", status.alias("status")).agg(F.count(F.lit(1)).alias("documents"), F.sum("k").alias("hits"))
