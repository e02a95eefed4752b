"""Registered queries of clusters, cluster-aware splits, hits in contigs, tandem repeats and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, scans
from ..sources.corpus import SEQUENCES_SQL, dealt, sequences
from ..sources.staging import fresh_path, staged
from ..streaming import events as stream
from .findings import _gc
from .queries import proteins, query


@query("w11_clusters")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clustered(proteins(spark, d))


@query("w10_cluster_split", """SELECT seq_id, cluster, CASE WHEN sum_before < greatest(1, CAST(floor(total * 0.1::DOUBLE) AS BIGINT)) THEN 'eval' ELSE 'train' END AS split FROM members JOIN (
  SELECT cluster, coalesce(sum(k) OVER (ORDER BY k DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sum_before, sum(k) OVER () AS total FROM (SELECT cluster, count(*) AS k FROM members GROUP BY 1)) USING (cluster)""",
       f"{SEQUENCES_SQL}, members AS (SELECT seq_id, min(seq_id) OVER (PARTITION BY substr(dna, 1, 8)) AS cluster FROM seqs)")
def w10(spark: SparkSession, d: str) -> DataFrame:
    """Sequences that begin alike are the clusters here."""
    rows = sequences(spark, d).select("seq_id", F.substring("dna", 1, 8).alias("head"))
    first = rows.groupBy("head").agg(F.min("seq_id").alias("cluster"))
    return clusters.cluster_split(rows.join(first, "head").select("seq_id", "cluster"))


def contigs(spark: SparkSession, d: str) -> DataFrame:
    """contig, seq: all letters of a document as one contig."""
    docs = dealt(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return docs.select(F.col("doc_id").alias("contig"), F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAN").alias("seq")).filter("seq <> ''")


HITS_SQL = """SELECT doc_id AS contig, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents WHERE text IS NOT NULL"""


@query("j11_hits_in_contigs", f"""SELECT hit_id, query, contig, CASE WHEN s > e THEN reverse(translate(part, 'ACGT', 'TGCA')) ELSE part END AS seq FROM (
  SELECT h.contig * 3 + j AS hit_id, 'q' || j AS query, h.contig, CASE WHEN j = 1 THEN hi ELSE lo END AS s, CASE WHEN j = 1 THEN lo ELSE hi END AS e, substr(translate(h.l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAN'), CAST(lo AS INT), CAST(hi - lo + 1 AS INT)) AS part
  FROM (SELECT contig, l, j, 1 + (contig * 37 + j * 4999) % length(l) AS lo, 1 + (contig * 37 + j * 4999) % length(l) + 6000 * j + 20 AS hi FROM ({HITS_SQL}), unnest(range(0, 2)) AS t(j) WHERE l <> '') h)""", "")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Two hits a contig, one of each strand, many across pieces or beyond the end; a third names no contig, a fourth is too weak."""
    pieces = staged(clusters.pieces_of(contigs(spark, d)), "pieces")
    ends = pieces.groupBy("contig").agg(F.sum(F.length("bases")).alias("n"))
    rows = ends.select("contig", "n", F.explode(F.array(*[F.lit(j).cast("long") for j in range(4)])).alias("j"))
    low = F.lit(1) + (F.col("contig") * 37 + F.col("j") * 4999) % F.col("n")
    high = low + 6000 * F.col("j") + 20
    back = F.col("j") == 1
    hits = rows.select((F.col("contig") * 3 + F.col("j")).alias("hit_id"), F.concat(F.lit("q"), F.col("j").cast("string")).alias("query"), F.when(F.col("j") == 2, -1).otherwise(F.col("contig")).cast("long").alias("contig"),
                       F.when(back, high).otherwise(low).alias("start"), F.when(back, low).otherwise(high).alias("end"), F.when(F.col("j") == 3, 1.0).otherwise(1e-9).alias("evalue"))
    return clusters.cut_hits(hits, pieces)


@query("m10_tandem_repeats")
def m10(spark: SparkSession, d: str) -> DataFrame:
    return scans.tandem_repeats(sequences(spark, d))


@query("t03_reviewed_stream", f"""SELECT 'ff-' || substr(sha256(dna || '|40.0-47.0'), 1, 16) AS result_id, min(seq_id) AS seq_id, any_value(CASE WHEN length(dna) % 3 <> 0 THEN 'FRAME' WHEN len(list_filter(range(0, length(dna) // 3 - 1), lambda i: substr(dna, 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA'))) > 0 THEN 'STOP'
  WHEN {_gc.format('dna')} BETWEEN 40 AND 47 THEN 'PASS' ELSE 'GC' END) AS verdict FROM seqs GROUP BY dna""")
def t03(spark: SparkSession, d: str) -> DataFrame:
    """All sequences as a stream of files, reviewed batch by batch, each result once."""
    source, out, state = (fresh_path(spark, x) for x in ("incoming", "reviewed", "state"))
    sequences(spark, d).select("seq_id", "dna").write.parquet(source)
    live = spark.readStream.schema("seq_id long, dna string").option("maxFilesPerTrigger", 64).parquet(source)
    stream.review_into(live, out, state).awaitTermination()
    return stream.read_results(spark, out)
