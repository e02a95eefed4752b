"""Sequence tables derived from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settled(df: DataFrame, column: str) -> DataFrame:
    """df with the column computed once per row: a generator keeps its expression out of the lambdas that use it."""
    return df.withColumn(column, F.explode(F.array(column)))


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores: a table whose rows lie in fewer partitions than there are cores is dealt anew; a larger one stays as it is read.

    Splits of a file count only if they hold rows: a file of one row group has one, however often it is split. The
    count reads no column, and only of tables with fewer files than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id()).distinct().count() >= cores:
        return df
    return df.repartition(cores)


#: Letters of a text are cut into pieces of this many, those of every seventh document into longer ones, so that one very long text becomes many sequences.
PIECE, LONG_PIECE = 600, 1200


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, gene, header, tpm, dna (letters mapped onto ACGTN), aa (its residue letters): all of a text, one row per piece.

    seq_id is doc_id * 1,000,000 + the piece's number. Headers come in the forms that gene_id() knows, some
    with an organellar marker. A text that is null or holds no letter gives no row.
    """
    gene = F.concat("lang", F.lit("_"), (F.col("doc_id") % 97).cast("string"))
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    cut = lambda n: F.regexp_extract_all(letters, F.lit(f".{{1,{n}}}"), F.lit(0))
    pieces = (
        dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars", "text"))
        .select("doc_id", gene.alias("gene"), F.col("n_chars").alias("tpm"), F.posexplode(F.when(F.col("doc_id") % 7 == 0, cut(LONG_PIECE)).otherwise(cut(PIECE))).alias("piece", "letters"))
    )
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), F.col("piece").cast("string"))
    form = F.col("doc_id") % 5
    header = F.when(form == 3, F.concat(name, F.lit(";GENE:"), "gene", F.lit("|x"))).when(form == 4, F.concat(F.lit("transcript:"), "gene", F.lit(".2 "), name)).otherwise(F.concat(name, F.lit(" gene="), "gene"))
    rows = pieces.select(
        (F.col("doc_id") * 1000000 + F.col("piece")).alias("seq_id"),
        "gene",
        F.concat(header, F.when(F.col("doc_id") % 53 == 0, " chrC").otherwise("")).alias("header"),
        "tpm",
        F.translate("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAN").alias("dna"),
        F.regexp_replace("letters", "[BJOUXZ]", "").alias("aa"),
    )
    return settled(settled(rows, "dna"), "aa")


SEQUENCES_SQL = f"""seqs AS (
  SELECT doc_id * 1000000 + k - 1 AS seq_id, gene, CASE doc_id % 5 WHEN 3 THEN name || ';GENE:' || gene || '|x' WHEN 4 THEN 'transcript:' || gene || '.2 ' || name ELSE name || ' gene=' || gene END
      || CASE WHEN doc_id % 53 = 0 THEN ' chrC' ELSE '' END AS header, n_chars AS tpm,
    translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAN') AS dna, regexp_replace(l, '[BJOUXZ]', '', 'g') AS aa
  FROM (SELECT *, 'doc' || doc_id || '.' || (k - 1) AS name FROM (SELECT doc_id, n_chars, lang || '_' || (doc_id % 97) AS gene, unnest(ls) AS l, generate_subscripts(ls, 1) AS k
    FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN list_transform(range(0, (length(letters) + {LONG_PIECE - 1}) // {LONG_PIECE}), lambda i: substr(letters, {LONG_PIECE} * CAST(i AS INT) + 1, {LONG_PIECE})) ELSE regexp_extract_all(letters, '.{{1,{PIECE}}}') END AS ls FROM (SELECT *, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters FROM documents))))
)"""
