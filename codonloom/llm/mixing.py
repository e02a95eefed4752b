"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every document's words are laid, in a seeded order, along the token line of a
(source, shard) cell, and the line is cut into equal blocks. The source targets
are apportioned to sources, and each source's blocks to its cells, by highest
Sainte-Lague quotients; a cell then takes its quota as whole laps of its line
plus a run of blocks that starts at a seeded place.

Defined results: null or empty texts have size 0 and take nothing; a null source
is a source of its own, last in order; repeated rows are separate documents; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], votes: str, seats: str) -> DataFrame:
    """Adds `quota`: the group's `seats` given to its rows by highest votes/(2s+1).

    Rounding votes*seats/sum(votes) is a Sainte-Lague result for some house; the
    few seats by which that house differs are then given to the highest next
    quotients or taken from the lowest last ones. A party can gain or lose at
    most its share of (difference + parties) + 1 seats, so that many quotients
    are listed: in all a few per party. Ties go by the rows' own columns.
    """
    key = [c for c in parties.columns]
    by = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    whole = F.sum(votes).over(by)
    start = (
        parties.withColumn("_votes", F.col(votes).cast("double"))
        .withColumn("_whole", whole.cast("double"))
        .withColumn("_first", F.coalesce(F.floor(F.col("_votes") * F.col(seats) / F.nullif(F.col("_whole"), F.lit(0.0)) + 0.5), F.lit(0)))
        .withColumn("_lack", F.when(F.col("_whole") > 0, F.col(seats) - F.sum("_first").over(by)).otherwise(F.lit(0)))
        .withColumn("_n", F.count(F.lit(1)).over(by))
    )
    listed = F.when(
        (F.col("_lack") != 0) & (F.col("_votes") > 0),
        F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_votes") / F.col("_whole") * (F.abs("_lack") + F.col("_n"))) + 1),
    )
    seat = F.when(F.col("_lack") > 0, F.col("_first") + F.col("_j")).otherwise(F.col("_first") - F.col("_j") + 1)
    rows = start.withColumn("_j", F.explode_outer(listed)).withColumn("_q", F.when(seat >= 1, F.col("_votes") / (2 * seat - 1)))
    order = by.orderBy(F.when(F.col("_lack") > 0, -F.col("_q")).otherwise(F.col("_q")).asc_nulls_last(), *key, "_j")
    moved = F.col("_q").isNotNull() & (F.row_number().over(order) <= F.abs("_lack"))
    return (
        rows.withColumn("_moved", moved.cast("long"))
        .groupBy(*key)
        .agg((F.first("_first") + F.signum(F.first("_lack")).cast("long") * F.sum("_moved")).alias("quota"))
    )


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(skey, source, source_size) with `target`: `share` of all sizes by weight, at most `most` times the size.

    Filling by weight with the excess shared again ends at min(cap, level*weight);
    the level is found by one pass over the sources in order of cap/weight.
    The frame has one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("_rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    by_ratio = every.orderBy("_ratio", "_rank")
    return (
        sources.withColumn("_rank", rank)
        .withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_open"))
        .withColumn("_level", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(every)["_level"])
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))))
        .select("skey", "source", "source_size", "target")
    )


def mix(docs: DataFrame, block_words: int = 16, docs_per_shard: int = 8192, seed: int = 7, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies.

    `taken` is the words the mix takes, repeats counted; `copies` rounds it to
    whole documents. The number of shards follows the number of documents, so a
    cell stays near docs_per_shard rows however hot its source is. Only ids,
    sources and sizes are shuffled, once, by cell.
    """
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")  # texts are read once
    shards = max(1, ceil(sized.count() / docs_per_shard))
    base = sized.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("skey"),
        "size",
        F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(shards)).alias("shard"),
        F.xxhash64(F.lit(seed + 1), F.col("doc_id")).alias("_ord"),
    )
    cell = Window.partitionBy("skey", "shard")
    order = cell.orderBy("_ord", "doc_id", "size")
    laid = (
        base.withColumn("_words", F.sum("size").over(cell))
        .withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(order))
    )
    cells = laid.filter("_nth = 1").select("skey", "source", "shard", "_words")
    sources = cells.groupBy("skey", "source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sources, share, most).withColumn(
        "_house", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("long")
    )
    seats = sainte_lague(targets, [], "target", "_house").withColumnRenamed("quota", "_seats")
    quotas = sainte_lague(cells.join(seats.drop("source"), "skey"), ["skey"], "_words", "_seats").select(
        "skey", "shard", "source_size", "target", F.col("quota").alias("_quota")
    )
    blocks = F.greatest(F.round(F.col("_words") / block_words).cast("long"), F.lit(1).cast("long"))
    edge = lambda block: F.floor(block * F.col("_words") / F.col("_blocks"))
    shared = lambda lo, hi: F.greatest(F.lit(0).cast("long"), F.least(F.col("_end"), hi) - F.greatest(F.col("_end") - F.col("size"), lo))
    return (
        laid.join(quotas, ["skey", "shard"])
        .withColumn("_blocks", blocks)
        .withColumn("_quota", F.least(F.col("_quota"), F.floor(F.lit(float(most)) * F.col("_blocks"))))
        .withColumn("_laps", F.floor(F.col("_quota") / F.col("_blocks")))
        .withColumn("_run", F.col("_quota") - F.col("_laps") * F.col("_blocks"))
        .withColumn("_from", F.pmod(F.xxhash64(F.lit(seed + 2), F.col("skey"), F.col("shard")), F.col("_blocks")))
        .withColumn("_to", F.col("_from") + F.col("_run"))
        .withColumn(
            "_part",
            shared(edge(F.col("_from")), edge(F.least(F.col("_to"), F.col("_blocks"))))
            + shared(F.lit(0).cast("long"), edge(F.greatest(F.col("_to") - F.col("_blocks"), F.lit(0).cast("long")))),
        )
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("_laps") * F.col("size") + F.col("_part")).alias("taken"),
            "source",
            (F.col("_laps") + (F.col("_part") * 2 > F.col("size")).cast("long")).cast("int").alias("copies"),
        )
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole: 0, 1 or 2 times; documents without words stay out. Rows of one id are taken alike."""
    plan = mix(docs).groupBy(F.col("doc_id").alias(free("_id", docs))).agg(F.max("copies").alias(free("_copies", docs))).filter(f"`{free('_copies', docs)}` > 0")
    times = F.explode(F.array_repeat(F.lit(0), F.col(free("_copies", docs))))
    return docs.join(plan, F.col("doc_id").eqNullSafe(F.col(free("_id", docs)))).withColumn(free("_copy", docs), times).select(*docs.columns)


def free(name: str, docs: DataFrame) -> str:
    """A column name that docs do not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name
