"""Ranks within keys of any size: rows are sorted in ranges, and a key that lies in several of them goes on from what the ranges before hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds r, a row's place in its key's order, from 1, and n, its key's rows. Keep the columns few: the rows are shuffled and written once.

    A task sorts one range of (key, order), so a key that holds a third of all rows is spread over a third of the ranges. Only
    sums of ranges meet: one row for each range and key.
    """
    ranged = staged(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part", key).agg(F.count(F.lit(1)).alias("k"))
    by = Window.partitionBy(key)
    held = sums.select("_part", key, F.coalesce(F.sum("k").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("k").over(by).alias("n"))
    own = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))
    met = ranged.withColumn("_own", own).alias("a").join(held.alias("b"), (F.col("a._part") == F.col("b._part")) & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")))
    return met.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("_own") + F.col("_before")).alias("r"), "n")


def tile(k: int) -> Column:
    """The bin from 1 to k of numbered() rows: equal counts, the first bins take what is left over."""
    r, q, rest = F.col("r") - 1, F.floor(F.col("n") / k), F.col("n") % k
    first = rest * (q + 1)
    return F.when(r < first, F.floor(r / F.nullif(q + 1, F.lit(0)))).otherwise(rest + F.floor((r - first) / F.nullif(q, F.lit(0)))).cast("int") + 1
