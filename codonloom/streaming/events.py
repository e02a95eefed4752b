"""Event streams: the functions take a static or a streaming frame with a TIMESTAMP `ts`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scalar import gc_percent, internal_stops


def read_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The events table, read at once or as a stream of files. `ts` has no zone in the file; it is taken in the session's."""
    path = f"{sf_dir}/events.parquet"
    static = spark.read.parquet(path)
    raw = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if stream else static
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n) by tumbling window; on a stream, rows later than `late` are dropped and closed windows leave the state."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def once(events: DataFrame, key: str, horizon: str = "2 hours") -> DataFrame:
    """One row per key; on a stream, within the horizon, so that state stays bounded."""
    if events.isStreaming:
        return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def verdict(s: Column, low: float = 40.0, high: float = 47.0) -> Column:
    """The first check that a sequence fails (FRAME, STOP, GC), or PASS: of the row alone, so the same on a table and on a stream."""
    return F.when(F.length(s) % 3 != 0, "FRAME").when(internal_stops(s) > 0, "STOP").when(gc_percent(s).between(low, high), "PASS").otherwise("GC")


def result_id(s: Column, criteria: str = "") -> Column:
    """The name of a result: of the same sequence under the same criteria always the same."""
    return F.concat(F.lit("ff-"), F.substring(F.sha2(F.concat(s, F.lit(f"|{criteria}")), 256), 1, 16))


def review_into(sequences: DataFrame, path: str, checkpoint: str, low: float = 40.0, high: float = 47.0) -> StreamingQuery:
    """Reviews a stream of (seq_id, dna) into the table at `path`, one row a result id and batch.

    A batch is a folder named by its number and is written whole, so one that is tried again after a failure, of the
    driver or in the middle of a write, takes its own place. read_results() gives each result once.
    """
    criteria = f"{low}-{high}"

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(result_id(F.col("dna"), criteria).alias("result_id"), "seq_id", verdict(F.col("dna"), low, high).alias("verdict"))
        rows.groupBy("result_id").agg(F.min_by(F.struct("seq_id", "verdict"), "seq_id").alias("r")).select("result_id", "r.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sequences.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """result_id, seq_id, verdict: of results that several batches hold the first."""
    rows = spark.read.schema("result_id string, seq_id long, verdict string, batch long").parquet(path)
    return rows.groupBy("result_id").agg(F.min_by(F.struct("seq_id", "verdict"), F.struct("batch", "seq_id")).alias("r")).select("result_id", "r.*")
