"""What the operators share: tables, the shared folder, and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import deleted, dropped_shuffles, fresh_path, scratch, shared_dir, staged  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Python workers get rows in batches bounded in bytes, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, most_rows: int = 2_000_000) -> DataFrame:
    """df, narrow and cheap to count, to be broadcast where it has at most most_rows rows; beyond, Spark joins by shuffling."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def id_fold(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice's text stays near most_bytes (one row at least)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > most_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Returns what a Python worker has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def tidy(run: Run) -> Run:
    """run, giving its memory back to the system at its end: Spark keeps the Python worker for later tasks of any query."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def sent(spark: SparkSession, model: object) -> Broadcast:
    """A model of bounded size for every task, with its class: see received()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(model: Broadcast) -> object:
    return pickle.loads(model.value)
