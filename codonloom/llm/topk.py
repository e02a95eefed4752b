"""Exact top-k inner products by block-at-a-time pruning.

Dimensions act as terms. Vectors are cut into document-range blocks, each with
its terms' largest and smallest values and its vectors as a forward index. A
query sums its terms' extremes into a bound per block, visits the blocks from
the highest bound down, and stops where bounds fall below its k-th score, or
below the k-th score that a first pass over a few blocks found for it.
Scores are exact: one that does not fit a long, and a component of 2**62 / 256 or
more, is an error.

Defined results: vectors that are null, or hold null, NaN or infinite
components, take no part; a shorter vector counts as padded with zeros; rows
that carry the query's own vec_id are its own; a query given more than once is
answered once, for its greatest vector; ties go to the smaller vec_id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, staged, table, tidy
from .warc import opened

SCALE, K, BLOCK, GROUP, QUERIES = 256, 5, 256, 64, 4096
NONE = np.iinfo(np.int64).min


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def scaled(vector: str, scale: int = SCALE) -> Column:
    """array<long>: floor(scale * component), each well within a long, or an error."""
    fits = lambda x: F.abs(x * scale) < 2.0**62
    return F.transform(vector, lambda x: F.when(fits(x), F.floor(x * scale)).otherwise(F.raise_error(F.concat(F.lit("component out of range: "), x.cast("string"))).cast("long")))


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: array<long> of the rows that take part."""
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
        .filter(F.forall("v", finite))
        .select("vec_id", scaled("v", scale).alias("v"))
    )


def read_rows(path: str, columns: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a table in the shared folder, at most `most` at a time, read within a task."""
    files, root = opened(path)
    for info in files.get_file_info(pafs.FileSelector(root)):
        if info.base_name.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(most, columns=columns)


def blocks_of(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of near `block` vectors by range of vec_id: block, dims, ids, rows, high, low (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                m, ids = matrix_of(part.column("v")), part.column("vec_id").to_numpy()
                values = [number, m.shape[1], ids.tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes()]
                types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["block", "dims", "ids", "rows", "high", "low"])
                number += 1

    ranged = vectors.repartitionByRange("vec_id", F.xxhash64("v")).sortWithinPartitions("vec_id")
    return ranged.mapInArrow(run, "block long, dims long, ids binary, rows binary, high binary, low binary")


def matrix_of(lists: pa.Array) -> np.ndarray:
    """Rows of numbers, shorter ones padded with zeros."""
    lengths = np.diff(lists.offsets.to_numpy())
    m = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))), np.int64)
    m[np.arange(m.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return m


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer a @ b.T: by doubles where every sum is exact in them, in Python's own numbers where a long may not do; a result that does not fit a long is an error."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    most = largest(a) * largest(b) * n
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    wide = a.astype(object) @ b.T.astype(object)
    if wide.size and max(abs(int(wide.max())), abs(int(wide.min()))) >= 2**63:
        raise OverflowError("a score does not fit a long")
    return wide.astype(np.int64)


def largest(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and block the sum of its terms' extremes, no lower than any score there; doubles, rounded up."""
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    n = min(q.shape[1], high.shape[1])
    found = up[:, :n] @ high[:, :n].T.astype(np.float64) + down[:, :n] @ low[:, :n].T.astype(np.float64)
    return found + np.abs(found) * 1e-12 + (up[:, :n] @ np.abs(high[:, :n]).T.astype(np.float64) - down[:, :n] @ np.abs(low[:, :n]).T.astype(np.float64)) * 1e-12


class Search:
    """The k best of all blocks seen so far, per query. Scores below a query's floor are of no use."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.q = queries
        self.score = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), NONE)
        self.floors = np.full(len(ids), NONE) if floors is None else floors
        self.visited = self.blocks = 0

    def add(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """blocks: (ids, rows, high, low) each."""
        dims = max(len(b[2]) for b in blocks)
        high, low = np.zeros((len(blocks), dims), np.int64), np.zeros((len(blocks), dims), np.int64)
        for i, b in enumerate(blocks):
            high[i, : len(b[2])], low[i, : len(b[3])] = b[2], b[3]
        bound = bounds(self.q, high, low)
        order = np.argsort(-bound, axis=1, kind="stable")
        self.blocks += order.size
        for step in range(len(blocks)):
            block = order[:, step]
            live = np.nonzero(bound[np.arange(len(block)), block] >= np.maximum(self.score[:, -1], self.floors))[0]
            if not len(live):
                break
            self.visited += len(live)
            for b in np.unique(block[live]):
                self.visit(live[block[live] == b], *blocks[b][:2])

    def visit(self, who: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        s = exact_product(self.q[who], rows)
        own = self.ids[who][:, None] == ids[None, :]
        s[own] = NONE
        better = (s >= np.maximum(self.score[who, -1:], self.floors[who, None])).any(axis=1)
        who, s, own = who[better], s[better], own[better]
        if not len(who):
            return
        scores = np.concatenate([self.score[who], s], axis=1)
        names = np.concatenate([self.found[who], np.where(own, NONE, np.broadcast_to(ids, s.shape))], axis=1)
        empty = names == NONE
        best = np.lexsort((names, -scores, empty), axis=1)[:, : self.k]
        self.score[who] = np.take_along_axis(scores, best, 1)
        self.found[who] = np.take_along_axis(names, best, 1)


def floors_of(blocks: DataFrame, queries: DataFrame, k: int = K, sample: int = 4) -> DataFrame:
    """vec_id, v, floor of the queries, one for each id: the k-th best score in `sample` blocks (by a hash), which no better block can undercut; null if they hold fewer than k others."""
    once = queries.groupBy("vec_id").agg(F.max("v").alias("v"))
    few = blocks.orderBy(F.xxhash64("block")).limit(sample)
    found = top_of(few, once.withColumn("floor", F.lit(None).cast("long")), k)
    low = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    return once.join(low.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left")


def top_of(blocks: DataFrame, queries: DataFrame, k: int = K, most: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score.

    The queries (vec_id, v, floor) are a table in the shared folder. Each task reads it, `most` queries
    at a time, for each GROUP of blocks: neither the plan, nor the driver, nor a
    task's memory grows with the number of queries.
    """
    path = fresh_path(blocks.sparkSession, "queries")
    queries.write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in chain(batches, [None]):
            if batch is not None:
                for row in batch.select(["dims", "ids", "rows", "high", "low"]).to_pylist():
                    vec, rows, high, low = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "high", "low"))
                    held.append((vec, rows.reshape(-1, row["dims"]), high, low))
            while len(held) >= GROUP or batch is None and held:
                for asked in read_rows(path, ["vec_id", "v", "floor"], most):
                    floors = asked.column("floor").fill_null(NONE).to_numpy(zero_copy_only=False)
                    state = Search(asked.column("vec_id").to_numpy(), matrix_of(asked.column("v")), k, floors)
                    state.add(held[:GROUP])
                    at, nth = np.nonzero((state.found != NONE) & (state.score >= floors[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(state.ids[at]), pa.array(state.found[at, nth]), pa.array(state.score[at, nth])], ["query_id", "vec_id", "score"])
                held = held[GROUP:]

    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = blocks.mapInArrow(tidy(run), "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def search(blocks: DataFrame, queries: DataFrame, k: int = K, most: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: a first pass over a few blocks gives every query a score that the second pass over all need not go below."""
    return top_of(blocks, floors_of(blocks, queries, k), k, most)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return search(staged(blocks_of(vectors), "blocks"), vectors.filter("vec_id % 50 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
