"""Hard negatives by vertical scans with bounds (BOND).

Vectors are stored in blocks, each dimension a column of its own with its smallest
and largest value. An anchor reads a block's columns in the order of its own
largest magnitudes. After each step, what the columns not yet read can still add,
at least and at most, bounds every candidate's score; the bitmap of candidates
shrinks to those that can still be among the best, until the exact ones are left.

Three passes. Each anchor first searches its own block, which gives a floor for
its positives' scores. The second pass finds the positives above that floor in
all blocks, the third the negatives of every positive's window of scores: there a
candidate must be able to fall into a window, above the window's third best so far.

Defined results: vectors that are null or hold null or non-finite components, and
rows with a null label or vec_id, take no part; a shorter vector counts as padded
with zeros; a vec_id given more than once is one row, its greatest label and vector;
ties go to the smaller vec_id; an empty table, and a window that nothing falls into,
give no rows; other columns are ignored. Scores are exact; one that does not fit a long, and a component
of 2**62 / 256 or more, is an error, never a wrapped number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, staged, table, tidy
from .topk import SCALE, finite, matrix_of, read_rows, scaled

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percents of its positive's.
LOW, HIGH = 50, 95
#: Vectors and bytes of a block, blocks and bytes held at once, anchors read at once.
BLOCK, BLOCK_BYTES, GROUP, GROUP_BYTES, ANCHORS = 2048, 4 << 20, 32, 64 << 20, 1024
#: Columns read between two looks at the bounds, first and later.
FIRST, STEP = 0.5, 0.125


def labelled(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (array<long>) of the rows that take part, one for each id, the labels of each seventh id turned over."""
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    kept = kept.filter("vec_id is not null and label is not null and v is not null").filter(F.forall("v", finite))
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    greatest = kept.groupBy("vec_id").agg(F.max(F.struct(turned.alias("label"), scaled("v", scale).alias("v"))).alias("x"))
    return greatest.select("vec_id", "x.label", "x.v")


def columns_of(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of vectors of unique ids, dealt by id, within a task by label: ids, labels, columns (array<binary>), lows, highs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                widest = max(1, int(np.diff(batch.column("v").offsets.to_numpy()[at : at + block + 1]).max(initial=0)))
                part = batch.slice(at, max(1, min(block, BLOCK_BYTES // (8 * widest))))
                m = np.ascontiguousarray(matrix_of(part.column("v")).T)
                row = [part.column("vec_id").to_numpy().tobytes(), part.column("label").to_numpy().tobytes(), [c.tobytes() for c in m], m.min(1).tobytes(), m.max(1).tobytes()]
                types = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["ids", "labels", "columns", "lows", "highs"])
                at += part.num_rows

    return vectors.sortWithinPartitions("label", "vec_id").mapInArrow(tidy(run), "ids binary, labels binary, columns array<binary>, lows binary, highs binary")


def exact(largest: int, other: int, terms: int) -> type:
    """The fastest type in which sums of `terms` products of numbers of these sizes are exact; beyond a long, Python's own numbers."""
    most = largest * other * max(1, terms)
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


class Block:
    """Columns of vectors, ordered by label."""

    def __init__(self, row: dict):
        self.ids, self.labels, low, high = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "lows", "highs"))
        self.columns = np.frombuffer(b"".join(row["columns"]), np.int64).reshape(len(low), len(self.ids))
        self.lows, self.highs = low, high
        self.largest = max(int(high.max(initial=0)), -int(low.min(initial=0)))
        self._as: dict[type, np.ndarray] = {}

    @property
    def nbytes(self) -> int:
        return self.columns.nbytes

    def of(self, kind: type) -> np.ndarray:
        """The columns in the type that a scan needs, cast once."""
        if kind not in self._as:
            self._as[kind] = self.columns.astype(kind)
        return self._as[kind]

    def same(self, label: int) -> np.ndarray:
        return np.arange(*np.searchsorted(self.labels, [label, label + 1]))

    def other(self, label: int) -> np.ndarray:
        a, b = np.searchsorted(self.labels, [label, label + 1])
        return np.concatenate([np.arange(a), np.arange(b, len(self.labels))])


#: (least, most score possible of each candidate) -> which stay.
Test = Callable[[np.ndarray, np.ndarray], np.ndarray]


def scan(block: Block, q: np.ndarray, rows: np.ndarray, test: Test) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, their exact scores, numbers read): the candidates that pass the test to the end.

    Columns are read in descending order of the anchor's magnitudes; the rest of the anchor against the block's lows and
    highs bounds what is still to come.
    """
    n, read = min(len(q), len(block.columns)), 0
    q = q[:n]
    kind = exact(int(np.abs(q).max(initial=0)), block.largest, n)
    columns, order = block.of(kind), np.argsort(-np.abs(q), kind="stable")
    q = q.astype(kind)
    ends = np.stack([q * block.lows[:n].astype(kind), q * block.highs[:n].astype(kind)])[:, order]
    least, most = ends.min(0)[::-1].cumsum()[::-1], ends.max(0)[::-1].cumsum()[::-1]  # of the columns from each place on
    score, at = np.zeros(len(rows), kind), 0
    while len(rows) and at < n:
        upto = min(n, max(at + 1, round(n * (FIRST if at == 0 else STEP)) + at))
        for d in order[at:upto]:
            score = score + q[d] * columns[d, rows]
        read, at = read + len(rows) * (upto - at), upto
        rest = (least[at], most[at]) if at < n else (0, 0)
        alive = test(score + rest[0], score + rest[1])
        rows, score = rows[alive], score[alive]
    return rows, score, read


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


class Best:
    """The k best (score, id) so far, and the score that another must reach."""

    def __init__(self, k: int, floor: int | None = None):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.zeros(0, object), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores.astype(object)]), np.concatenate([self.ids, ids])
        top = best_of(s, i, self.k)
        self.scores, self.ids = s[top], i[top]
        if len(top) == self.k and (self.floor is None or self.scores[-1] > self.floor):
            self.floor = self.scores[-1]


def kth(least: np.ndarray, k: int) -> object | None:
    """The k-th highest of the scores that candidates have at least: no lower one can be among the k best."""
    return np.partition(least, len(least) - k)[-k] if len(least) >= k else None


def positives_in(block: Block, anchor: int, label: int, q: np.ndarray, best: Best) -> int:
    """Adds the anchor's best rows of its own label to `best`; returns how many numbers were read."""
    rows = block.same(label)
    rows = rows[block.ids[rows] != anchor]

    def test(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        floors = [f for f in (kth(least, best.k), best.floor) if f is not None]
        return most >= max(floors) if floors else np.ones(len(most), bool)

    rows, scores, read = scan(block, q, rows, test)
    best.add(scores, block.ids[rows])
    return read


def window(positive_score: int) -> tuple[int, int]:
    """The least and the greatest score of a positive's negatives."""
    return -(-LOW * positive_score // 100), HIGH * positive_score // 100


def negatives_in(block: Block, label: int, q: np.ndarray, windows: dict[tuple[int, int], Best]) -> int:
    """Adds the best rows of other labels to each window of scores; returns how many numbers were read."""

    def inside(least: np.ndarray, most: np.ndarray, low: int, high: int, best: Best) -> np.ndarray:
        sure = least[(least >= low) & (most <= high)]
        floor = max(x for x in (low, best.floor, kth(sure, best.k)) if x is not None)
        return (most >= floor) & (least <= high)

    def test(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([inside(least, most, *w, best) for w, best in windows.items()])

    rows, scores, read = scan(block, q, block.other(label), test)
    for (low, high), best in windows.items():
        fits = (scores >= low) & (scores <= high)
        best.add(scores[fits], block.ids[rows[fits]])
    return read


def long(x: int) -> int:
    if not -(2**63) <= int(x) < 2**63:
        raise OverflowError(f"a score of {int(x)} does not fit a long")
    return int(x)


ANCHOR = "vec_id long, label long, v array<long>"


def floors_of(blocks: DataFrame, every: int, k: int = POSITIVES) -> DataFrame:
    """The anchors (every so many ids) with the k-th best score that they have in their own block, or null: vec_id, label, v, floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, found = Block(row), []
                for i in np.nonzero(block.ids % every == 0)[0]:
                    best = Best(k)
                    positives_in(block, block.ids[i], block.labels[i], block.columns[:, i], best)
                    found.append((int(block.ids[i]), int(block.labels[i]), block.columns[:, i].tolist(), None if best.floor is None else long(best.floor)))
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(types)], ["vec_id", "label", "v", "floor"])

    return blocks.mapInArrow(tidy(run), f"{ANCHOR}, floor long")


def search(blocks: DataFrame, anchors: DataFrame, columns: list[str], visit: Callable[[list[Block], dict], Iterator[tuple]], out: str) -> DataFrame:
    """visit(blocks, anchor) over every anchor and every block.

    The anchors are a table in the shared folder, which each task reads, ANCHORS at a time, for each group of
    blocks: neither plan, driver nor a task's memory grows with their number.
    """
    path = fresh_path(blocks.sparkSession, "anchors")
    anchors.select(*columns).write.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [c.split()[0] for c in out.split(", ")], []
        for row in chain((r for b in batches for r in b.to_pylist()), [None]):
            held += [] if row is None else [Block(row)]
            if held and (row is None or len(held) >= GROUP or sum(b.nbytes for b in held) >= GROUP_BYTES):
                for read in read_rows(path, columns, ANCHORS):
                    found = [f for anchor in read.to_pylist() for f in visit(held, anchor)]
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(len(names))], names)
                held = []

    return blocks.mapInArrow(tidy(run), out)


def positives(blocks: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """anchor_id, positive_id, positive_score: the k best rows of an anchor's own label."""

    def visit(held: list[Block], a: dict) -> Iterator[tuple]:
        best, q = Best(k, a["floor"]), np.array(a["v"], np.int64)
        for block in held:
            positives_in(block, a["vec_id"], a["label"], q, best)
        return ((a["vec_id"], int(i), long(s)) for s, i in zip(best.scores, best.ids))

    found = search(blocks, anchors, ["vec_id", "label", "v", "floor"], visit, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def negatives(blocks: DataFrame, anchors: DataFrame, wanted: DataFrame, k: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_score, rank, negative_id, negative_score: the k best rows of other labels in the window of each of an anchor's positives' scores."""
    asked = wanted.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))

    def visit(held: list[Block], a: dict) -> Iterator[tuple]:
        q = np.array(a["v"], np.int64)
        windows = {w: Best(k) for s in a["scores"] if (w := window(s))[0] <= w[1]}
        for block in held if windows else []:
            negatives_in(block, a["label"], q, windows)
        for s in a["scores"]:
            best = windows.get(window(s))
            yield from ((a["vec_id"], s, int(i), long(x)) for x, i in zip(best.scores, best.ids)) if best else ()

    found = search(blocks, anchors.join(asked, "vec_id"), ["vec_id", "label", "v", "scores"], visit, "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors, whose ids `every` divides."""
    blocks = staged(columns_of(vectors), "columns")
    anchors = staged(floors_of(blocks, every), "floors")
    found = staged(positives(blocks, anchors), "positives")
    mined = negatives(blocks, anchors, found)
    return found.join(mined, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(labelled(table(spark, sf_dir, "embeddings")))


OP11_SQL = """
WITH v AS (SELECT vec_id, label, e FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label DESC, e DESC) AS r FROM (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)) WHERE r = 1
), s AS (
  SELECT a.vec_id AS anchor, c.vec_id AS other, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) AS r FROM s WHERE same) WHERE r <= 5
), n AS (
  SELECT p.anchor, p.other AS positive, p.score AS ps, s.other, s.score, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS r
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(r AS INTEGER) AS rank, other AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE r <= 3
"""
