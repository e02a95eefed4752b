"""Prefix tries of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Sums of a hash of each turn and its place
name the sequences, so the names of all prefixes are running sums, which are taken by
ranges of rows: a conversation of any length is spread over tasks. Every node gets an
enter and an exit arc, each arc its successor in the tour. The tour is ranked by
contraction: tasks join the arcs that follow each other within a range of the table into
segments, over and over; where ranges no longer help, segments that a coin chooses take
in their successors by joins. At most LIST segments are ranked at once, then ranks go
back down. Prefix sums at the arcs' places give each subtree's leaves and savings.

Defined results: rows with a null conv_id name no conversation; null roles and texts are
empty; turns of one number are ordered by role, then by the SHA-256 of the text; repeated
rows are turns of their own; a conversation of which nothing is left belongs to the root
alone; an empty table has no root and gives no rows; other columns are ignored. A node's
name has 128 bits. The ids of a node are hashed in one task, as SHA-256 asks, but
as chunks of text that pass through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, tidy

#: Conversations of one hundred share the first turns of its first one, at most MOST_SHARED - 1 of them.
FAMILY, MOST_SHARED = 100, 6
#: Arcs that a task joins at once, segments that are ranked at once, ids of a chunk of text.
CHUNK, LIST, IDS = 500_000, 50_000, 8192
LANES = [f"k{i}" for i in range(4)]
KEY = ["depth", *LANES]
NODE = ["conv_id", "depth"]
#: An arc is a node and a way: 0 enters, 1 leaves.
ARC, NEXT, HEAD = ["c", "d", "x"], ["nc", "nd", "nx"], ["hc", "hd", "hx"]


def shared(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its family's first."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("long")


def by_range(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """rows in ranges of these columns, sorted within them; _part is a range's number. Written, so that ranges stay as they are."""
    return staged(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_part", F.spark_partition_id()), name)


def carried(rows: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """_part, key and, as before_*, what earlier ranges hold of a key's sums: at most one row a range, as a range's first key alone goes on from before."""
    each = rows.groupBy("_part", key).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("_part", key, *[F.sum(c).over(earlier).alias(f"before_{c}") for c in sums]).filter(F.col(f"before_{sums[0]}").isNotNull())


def running(rows: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """Replaces each of `sums` by its running sum within the key, over all ranges. A range's rows of a key meet in one task, a key's ranges never."""
    upto = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.broadcast(carried(rows, key, sums))
    met = rows.withColumns({c: F.sum(c).over(upto) for c in sums}).join(before, ["_part", key], "left")
    return met.withColumns({c: F.col(c) + F.coalesce(f"before_{c}", F.lit(0)) for c in sums}).drop(*[f"before_{c}" for c in sums])


def lanes(place: Column, digest: Column) -> dict[str, Column]:
    """Four numbers below 2**32 of a turn at a place: their sums over any number of turns stay within a long."""
    a, b = F.xxhash64(place, digest), F.xxhash64(digest, place, F.lit(1))
    low = F.lit(0xFFFFFFFF).cast("long")
    return dict(zip(LANES, (a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32))))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, size and one (1): the texts stay where they are read."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.sha2(text, 256).alias("digest"), F.char_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("place")
    )


def members(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, the name of the first `depth` turns (k0..k3) and of one fewer (p0..p3), size of the last text, whether it is the last turn: of all rebuilt conversations."""
    order = ["turn", "role", "digest"]
    ranged = by_range(turns_of(conversations), ["conv_id", *order], "turns")
    digest = F.concat_ws("|", "role", "digest")
    is_base = F.col("conv_id") % FAMILY == 0
    first = running(ranged.filter(is_base), "conv_id", order, ["place"]).filter(F.col("place") < MOST_SHARED).withColumns(lanes(F.col("place"), digest))
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # at most five rows
    first = first.withColumns({k: F.sum(k).over(upto) for k in LANES})
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", *LANES, "size"))).alias("head"))

    n = ranged.groupBy("_part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = n.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("h", shared(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    none = F.array().cast("array<struct<place:bigint,k0:bigint,k1:bigint,k2:bigint,k3:bigint,size:bigint>>")
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", none), 1, F.col("h").cast("int")))
    convs = staged(convs.select("conv_id", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")

    root = F.struct(F.lit(0).cast("long").alias("place"), *[F.lit(0).cast("long").alias(k) for k in [*LANES, "size"]])
    every = F.concat(F.array(root), "head")
    before = lambda i: F.get("every", F.greatest(i - 1, F.lit(0)))
    taken = convs.withColumn("every", every).select("conv_id", "total", F.posexplode(F.transform("every", lambda x, i: F.struct(x.alias("x"), before(i).alias("p")))).alias("i", "s"))
    taken = taken.select("conv_id", F.col("s.x.place").alias("depth"), *[F.col(f"s.x.{k}").alias(k) for k in LANES], *[F.col(f"s.p.k{i}").alias(f"p{i}") for i in range(4)], F.col("s.x.size").alias("size"), (F.col("total") == F.col("s.x.place")).alias("last"))

    # A row's place moves by what its family's first conversation is short of.
    moved = n.select("_part", "conv_id").join(convs, "conv_id").select("_part", "conv_id", "h", (F.size("head") - F.col("h")).alias("moved"), "total", F.get("head", F.size("head") - 1).alias("start"))
    own = running(ranged, "conv_id", order, ["place"]).join(moved, ["_part", "conv_id"]).filter(F.col("place") > F.col("h"))
    own = own.withColumn("place", F.col("place") + F.col("moved")).withColumns(lanes(F.col("place"), digest)).withColumns({f"own{i}": F.col(k) for i, k in enumerate(LANES)})
    own = staged(own.select("_part", "conv_id", "place", "size", (F.col("total") == F.col("place")).alias("last"), *LANES, *[f"own{i}" for i in range(4)], *[F.coalesce(f"start.{k}", F.lit(0)).alias(f"s{i}") for i, k in enumerate(LANES)]), "own")
    own = running(own, "conv_id", ["place"], LANES).withColumns({k: F.col(k) + F.col(f"s{i}") for i, k in enumerate(LANES)})
    own = own.select("conv_id", F.col("place").alias("depth"), *LANES, *[(F.col(k) - F.col(f"own{i}")).alias(f"p{i}") for i, k in enumerate(LANES)], "size", "last")
    return taken.unionByName(own)


def hashed_ids(ends: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of the conversations that end at a node. Ids become chunks of text in ranges, then a node's chunks pass through one task in order."""
    long = pa.int64()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in KEY])
            cuts = np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0] + 1 if batch.num_rows else []
            ids = batch.column("conv_id").to_pylist()
            starts = [a for lo, hi in zip([0, *cuts], [*cuts, len(ids)]) for a in range(lo, hi, IDS)]
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[starts], long) for k in keys), pa.array([ids[a] for a in starts], long), pa.array(texts, pa.string())], [*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in chain(batches, [None]):
            done = []
            for row in [None] if batch is None else zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"])):
                if row is None or row[:-1] != held:
                    if held is not None:
                        done.append((*held, state.hexdigest()))
                    held, state = (None, None) if row is None else (row[:-1], hashlib.sha256(row[-1].encode()))
                else:
                    state.update(b"," + row[-1].encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], long if i < 5 else pa.string()) for i in range(6)], [*KEY, "ends_sha256"])

    keys = ", ".join(f"{k} long" for k in KEY)
    cut = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(tidy(chunks), f"{keys}, first long, ids string")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(tidy(digests), f"{keys}, ends_sha256 string")


def nodes_of(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, first_child, saved, ends_sha256: all nodes of the trie."""
    rows = staged(rows, "members")
    found = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"), *[F.max(f"p{i}").alias(f"p{i}") for i in range(4)])
    found = staged(found, "named")
    parent = found.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(f"p{i}") for i, k in enumerate(LANES)], F.col("conv_id").alias("parent_conv_id"))
    # Many children of one parent are one key: Spark splits it, as the parents' side has one row of it.
    linked = found.join(parent, ["depth", *[f"p{i}" for i in range(4)]], "left").join(hashed_ids(rows.filter("last").select(*KEY, "conv_id")), KEY, "left")
    linked = staged(linked.select(*NODE, "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "linked")
    children = linked.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child"))
    return staged(linked.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")


def siblings(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, sibling: the next child of the same parent, by id. Children are ordered by ranges; a range's last one finds its sibling in the next range's first row."""
    family = ["depth", "parent_conv_id"]
    ranged = by_range(nodes.filter("depth > 0").select("conv_id", *family), [*family, "conv_id"], "siblings")
    first = ranged.groupBy("_part").agg(F.min(F.struct(*family, "conv_id")).alias("f"))  # a row a range
    following = F.broadcast(first.select("_part", F.lead("f").over(Window.orderBy("_part")).alias("f")))
    within = F.lead("conv_id").over(Window.partitionBy("_part", *family).orderBy("conv_id"))
    goes_on = (F.col("f.depth") == F.col("depth")) & (F.col("f.parent_conv_id") == F.col("parent_conv_id"))
    return ranged.withColumn("sibling", within).join(following, "_part", "left").select(*NODE, F.coalesce("sibling", F.when(goes_on, F.col("f.conv_id"))).alias("sibling"))


def tour(nodes: DataFrame) -> DataFrame:
    """ARC, NEXT (null after the last), leaf, saved: two arcs a node; what a node adds stands at its enter arc."""
    rows = nodes.join(siblings(nodes), NODE, "left")
    way = lambda c, d, x: F.struct(c.cast("long").alias("nc"), d.cast("long").alias("nd"), F.lit(x).cast("long").alias("nx"))
    c, d = F.col("conv_id"), F.col("depth")
    down = F.when(F.col("n_children") > 0, way(F.col("first_child"), d + 1, 0)).otherwise(way(c, d, 1))
    up = F.when(F.col("sibling").isNotNull(), way(F.col("sibling"), d, 0)).when(d > 0, way(F.col("parent_conv_id"), d - 1, 1))
    leaf = (F.col("n_children") == 0).cast("long")
    arc = lambda x, to, n, saved: F.struct(F.lit(x).cast("long").alias("x"), to.alias("to"), n.cast("long").alias("leaf"), saved.cast("long").alias("saved"))
    both = rows.select(c.alias("c"), d.alias("d"), F.explode(F.array(arc(0, down, leaf, F.col("saved")), arc(1, up, F.lit(0), F.lit(0)))).alias("a"))
    return both.select("c", "d", "a.x", *[f"a.to.{n}" for n in NEXT], "a.leaf", "a.saved")


def joined(ids: np.ndarray, following: np.ndarray, has: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head of each item, length before it within its segment, last item of each head's segment) of the list that the items hold; places in `ids`.

    ids and following are of three columns; links that lead out of the items end a segment. Heads are found by doubling jumps.
    """
    n = len(ids)
    order = np.lexsort(ids.T[::-1])
    both = np.concatenate([ids, following])
    rank = np.zeros(len(both), np.int64)
    by = np.lexsort(both.T[::-1])
    rank[by] = np.concatenate([[0], (both[by][1:] != both[by][:-1]).any(1).cumsum()]) if n else 0
    at = np.searchsorted(rank[:n][order], rank[n:])
    inside = has & (at < n)
    inside[inside] = rank[:n][order][at[inside]] == rank[n:][inside]
    back = np.arange(n)
    back[order[at[inside]]] = np.nonzero(inside)[0]
    last = ~inside
    before = np.where(back == np.arange(n), 0, length[back])
    while (again := back[back] != back).any():
        before, back = before + np.where(again, before[back], 0), back[back]
    tail = np.zeros(n, np.int64)
    tail[back[last]] = np.nonzero(last)[0]
    return back, before, tail


LEVEL = ", ".join(f"{c} long" for c in [*ARC, *HEAD, "before", "length", *NEXT])


def by_ranges(items: DataFrame) -> DataFrame:
    """LEVEL: every item's segment (HEAD) and what lies before it there; at heads also the segment's length and NEXT. Items join where a task holds both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chain(batches, [None]):
            held += [] if batch is None else [batch]
            n += 0 if batch is None else batch.num_rows
            if not n or batch is not None and n < CHUNK:
                continue
            columns = {c: np.concatenate([b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for b in held]) for c in [*ARC, *NEXT, "length"]}
            has = np.concatenate([b.column("nc").is_valid().to_numpy(zero_copy_only=False) for b in held])
            ids, following = (np.stack([columns[c] for c in names], 1) for names in (ARC, NEXT))
            head, before, tail = joined(ids, following, has, columns["length"])
            first = head == np.arange(n)
            end = tail[head]
            whole = before[end] + columns["length"][end]
            out = [*ids.T, *ids[head].T, before, whole, *following[end].T]
            masks = [None] * 7 + [~first] + [~(first & has[end])] * 3
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64(), mask=m) for x, m in zip(out, masks)], [c.split()[0] for c in LEVEL.split(", ")])
            held, n = [], 0

    return items.mapInArrow(tidy(run), LEVEL)


def by_coins(items: DataFrame, turn: int) -> DataFrame:
    """LEVEL: items that show heads take in a successor that shows tails, a quarter of all on average."""
    coin = lambda names: F.xxhash64(F.lit(turn), *names) % 2 == 0
    taker, taken = coin(ARC) & F.col("nc").isNotNull() & ~coin(NEXT), ~coin(ARC)
    heads = items.filter(taker).select(*[F.col(a).alias(h) for a, h in zip(ARC, HEAD)], *[F.col(n).alias(a) for n, a in zip(NEXT, ARC)], F.col("length").alias("before"))
    gone = items.filter(taken).join(heads, ARC)
    grown = gone.select(*[F.col(h).alias(a) for a, h in zip(ARC, HEAD)], F.col("length").alias("more"), *[F.col(n).alias(f"t{n}") for n in NEXT])
    kept = items.join(gone.select(*ARC), ARC, "left_anti").join(grown, ARC, "left")
    took = F.col("more").isNotNull()
    kept = kept.select(
        *ARC, *[F.col(a).alias(h) for a, h in zip(ARC, HEAD)], F.lit(0).cast("long").alias("before"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), *[F.when(took, F.col(f"t{n}")).otherwise(F.col(n)).alias(n) for n in NEXT]
    )
    nothing = [F.lit(None).cast("long").alias(c) for c in ["length", *NEXT]]
    return kept.unionByName(gone.select(*ARC, *HEAD, "before", *nothing))


def ranked(items: DataFrame, most: int = LIST) -> DataFrame:
    """ARC, rank: every item's place (the lengths before it) in the one list that they form; `items` has ARC, NEXT, length."""
    levels, n, ranges, turn = [], items.count(), True, 0
    while n > most:
        level = by_ranges(items.repartitionByRange(*ARC).sortWithinPartitions(*ARC)) if ranges else by_coins(items, turn)
        levels.append(staged(level, "level"))
        items, before = levels[-1].filter("length is not null").select(*ARC, *NEXT, "length"), n
        n, turn = items.count(), turn + 1
        ranges = 2 * n < before
    found = by_ranges(items.coalesce(1)).select(*ARC, F.col("before").alias("rank"))  # at most `most` rows
    for level in reversed(levels):
        heads = staged(found.select(*[F.col(a).alias(h) for a, h in zip(ARC, HEAD)], "rank"), "ranks")
        heads = F.broadcast(heads) if heads.count() <= most else heads
        found = level.join(heads, HEAD).select(*ARC, (F.col("rank") + F.col("before")).alias("rank"))
    return found


def subtree_sums(arcs: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: what the prefix sums grow by from a node's enter to its exit arc. n: the arcs."""
    block = max(1 << 12, round(n**0.5))
    placed = staged(arcs.select(*ARC, "leaf", "saved").join(ranks, ARC).withColumn("block", F.floor(F.col("rank") / block)), "places")
    totals = placed.groupBy("block").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saving"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the root of the arcs' number
    totals = totals.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("leaves", "saving")])
    upto = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.withColumns({f"s_{c}": F.sum(c).over(upto) for c in ("leaf", "saved")}).join(totals, "block")
    sums = sums.select(*ARC, "leaf", "saved", (F.col("s_leaf") + F.col("leaves")).alias("a"), (F.col("s_saved") + F.col("saving")).alias("b"))
    grown = lambda upto, own: F.sum(F.when(F.col("x") == 1, F.col(upto)).otherwise(F.col(own) - F.col(upto)))
    return sums.groupBy(F.col("c").alias("conv_id"), F.col("d").alias("depth")).agg(grown("a", "leaf").alias("n_leaves"), grown("b", "saved").alias("saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    nodes = nodes_of(members(conversations))
    arcs = staged(tour(nodes), "arcs")
    sums = subtree_sums(arcs, ranked(arcs.select(*ARC, *NEXT, F.lit(1).cast("long").alias("length"))), arcs.count())
    return nodes.join(sums, NODE).select(*NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: Everything is compared as it is: a node is named by the list of its turns. crc32 is taken bit by bit.
OP13_SQL = """
WITH crc AS (SELECT conv_id, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, CAST(i AS INT), 1))), lambda b: [b + 256, 0, 0, 0, 0, 0, 0, 0]))), lambda r, b:
    CASE WHEN (CASE WHEN b > 0 THEN xor(r, b - 256) ELSE r END) % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), (CASE WHEN b > 0 THEN xor(r, b - 256) ELSE r END) // 2) ELSE (CASE WHEN b > 0 THEN xor(r, b - 256) ELSE r END) // 2 END)) AS BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL)
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT c.conv_id, 0 AS part, b.pos, b.role, b.text FROM crc c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 100 AND b.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM crc c JOIN t o ON o.conv_id = c.conv_id AND o.pos > c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS k, text FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]), '' FROM crc
), m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p
), nodes AS (SELECT k, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(length(text)) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM m GROUP BY k
), kin AS (SELECT v.*, u.conv_id AS parent_conv_id FROM nodes v LEFT JOIN nodes u ON v.depth > 0 AND u.k = v.k[1:v.depth - 1]
), kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM kin WHERE depth > 0 GROUP BY 1, 2
), every AS (SELECT v.*, coalesce(kids.n, 0) AS n_children FROM kin v LEFT JOIN kids ON kids.conv_id = v.conv_id AND kids.depth = v.depth
), sums AS (SELECT a.k, sum((e.n_children = 0)::INT) AS n_leaves, sum(e.saved) AS saved_tokens FROM every e, unnest(range(0, e.depth + 1)) AS u(i) JOIN nodes a ON a.k = e.k[1:CAST(i AS INT)] GROUP BY 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM every JOIN sums USING (k)
"""
