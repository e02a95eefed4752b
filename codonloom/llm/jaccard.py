"""Exact n-gram Jaccard join by parity sketches.

A document's set of shingles is cut, by the leading bits of the shingles' hashes,
into pieces; a piece's sketch is the XOR (bitwise parity) of its shingles' hashes.
Sets that differ in d shingles have at most d different pieces, so with more pieces
than the largest difference that a size band allows, linked sets share a piece and
meet on its sketch. A second parity sketch, of bits and eight times as wide as the
largest difference that the set's size allows, has a Hamming distance of at most d,
which drops nearly all false candidates; the rest are verified on the sets.

A band has spare pieces: of equal pieces more than the spares must be there, so a
document may leave out as many pieces as there are spares, if all documents rank
pieces alike: the last of the equal ones in this order is left out by neither set.
Empty pieces are left out first, then those that most sets share, so what strangers
share with many (a common passage) does not gather them. A document with more empty
pieces than spares keys each of the others together with every piece of a second cut.

Equal sets are one node. Links are wanted for components, so candidates of nodes
that are joined already are not looked at again. Small buckets propose all their
pairs; of a larger one each node first tries the hub that it meets most often, then,
as long as a quarter of these are links, its nearest untried neighbour by sketch in another
component. Last comes every untried pair that the sketches allow and that is still apart:
a bucket names the nodes that such pairs connect, not the pairs, and the sets of connected
nodes are compared in blocks of bounded bytes, of which each gives only links that join components.

Defined results: null texts and texts without words have no shingles and stand
alone; with fewer words than a shingle the whole sequence is one; repeated rows
are copies of each other; rows with a null doc_id are linked like others but name
no component (one without any id has a null component_id); an empty table gives no
rows; other columns are ignored. Sets are known by 128 bits, shingles by 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, small_side, staged, table, tidy

PERCENT, NGRAM = 85, 4
#: The pipeline stage's own rule.
STAGE_PERCENT, STAGE_NGRAM = 80, 5
#: Buckets of at most SMALL nodes propose all their pairs. In buckets of more than HOT a node may use up its spares.
SMALL, HOT = 4, 64
#: Spare pieces a needed piece, growth of a band, narrowest and widest sketch in bits, bytes hashed at once, nodes that a task remembers.
SPARES, GROWTH, NARROW, WIDE, CHUNK, SEEN = 0.25, 1.3, 256, 8192, 1 << 20, 1 << 20
#: Pairs of one node that are verified by one task, and names of 64 bits that two sets may have (of 10^10 sets about three do).
FAN, CLASHES = 512, 10_000
#: Links or pairs that one task may hold.
ALONE = 200_000
#: Bytes of sets in a block that is compared with another one in one task.
BLOCK = 4 << 20
#: Rounds in which each node tries its nearest neighbour, while a quarter of the trials are links; then all pairs that the sketches leave are tried.
NEAREST = 4


def difference(total: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """The largest symmetric difference of linked sets whose sizes sum to total."""
    return (100 - percent) * total // (100 + percent)


class Bands:
    """Bands (tops[k-1], tops[k]] of set sizes; a set joins its own band and the further ones that it can link into."""

    def __init__(self, percent: int = PERCENT, most: int = 1 << 31):
        if percent < 50:  # a set must not join more than four bands
            raise ValueError("percent must be 50 or more")
        self.percent = percent
        tops = [0]
        while tops[-1] < most:
            tops.append(max(tops[-1] + 1, int(tops[-1] * GROWTH)))
        self.tops = np.array(tops)

    def of(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(which sets, band, pieces, spares, pieces of the second cut) of the sets' own bands, then of their next ones, and so on."""
        band = np.searchsorted(self.tops, sizes)
        who = np.flatnonzero(sizes > 0)
        while len(who):
            most = difference(2 * self.tops[band[who]], self.percent)
            some, spare = who[most > 0], np.ceil((most + 1) * SPARES).astype(np.int64)
            if len(some):
                yield some, band[some], (most + 1 + spare)[most > 0], spare[most > 0], (most + 1)[most > 0]
            band = band + 1
            who = who[100 * sizes[who] >= self.percent * (self.tops[band[who] - 1] + 1)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), salted."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingles of whole texts, computed on the bytes of many texts at once.

    A word's hash is a polynomial in its bytes' random values, taken from running sums.
    """

    STEP = 0x9E3779B97F4A7C15

    def __init__(self, n: int = NGRAM):
        self.n = n
        self.value = mix(np.arange(256, dtype=np.uint64), 99)
        self.value[65:91] = self.value[97:123]
        self.gap = np.zeros(256, bool)
        self.gap[[32, *range(9, 14)]] = True
        self.odd = mix(np.arange(1, n + 1, dtype=np.uint64), 77) | np.uint64(1)
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)]) for base in (self.STEP, pow(self.STEP, -1, 1 << 64)))

    def _hashed(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of each word; words end at the cuts too."""
        word = ~self.gap[raw]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts], last[cuts - 1] = word[cuts], word[cuts - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._powers(len(raw))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(self.value[raw] * self.up[: len(raw)], out=sums[1:])
            return a, mix((sums[b] - sums[a]) * self.down[a])

    def words(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes, and each text's number of words. Bytes are hashed CHUNK by CHUNK, cut between words."""
        starts, hashes, at = [], [], 0
        while at < len(raw):
            end = min(len(raw), at + CHUNK)
            if end < len(raw):
                ends = np.concatenate([np.flatnonzero(self.gap[raw[at:end]]) + at + 1, edges[(edges > at) & (edges <= end)]])
                if not len(ends):  # a word longer than a chunk
                    further = np.flatnonzero(self.gap[raw[end:]])
                    ends = np.r_[end + further[:1], edges[edges > end][:1]]
                    end = int(ends.min())
                else:
                    end = int(ends.max())
            a, h = self._hashed(raw[at:end], edges - at)
            starts.append(a + at)
            hashes.append(h)
            at = end
        first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.diff(np.searchsorted(first, edges))

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, sizes): each text's set of shingles as sorted 64-bit hashes, one set after the other."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        h, count = self.words(raw, edges - edges[0])
        n = self.n
        with np.errstate(over="ignore"):
            runs = np.zeros(max(0, len(h) - n + 1), np.uint64)
            for i in range(n):
                runs += h[i : i + len(runs)] * self.odd[i]
            runs = mix(runs)
            parts, at = [], 0
            for k in count.tolist():
                if k >= n:
                    parts.append(np.sort(runs[at : at + k - n + 1]))
                elif k:
                    parts.append(mix(np.array([np.sum(h[at : at + k] * self.odd[:k]) + np.uint64(k)]), 5))
                at += k
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(count)), np.where(count >= n, count - n + 1, np.minimum(count, 1)))
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        return tokens[new], np.bincount(owner[new], minlength=len(count))


def parities(tokens: np.ndarray, salt: int) -> np.ndarray:
    """Running XOR of the tokens' hashes: the parity of tokens a..b is the XOR of its places a and b."""
    found = np.zeros(len(tokens) + 1, np.uint64)
    np.bitwise_xor.accumulate(mix(tokens, salt), out=found[1:])
    return found


def names_of(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names per set, from the XOR of its tokens."""
    ends = np.cumsum(sizes)
    return tuple(mix((p := parities(tokens, salt))[ends] ^ p[ends - sizes] ^ sizes.astype(np.uint64), salt + 1).view(np.int64) for salt in (41, 45))


def renamed(node: np.ndarray, check: np.ndarray, clashes: list[int]) -> np.ndarray:
    """The nodes' names, where `clashes` (names that two sets have) are told apart by the second name."""
    if not clashes:
        return node
    return np.where(np.isin(node, clashes), mix(node.view(np.uint64) ^ check.view(np.uint64), 47).view(np.int64), node)


def widths_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Bits of each set's parity sketch."""
    wanted = np.maximum(1, 8 * difference(2 * sizes, percent))
    return np.clip(2 ** np.ceil(np.log2(wanted)).astype(np.int64), NARROW, WIDE)


def sketches_of(tokens: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> list[bytes]:
    """Each set's parity sketch: the bit at a token's last bits flips. Half as wide a sketch is the XOR of the two halves."""
    width = widths_of(sizes, percent)
    base = np.cumsum(width) - width
    place = (tokens & (np.repeat(width, sizes) - 1).astype(np.uint64)).astype(np.int64) + np.repeat(base, sizes)
    bits = np.packbits((np.bincount(place, minlength=int(width.sum())) & 1).astype(np.uint8)).tobytes()
    return [bits[a : a + w] for a, w in zip((base // 8).tolist(), (width // 8).tolist())]


def unsketched(sketch: bytes, width: int) -> np.ndarray:
    """A sketch folded to `width` bytes."""
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 8 > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def keys_of(tokens: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, key) of the sets' pieces; and per set the spares left in each band, 16 bits at 16 * (band & 3). A key's last two bits are its band's."""
    owners, found = [], []
    starts = np.cumsum(sizes) - sizes
    place, parity = tokens >> np.uint64(32), parities(tokens, 1001)
    left = np.zeros(len(sizes), np.uint64)
    for who, band, pieces, spare, second in bands.of(sizes):
        n = sizes[who]
        ahead = np.cumsum(n) - n
        base = np.cumsum(pieces) - pieces
        total = int(pieces.sum())
        rows = np.arange(n.sum()) + np.repeat(starts[who] - ahead, n)
        at = (place[rows] * np.repeat(pieces, n).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + np.repeat(base, n)
        count = np.bincount(at, minlength=total)
        owner = np.repeat(np.arange(len(who)), pieces)
        first = np.cumsum(count) - count + np.repeat(starts[who] - ahead, pieces)  # tokens are sorted, so a piece's stand together
        number = (np.arange(total) - base[owner]).astype(np.uint64)
        mark = (band & 3).astype(np.uint64)
        keys = mix(parity[first + count] ^ parity[first] ^ mix(number | (band[owner].astype(np.uint64) << np.uint64(40)), 2), 3)
        keys = keys & ~np.uint64(3) | mark[owner]
        full = count > 0
        owners.append(who[owner[full]])
        found.append(keys[full])
        empty = np.bincount(owner[~full], minlength=len(who))
        left[who] |= np.clip(spare - empty, 0, 65535).astype(np.uint64) << (np.uint64(16) * mark)
        for i in np.flatnonzero(empty > spare):
            weak = keys[base[i] : base[i] + pieces[i]][~full[base[i] : base[i] + pieces[i]]][spare[i] :]
            own = tokens[starts[who[i]] : starts[who[i]] + n[i]]
            other = np.zeros(second[i], np.uint64)
            np.bitwise_xor.at(other, ((mix(own, 2000) >> np.uint64(32)) * np.uint64(second[i]) >> np.uint64(32)).astype(np.int64), mix(own, 2001))
            inner = mix(other ^ mix(np.arange(second[i], dtype=np.uint64), 9), 4)
            found.append(mix(weak[:, None] ^ inner[None, :], 6).ravel() & ~np.uint64(3) | mark[i])
            owners.append(np.full(len(found[-1]), who[i]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), left
    return np.concatenate(owners), np.concatenate(found), left


def features(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, mark: Column | None = None, clashes: list[int] | None = None) -> DataFrame:
    """doc_id, mark (0 if none is given), n, node and check (the set's names, null without shingles), spares left, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(ngram), Bands(percent)
        for batch in slices(batches, "text", CHUNK):
            tokens, sizes = shingler.sets(batch.column("text"))
            node, check = names_of(tokens, sizes)
            node, left, none = renamed(node, check, clashes or []), keys_of(tokens, sizes, bands)[2], sizes == 0
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(sizes.astype(np.int64)), pa.array(node, mask=none), pa.array(check, mask=none)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(left.view(np.int64)), pa.array(sketches_of(tokens, sizes, percent), pa.binary())], names)

    marked = docs.select(F.col("doc_id").cast("long"), "text", (F.lit(0) if mark is None else mark).cast("long").alias("mark"))
    names = ["doc_id", "mark", "n", "node", "check", "spares", "sketch"]
    return marked.mapInArrow(tidy(run), "doc_id long, mark long, n long, node long, check long, spares long, sketch binary")


def buckets(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, clashes: list[int] | None = None) -> DataFrame:
    """(key, a, b) of the nodes that share keys: with a null key a pair of a small bucket, else a node of a larger one and the bucket's hub, its smallest node.

    Rows are dealt by key and pass through a task in the order of keys, a batch at a time.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands, seen = Shingler(ngram), Bands(percent), set()
        for batch in slices(batches, "text", CHUNK):
            tokens, sizes = shingler.sets(batch.column("text"))
            node = renamed(*names_of(tokens, sizes), clashes or [])
            if len(seen) > SEEN:
                seen.clear()
            fresh = np.zeros(len(sizes), bool)  # copies in one task give their keys once
            for i, x in enumerate(node.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            fresh &= sizes > 0
            tokens, sizes, node = tokens[np.repeat(fresh, sizes)], sizes[fresh], node[fresh]
            owner, keys, _ = keys_of(tokens, sizes, bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node[owner])], ["key", "node"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None  # the smallest node of the large bucket that is passing through
        key = node = np.zeros(0, np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                key, node = np.concatenate([key, batch.column("key").to_numpy()]), np.concatenate([node, batch.column("node").to_numpy()])
                if not len(key):
                    continue
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
                key, node = key[new], node[new]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.r_[starts, len(key)])
            heads = node[starts]
            large = size > SMALL
            if goes_on := hub is not None:
                large[0], heads[0] = True, hub
            whole = np.ones(len(starts), bool)
            if batch is not None:
                whole[-1] = large[-1]  # the last bucket goes on in the next batch
            rows = np.repeat(large, size)
            if goes_on:
                rows[0] = False  # it went out with the batch before
            found = [(key[rows], node[rows], np.repeat(heads, size)[rows])]
            for i in range(SMALL):
                for j in range(i + 1, SMALL):
                    at = starts[whole & ~large & (size > j)]
                    found.append((np.zeros(len(at), np.int64), node[at + i], node[at + j]))
            keys, a, b = (np.concatenate(x) for x in zip(*found))
            pair = np.arange(len(keys)) >= len(found[0][0])
            once = np.unique(np.stack([a[pair], b[pair]], axis=1), axis=0)
            a, b = np.r_[a[~pair], once[:, 0]], np.r_[b[~pair], once[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[keys[~pair], np.zeros(len(once), np.int64)], mask=np.arange(len(a)) >= (~pair).sum()), pa.array(a), pa.array(b)], ["key", "a", "b"])
            if len(starts):
                hub = heads[-1] if large[-1] else None
                rest = len(key) - 1 if large[-1] else starts[-1]
                key, node = key[rest:], node[rest:]

    rows = docs.select("text").mapInArrow(tidy(keyed), "key long, node long")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(met), "key long, a long, b long")


def spared(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The bucket rows (key, a) without those that a node may leave out: in each band as many of its fullest buckets as it has spares left. A node meets its spares once, with its full buckets in a list."""
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > HOT)
    sized = rows.join(size, "key", "left")
    full = sized.filter("size is not null").groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("s"), "key"))).alias("full"))
    met = full.join(nodes.select(F.col("node").alias("a"), "spares"), "a")

    def kept(band: int) -> Column:
        own = F.filter("full", lambda x: x["key"].bitwiseAND(F.lit(3)) == band)
        left = F.expr(f"cast(shiftrightunsigned(spares, {16 * band}) & 65535 AS int)")
        return F.slice(own, left + 1, F.size(own))

    hot = met.select(F.explode(F.transform(F.concat(*map(kept, range(4))), lambda x: x["key"])).alias("key"), "a")
    return sized.filter("size is null").select("key", "a").union(hot)


def fits(n: np.ndarray, m: np.ndarray, far: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the sketches' distance allow a link."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (far <= difference(n + m, percent))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow, with `far`, the sketches' distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())):
                width = min(len(x), len(y))
                far[i] = np.bitwise_count(unsketched(x, width) ^ unsketched(y, width)).sum()
            keep = fits(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), far, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(far)], ["a", "b", "far"]).filter(pa.array(keep))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    sized = pairs.join(left, "a").join(right, "b").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return sized.select("a", "b", "na", "nb", "x", "y").mapInArrow(tidy(run), "a long, b long, far long")


def connect(first: np.ndarray, these: np.ndarray) -> None:
    """Gives all places whose first place is that of one of these the smallest of them."""
    firsts = np.unique(first[these])
    if len(firsts) > 1:
        first[np.isin(first, firsts)] = firsts[0]


def neighbours(rows: DataFrame, how: str, percent: int = PERCENT) -> DataFrame:
    """From bucket rows (key, node, comp, n, sketch, past), for the nodes outside a bucket's largest component, as (a, b, far) the nearest one in another component that the sketches allow (`nearest`), past pairs aside; or (`all`) as (nodes), the
    nodes that such pairs connect, a row for each group of them: what a bucket gives grows with its nodes, not with its pairs.

    A task holds one bucket; its distances are computed in blocks.
    """

    def compared(node: np.ndarray, comp: np.ndarray, n: np.ndarray, sketches: list[bytes], past: list[list[int] | None]) -> Iterator[pa.RecordBatch]:
        width = min(map(len, sketches))
        s = np.stack([unsketched(x, width) for x in sketches])
        names, size = np.unique(comp, return_counts=True)
        rest = np.flatnonzero(comp != names[np.argmax(size)])  # of two components one at least is not the largest
        step = max(1, (1 << 21) // (len(node) * s.shape[1]))
        first, met = np.arange(len(node)), np.zeros(len(node), bool)
        for at in range(0, len(rest), step):
            i = rest[at : at + step]
            far = np.bitwise_count(s[i, None, :] ^ s[None, :, :]).sum(axis=-1, dtype=np.int64)
            ok = fits(n[i, None], n[None, :], far, percent) & (comp[i, None] != comp[None, :])
            for k, others in enumerate(past[x] for x in i):
                if others and ok[k].any():
                    ok[k] &= ~np.isin(node, others)
            if how == "nearest":
                b = np.argmin(np.where(ok, far, 1 << 40), axis=1)
                a = np.flatnonzero(ok[np.arange(len(b)), b])
                b = b[a]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node[i[a]], node[b], far[a, b])], ["a", "b", "far"])
                continue
            for a, others in zip(i, ok):
                if others.any():
                    others[a] = True
                    met |= others
                    connect(first, others)
        if how == "all" and met.any():
            at = np.flatnonzero(met)
            at = at[np.argsort(first[at])]
            cuts = np.flatnonzero(np.r_[True, first[at][1:] != first[at][:-1], True])
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(node[at]))], ["nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            node, comp, n = (t.column(c).to_numpy() for c in ("node", "comp", "n"))
            if comp.min() != comp.max():
                yield from compared(node, comp, n, t.column("sketch").to_pylist(), t.column("past").to_pylist())

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = batch.column("key").to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
            for at, end in zip(cuts, np.r_[cuts[1:], len(key)]):
                if held and key[at] != last:
                    yield from of(held)
                    held = []
                held.append(batch.slice(at, end - at))
                last = key[at]
        if held:
            yield from of(held)

    columns = rows.select("key", "node", "comp", "n", "sketch", "past")
    return columns.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "nodes array<long>" if how == "all" else "a long, b long, far long")


def undirected(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, few: bool = False) -> DataFrame:
    """The pairs whose sets, sorted hashes in bytes, have 100 * intersection >= percent * union.

    A node's set goes once to each FAN of its pairs, ahead of the others' sets. A bounded number of pairs is sent to the sets, else both are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, raw in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("tokens")):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    hub, own = a, x.copy()
                    continue
                if a != hub:
                    raise ValueError("a pair came without its first set")
                both = len(np.intersect1d(own, x, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(x) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    near, sent = (lambda df: df.coalesce(1), F.broadcast) if few else (lambda df: df, lambda df: df)
    pairs = near(pairs)
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("fans"))
    dealt = pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b"), "fans").alias("fan"))
    own = sets.withColumnRenamed("node", "a").join(sent(fans.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fans") - 1)).alias("fan"))), "a")
    rows = sets.withColumnRenamed("node", "b").join(sent(dealt), "b").select("a", "fan", "b", "tokens").union(own.select("a", "fan", F.lit(None).cast("long"), "tokens"))
    return rows.repartition("a", "fan").sortWithinPartitions("a", "fan", F.col("b").asc_nulls_first()).select("a", "b", "tokens").mapInArrow(tidy(run), "a long, b long")


def linked_within(rows: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(a, b): of rows (node, comp, n, sketch, part), the links between components of one part that are needed to join what links join there.

    A part's sets are dealt to blocks of about `block` bytes, and each two blocks meet in one group; a group gives fewer links than it has nodes.
    """

    def found(node: np.ndarray, comp: np.ndarray, n: np.ndarray, sketches: list[bytes], raw: list[bytes], side: np.ndarray) -> Iterator[tuple[int, int]]:
        width = min(map(len, sketches))
        s = np.stack([unsketched(x, width) for x in sketches])
        token = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)[1].astype(np.int32)
        ends = np.cumsum([len(x) // 8 for x in raw])
        own = np.zeros(int(token.max()) + 1, np.int64)
        names, at, size = np.unique(comp, return_inverse=True, return_counts=True)
        top = np.argmax(size)
        rest, first = np.flatnonzero(at != top), np.arange(len(names))
        for k in rest:
            apart = (first[at] != first[at[k]]) & ((at == top) | (np.arange(len(node)) > k))
            if side.any():
                apart &= side != side[k]
            c = np.flatnonzero(apart)
            c = c[fits(n[k], n[c], np.bitwise_count(s[k] ^ s[c]).sum(axis=-1, dtype=np.int64), percent)]
            if not len(c):
                continue
            mine = token[ends[k] - n[k] : ends[k]]
            own[mine] = 1
            for some in np.split(c, np.flatnonzero(np.diff(np.cumsum(n[c]) >> 20)) + 1):  # about a million shingles together
                both = np.add.reduceat(own[np.concatenate([token[ends[j] - n[j] : ends[j]] for j in some])], np.cumsum(n[some]) - n[some])
                for j in some[100 * both >= percent * (n[k] + n[some] - both)]:
                    if first[at[j]] != first[at[k]]:
                        connect(first, np.isin(np.arange(len(first)), (at[j], at[k])))
                        yield node[k], node[j]
            own[mine] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            t = t.take(np.unique(t.column("node").to_numpy(), return_index=True)[1])  # copies in several tasks gave their set several times
            node, comp, n, block, i, j = (t.column(c).to_numpy() for c in ("node", "comp", "n", "block", "i", "j"))
            side = (block == j) & (i != j)
            pairs = list(found(node, comp, n, t.column("sketch").to_pylist(), t.column("tokens").to_pylist(), side)) if comp.min() != comp.max() else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "i", "j"))))
            cuts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            for at, end in zip(cuts, [*cuts[1:], len(keys)]):
                if held and keys[at] != last:
                    yield of(held)
                    held = []
                held.append(batch.slice(at, end - at))
                last = keys[at]
        if held:
            yield of(held)

    blocks = rows.groupBy("part").agg(F.ceil(F.sum("n") * 8 / block).alias("blocks"))
    each = rows.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = each.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "n", "sketch").join(sets, "node")
    return met.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(tidy(run), "a long, b long")


def alone(links: DataFrame) -> DataFrame:
    """components() of at most ALONE links, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        a, b = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = at[: len(a)], at[len(a) :]
        comp = np.arange(len(names))
        while len(names):
            low, new = np.minimum(comp[i], comp[j]), comp.copy()
            np.minimum.at(new, comp[i], low)
            np.minimum.at(new, comp[j], low)
            while (new[new] != new).any():
                new = new[new]
            if (new == comp).all():
                break
            comp = new
        yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(names[comp].astype(np.int64))], ["node", "comp"])

    return links.select("a", "b").coalesce(1).mapInArrow(tidy(run), "node long, comp long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): each linked node with the smallest node it reaches.

    Every node takes the smallest label around it, then its label's label, until
    nothing changes; each round is written and read again.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        lower = labels.join(around, "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = staged(lower.join(jump, "comp", "left").select("node", "was", F.coalesce("further", "comp").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if not new.filter("was <> comp").head(1):
            return labels


def joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, comp) after further links between nodes."""
    if comps is None:
        return components(links)
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    met = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", *[F.coalesce(f"comp_{c}", c).alias(f"comp_{c}") for c in "ab"])
    tops = components(met.filter("comp_a <> comp_b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    every = comps.union(met.select("a", "comp_a")).union(met.select("b", "comp_b")).distinct()
    return staged(every.join(tops, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")


def set_table(docs: DataFrame, wanted: DataFrame, ngram: int = NGRAM, clashes: list[int] | None = None) -> DataFrame:
    """node, tokens of the wanted (doc_id, node), copies in several tasks several times. Nodes that no row with an id has are looked for in the rows without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(ngram), set()
        for batch in slices(batches, "text", CHUNK):
            tokens, sizes = shingler.sets(batch.column("text"))
            node = renamed(*names_of(tokens, sizes), clashes or [])
            raw, ends = tokens.tobytes(), (8 * np.cumsum(sizes)).tolist()
            same = (sizes > 0) & (node == batch.column("node").to_numpy() if "node" in batch.schema.names else True)  # an id may name other texts too
            for i in np.flatnonzero(same):  # copies in one task give their set once
                same[i] = node[i] not in seen
                seen.add(node[i])
            if len(seen) > SEEN:
                seen.clear()
            tokens = [raw[ends[i] - 8 * sizes[i] : ends[i]] for i in np.flatnonzero(same)]
            yield pa.RecordBatch.from_arrays([pa.array(node[same]), pa.array(tokens, pa.binary())], ["node", "tokens"])

    schema = "node long, tokens binary"
    named, rest = wanted.filter("doc_id is not null"), wanted.filter("doc_id is null").select("node")
    found = docs.select(F.col("doc_id").cast("long"), "text").join(small_side(named), "doc_id").select("node", "text").mapInArrow(tidy(run), schema)
    if rest.head(1):
        found = found.union(docs.filter("doc_id is null").select("text").mapInArrow(tidy(run), schema).join(rest, "node", "left_semi"))
    return found


def mixed(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Of the bucket rows (key, a) those of buckets whose nodes are not all of one component, with comp."""
    at = rows.withColumn("comp", F.col("a")) if comps is None else rows.join(small_side(comps).withColumnRenamed("node", "a"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    keys = staged(at.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("key"), "mixed")
    return at.join(small_side(keys), "key", "left_semi")


def trials(tried: list[DataFrame], comps: DataFrame | None) -> DataFrame | None:
    """node, past: the nodes of other components that a node was compared with."""
    if not tried:
        return None
    pairs = reduce(DataFrame.union, tried)
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    if comps is not None:
        of = lambda c, comp: small_side(comps).select(F.col("node").alias(c), F.col("comp").alias(comp))
        both = both.join(of("node", "x"), "node", "left").join(of("other", "y"), "other", "left").filter("coalesce(x, node) <> coalesce(y, other)")
    return both.groupBy("node").agg(F.collect_list("other").alias("past"))


def grouped(docs: DataFrame, ngram: int, percent: int, mark: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows' features, and (node, comp, doc_id) of the nodes: the component, and the smallest id of the node's rows."""
    feats = staged(features(docs, ngram, percent, mark), "features")
    double = feats.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low <> high")
    clashes = [r["node"] for r in double.select("node").limit(CLASHES + 1).collect()]
    if len(clashes) > CLASHES:
        raise ValueError("too many sets share a name of 64 bits")
    if clashes:
        feats = staged(features(docs, ngram, percent, mark, clashes), "features")
    named = feats.filter("node is not null")
    every = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    found = staged(buckets(docs, ngram, percent, clashes), "buckets")
    met = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    firsts = [F.first(c).alias(c) for c in ("n", "spares", "sketch")]
    nodes = staged(named.join(met, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), *firsts), "nodes")
    rows = staged(spared(found.filter("key is not null").select("key", "a"), nodes), "rows")
    comps, tried, links, n_links = None, [], [], 0
    left = NEAREST
    how = "hubs"
    while how:
        if how == "hubs":
            hubs = found.filter("key is not null and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
            first = hubs.groupBy("a").agg(F.max_by("b", F.struct("times", "b")).alias("b"))
            near = likely(undirected(found.filter("key is null").select("a", "b").union(first)), nodes, percent)
        else:
            rows = staged(mixed(rows.select("key", "a"), comps), "rows")  # a bucket of one component stays so
            past = trials(tried, comps)
            known = nodes.select("node", "n", "sketch")
            known = known.withColumn("past", F.lit(None).cast("array<long>")) if past is None else known.join(small_side(staged(past, "past")), "node", "left")
            near = neighbours(rows.withColumnRenamed("a", "node").join(known, "node"), how, percent)
            if how == "all":
                parts = staged(near.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).filter("a <> b").distinct(), "parts")
                if n_parts := parts.count():
                    part = staged(alone(parts) if n_parts <= ALONE else components(parts), "part").withColumnRenamed("comp", "part")
                    apart = nodes.select("node", "n", "sketch", "doc_id").join(small_side(part), "node")
                    apart = apart.withColumn("comp", F.col("node")) if comps is None else apart.join(small_side(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
                    apart = staged(apart, "apart")
                    sets = set_table(docs, apart.select("doc_id", "node"), ngram, clashes)
                    fresh = staged(linked_within(apart.drop("doc_id"), sets, percent), "verified")
                    if found_now := fresh.count():
                        links.append(fresh)
                        n_links += found_now
                        comps = staged(alone(reduce(DataFrame.union, links)), "labels") if n_links <= ALONE else joined(comps, fresh)
                break
            near = undirected(near.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best")).select("a", "best.b"))  # over all of a node's buckets
        pairs = staged(near.select("a", "b"), "pairs")
        merged, n_pairs = False, pairs.count()
        if n_pairs:
            tried.append(pairs)
            few = n_pairs <= ALONE
            ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            wanted = staged(nodes.join(F.broadcast(ends.coalesce(1)) if few else ends, "node", "left_semi").select("doc_id", "node"), "wanted")
            fresh = staged(verified(pairs, staged(set_table(docs, wanted, ngram, clashes), "sets"), percent, few), "verified")
            if found_now := fresh.count():
                links.append(fresh)
                n_links += found_now
                comps = staged(alone(reduce(DataFrame.union, links)), "labels") if n_links <= ALONE else joined(comps, fresh)
                merged = 4 * found_now >= n_pairs
        if how == "nearest":
            left -= 1
        how = None if how == "nearest" and not n_pairs else "nearest" if how == "hubs" or merged and left else "all"
    if comps is None:
        return feats, every.select("node", F.col("node").alias("comp"), "doc_id")
    return feats, every.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "doc_id")


def join(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, by shingles of ngram words and links of percent or more."""
    feats, part = grouped(docs, ngram, percent)
    low = part.groupBy("comp").agg(F.min("doc_id").alias("low"))
    smallest = part.join(low, "comp").select("node", "low")
    named = feats.filter("node is not null").join(smallest, "node").select("doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"))
    return named.union(feats.filter("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), NGRAM, PERCENT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies by the stage's rule stays: the one with the smallest id, then set and content. Ids may be null or repeated.

    Rows are told apart by a hash of all columns; of whole rows that are repeated one stays.
    """
    mark = F.xxhash64(*docs.columns)
    feats, part = grouped(docs, STAGE_NGRAM, STAGE_PERCENT, mark)
    named = feats.filter("node is not null").groupBy("node", "mark").agg(F.min("doc_id").alias("doc_id")).join(part.select("node", "comp"), "node")
    rows = staged(named.select("comp", "mark", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "mark").alias("rank")), "ranked")
    first = rows.groupBy("comp").agg(F.min("rank").alias("first"))
    gone = rows.join(first, "comp").filter("mark <> first.mark").select(F.col("mark").alias("_mark"))
    kept = docs.withColumn("_mark", mark).join(small_side(gone), "_mark", "left_anti")
    if feats.groupBy("mark").count().filter("count > 1").head(1):
        kept = kept.dropDuplicates(["_mark"])
    return kept.select(*docs.columns)


OP9_SQL = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS g FROM w
), e AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
n AS MATERIALIZED (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
c AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""
