"""Toxicity by two class-conditional Kneser-Ney bigram models.

Each class has its own discounted counts of words (runs of letters, lower case)
after the word before. What the discount frees there goes to a backoff whose counts
both classes share: discounted counts of the pair in both, and below them those of
the single word, down to the number of different words that it follows, estimated
from bitmaps that each take an eighth of what the one before takes, so that none is too full. A class rescales the shared probability of a pair
by what its own discounted counts of the single word say beside the shared ones.
At each level the evidence of what was seen n times is interpolated with that of
the level below in the logarithm, by n^2 / (n^2 + shrink^2), so rare expressions say
little, but none says nothing. Words, the words they follow and pairs are counted
over all labelled rows that learn. Words are a table in the shared folder, keyed by
64-bit hashes, in which tasks look words up, shard by shard where they are
many. Stems, a word's first letters, are a second table of the same make: they speak for
words that were never seen. So are the pairs of at most HELD_PAIRS counted words. More pairs are
dealt by the word before into groups, and so are the different pairs of each slice of texts;
they meet there, and the answers meet the slice again. The difference of the two log-likelihoods, normalised by length over the whole
text and over its best short windows, is calibrated by a logistic fit on all labelled
rows that gave no counts (fold 3), whose sums are made in tasks.

Defined results: null and empty texts, and texts without words, get the score of
an evidence of zero; long texts are scored whole; a document labelled more than
once counts as toxic if any of its labels says so; labels without a document and
null labels are left out; without labels of both kinds every score is the share
of toxic labels (0 if there are none); repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped_shuffles, fresh_path, id_fold, received, sent, slices, small_side, staged, table, tidy
from .warc import opened

WORDS = re.compile(r"[^\W\d_]+")
DISCOUNT = 0.75
#: Occurrences at which a word and a pair have half of their evidence; window lengths in words.
SHRINK, PAIR_SHRINK, WINDOWS = 4, 16, (4, 24)
#: Bitmaps of the words before a word: each takes an eighth of what the one before it takes, so they tell up to a hundred million apart. Bits of a bitmap that is full enough to be passed over.
LEVELS, FULL = 8, 58
#: Counted words up to which tasks hold all pairs; beyond, pairs are looked up by shuffles.
HELD_PAIRS = 2_000_000
#: Words in a shard of the model, words a task holds (of a larger model it reads the shards in turn for each batch).
SHARD_WORDS, HELD_WORDS = 1 << 20, 1 << 22
MEMO = 200_000
#: Bytes of text that a task counts together, and whose different pairs it looks up together.
COUNTED_BYTES, ASKED_BYTES = 2 << 20, 4 << 20
#: Groups of pairs, at least, and counted words in a group, at most.
GROUPS, GROUP_WORDS = 256, 1 << 22
#: Rounds in which documents look up pairs by shuffles: each needs its share of the disk.
ROUNDS = 4
THRESHOLD = 0.3
#: Letters of a stem.
STEM = 5
KINDS = ("toxic", "plain", "both")
LOGS = ("log_toxic", "log_plain", "log_shared")
LANES = [f"before{i}" for i in range(LEVELS)]


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode(), 42) - (1 << 63)
        return h


def hashed(texts: list[str | None], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(words in each text, hash of every word). Of the words themselves, only one text's are held at a time."""
    parts = [np.fromiter(map(known.__getitem__, WORDS.findall((t or "").lower())), np.int64) for t in texts]
    return np.array([len(x) for x in parts], np.int64), np.concatenate(parts) if parts else np.zeros(0, np.int64)


def numbered(texts: list[str | None], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words in each text, hash of every word of all texts, hash of the word before it: 0 at a text's start)."""
    sizes, word = hashed(texts, hashes)
    before = np.concatenate([[0], word[:-1]]).astype(np.int64)[: len(word)]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return sizes, word, before


def bits_of(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, bit as a number) of the words before: seven of eight go to the first bitmap, seven of eight of the rest to the second, and so on."""
    h = before.view(np.uint64)
    ones = np.bitwise_count(h ^ (h - np.uint64(1))).astype(np.int64) - 1  # zeros at the end
    return np.minimum(ones // 3, LEVELS - 1), (np.uint64(1) << (h >> np.uint64(58))).view(np.int64)


def followed() -> Column:
    """How many different words stand before a word, by the first bitmap that is not too full and those after it."""
    linear = [-64 * F.ln(1 - F.least(F.bit_count(c), F.lit(63.5)) / 64) for c in LANES]
    found = F.lit(8.0 ** (LEVELS - 1)) * linear[-1]
    for k in range(LEVELS - 2, -1, -1):
        found = F.when(F.bit_count(LANES[k]) <= FULL, 8.0**k * sum(linear[k + 1 :], linear[k])).otherwise(found)
    return found


class Stems(Hashes):
    """Hashes of words' stems by word: the first STEM letters, a shorter word whole."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest((word[:STEM] + "-").encode(), 42) - (1 << 63)
        return h


def stems(texts: list[str | None], known: Stems) -> np.ndarray:
    """Hash of every word's stem."""
    return hashed(texts, known)[1]


def paired(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit hash for a word and the one before it."""
    x = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) + word.view(np.uint64)).view(np.int64)


def word_counts(labelled: DataFrame, of_stems: bool = False) -> DataFrame:
    """(word, toxic, plain, bitmaps of the words before) of labelled(text, toxic), summed within slices of a task first; of stems in place of words, if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = Hashes(), Stems()
        for batch in slices(batches, "text", COUNTED_BYTES):
            sizes, word, before = numbered(batch.column("text").to_pylist(), hashes)
            if not len(word):
                continue
            if of_stems:
                word = stems(batch.column("text").to_pylist(), known)
            order = np.argsort(word)
            toxic = np.repeat(np.array(batch.column("toxic").to_pylist(), np.int64), sizes)[order]
            word, (level, one) = word[order], bits_of(before[order])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            n, bad = np.diff(np.r_[starts, len(word)]), np.add.reduceat(toxic, starts)
            seen = [np.bitwise_or.reduceat(np.where(level == i, one, 0), starts) for i in range(LEVELS)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (word[starts], bad, n - bad, *seen)], ["word", "toxic", "plain", *LANES])

    schema = "word long, toxic long, plain long, " + ", ".join(f"{c} long" for c in LANES)
    partial = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(tidy(run), schema)
    return partial.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"), *[F.bit_or(c).alias(c) for c in LANES])


def pair_counts(labelled: DataFrame) -> DataFrame:
    """(key, before, word, toxic, plain) of labelled(text, toxic), summed within slices of a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in slices(batches, "text", COUNTED_BYTES):
            sizes, word, before = numbered(batch.column("text").to_pylist(), hashes)
            toxic = np.repeat(np.array(batch.column("toxic").to_pylist(), np.int64), sizes)
            key, first, at = np.unique(paired(before, word), return_index=True, return_inverse=True)
            bad = np.bincount(at, toxic, len(key)).astype(np.int64)
            cols = (key, before[first], word[first], bad, np.bincount(at, minlength=len(key)) - bad)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "before", "word", "toxic", "plain"])

    partial = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(tidy(run), "key long, before long, word long, toxic long, plain long")
    return partial.groupBy("key", "before", "word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


class Local(dict):
    """Numbers of the words of a slice, in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True) if len(x) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


@dataclass
class Evidence:
    """Log-likelihood differences of words and of pairs, known by 64-bit hashes, in sorted files under two paths.

    Without a path of pairs, a word's number is its place in the files, and a pair's is before * (words + 1) + word, where the start of a text is before = words.
    """

    words_path: str
    pairs_path: str | None
    words: int
    stems_path: str | None = None
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=dict)
    hashes: Hashes = field(default_factory=Hashes)
    known: Stems = field(default_factory=Stems)

    def shards(self, at: str, hold: bool, names: tuple[str, ...] = ("key", "gain")) -> Iterator[tuple[np.ndarray, ...]]:
        """(hashes, gains) or other columns of each shard under a path, by name of file; where hold, a task keeps them."""
        kept_as = at if names == ("key", "gain") else f"{at} {names}"
        if kept_as in self.held:
            yield from self.held[kept_as]
            return
        files, path = opened(at)
        kept = []
        for info in sorted(files.get_file_info(pafs.FileSelector(path)), key=lambda i: i.base_name):
            if info.base_name.endswith(".parquet"):
                with files.open_input_file(info.path) as f:
                    t = pq.read_table(f, columns=list(names), use_threads=False)
                shard = tuple(t.column(c).to_numpy() for c in names)
                if hold:
                    kept.append(shard)
                yield shard
        if hold:
            self.held[kept_as] = kept

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of words, by hashes; -1 for unknown words."""
        number, offset = np.full(len(keys), -1), 0
        for known, _ in self.shards(self.words_path, self.words <= HELD_WORDS):
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                own = known[place] == keys
                number[own] = offset + place[own]
            offset += len(known)
        return number

    def by_number(self, number: np.ndarray, *names: str) -> list[np.ndarray]:
        """Columns of the words' table by the numbers of words; 0 where there is none."""
        cols, offset = [np.zeros(len(number)) for _ in names], 0
        for shard in self.shards(self.words_path, self.words <= HELD_WORDS, names):
            own = np.flatnonzero((number >= offset) & (number < offset + len(shard[0])))
            for col, values in zip(cols, shard):
                col[own] = values[number[own] - offset]
            offset += len(shard[0])
        return cols

    def numbered_words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(words in each text, number of every word, number in the last of every word, different words)."""
        local = Local()
        parts = [np.fromiter(map(local.__getitem__, WORDS.findall((t or "").lower())), np.int64) for t in texts]
        at, words = np.concatenate(parts) if parts else np.zeros(0, np.int64), list(local)
        number = self.numbers(np.array([self.hashes[w] for w in words], np.int64))
        return np.array([len(x) for x in parts], np.int64), number[at], at, words

    def pairs_of(self, sizes: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The number of every pair; -1 where one of its words is unknown."""
        before = np.r_[self.words, number[:-1]][: len(number)]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = self.words
        return np.where((before >= 0) & (number >= 0), before * (self.words + 1) + number, -1)

    def dealt(self, pairs: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
        """(group, places) of ascending pairs, in ascending order."""
        group = pairs // (self.words + 1) % groups
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(groups + 1))
        for g in np.flatnonzero(np.diff(starts)).tolist():
            yield g, order[starts[g] : starts[g + 1]]

    def found(self, keys: np.ndarray, at: str, hold: bool, gains: np.ndarray) -> np.ndarray:
        """The gains of keys under a path, else those given."""
        new, back = np.unique(keys, return_inverse=True)
        gain, hit = np.zeros(len(new)), np.zeros(len(new), bool)
        for known, values in self.shards(at, hold):
            if len(known):
                place = np.minimum(np.searchsorted(known, new), len(known) - 1)
                own = known[place] == new
                gain[own], hit[own] = values[place[own]], True
        return np.where(hit[back], gain[back], gains)

    def single(self, word: np.ndarray) -> np.ndarray:
        """Every word's evidence, as the levels below the pairs give it; 0 for unknown words."""
        return self.found(word, self.words_path, self.words <= HELD_WORDS, np.zeros(len(word)))

    def gains(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Every word's evidence after the word before it: that of the pair, or else of the word."""
        return self.found(paired(before, word), self.pairs_path, True, self.single(word))

    def of(self, texts: list[str | None]) -> list[list[float]]:
        """For each text the difference of the length-normalised log-likelihoods of it and of its best windows, by pairs, by words and by stems, and the log of its length.

        The calibration weighs the levels: where word order says nothing, pairs add only noise; stems speak for words never seen.
        """
        sizes, word, before = numbered(texts, self.hashes)
        if not len(sizes):
            return []
        ends, single = np.cumsum(sizes)[:-1], self.single(word)
        levels = [self.found(paired(before, word), self.pairs_path, True, single), single]
        if self.stems_path is not None:
            levels.append(self.found(stems(texts, self.known), self.stems_path, self.words <= HELD_WORDS, np.zeros(len(word))))
        return [self.measures(first) + [x for g in rest for x in self.measures(g)[:-1]] for first, *rest in zip(*(np.split(g, ends) for g in levels))]

    def words_levels(self, number: np.ndarray, at: np.ndarray, words: list[str]) -> list[np.ndarray]:
        """Every word's evidence by words and by stems, as in of(), of numbered_words()."""
        levels = [self.by_number(number, "gain")[0]]
        if self.stems_path is not None:
            of_stems = np.array([self.known[w] for w in words], np.int64)
            levels.append(self.found(of_stems, self.stems_path, self.words <= HELD_WORDS, np.zeros(len(words)))[at])
        return levels

    @staticmethod
    def measures(gain: np.ndarray) -> list[float]:
        if not len(gain):
            return [0.0] * (2 + len(WINDOWS))
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        best = [float((sums[(m := min(k, len(gain))) :] - sums[: len(sums) - m]).max()) / k for k in WINDOWS]
        return [float(sums[-1]) / len(gain), *best, float(np.log1p(len(gain)))]


def singles(counts: DataFrame, discount: float = DISCOUNT, shrink: float = SHRINK) -> tuple[DataFrame, int] | None:
    """(word, log_toxic, log_plain, log_shared, gain) of word_counts, and how many; None without counts of both classes. Only sums come to the driver."""
    totals = counts.select("word", "toxic", "plain", (F.col("toxic") + F.col("plain")).alias("both"), followed().alias("followed"))
    freed = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(discount))).alias(f"freed_{c}")
    n = totals.agg(*[F.sum(c).alias(c) for c in KINDS], *[freed(c) for c in KINDS], F.sum("followed").alias("followed"), F.count(F.lit(1)).alias("words")).first()
    if not n["toxic"] or not n["plain"]:
        return None
    above = lambda c: F.greatest(F.col(c) - discount, F.lit(0.0))
    direct = lambda c: above(c) / float(n[c])
    free = lambda c: F.lit(n[f"freed_{c}"] / n[c])
    shared = direct("both") + free("both") * F.col("followed") / float(n["followed"])
    mixed = lambda c: weight("both", shrink) * F.ln(direct(c) + free(c) * F.col("shared")) + (1 - weight("both", shrink)) * F.ln("shared")
    single = totals.withColumn("shared", shared).select("word", mixed("toxic").alias("log_toxic"), mixed("plain").alias("log_plain"), F.ln("shared").alias("log_shared"))
    return staged(single.withColumn("gain", F.col("log_toxic") - F.col("log_plain")), "word-logs"), n["words"]


def weight(c: str, half: float) -> Column:
    """How far evidence seen so many times is trusted."""
    return 1 / (1 + F.pow(half / F.col(c), 2))


def learn(counts: DataFrame, pairs: DataFrame | None, stem_counts: DataFrame | None = None, discount: float = DISCOUNT, shrink: float = SHRINK, pair_shrink: float = PAIR_SHRINK, shard_words: int = SHARD_WORDS) -> Evidence | None:
    """All words', pairs' and stems' evidence from word_counts and pair_counts, computed and written by Spark; only sums come to the driver. Without pairs, words have numbers and keep their logarithms."""
    found = singles(counts, discount, shrink)
    if found is None:
        return None
    single, words = found

    def written(gains: DataFrame, shards: int, name: str, *more: str) -> str:
        gains.select("key", "gain", *more).repartition(shards).sortWithinPartitions("key").write.parquet(path := fresh_path(counts.sparkSession, name))
        return path

    of_stems = None if stem_counts is None else singles(stem_counts, discount, shrink)
    stems_path = None if of_stems is None else written(of_stems[0].withColumnRenamed("word", "key"), ceil(of_stems[1] / shard_words), "stem-gains")
    if pairs is None:
        return Evidence(written(single.withColumnRenamed("word", "key"), ceil(words / shard_words), "word-gains", *LOGS), None, words, stems_path)
    pairs = pairs.withColumn("both", F.col("toxic") + F.col("plain"))
    once, twice = pairs.agg(F.count_if(F.col("both") == 1), F.count_if(F.col("both") == 2)).first()
    cut = F.lit(once / (once + 2 * twice) if once else discount)  # the usual estimate
    freed_pairs = lambda c: F.sum(F.least(F.col(c).cast("double"), cut)).alias(f"freed_{c}")
    after = pairs.groupBy("before").agg(*[F.sum(c).alias(f"n_{c}") for c in KINDS], *[freed_pairs(c) for c in KINDS])
    smoothed = lambda c, below: (F.greatest(F.col(c) - cut, F.lit(0.0)) + F.col(f"freed_{c}") * below) / F.col(f"n_{c}")
    rescaled = lambda c: F.col("pair_shared") * F.exp(F.col(f"log_{c}") - F.col("log_shared"))
    log_p = lambda c: F.ln(F.when(F.col(f"n_{c}") > 0, smoothed(c, rescaled(c))).otherwise(rescaled(c)))
    seen = pairs.join(after, "before").join(single, "word").withColumn("pair_shared", smoothed("both", F.exp("log_shared")))
    trust = weight("both", pair_shrink)
    gained = seen.select("key", (trust * (log_p("toxic") - log_p("plain")) + (1 - trust) * F.col("gain")).alias("gain"))
    words_path = written(single.withColumnRenamed("word", "key"), ceil(words / shard_words), "word-gains")
    return Evidence(words_path, written(gained, 4, "pair-gains"), words, stems_path)


@dataclass
class Groups:
    """All pairs' counts by groups of the word before, as written by counted_groups: one row a group."""

    counts: DataFrame
    groups: int
    cut: float


def counted_groups(labelled: DataFrame, evidence: Evidence, groups: int, discount: float = DISCOUNT) -> Groups:
    """Counts all pairs of labelled(text, toxic). A slice's different pairs go to their groups together and are summed there; two sums come to the driver."""
    model = sent(labelled.sparkSession, evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = received(model)
        for batch in slices(batches, "text", ASKED_BYTES):
            sizes, number, _, _ = found.numbered_words(batch.column("text").to_pylist())
            toxic = np.repeat(np.array(batch.column("toxic").to_pylist(), np.int64), sizes)
            pairs, bad, n = summed_pairs([(found.pairs_of(sizes, number), toxic, np.ones_like(toxic))])
            rows = [(g, len(at), packed(np.diff(pairs[at], prepend=0)), packed(bad[at]), packed(n[at])) for g, at in found.dealt(pairs, groups)]
            if rows:
                types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["pair_group", "n", "pairs", "toxic", "both"])

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        kept, more, waiting = (np.zeros(0, np.int64),) * 3, [], 0
        for n, *cols in zip(*(rows.column(c).to_pylist() for c in ("n", "pairs", "toxic", "both"))):
            pairs, bad, both = (unpacked(c, n) for c in cols)
            more.append((np.cumsum(pairs), bad, both))
            waiting += n
            if waiting > max(1 << 20, 2 * len(kept[0])):
                kept, more, waiting = summed_pairs([kept, *more]), [], 0
        pairs, bad, both = summed_pairs([kept, *more])
        return pa.table({"pair_group": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(pairs)], pa.int32()), "pairs": [packed(np.diff(pairs, prepend=0))],
                         "toxic": [packed(bad)], "both": [packed(both)], "once": [int((both == 1).sum())], "twice": [int((both == 2).sum())]})

    schema = "pair_group int, n int, pairs binary, toxic binary, both binary"
    partial = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(tidy(run), schema)
    counts = staged(partial.groupBy("pair_group").applyInArrow(merged, schema + ", once long, twice long"), "pair-groups")
    once, twice = counts.agg(F.sum("once"), F.sum("twice")).first()
    return Groups(counts, groups, once / (once + 2 * twice) if once else discount)  # the usual estimate


def summed_pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different known pairs, in order, their toxic counts, all their counts)."""
    pairs, bad, both = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(pairs)
    order = order[np.searchsorted(pairs[order], 0) :]
    pairs = pairs[order]
    starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)])
    return (pairs[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c[:0] for c in (bad, both)))


def pair_gains(evidence: Evidence, pairs: np.ndarray, bad: np.ndarray, both: np.ndarray, cut: float, pair_shrink: float = PAIR_SHRINK) -> np.ndarray:
    """What each pair's evidence adds to that of its word, as in learn(); pairs are ascending, with all that follow a word."""
    before, word = np.divmod(pairs, evidence.words + 1)
    gain, *logs = evidence.by_number(word, "gain", *LOGS)
    log = dict(zip(LOGS, logs))
    starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
    sizes = np.diff(np.r_[starts, len(pairs)])
    counts = {"toxic": bad, "plain": both - bad, "both": both}

    def smoothed(c: str, below: np.ndarray) -> np.ndarray:
        n, freed = (np.repeat(np.add.reduceat(x, starts), sizes) for x in (counts[c], np.minimum(counts[c].astype(float), cut)))
        return np.where(n > 0, (np.maximum(counts[c] - cut, 0.0) + freed * below) / np.maximum(n, 1), below)

    shared = smoothed("both", np.exp(log["log_shared"]))
    log_p = {c: np.log(smoothed(c, shared * np.exp(log[f"log_{c}"] - log["log_shared"]))) for c in KINDS[:2]}
    trust = 1 / (1 + (pair_shrink / both) ** 2)
    return trust * (log_p["toxic"] - log_p["plain"] - gain)


ASKED = "pair_group int, slice long, n int, pairs binary, doc_id array<long>, held_out array<boolean>, mark array<long>, sizes array<long>, words binary, x array<double>"
MEASURED = "doc_id long, held_out boolean, mark long, x array<double>"


def looked_up(docs: DataFrame, evidence: Evidence, groups: Groups) -> DataFrame:
    """MEASURED of docs(doc_id, held_out, mark, text). Slices send their different pairs to the pairs' groups, and themselves as numbers of words; the answers meet them again."""
    model, n_groups, cut = sent(docs.sparkSession, evidence), groups.groups, groups.cut
    schema = pa.schema([("pair_group", pa.int32()), ("slice", pa.int64()), ("n", pa.int32()), ("pairs", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                        ("mark", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("x", pa.list_(pa.float64()))])

    kept: list[Evidence] = []

    def own_model() -> Evidence:
        """Received once a task, with the words' table that it holds."""
        if not kept:
            kept.append(received(model))
        return kept[0]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, first = own_model(), TaskContext.get().partitionId() << 32
        for i, batch in enumerate(slices(batches, "text", ASKED_BYTES)):
            texts = batch.column("text").to_pylist()
            sizes, number, at, words = found.numbered_words(texts)
            pairs = np.unique(found.pairs_of(sizes, number))
            pairs = pairs[np.searchsorted(pairs, 0) :]
            own = {"slice": first + i}
            rows = [own | {"pair_group": g, "n": len(p), "pairs": packed(np.diff(pairs[p], prepend=0))} for g, p in found.dealt(pairs, n_groups)]
            ends, levels = np.cumsum(sizes)[:-1], found.words_levels(number, at, words)
            x = [v for gains in zip(*(np.split(g, ends) for g in levels)) for g in gains for v in found.measures(g)[:-1]]
            columns = {c: batch.column(c).to_pylist() for c in ("doc_id", "held_out", "mark")}
            rows.append(own | columns | {"pair_group": i % n_groups, "sizes": sizes.tolist(), "n": len(number), "words": packed(number), "x": x})
            yield pa.RecordBatch.from_pylist(rows, schema)

    def answered(counts: pa.Table, rows: pa.Table) -> pa.Table:
        known = rows.filter(pc.is_valid(rows.column("words")))
        if not counts.num_rows:
            return known.cast(schema)
        found, one = own_model(), counts.to_pylist()[0]
        pairs, bad, both = (unpacked(one[c], one["n"]) for c in ("pairs", "toxic", "both"))
        pairs = np.cumsum(pairs)
        gains, out = pair_gains(found, pairs, bad, both, cut).astype(np.float32), []
        questions = rows.filter(pc.is_null(rows.column("words"))).select(["pair_group", "slice", "n", "pairs"])
        for g, s, n, data in zip(*(questions.column(c).to_pylist() for c in questions.column_names)):
            want = np.cumsum(unpacked(data, n))
            place = np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)
            out.append({"pair_group": g, "slice": s, "n": n, "pairs": np.where(pairs[place] == want, gains[place], np.float32(0)).tobytes()})
        return pa.concat_tables([known.cast(schema), pa.Table.from_pylist(out, schema)])

    def met(rows: pa.Table) -> pa.Table:
        found = own_model()
        one = rows.filter(pc.is_valid(rows.column("words"))).to_pylist()[0]
        answers = rows.filter(pc.is_null(rows.column("words")))
        answers = dict(zip(answers.column("pair_group").to_pylist(), answers.column("pairs").to_pylist()))
        sizes, number = np.array(one["sizes"], np.int64), unpacked(one["words"], one["n"])
        every = found.pairs_of(sizes, number)
        pairs = np.unique(every)
        pairs = pairs[np.searchsorted(pairs, 0) :]
        gains = np.zeros(len(pairs) + 1)
        for g, at in found.dealt(pairs, n_groups):
            if g in answers:
                gains[at] = np.frombuffer(answers[g], np.float32)
        gain = found.by_number(number, "gain")[0] + gains[np.where(every >= 0, np.searchsorted(pairs, every), len(pairs))]
        rest = np.array(one["x"]).reshape(len(sizes), -1)
        x = [found.measures(g) + more for g, more in zip(np.split(gain, np.cumsum(sizes)[:-1]), rest.tolist())]
        return pa.table({"doc_id": pa.array(one["doc_id"], pa.int64()), "held_out": pa.array(one["held_out"], pa.bool_()), "mark": pa.array(one["mark"], pa.int64()), "x": pa.array(x, pa.list_(pa.float64()))})

    questions = docs.mapInArrow(tidy(asked), ASKED)
    answers = groups.counts.groupBy("pair_group").cogroup(questions.groupBy("pair_group")).applyInArrow(answered, ASKED)
    return answers.groupBy("slice").applyInArrow(met, MEASURED)


def measured(docs: DataFrame, evidence: Evidence, groups: Groups | None = None) -> DataFrame:
    """(doc_id, held_out, mark: a hash of the text, x: what the calibration weighs) of each document, written."""
    rows = docs.select(F.col("doc_id").cast("long"), (id_fold("doc_id", 4) == 2).alias("held_out"), text_mark().alias("mark"), "text")
    if groups is not None:
        with dropped_shuffles(docs.sparkSession):
            rounds = [rows.filter(F.pmod("mark", F.lit(ROUNDS)) == k) for k in range(ROUNDS)]
            return reduce(DataFrame.union, [staged(looked_up(r, evidence, groups), "toxicity-measures") for r in rounds])
    model = sent(docs.sparkSession, evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = received(model)
        for batch in slices(batches, "text", 2 << 20):
            x = pa.array(found.of(batch.column("text").to_pylist()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "mark")), x], ["doc_id", "held_out", "mark", "x"])

    return staged(rows.mapInArrow(tidy(run), MEASURED), "toxicity-measures")


def text_mark() -> Column:
    return F.xxhash64("text", F.length("text"))


Fit = tuple[np.ndarray, np.ndarray, np.ndarray]


def sums(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(x, toxic) over the batches of rows(x, toxic); a row a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = of(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("toxic").to_numpy().astype(float))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    return np.array(rows.select("x", "toxic").mapInArrow(run, "v array<double>").toArrow().column("v").to_pylist()).sum(0)


def logistic(rows: DataFrame, ridge: float = 1e-2, rounds: int = 60) -> Fit | None:
    """(centres, scales, weights with the bias last) of a logistic fit on all rows(x, toxic) by Newton's method; None without rows of both classes."""
    first = sums(rows, lambda x, y: np.r_[len(y), y.sum(), x.sum(0)])
    if not np.ndim(first) or not 0 < first[1] < first[0]:
        return None
    centre = first[2:] / first[0]
    scale = np.sqrt(sums(rows, lambda x, y: ((x - centre) ** 2).sum(0)) / first[0]) + 1e-9
    w = np.zeros(len(centre) + 1)
    for _ in range(rounds):

        def parts(x: np.ndarray, y: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = np.c_[(x - centre) / scale, np.ones(len(x))]
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            return np.r_[z.T @ (y - p), (z.T @ (z * (p * (1 - p))[:, None])).ravel()]

        found = sums(rows, parts)
        step = np.linalg.solve(found[len(w) :].reshape(len(w), -1) + ridge * np.eye(len(w)), found[: len(w)] - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


class Scorer:
    def __init__(self, evidence: Evidence | None, fit: Fit | None, prior: float, groups: Groups | None = None, seen: tuple[DataFrame, DataFrame] | None = None):
        """seen: documents and what was measured of them."""
        self.evidence, self.fit, self.prior, self.groups, self.seen = evidence, fit, prior, groups, seen

    def scored(self, docs: DataFrame) -> DataFrame:
        """(doc_id, held_out, mark, score) of each document."""
        if self.evidence is None or self.fit is None:
            return docs.select(F.col("doc_id").cast("long"), (id_fold("doc_id", 4) == 2).alias("held_out"), text_mark().alias("mark"), F.lit(float(self.prior)).alias("score"))
        rows = self.seen[1] if self.seen is not None and self.seen[0] is docs else measured(docs, self.evidence, self.groups)
        centre, scale, weights = (v.tolist() for v in self.fit)
        logit = sum(((F.col("x")[i] - c) / s * w for i, (c, s, w) in enumerate(zip(centre, scale, weights))), F.lit(weights[-1]))
        return rows.select("doc_id", "held_out", "mark", (1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, calibration_rows: int | None = None, pair_words: int | None = None) -> Scorer:
    """The calibration is on all labelled rows of fold 3, counts of words and pairs come from all other labelled rows; fold 2 is held out.

    A caller may ask for less: calibration on about calibration_rows rows drawn from fold 3 (the others then give counts),
    pairs from rows drawn of those that give counts, about pair_words words a class."""
    with dropped_shuffles(docs.sparkSession):
        return fitted(docs, labels, calibration_rows, pair_words)


def fitted(docs: DataFrame, labels: DataFrame, calibration_rows: int | None, pair_words: int | None) -> Scorer:
    """See fit()."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    fold = id_fold("doc_id", 4)
    texts = docs.select("doc_id", "text")
    held = marks.filter(fold == 3)
    n, toxic = held.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = float(toxic or 0) / n if n else 0.0
    draw = fold == 3
    if calibration_rows is not None and n:
        draw &= F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) <= int(min(1.0, calibration_rows / n) * (1 << 30))
    learning = texts.filter(~draw & (fold != 2)).join(small_side(marks.filter(~draw & (fold != 2))), "doc_id")
    counts = staged(word_counts(learning), "word-counts")
    words = counts.agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")).first()
    if not words["toxic"] or not words["plain"]:
        return Scorer(None, None, prior)
    drawn = learning
    if pair_words is not None:
        share = F.when(F.col("toxic") > 0, min(1.0, pair_words / words["toxic"])).otherwise(min(1.0, pair_words / words["plain"]))
        drawn = learning.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    hold = pair_words is not None or words["toxic"] + words["plain"] <= HELD_PAIRS
    evidence = learn(counts, staged(pair_counts(drawn), "pair-counts") if hold else None, staged(word_counts(learning, of_stems=True), "stem-counts"))
    if evidence is None or not n:
        return Scorer(None, None, prior)
    groups = None if hold else counted_groups(learning, evidence, max(GROUPS, ceil((words["toxic"] + words["plain"]) / GROUP_WORDS)))
    rows = measured(docs, evidence, groups)
    found = logistic(staged(rows.filter(draw).join(small_side(held.filter(draw)), "doc_id").select("x", "toxic"), "calibration"))
    return Scorer(None, None, prior) if found is None else Scorer(evidence, found, prior, groups, (docs, rows))


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document."""
    return scorer.scored(docs).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    """Keeps the documents that op2 does not predict toxic: those that score below the threshold."""
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    if scorer.fit is None:
        return docs.filter(F.lit(scorer.prior < threshold))
    toxic = scorer.scored(docs).filter(F.col("score") >= threshold).select("mark").distinct()
    return docs.withColumn("mark_", text_mark()).join(small_side(toxic.withColumnRenamed("mark", "mark_")), "mark_", "left_anti").select(*docs.columns)
