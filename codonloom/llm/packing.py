"""Packing into fixed-length sequences by cutting-stock column generation.

Each document's tail (its ids beyond whole sequences) falls into a length class.
A linear program over the class histogram finds patterns of classes that fill a
sequence; patterns are priced by knapsack dynamic programming. In each bounded
shard the patterns, in rounded numbers, are given to its documents ranked within
their class; documents left over are cut to fill what room remains.

Defined results: null and empty texts are one id (the end id) long; documents of
any length are cut into whole sequences first; repeated rows are separate
documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, slices, staged, table, tidy

LENGTH, CLASS, END_ID = 2048, 16, 1
SHARD_IDS, MEMO, LEAST_PIECE = 4 << 20, 200_000, 8
#: Bytes of text whose different pieces are looked up together: more cost less time, fewer less memory. The pipeline's workers come from other stages and still hold some.
TOGETHER, STAGE_TOGETHER = 6 << 20, 2 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


class Encoder:
    """Ids of whole texts, equal to the vocabulary file's own encoding.

    Its rules never join characters across a space or a line break, so what stands
    between them is encoded apart. A piece of plain Latin characters is lower-cased
    and cut into words as the file's rules say; other pieces go through the whole
    tokenizer. Pieces and words are remembered, up to a number of each.
    """

    PLAIN = r"\x21-\x7eÀ-ÖØ-öø-ÿ"
    WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        marks = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([rf"[^\n{self.PLAIN}]", *marks]))
        self.model = Tokenizer(self.whole.model)  # the same model on words that stand between spaces
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(1 << 16, bool)
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _wholes(self, pieces: list[str]) -> None:
        for p, e in zip(pieces, self.whole.encode_batch_fast(pieces, add_special_tokens=False)):
            self.known[p] = np.array(e.ids, "<u2").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            ends = (2 * np.nonzero(self.last[ids])[0] + 2).tolist()
            if len(ends) != len(some):
                raise ValueError("each word must end with one last token")
            raw = ids.tobytes()
            self.words.update((w, raw[a:b]) for w, a, b in zip(some, [0, *ends], ends))

    def _learn(self, new: list[str]) -> None:
        joined = "\n".join(new)
        odd = {joined[joined.rfind("\n", 0, m.start()) + 1 : e if (e := joined.find("\n", m.start())) >= 0 else len(joined)] for m in self.odd.finditer(joined)}
        self._wholes(list(odd))
        plain = [p for p in new if p not in odd] if odd else new
        low = "\n".join(plain).lower().split("\n") if plain else []
        parts = [(w,) if w.isalpha() else self.WORDS.findall(w) for w in low]
        if len(self.words) > MEMO:
            self.words = {}
        if unknown := set(chain.from_iterable(parts)) - self.words.keys():
            self._learn_words(list(unknown))
        words = self.words
        self.known.update((p, words[w[0]] if len(w) == 1 else b"".join([words[x] for x in w])) for p, w in zip(plain, parts))

    def pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > MEMO:
            self.known = {}
        known = self.known
        if new := [p for p in pieces if p not in known]:
            self._learn(new)
        return list(map(known.__getitem__, pieces))

    def texts(self, texts: list[pa.Array]) -> Iterator[tuple[pa.Array, pa.Array]]:
        """For each array of texts, their ids with the end id as bytes, and their number. Each different piece of all arrays is looked up once."""
        split = [pc.split_pattern(pc.replace_substring(pc.fill_null(x, ""), "\n", " "), " ") for x in texts]
        coded = pa.chunked_array([x.flatten() for x in split]).combine_chunks().dictionary_encode()
        known = [*self.pieces(coded.dictionary.to_pylist()), np.array([END_ID], "<u2").tobytes()]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 2
        first = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(known), "<u2")
        indices, at = coded.indices.to_numpy(), 0
        for x in split:
            bounds = x.offsets.to_numpy()
            bounds = bounds - bounds[0]
            codes = np.insert(indices[at : at + bounds[-1]], bounds[1:], len(known) - 1)
            at += bounds[-1]
            n = sizes[codes]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = pool[np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[bounds + np.arange(len(bounds))]
            yield pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(2 * cuts), pa.py_buffer(ids)]).cast(pa.binary()), pa.array(np.diff(cuts), pa.int64())


def encode(docs: DataFrame, path: str | None = None, together: int = TOGETHER) -> DataFrame:
    """doc_id, ids (little-endian 16-bit ids, the end id last), n."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        held: list[pa.RecordBatch] = []
        for batch in chain(slices(batches, "text", together * 2 // 3), [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(x.nbytes for x in held) > together):
                for x, found in zip(held, encoder.texts([x.column("text") for x in held])):
                    yield pa.RecordBatch.from_arrays([x.column("doc_id"), *found], ["doc_id", "ids", "n"])
                held, x, found = [], None, None
                give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids binary, n long")


def knapsack(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes 1..len(values) (class b takes b units) that fits into room."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, int)
    for c in range(1, room + 1):
        gains = best[c - 1 :: -1][: len(values)][: c] + values[: min(c, len(values))]
        k = int(np.argmax(gains))
        best[c], last[c] = (gains[k], k + 1) if gains[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    counts, c = np.zeros(len(values), int), room
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[room]), counts


def patterns_for(demand: np.ndarray, room: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns with their fractional numbers: the linear program min sum(x), Ax = demand, by column generation."""
    used = np.nonzero(demand)[0]
    if not len(used):
        return []
    d = demand[used].astype(float)
    columns = np.diag([room // (b + 1) for b in used]).astype(float)
    for _ in range(rounds):
        prices = np.zeros(len(demand))
        prices[used] = np.clip(np.linalg.solve(columns.T, np.ones(len(used))), 0, None)
        worth, pattern = knapsack(prices, room)
        if worth <= 1 + 1e-7:
            break
        enter = np.linalg.solve(columns, pattern[used].astype(float))
        amounts = np.clip(np.linalg.solve(columns, d), 0, None)
        ratios = np.full(len(used), np.inf)
        np.divide(amounts, enter, out=ratios, where=enter > 1e-9)
        leave = int(np.argmin(ratios))
        if not np.isfinite(ratios[leave]):
            break
        columns[:, leave] = pattern[used]
    amounts = np.linalg.solve(columns, d)
    found = []
    for j, x in enumerate(amounts):
        if x > 1e-9:
            pattern = np.zeros(len(demand), int)
            pattern[used] = np.rint(columns[:, j]).astype(int)
            found.append((pattern, float(x)))
    return sorted(found, key=lambda p: (-p[1], tuple(p[0])))


def assign(tails: list[int], patterns: list[tuple[np.ndarray, float]], share: float, length: int = LENGTH, unit: int = CLASS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences of one shard as (length after padding, [(document, start in its tail, ids)]).

    tails: each document's tail length, 0 for none. share: this shard's part of
    the corpus, by which the patterns' numbers are rounded.
    """
    ranked: dict[int, list[int]] = {}
    for doc in sorted((i for i, n in enumerate(tails) if n), key=lambda i: (tails[i], -i)):
        ranked.setdefault(-(-tails[doc] // unit) - 1, []).append(doc)  # the longest of a class is taken first
    sequences: list[list[tuple[int, int, int]]] = []
    due = made = 0.0
    for pattern, x in patterns:
        takes = [(int(b), int(pattern[b])) for b in np.nonzero(pattern)[0]]
        due += x * share  # rounded as a running sum, so small numbers are not all lost
        while made + 1 <= due + 0.5:
            made += 1
            if all(len(ranked.get(b, ())) >= k for b, k in takes):
                sequences.append([(doc, 0, tails[doc]) for b, k in takes for doc in (ranked[b].pop() for _ in range(k))])
    left = iter(sorted((doc for docs in ranked.values() for doc in docs), key=lambda i: (-tails[i], i)))
    doc, start = next(left, None), 0
    remaining = sum(tails) - sum(n for row in sequences for *_, n in row)

    def fill(row: list[tuple[int, int, int]], room: int) -> None:
        nonlocal doc, start, remaining
        while doc is not None and room:
            n = min(room, tails[doc] - start)
            row.append((doc, start, n))
            room, start, remaining = room - n, start + n, remaining - n
            if start == tails[doc]:
                doc, start = next(left, None), 0

    out = []
    for row in sequences:
        room = length - sum(n for *_, n in row)
        if room >= LEAST_PIECE:
            fill(row, room)
        out.append((length, row))
    while doc is not None:  # whole sequences, then powers of two, which need no padding
        size = length if remaining >= length else 1 << (remaining.bit_length() - 1)
        out.append((size, []))
        fill(out[-1][1], size)
    return out


def pack(encoded: DataFrame, length: int = LENGTH, unit: int = CLASS) -> DataFrame:
    """Pieces of the encoded documents. The histogram has length/unit classes, whatever the corpus; shards are packed where they are read."""
    tail = (F.col("n") % length).alias("tail")
    histogram = encoded.select(tail).filter("tail > 0").groupBy(F.ceil(F.col("tail") / unit).alias("c")).count().collect()
    demand = np.zeros(-(-length // unit), int)
    for row in histogram:
        demand[row["c"] - 1] = row["count"]
    patterns, total = patterns_for(demand, length // unit), max(1, int(demand.sum()))

    def shard(ids: list[int | None], docs: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        rows: list[tuple] = []
        seq = first
        for i, x in zip(ids, docs):
            for at in range(0, len(x) - length + 1, length):
                rows.append((i, at, length, zlib.crc32(x[at : at + length].astype("<u4").tobytes()), len(x), seq, 0))
                seq += 1
        tails = [len(x) % length for x in docs]
        for _, row in assign(tails, patterns, sum(1 for t in tails if t) / total, length, unit):
            at = 0
            for d, start, n in row:
                x = docs[d]
                a = len(x) - tails[d] + start
                rows.append((ids[d], a, n, zlib.crc32(x[a : a + n].astype("<u4").tobytes()), len(x), seq, at))
                at += n
            seq += 1
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], schema=_ARROW), seq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 36
        ids: list[int | None] = []
        docs: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids.append(i)
                docs.append(np.frombuffer(x.as_py(), "<u2"))
                held += len(docs[-1])
                if held >= SHARD_IDS:
                    out, seq = shard(ids, docs, seq)
                    yield out
                    ids, docs, held = [], [], 0
        if ids:
            out, seq = shard(ids, docs, seq)
            yield out

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(staged(encode(table(spark, sf_dir, "documents")), "encoded"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(staged(encode(docs, together=STAGE_TOGETHER), "encoded"))
