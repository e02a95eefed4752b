"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language becomes a suffix automaton. A text is
cut greedily into the longest phrases that the automaton knows; the language
that needs the fewest phrases per letter or gap wins.

Defined results: null texts and texts without a letter are `und` with score 0;
long texts are parsed whole, in segments between which a phrase starts anew;
ties go to the first language by name; if there is no labelled text, every text
is `und`; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_fold, received, sent, slices, staged, table, tidy

#: Bounds of the training sample: characters per language, per document, and in all.
LANG_CHARS, DOC_CHARS, ALL_CHARS = 12_288, 1024, 1 << 20
#: LETTERS: the most frequent letters' moves are in a dense table, those of all others in a sorted list. BLOCK: states followed at once.
SEGMENT, LETTERS, BLOCK = 1024, 46, 1 << 22
STARTS = np.int32(1 << 30)

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rate double"


class Coder:
    """Text as small codes: 0 a gap, 1.. the sample's letters, the last any other letter; runs of gaps are one."""

    def __init__(self, letters: str):
        self.size = len(letters) + 2
        top = max(map(ord, letters), default=0)
        self.low = np.full(max(top + 1, 0x250), self.size - 1, np.uint8 if self.size <= 256 else np.uint32)
        for cp in range(len(self.low)):
            if not chr(cp).isalpha():
                self.low[cp] = 0
        for i, c in enumerate(letters):
            self.low[ord(c)] = i + 1

    def encode(self, text: str) -> np.ndarray:
        cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.low[np.minimum(cps, len(self.low) - 1)]
        far = np.nonzero(cps >= len(self.low))[0]
        if len(far):
            codes[far] = [(self.size - 1) * chr(c).isalpha() for c in cps[far].tolist()]
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0
        return codes[keep]


def automaton(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix automaton's moves: a dense table of the codes below width - 1, whose last column is for codes that no
    state knows, and rows (state, code, to) for the other codes. A move that starts a phrase is marked with STARTS."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    root = np.full(width, STARTS, np.int32)
    rare = []
    for c, s in moves[0].items():
        if c < width - 1:
            root[c] = s | STARTS
    table = np.tile(root, (len(moves), 1))
    for s in range(len(moves)):
        for c, to in moves[s].items():
            if c >= width - 1:
                rare.append((s, c, to if s else to | int(STARTS)))
            elif s:
                table[s, c] = to
    return table, np.array(rare, np.int64).reshape(-1, 3)


class Model:
    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        counts = Counter(c for t in texts.values() for c in t.lower() if c.isalpha())
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        self.coder = Coder("".join(sorted(letters[:LETTERS]) + sorted(letters[LETTERS:])))
        self.width = min(len(letters), LETTERS) + 2
        tables, roots, keys, values, base = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
        of = lambda t: (((t & ~STARTS) + base) * self.width) | (t & STARTS)
        for lang in self.langs:
            t, rare = automaton(self.coder.encode(texts[lang]), self.width)
            tables.append(of(t))
            keys.append((rare[:, 0] + base) * self.width * self.coder.size + rare[:, 1])
            values.append(of(rare[:, 2].astype(np.int32)))
            roots.append(base * self.width)
            base += len(t)
        self.moves = np.concatenate(tables).astype(np.int32).ravel() if tables else np.zeros(0, np.int32)
        self.roots = np.array(roots, np.int32)
        order = np.argsort(keys := np.concatenate(keys))
        self.keys, self.values = keys[order], np.concatenate(values)[order].astype(np.int32)

    def rare(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The moves of states (languages, columns) on the columns' codes, none of which is in the dense table."""
        to = np.tile((self.roots | STARTS)[:, None], (1, len(codes)))
        if len(self.keys):
            for s in (np.broadcast_to(self.roots[:, None], state.shape), state):
                wanted = s.astype(np.int64) * self.coder.size + codes
                at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                to = np.where(self.keys[at] == wanted, self.values[at], to)
        return to

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases per document and language; all segments of all documents step together."""
        parts = [(i, d[at : at + SEGMENT]) for i, d in enumerate(docs) for at in range(0, len(d), SEGMENT)]
        parts.sort(key=lambda x: -len(x[1]))
        out = np.zeros((len(docs), len(self.langs)), np.int64)
        if not parts:
            return out
        for at in range(0, len(parts), step := max(1, BLOCK // max(1, len(self.langs)))):
            self.follow(parts[at : at + step], out)
        return out

    def follow(self, parts: list[tuple[int, np.ndarray]], out: np.ndarray) -> None:
        """Adds the phrases of (document, codes), longest first, to out."""
        lengths = np.array([len(p) for _, p in parts])
        grid = np.zeros((lengths[0], len(parts)), np.int32)
        for j, (_, p) in enumerate(parts):
            grid[: len(p), j] = p
        state = np.tile(self.roots[:, None], (1, len(parts)))
        count = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        odd = (grid >= self.width - 1).any(axis=1)
        for t in range(lengths[0]):
            n, codes = live[t], grid[t, : live[t]]
            to = self.moves[state[:, :n] + (np.minimum(codes, self.width - 1) if odd[t] else codes)]
            if odd[t]:
                at = np.nonzero(codes >= self.width - 1)[0]
                to[:, at] = self.rare(state[:, at], codes[at])
            count[:, :n] += to >> 30
            np.bitwise_and(to, STARTS - 1, out=state[:, :n])
        owner = np.array([i for i, _ in parts])
        for k in range(len(self.langs)):
            out[:, k] += np.bincount(owner, count[k], len(out)).astype(np.int64)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, phrases per code) for each text; the score is the margin to the next language."""
        docs = [self.coder.encode(t) if t else np.zeros(0, np.uint8) for t in texts]
        if not self.langs:
            return [("und", 0.0, 1.0)] * len(texts)
        counts = self.phrases(docs)
        out = []
        for t, codes, row in zip(texts, docs, counts):
            if not codes.any():
                out.append(("und", 0.0, 1.0))
                continue
            order = np.argsort(row, kind="stable")
            best, next_best = int(row[order[0]]), int(row[order[1]]) if len(row) > 1 else len(codes)
            out.append((self.langs[order[0]], 1 - best / next_best if next_best > best else 0.0, best / len(codes)))
        return out


def fit(docs: DataFrame, lang_chars: int = LANG_CHARS, doc_chars: int = DOC_CHARS, all_chars: int = ALL_CHARS) -> Model:
    """A model from a bounded sample of labelled documents outside the held-out fold.

    Languages are counted over all documents; each then gives documents chosen by
    a hash of their ids, the number near 2 * lang_chars / 256, and 32 at least.
    """
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_fold("doc_id", 3) != 1))
    counts = staged(train.groupBy("lang").count(), "languages")
    n = counts.count()
    if not n:
        return Model({})
    lang_chars = max(1, min(lang_chars, all_chars // n))
    wanted = max(32, 2 * lang_chars // 256)
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = (
        train.withColumn("_draw", draw)
        .join(F.broadcast(counts.select("lang", (wanted / F.col("count")).alias("_odds"))), "lang")
        .filter(F.col("_draw") < F.col("_odds"))
        .select("lang", F.substring("text", 1, min(doc_chars, lang_chars)).alias("text"), "_draw")
        .collect()
    )
    texts: dict[str, dict[str, None]] = {}
    for r in sorted(rows, key=lambda r: (r["_draw"], r["text"])):
        texts.setdefault(r["lang"], {})[r["text"]] = None
    return Model({lang: "\n".join(t)[:lang_chars] for lang, t in texts.items()})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document, made where its text is read. The model's size is bounded by fit()."""
    shipped = sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = received(shipped)
        for batch in slices(batches, "text", 6 << 20):
            lang, score, rate = zip(*found.predict(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "rate"],
            )

    return docs.select(F.col("doc_id").cast("long"), (id_fold("doc_id", 3) == 1).alias("held_out"), "text").mapInArrow(tidy(run), SCHEMA)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, most_rate: float = 0.7) -> DataFrame:
    """Keeps documents in a learned language; texts without letters, or nowhere near a learned language, go."""
    shipped = sent(spark, fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(shipped)
        for batch in slices(batches, "text", 6 << 20):
            found = model.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([lang != "und" and rate <= most_rate for lang, _, rate in found]))

    return docs.mapInArrow(tidy(run), docs.schema)
