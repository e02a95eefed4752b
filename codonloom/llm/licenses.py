"""License scan: exact phrases, and short notices with a few edits.

A notice of at most k edits keeps one of its k+1 pieces intact, so the pieces
are searched exactly; only around their hits does the regex library match the
whole notice with bounded errors and report its span and its edits.

Defined results: null or empty texts have no words, places or labels and score
0; texts are read whole, whatever their length; repeated rows give repeated
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, tidy

#: The base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of this operator's own, as words, with their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "apache license version 2 0 january 2004": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-notice",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "gnu general public license": "gnu-gpl",
    "under the terms of the gnu general public license": "gnu-gpl",
    "gnu lesser general public license": "gnu-lgpl",
    "redistribution and use in source and binary forms": "bsd-notice",
    "bsd 3 clause license": "bsd-notice",
    "mozilla public license version 2 0": "mpl-2.0",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
ERRORS = 2

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "n_spans long, spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
)
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64()), ("spans", pa.list_(_SPAN))]
)


def _word_table() -> bytes:
    """Per byte: A-Z lowered; other ASCII outside 0-9 and a-z a space; bytes of longer characters as they are."""
    keep = lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122
    return bytes(b + 32 if 65 <= b <= 90 else b if keep(b) else 32 for b in range(256))


def seeds_of(phrase: str, errors: int) -> list[tuple[str, int]]:
    """The phrase in errors+1 near-equal pieces, each with its place."""
    n, cuts = len(phrase), errors + 1
    edges = [n * i // cuts for i in range(cuts + 1)]
    return [(phrase[a:b], a) for a, b in zip(edges, edges[1:])]


class Spaces:
    """How many spaces stand before a place; they are listed at the first question."""

    def __init__(self, text: str):
        self.text, self.at = text, None

    def before(self, place: int) -> int:
        if self.at is None:
            self.at = np.flatnonzero(np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        return int(np.searchsorted(self.at, place))


class Scanner:
    """The search over one text; `phrases` are exact, `notices` may have up to `errors` edits."""

    def __init__(self, phrases: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, errors: int = ERRORS):
        self.table = _word_table()
        self.phrases = [(f" {p} ", label) for p, label in phrases.items()]
        self.errors = errors
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (phrase, label) in enumerate(notices.items()):
            rule = regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(phrase, literal_spaces=True)}){{e<={errors}}}(?![^ ])")
            self.notices.append((phrase, label, rule))
            for seed, at in seeds_of(phrase, errors):
                seeds.setdefault(seed, []).append((i, at))
        self.seeds = seeds

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").translate(self.table).split()

    def exact(self, norm: str, spaces: "Spaces") -> list[tuple[int, str]]:
        found = []
        for phrase, label in self.phrases:
            at = norm.find(phrase)
            while at >= 0:
                found.append((spaces.before(at), label))
                at = norm.find(phrase, at + 1)
        return found

    def fuzzy(self, norm: str, spaces: "Spaces") -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, edits, similarity), one per notice and place, in order."""
        starts: dict[int, set[int]] = {}
        for seed, uses in self.seeds.items():
            at = norm.find(seed)
            while at >= 0:
                for i, offset in uses:
                    starts.setdefault(i, set()).add(at - offset)
                at = norm.find(seed, at + 1)
        found = {}
        for i, places in starts.items():
            phrase, label, rule = self.notices[i]
            done = -1
            for start in sorted(places):
                if start + self.errors <= done:
                    continue  # inside the last match
                lo = max(0, start - self.errors - 1)
                m = rule.search(norm, lo, min(len(norm), start + len(phrase) + 2 * self.errors + 2))
                if m and m.end() > m.start():
                    a = m.start() + (len(m[0]) - len(m[0].lstrip(" ")))
                    first = spaces.before(a + 1) - 1 if norm[a] != " " else spaces.before(a)
                    last = first + m[0].strip(" ").count(" ")
                    edits = sum(m.fuzzy_counts)
                    found.setdefault((label, first, last), (edits, 1 - edits / len(phrase)))
                    done = m.end()
        return sorted((label, a, b, e, s) for (label, a, b), (e, s) in found.items())

    def scan(self, text: str | None) -> dict:
        words = self.words(text)
        norm = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass") if words else ""
        spaces = Spaces(norm)
        base = self.exact(norm, spaces)
        spans = self.fuzzy(norm, spaces)
        base_labels = {label for _, label in base}
        return {
            "n_words": len(words),
            "n_base": len(base),
            "first_word": min((w for w, _ in base), default=None),
            "last_word": max((w for w, _ in base), default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(base_labels | {s[0] for s in spans})),
            "score": max([1.0 if base else 0.0, *(s[4] for s in spans)]),
            "n_spans": len(spans),
            "spans": [{"label": s[0], "first_word": s[1], "last_word": s[2], "edits": s[3]} for s in spans],
        }


def scan(docs: DataFrame, phrases: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, errors: int = ERRORS) -> DataFrame:
    """One row per document, made where its text is read: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, errors)
        for batch in slices(batches, "text"):
            rows = [{"doc_id": i, **scanner.scan(t)} for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
