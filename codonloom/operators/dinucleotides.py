"""Fewer CpG and TpA by synonymous codons: passes from left to right, each in the sequence's own row.

What a codon becomes depends on the base before it (already edited), itself and the base after it (not yet edited): 1,600
cases, listed once. A pass looks its cases up, codon by codon in all rows of a batch at once; a pass that costs too much codon adaptation is undone.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from itertools import product
from math import log

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import BASES, code
from . import batches, generate
from .batches import Texts
from .edits import synonyms, unfit
from .generate import FIRST_LETTER, letter_of
from .usage import STOP, read_places

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODES = ("aggressive", "balanced", "cai_preserving")


def cases(frequencies: dict[str, float], targets: Sequence[str]) -> str:
    """The new codon's letter by base before (four and none), codon and base after (four and none): the first synonym, the most frequent first, with fewer target pairs in and around it."""
    others = synonyms(frequencies)
    pairs = lambda s: sum(s[i : i + 2] in targets for i in range(len(s) - 1))
    found = []
    for before, codon, after in product((*BASES, ""), code(), (*BASES, "")):
        now = pairs(before + codon + after)
        found.append(letter_of(next((c for c in others.get(codon, []) if pairs(before + c + after) < now), codon)))
    return "".join(found)


def one_pass(codes: Texts, table: np.ndarray) -> Texts:
    """The codons' places after one pass."""
    order = np.argsort(-codes.lengths, kind="stable")
    longest, own = codes.lengths[order], codes.letters
    following = np.append(own[1:] // 16, 4)[: len(own)]
    following[(codes.starts + codes.lengths - 1)[codes.lengths > 0]] = 4
    out, before = np.zeros(len(own), np.int64), np.full(len(order), 4)
    for k in range(int(longest[0]) if len(longest) else 0):
        rows = order[: np.searchsorted(-longest, -k, "left")]
        at = codes.starts[rows] + k
        out[at] = new = table[before[rows], own[at], following[at]]
        before[rows] = new % 4
    return Texts(out, codes.lengths)


def mean_adaptation(codes: Texts, logs: np.ndarray) -> np.ndarray:
    """The geometric mean of sense codons' weights; 0 where a codon has none."""
    sense = codes.kept(~STOP[codes.letters])
    mean = batches.sums(logs[sense.letters], sense) / np.maximum(sense.lengths, 1)
    return np.where((sense.lengths == 0) | np.isnan(mean), 0.0, np.exp(mean))


def fewer_pairs(
    seqs: DataFrame, frequencies: dict[str, float], weights: dict[str, float], targets: Sequence[str] = ("CG", "TA"), mode: str = "balanced",
    passes: int = 5, cai_floor: float = 0.75, most_drop: float = 0.003,
) -> DataFrame:
    """seq_id, cds, rounds, before, after, reduction_pct, cai_before, cai_after, error of (seq_id, cds).

    Modes: aggressive takes every pass; balanced undoes a pass that ends below cai_floor, cai_preserving one that ends more
    than most_drop below the start; either ends the passes. A pass that changes nothing ends them as well. Stops stay.
    A sequence that is empty, out of frame, has other letters or an inner stop is left as it is, with its error and no figures.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    table = np.array([*cases(frequencies, tuple(targets)).encode()]).reshape(5, 64, 5) - FIRST_LETTER
    logs = np.array([log(w) if (w := weights.get(c)) else np.nan for c in code()] + [np.nan])
    bases, pairs = generate.BASES[FIRST_LETTER : FIRST_LETTER + 64], [t.encode() for t in targets]

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column("cds").to_pylist()
        error = [unfit(s) if s else "empty" for s in texts]
        fit = np.flatnonzero([e is None for e in error])
        codes = read_places([texts[i] for i in fit.tolist()])
        first, rounds, left = mean_adaptation(codes, logs), np.zeros(len(fit), int), np.arange(len(fit))
        floor = {"aggressive": np.zeros(len(fit)), "balanced": np.full(len(fit), float(cai_floor)), "cai_preserving": first - most_drop}[mode]
        for k in range(1, passes + 1):
            if not len(left):
                break
            rounds[left] = k
            now = codes.take(left)
            tried = one_pass(now, table)
            good = batches.counts(tried.letters != now.letters, now) > 0
            if mode != "aggressive":
                good &= mean_adaptation(tried, logs) >= floor[left]
            taken = np.zeros(len(fit), bool)
            taken[left[good]] = True
            codes.letters[np.repeat(taken, codes.lengths)] = tried.letters[np.repeat(good, tried.lengths)]
            left = left[good]
        last, new = mean_adaptation(codes, logs), list(texts)
        for i, s in zip(fit.tolist(), batches.spelt(codes, bases).texts()):
            new[i] = s
        spread = lambda values, other: [by_row.get(i, other) for by_row in [dict(zip(fit.tolist(), values.tolist()))] for i in range(len(texts))]
        before, after = (batches.site_counts(Texts.of(t), pairs) for t in (texts, new))
        return {"_new": new, "rounds": spread(rounds, 0), "before": before, "after": after, "_first": spread(first, None), "_last": spread(last, None), "error": error}

    kinds = {"_new": pa.string(), "rounds": pa.int32(), "before": pa.int32(), "after": pa.int32(), "_first": pa.float64(), "_last": pa.float64(), "error": pa.string()}
    rows = batches.mapped(seqs.select("seq_id", "cds"), "cds", kinds, run, drop=("cds",))
    lost = F.round((F.col("before") - F.col("after")) * F.lit(100.0) / F.greatest(F.col("before"), F.lit(1)), 1)
    return rows.select("seq_id", F.col("_new").alias("cds"), "rounds", "before", "after", F.when(F.col("error").isNull(), lost).alias("reduction_pct"), F.round("_first", 4).alias("cai_before"), F.round("_last", 4).alias("cai_after"), "error")
