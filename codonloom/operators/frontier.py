"""The exact frontier of codon adaptation and GC content: the best log weight for every GC total that a protein's coding sequences can have.

Totals are sums over residues, whose order plays no part, so a protein is the counts of its twenty residues. A kind of
residue whose best codons gain less with each further G or C (its steps fall) is taken greedily with all others of that sort:
the frontier of all of them is one walk down their steps. Each other kind is a round: the states (protein, GC total)
meet the ways in which all its residues can spread over its codons' GC classes, and the best state of each total stays.
In frontier() rounds are written, so that a protein of any length is many rows; best_states() does the same within a protein's row. Going back through them rebuilds a best sequence. A protein of n residues has at most 3n + 1 states.
"""

from __future__ import annotations

import sys
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import RESIDUES, code
from ..sources.staging import staged
from . import batches
from .batches import Texts
from .generate import BASES, GC_OF, by_letter, letter, letter_of, spelt

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = "".join(sorted(set(RESIDUES) - {"*"}))
#: Logarithms are whole numbers of 10**-12, so that sums do not depend on their order.
SCALE = 10**12

#: A kind's best codon of each GC count: (g, scaled log weight, codon letter), by g.
Classes = list[tuple[int, int, str]]


def classes(weights: dict[str, float]) -> dict[str, Classes]:
    """By residue. Of equal weights the first codon by letters; a codon without a weight is not chosen."""
    found: dict[str, dict[int, tuple[int, str]]] = {a: {} for a in KINDS}
    for codon, aa in sorted(code().items()):
        if aa != "*" and (w := weights.get(codon) or 0) > 0:
            x, l = letter_of(codon), round(log(w) * SCALE)
            best = found[aa].get(GC_OF[x])
            if best is None or l > best[0]:
                found[aa][GC_OF[x]] = (l, x)
    return {a: [(g, l, x) for g, (l, x) in sorted(c.items())] for a, c in found.items()}


def falling(c: Classes) -> bool:
    """Whether each class has one G or C more than the last, for a gain that never grows."""
    gains = [b[1] - a[1] for a, b in zip(c, c[1:])]
    return all(b[0] - a[0] == 1 for a, b in zip(c, c[1:])) and gains == sorted(gains, reverse=True)


class Kinds:
    """The weights as the frontier needs them."""

    def __init__(self, weights: dict[str, float]):
        self.classes = classes(weights)
        self.known = "".join(a for a in KINDS if self.classes[a])
        self.rounds = [a for a in self.known if not falling(self.classes[a])]
        greedy = [a for a in self.known if a not in self.rounds]
        #: (gain, residue, class stepped to), from the largest gain.
        self.steps = sorted(((b[1] - a[1], r, k) for r in greedy for k, (a, b) in enumerate(zip(self.classes[r], self.classes[r][1:]), 1)), key=lambda s: (-s[0], s[1], s[2]))

    def taken(self, t: Column) -> list[Column]:
        """How often each step is taken if t steps are."""
        out, before = [], F.lit(0)
        for _, a, _ in self.steps:
            out.append(F.greatest(F.lit(0), F.least(t - before, held(a))))
            before = before + held(a)
        return out


def held(a: str) -> Column:
    """How many residues of this kind a protein has."""
    return F.col(f"k_{a}")


def total(terms: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, terms, F.lit(0).cast("long"))


def counted(proteins: DataFrame, kinds: Kinds) -> DataFrame:
    """seq_id, aa, n and one count a residue, of the proteins that have a sequence; one last stop is left out."""
    known = proteins.select("seq_id", F.regexp_replace("aa", r"\*$", "").alias("aa")).filter(F.col("aa").rlike(f"^[{kinds.known}]+$"))
    return known.select("seq_id", "aa", F.length("aa").alias("n"), *[(F.length("aa") - F.length(F.replace("aa", F.lit(a)))).alias(f"k_{a}") for a in kinds.known])


def ways(c: Classes, n: Column) -> Column:
    """array<struct<g, l, a, b>>: how n residues of one kind can spread over its classes; a and b of them are in the second and the third."""
    (g0, l0, _), (g1, l1, _), (g2, l2, _) = (c + [(0, 0, "")] * 2)[:3]
    way = lambda a, b: F.struct(((n - a - b) * g0 + a * g1 + b * g2).cast("long").alias("g"), ((n - a - b) * F.lit(l0) + a * F.lit(l1) + b * F.lit(l2)).cast("long").alias("l"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    zero = F.lit(0)
    if len(c) == 2:
        return F.transform(F.sequence(zero, n), lambda a: way(a, zero))
    if g1 - g0 == g2 - g1 == 1:  # gains grow, so of equal totals the one with the fewest in the middle is best
        return F.transform(F.sequence(zero, 2 * n), lambda t: way(t % 2, F.floor(t / 2)))
    return F.flatten(F.transform(F.sequence(zero, n), lambda b: F.transform(F.sequence(zero, n - b), lambda a: way(a, b))))


def frontier(proteins: DataFrame, kinds: Kinds) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(states, rounds): states seq_id, n, g, l of every reachable total, the best l for each; by kind the rounds' back-pointers.

    A protein with a letter that is no residue, or a residue without a weighted codon, has no states.
    """
    rows = counted(proteins, kinds)
    greedy = [a for a in kinds.known if a not in kinds.rounds]
    base = lambda i: total([held(a) * F.lit(kinds.classes[a][0][i]) for a in greedy])
    gain = lambda t: total([k * F.lit(s[0]) for s, k in zip(kinds.steps, kinds.taken(t))])
    most = total([held(a) for _, a, _ in kinds.steps]).cast("int")
    walk = F.transform(F.sequence(F.lit(0), most), lambda t: F.struct((F.col("_g") + t).alias("g"), (F.col("_l") + gain(t)).alias("l")))
    state = rows.withColumns({"_g": base(0), "_l": base(1)}).select("seq_id", "n", *[f"k_{a}" for a in kinds.rounds], F.inline(walk))
    back = {}
    for i, a in enumerate(kinds.rounds):
        rest = [f"k_{x}" for x in kinds.rounds[i + 1 :]]
        met = state.select("seq_id", "n", *rest, F.col("g").alias("g0"), F.col("l").alias("l0"), F.explode(ways(kinds.classes[a], held(a))).alias("w"))
        # Of equal totals the best; on ties the one of the fewest G and C before.
        best = F.max(F.struct((F.col("l0") + F.col("w.l")).alias("l"), (-F.col("g0")).alias("g0"), F.col("w.a").alias("a"), F.col("w.b").alias("b")))
        best_of = staged(met.groupBy("seq_id", "n", *rest, (F.col("g0") + F.col("w.g")).alias("g")).agg(best.alias("m")).select("seq_id", "n", *rest, "g", "m.l", (-F.col("m.g0")).alias("g0"), "m.a", "m.b"), f"frontier-{a}")
        back[a] = best_of.select("seq_id", "g", "g0", "a", "b")
        state = best_of.select("seq_id", "n", *rest, "g", "l")
    return state.select("seq_id", "n", "g", "l"), back


#: Below every sum of scaled logarithms.
NEVER = -(1 << 62)


def spreads(c: Classes, n: int) -> list[tuple[int, int, int, int]]:
    """ways() of one row as (g, l, a, b): those of the most G and C first, then of the largest a and b, so that the first of equally good ones is the one that frontier() keeps."""
    (g0, l0, _), (g1, l1, _), (g2, l2, _) = (c + [(0, 0, "")] * 2)[:3]
    if len(c) == 2:
        pairs = [(a, 0) for a in range(n + 1)]
    elif g1 - g0 == g2 - g1 == 1:
        pairs = [(t % 2, t // 2) for t in range(2 * n + 1)]
    else:
        pairs = [(a, b) for b in range(n + 1) for a in range(n - b + 1)]
    made = [((n - a - b) * g0 + a * g1 + b * g2, (n - a - b) * l0 + a * l1 + b * l2, a, b) for a, b in pairs if a + b <= n]
    return sorted(made, key=lambda w: (-w[0], -w[2], -w[3]))


def of_row(held: dict[str, int], classes: dict[str, Classes], steps: list[tuple[int, str, int]], kinds: list[str]) -> tuple[int, np.ndarray, list[tuple[list, int, np.ndarray, int]]]:
    """(least total, best l by total from there on, rounds): the frontier of one protein's counts, with the classes, steps and rounds of Kinds. A round keeps its ways, the least total before it and which way each total took."""
    greedy = [a for a in held if a not in kinds]
    low, base = (sum(held[a] * classes[a][0][i] for a in greedy) for i in (0, 1))
    gains = np.repeat(np.array([s[0] for s in steps], np.int64), np.array([held[s[1]] for s in steps], np.int64))
    best, rounds = base + np.concatenate([[0], np.cumsum(gains)]).astype(np.int64), []
    for a in kinds:
        ways = spreads(classes[a], held[a])
        least = ways[-1][0]
        new = np.full(len(best) + ways[0][0] - least, NEVER, np.int64)
        took = np.full(len(new), -1)
        for i, (g, l, _, _) in enumerate(ways):
            part = slice(g - least, g - least + len(best))
            better = (best > NEVER) & (best + l > new[part])
            new[part][better], took[part][better] = (best + l)[better], i
        rounds.append((ways, low, took, low + least))
        best, low = new, low + least
    return low, best, rounds


def best_states(proteins: DataFrame, kinds: Kinds, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """The counted proteins, a row a range: range, feasible, g, l of under_ranges(), rest (the G and C of the greedy walk) and each round's a_ and b_.

    A protein's frontier is a few arrays of at most 3n + 1 numbers, made within its row, so nothing is written or exchanged.
    """
    names = [c for a in kinds.rounds for c in (f"a_{a}", f"b_{a}")]
    known, of, steps, in_rounds = kinds.known, kinds.classes, kinds.steps, kinds.rounds

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        found = []
        held = zip(*[batch.column(f"k_{a}").to_pylist() for a in known]) if known else [()] * batch.num_rows
        for n, counts in zip(batch.column("n").to_pylist(), held):
            low, best, rounds = of_row(dict(zip(known, counts)), of, steps, in_rounds)
            gc = np.arange(low, low + len(best)) * 100.0 / (n * 3)
            each = []
            for name, (least, most) in ranges.items():
                inside = np.where((gc >= least) & (gc <= most), best, NEVER)
                k = int(inside.argmax()) if len(inside) else 0
                state = {"range": name, "feasible": bool(inside[k] > NEVER)}
                if state["feasible"]:
                    g = low + k
                    state |= {"g": g, "l": int(best[k])}
                    for a, (ways, before, took, start) in reversed([*zip(in_rounds, rounds)]):
                        way = ways[took[g - start]]
                        state |= {f"a_{a}": way[2], f"b_{a}": way[3]}
                        g -= way[0]
                    state["rest"] = g
                each.append(state)
            found.append(each)
        return {"states": found}

    state = pa.struct([("range", pa.string()), ("feasible", pa.bool_()), ("g", pa.int64()), ("l", pa.int64()), ("rest", pa.int64()), *[(c, pa.int32()) for c in names]])
    rows = batches.mapped(counted(proteins, kinds), "aa", {"states": pa.list_(state)}, run)
    return rows.select("*", F.inline("states")).drop("states")


def ranges_of(proteins: DataFrame, kinds: Kinds, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """under_ranges() of the proteins' frontiers."""
    return best_states(proteins, kinds, ranges).select("seq_id", "range", "feasible", "g", cai_of(F.col("l"), F.col("n")).alias("cai"))


def best_sequences(proteins: DataFrame, kinds: Kinds, low: float, high: float) -> DataFrame:
    """seq_id, cds: a best sequence within the GC range for each protein that has one. The codons are put in place as written() does, over the letters of a batch at once."""
    chosen = best_states(proteins, kinds, {"": (low, high)}).filter("feasible")
    known, of, steps, in_rounds = kinds.known, kinds.classes, kinds.steps, kinds.rounds
    greedy, bases = [a for a in known if a not in in_rounds], BASES

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        aa, column = Texts.of(batch.column("aa").to_pylist()), lambda c: batch.column(c).to_numpy()
        held = {a: column(f"k_{a}").astype(np.int64) for a in known}
        left = column("rest") - sum(held[a] * of[a][0][0] for a in greedy)
        taken = {}
        for _, a, k in steps:
            taken[a, k] = np.maximum(0, np.minimum(left, held[a]))
            left = left - held[a]
        codes, row = np.zeros(len(aa.letters), np.uint8), aa.rows()
        for a in known:
            own = np.flatnonzero(aa.letters == ord(a))
            at, letters = row[own], [ord(x) for _, _, x in of[a]]
            place = np.arange(len(own)) - np.searchsorted(at, at)  # which of its kind in the row
            third = column(f"b_{a}") if a in in_rounds else taken.get((a, 2), np.zeros(batch.num_rows, np.int64))
            second = third + (column(f"a_{a}") if a in in_rounds else taken.get((a, 1), np.zeros(batch.num_rows, np.int64)) - third)
            made = np.where(place < second[at], letters[min(1, len(letters) - 1)], letters[0])
            codes[own] = np.where((place < third[at]) & (len(letters) > 2), letters[-1], made)
        return {"cds": batches.spelt(Texts(codes, aa.lengths), bases).texts()}

    rows = chosen.select("seq_id", "aa", "rest", *[f"k_{a}" for a in known], *[c for a in in_rounds for c in (f"a_{a}", f"b_{a}")])
    return batches.mapped(rows, "aa", {"cds": pa.string()}, run, drop=tuple(rows.columns[1:]))


def cai_of(l: Column, n: Column) -> Column:
    return F.exp(l / float(SCALE) / n)


def under_ranges(states: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """seq_id, range, feasible, g, cai: the best state within each GC range, in percent; of equal ones the one of the fewest G and C. A range that is not reached is there, infeasible."""
    gc = F.col("g") * F.lit(100.0) / (F.col("n") * 3)
    inside = lambda low, high: F.max(F.when(gc.between(low, high), F.struct("l", (-F.col("g")).alias("g"), "n")))
    each = states.groupBy("seq_id").agg(*[inside(*r).alias(name) for name, r in ranges.items()])
    rows = each.select("seq_id", F.inline(F.array(*[F.struct(F.lit(name).alias("range"), F.col(f"`{name}`").alias("b")) for name in ranges])))
    return rows.select("seq_id", "range", F.col("b").isNotNull().alias("feasible"), (-F.col("b.g")).alias("g"), cai_of(F.col("b.l"), F.col("b.n")).alias("cai"))


def rebuilt(chosen: DataFrame, back: dict[str, DataFrame], proteins: DataFrame, kinds: Kinds) -> DataFrame:
    """seq_id, cds of the chosen states (seq_id, g), one a protein: the rounds are gone back, what is left is walked greedily, and each kind's classes go to its residues in order.

    Which of a kind's residues takes which codon changes neither CAI nor GC.
    """
    at = chosen.select("seq_id", "g")
    for a in reversed(kinds.rounds):
        at = at.join(back[a], ["seq_id", "g"]).drop("g").withColumnsRenamed({"g0": "g", "a": f"a_{a}", "b": f"b_{a}"})
    return written(at.join(counted(proteins, kinds), "seq_id"), kinds)


def written(rows: DataFrame, kinds: Kinds) -> DataFrame:
    """seq_id, cds of counted proteins with what the greedy walk is left with (g) and each round's spread (a_, b_)."""
    greedy = [a for a in kinds.known if a not in kinds.rounds]
    t = (F.col("g") - total([held(a) * F.lit(kinds.classes[a][0][0]) for a in greedy])).cast("int")
    taken = dict(zip(((a, k) for _, a, k in kinds.steps), kinds.taken(F.col("_t"))))

    def cuts(a: str) -> Column:
        """The places where a kind's third and second classes end among the residues, and the classes' letters."""
        letters = [x for _, _, x in kinds.classes[a]]
        third = F.col(f"b_{a}") if a in kinds.rounds else taken.get((a, 2), F.lit(0))
        second = F.col(f"a_{a}") if a in kinds.rounds else taken.get((a, 1), F.lit(0)) - third
        upto = lambda k: F.when(k > 0, F.length(F.call_function("substring_index", F.col("aa"), F.lit(a), k.cast("int"))) + 1).otherwise(F.lit(0))
        return F.struct(upto(third).alias("third"), upto(third + second).alias("second"), F.lit("".join(reversed((letters * 3)[:3] if len(letters) == 1 else letters))).alias("x"))

    table = by_letter({a: cuts(a) for a in kinds.known}, F.lit(None).cast("struct<third:int,second:int,x:string>"))
    rows = rows.withColumn("_t", t).withColumn("_cuts", F.explode(F.array(table)))
    # The letters stand from the last class to the first.
    pick = lambda c, i: F.substring(c["x"], F.when((F.length(c["x"]) > 2) & (i < c["third"]), 1).when(i < c["second"], F.length(c["x"]) - 1).otherwise(F.length(c["x"])), F.lit(1))
    codes = F.array_join(F.transform(F.split("aa", ""), lambda x, i: pick(F.get("_cuts", letter(x)), i)), "")
    return rows.withColumn("codes", codes).select("seq_id", spelt(F.col("codes")).alias("cds"))
