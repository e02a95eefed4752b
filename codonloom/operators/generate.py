"""Coding sequences for proteins, and their scores. Draws are hashes of (seed, sequence, attempt, place), so partitioning cannot change them.

While a sequence is made and scored it is a text of one letter a codon (`codes`), so that proteins, GC and frequencies
are taken by Spark's own text functions; its bases are spelt out once. Steps for every codon run over Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.codes import ASSEMBLY, RESIDUES, TYPE_IIS, code
from ..functions.scalar import count_of
from . import batches
from .batches import Texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The letter of each codon, in the order of RESIDUES; any other codon is NO_CODON.
FIRST_LETTER, NO_CODON = 48, "~"
LETTERS = "".join(chr(FIRST_LETTER + k) for k in range(64))
GC_OF = {chr(FIRST_LETTER + k): sum(b in "GC" for b in c) for k, c in enumerate(code())}
SIXTEEN = 1 << 16


def _choices() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for c, a in sorted(code().items()):
        found.setdefault(a, []).append(c)
    return found


def letter_of(codon: str) -> str:
    return LETTERS[list(code()).index(codon)]


def letter(a: Column) -> Column:
    """A residue's place, from 0: A..Z, then everything else as a stop."""
    return F.when(a == "*", 26).otherwise(F.ascii(a) - 65)


def by_letter(of: dict[str, Column], otherwise: Column) -> Column:
    """A literal array to be asked by letter()."""
    return F.array(*[of.get(a, otherwise) for a in [*map(chr, range(65, 91)), "*"]])


def spelt(codes: Column) -> Column:
    """The bases of a text of codon letters."""
    words = F.array(*map(F.lit, code()))
    return F.array_join(F.transform(F.split(codes, ""), lambda x: F.get(words, F.ascii(x) - FIRST_LETTER)), "")


def read_codes(cds: Column) -> Column:
    """The codon letters of a sequence of bases: whole codons, NO_CODON for one with another base."""
    place = lambda x, k: F.instr(F.lit("TCAG"), F.substring(x, k, 1))
    each = lambda x: F.when(x.rlike("^[ACGT]{3}$"), F.char(16 * place(x, 1) + 4 * place(x, 2) + place(x, 3) + (FIRST_LETTER - 21))).otherwise(NO_CODON)
    return F.array_join(F.transform(F.regexp_extract_all(cds, F.lit("(?s).{3}"), F.lit(0)), each), "")


def protein_of(codes: Column) -> Column:
    return F.translate(codes, LETTERS + NO_CODON, RESIDUES + "X")


def gc_of(codes: Column) -> Column:
    """G and C in a text of codon letters."""
    counts = F.translate(codes, LETTERS + NO_CODON, "".join(str(GC_OF[x]) for x in LETTERS) + "0")
    held = lambda k: F.length(counts) - F.length(F.replace(counts, F.lit(str(k))))
    return held(1) + 2 * held(2) + 3 * held(3)


def gc_share(codes: Column) -> Column:
    """GC percent, to 2 places; 0 for an empty sequence."""
    return F.coalesce(F.round(gc_of(codes) * F.lit(100.0) / F.nullif(F.length(codes) * 3, F.lit(0)), 2), F.lit(0.0))


def draws(seed: int | str, seq_id: Column, attempt: Column, n: Column) -> Column:
    """n or more whole numbers below 65536: the 16-bit parts of md5 over (seed, sequence, attempt, block), eight a block."""
    block = lambda b: F.md5(F.concat_ws("|", F.lit(str(seed)), seq_id.cast("string"), attempt.cast("string"), b.cast("string")))
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 8).cast("int")), block), "")
    return F.transform(F.regexp_extract_all(hexes, F.lit("[0-9a-f]{4}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


# Tables of codons by residue, made from the 64 weights: one row, to be joined to every protein.


def best_table(weights: DataFrame, order: str = "w") -> DataFrame:
    """residues, best: for every residue the letter of its highest codon, the first by letters on ties; as two texts for translate()."""
    known = weights.filter("w is not null").withColumn("x", code_letter(F.col("codon")))
    best = known.groupBy("aa").agg(F.max(F.struct(F.col(order), F.translate("codon", "ACGT", "TGCA"), "x"))["x"].alias("x"))
    return F.broadcast(best.agg(F.sort_array(F.collect_list(F.struct("aa", "x"))).alias("t")).select(F.array_join("t.aa", "").alias("residues"), F.array_join("t.x", "").alias("best")))


def code_letter(codon: Column) -> Column:
    words = F.array(*map(F.lit, code()))
    return F.char(F.array_position(words, codon).cast("int") + (FIRST_LETTER - 1))


def shares_table(weights: DataFrame, preferred: int = 0) -> DataFrame:
    """One row, `table`: by letter() a residue's codon letters and the upper bounds of their shares of 65536 draws.

    A codon's share follows its frequency in millionths, so it is the same whole number everywhere; the most frequent
    codon also gets `preferred` draws before. Codons go by frequency, then by letters.
    """
    order = F.struct((-F.col("f")).alias("f"), "codon", "x")
    rows = weights.filter("w is not null").select("aa", "codon", code_letter(F.col("codon")).alias("x"), F.greatest(F.round(F.col("frequency") * 1000000), F.lit(1)).cast("long").alias("f"))
    each = rows.groupBy("aa").agg(F.sort_array(F.collect_list(order)).alias("c"))
    upto = lambda k: F.aggregate(F.slice("c", 1, k), F.lit(0).cast("long"), lambda t, c: t - c["f"])
    bound = lambda c, k: (F.lit(preferred) + F.floor((SIXTEEN - preferred) * upto(k + 1) / upto(F.size("c")))).cast("int")
    entry = F.struct(F.array_join("c.x", "").alias("letters"), F.transform("c", bound).alias("bounds"))
    held = lambda a: F.max(F.when(F.col("aa") == a, entry))
    return F.broadcast(each.agg(F.array(*[held(a) for a in [*map(chr, range(65, 91)), "*"]]).alias("table")))


def drawn(aa: Column, numbers: Column, table: Column) -> Column:
    """The codon letters that a protein's draws choose from shares_table()."""
    pick = lambda t, d: F.substring(t["letters"], F.size(F.filter(t["bounds"], lambda b: b <= d)) + 1, F.lit(1))
    return F.array_join(F.zip_with(F.split(aa, ""), F.slice(numbers, 1, F.length(aa)), lambda a, d: pick(F.get(table, letter(a)), d)), "")


def candidates(rows: DataFrame, method: str, codes: Column | str, replicate: Column | None = None) -> DataFrame:
    return rows.select("seq_id", "aa", F.lit(method).alias("method"), (F.lit(0) if replicate is None else replicate).cast("int").alias("replicate"), (F.col(codes) if isinstance(codes, str) else codes).alias("codes"))


# Methods: proteins (seq_id, aa) in, candidates (seq_id, aa, method, replicate, codes) out.


def greedy(proteins: DataFrame, weights: DataFrame, method: str = "greedy_cai", order: str = "w") -> DataFrame:
    """The codon of the highest weight for every residue, the first by letters on ties."""
    return candidates(proteins.join(best_table(weights, order)), method, F.expr("translate(aa, residues, best)"))


def by_byte(of: dict[str, list[int]], width: int = 6) -> np.ndarray:
    """Rows of numbers by residue, filled up with 0; rows of 0 for anything that is no residue."""
    table = np.zeros((256, width), np.int64)
    for a, values in of.items():
        table[ord(a), : len(values)] = values
    return table


def entries(table: list[Row | list[Row] | None]) -> dict[str, Row | list[Row]]:
    """A table asked by letter(), by residue."""
    return {a: e for a, e in zip([*map(chr, range(65, 91)), "*"], table) if e}


def keys_of(batch: pa.RecordBatch) -> list[bytes]:
    return [k.encode() for k in batch.column("_key").to_pylist()]


def seeded(proteins: DataFrame, seed: int | str, *more: str) -> DataFrame:
    """Adds _key, by which a sequence's draws begin."""
    return proteins.withColumn("_key", F.concat_ws("|", F.lit(str(seed)), F.col("seq_id").cast("string"), *[F.col(c).cast("string") for c in more]))


#: G and C of a codon letter.
GC_BYTES = by_byte({x: [g] for x, g in GC_OF.items()}, 1)[:, 0]


def random_synonymous(proteins: DataFrame, replicates: int = 3, seed: int = 320) -> DataFrame:
    """For every residue one of its codons, in their order, by a draw modulo their number."""
    of = {a: [ord(letter_of(c)) for c in cs] for a, cs in _choices().items()}
    letters, n = by_byte(of).astype(np.uint8), by_byte({a: [len(cs)] for a, cs in of.items()}, 1)[:, 0]

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        aa = Texts.of(batch.column("aa").to_pylist())
        return {"codes": batches.modulo(aa, batches.draws(keys_of(batch), aa.lengths), n, letters).texts()}

    rows = seeded(proteins.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))), seed, "replicate")
    made = batches.mapped(rows.select("seq_id", "aa", "replicate", "_key"), "aa", {"codes": pa.string()}, run, drop=("_key",))
    return candidates(made, "random_synonymous", "codes", F.col("replicate"))


def gc_target(proteins: DataFrame, weights: DataFrame, target: float = 43.5, method: str = "gc_target") -> DataFrame:
    """Residue by residue the codon that brings the GC of what is made so far, to 2 places, nearest to the target; on ties the more frequent, then the first by letters.

    A codon adds 0 to 3 to the state, so of each residue's codons the best of each count is enough.
    """
    rows = weights.filter("w is not null").select("aa", code_letter(F.col("codon")).alias("x"), F.struct((-F.col("frequency")).alias("f"), "codon").alias("o"))
    gc = F.translate("x", LETTERS, "".join(str(GC_OF[x]) for x in LETTERS)).cast("int")
    each = rows.withColumn("g", gc).groupBy("aa", "g").agg(F.min(F.struct("o", "x")).alias("m"))
    each = each.groupBy("aa").agg(F.sort_array(F.collect_list(F.struct("m.o", "g", "m.x"))).alias("c"))
    held = lambda a: F.max(F.when(F.col("aa") == a, F.transform("c", lambda c: F.struct(c["g"].alias("g"), c["x"].alias("x")))))
    of = entries(each.agg(F.array(*[held(a) for a in [*map(chr, range(65, 91)), "*"]]).alias("table")).first()["table"])  # four codons a residue at most
    g, letters = by_byte({a: [c["g"] for c in cs] for a, cs in of.items()}), by_byte({a: [ord(c["x"]) for c in cs] for a, cs in of.items()})

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        aa = Texts.of(batch.column("aa").to_pylist())
        return {"codes": whole(batches.to_target(aa, float(target), g, letters), aa, letters)}

    return candidates(batches.mapped(proteins.select("seq_id", "aa"), "aa", {"codes": pa.string()}, run), method, "codes")


def whole(codes: Texts, aa: Texts, letters: np.ndarray) -> list[str | None]:
    """The texts of codon letters; null where a residue has no codon."""
    lacking = batches.counts(letters[aa.letters, 0] == 0, aa) > 0
    return [None if odd else t for t, odd in zip(codes.texts(), lacking.tolist())]


#: What attempts make of rows: (proteins, keys that end with the attempt, whether each is its row's last), as codon letters.
Attempt = Callable[[Texts, list[bytes], np.ndarray], Texts]


def attempted(proteins: DataFrame, seed: str, run: Callable[[Texts, list[bytes]], list[str | None]], method: str) -> DataFrame:
    """Candidates of attempts that a task makes of its own rows, one after the other, so that nothing is written between them."""

    def each(batch: pa.RecordBatch) -> dict[str, list]:
        return {"codes": run(Texts.of(batch.column("aa").to_pylist()), keys_of(batch))}

    rows = seeded(proteins.select("seq_id", "aa"), seed)
    return candidates(batches.mapped(rows, "aa", {"codes": pa.string()}, each, drop=("_key",)), method, "codes")


def by_shares(weights: DataFrame, preferred: int = 0) -> Attempt:
    """Codons drawn by shares_table()."""
    of = entries(shares_table(weights, preferred).first()["table"])
    letters, bounds = by_byte({a: [*map(ord, e["letters"])] for a, e in of.items()}).astype(np.uint8), by_byte({a: e["bounds"] for a, e in of.items()})
    bounds[letters == 0] = SIXTEEN

    known: list[tuple[np.ndarray, np.ndarray]] = []

    def make(aa: Texts, keys: list[bytes], final: np.ndarray) -> Texts:
        if not known:  # made in the task, from a few numbers
            known.append(batches.chosen(bounds, letters))
        return batches.shared(aa, batches.draws(keys, aa.lengths), *known[0])

    return make


def site_bytes(standard: str = "golden_gate") -> list[bytes]:
    return [x.encode() for sites in ASSEMBLY[standard].values() for x in sites]


#: The bases of each codon letter.
BASES = by_byte({x: [*map(ord, c)] for x, c in zip(LETTERS, code())}, 3).astype(np.uint8)


def site_count(codes: Column, standard: str = "golden_gate") -> Column:
    """How many recognition sites of the standard the sequence holds."""
    cds = spelt(codes)
    return F.get(F.transform(F.array(cds), lambda s: reduce(lambda a, b: a + b, [count_of(s, x) for sites in ASSEMBLY[standard].values() for x in sites])), F.lit(0))


PREFERRED_70, PREFERRED_60 = round(0.7 * SIXTEEN), round(0.6 * SIXTEEN)
#: GC attempts within one attempt, and rounds of attempts at most.
GC_ATTEMPTS, ROUNDS = 10, 10


def of_rows(make: Attempt, aa: Texts, keys: list[bytes], last: int) -> Callable[[np.ndarray, np.ndarray], Texts]:
    return lambda rows, attempts: make(aa.take(rows), [keys[i] + b"|%d" % k for i, k in zip(rows.tolist(), attempts.tolist())], attempts == last)


#: By codon letter its number, and the codons.
NUMBERS = np.full(256, batches.NONE, np.int32)
NUMBERS[[*map(ord, LETTERS)]] = range(64)
WORDS = [c.encode() for c in code()]


def site_counter(sites: list[bytes]) -> Callable[[Texts], np.ndarray]:
    """Sites of each row of codon letters."""
    number, words, known = NUMBERS, WORDS, []

    def count(codes: Texts) -> np.ndarray:
        if not known:
            known.append(batches.site_table(sites, words))
        return batches.codon_sites(codes, number, known[0])

    return count


def in_band(make: Attempt, low: float, high: float) -> Callable[[Texts, list[bytes], int], list[str | None]]:
    """Of GC_ATTEMPTS attempts from a first one on the first within the GC band, else the nearest to its middle."""
    gc = GC_BYTES

    def run(aa: Texts, keys: list[bytes], first: int) -> list[str | None]:
        return batches.tried(len(keys), range(first, first + GC_ATTEMPTS), of_rows(make, aa, keys, first + GC_ATTEMPTS - 1), lambda c: batches.band_gap(c, gc, low, high))

    return run


def balanced(proteins: DataFrame, weights: DataFrame, low: float = 40.0, high: float = 47.0, seed: int = 320) -> DataFrame:
    """Seven of ten residues take their most frequent codon, the others one by frequency; of ten attempts the first within the GC band, else the nearest to its middle."""
    near = in_band(by_shares(weights, PREFERRED_70), low, high)
    return attempted(proteins, f"balanced|{seed}", lambda aa, keys: near(aa, keys, 0), "balanced")


def assembly_friendly(proteins: DataFrame, weights: DataFrame, low: float = 40.0, high: float = 47.0, seed: int = 320) -> DataFrame:
    """balanced() at six of ten, over again until no assembly site is left, at most ten times."""
    near, sites = in_band(by_shares(weights, PREFERRED_60), low, high), site_counter(site_bytes())

    def run(aa: Texts, keys: list[bytes]) -> list[str | None]:
        again = lambda rows, attempts: Texts.of(near(aa.take(rows), [keys[i] for i in rows.tolist()], GC_ATTEMPTS * int(attempts[0])))  # noqa: E731, all at the same attempt
        return batches.tried(len(keys), range(ROUNDS), again, sites, last=True)

    return attempted(proteins, f"assembly|{seed}", run, "assembly_friendly")


#: Rows for which a step over all rows is worth its call.
WORTH = 1 << 10


def clean(make: Attempt, attempts: int, ahead: int = 0) -> Callable[[Texts, list[bytes]], list[str | None]]:
    """The first of `attempts` without an assembly site, else the last."""
    sites = site_counter(site_bytes())
    return lambda aa, keys: batches.tried(len(keys), range(attempts), of_rows(make, aa, keys, attempts - 1), sites, last=True, ahead=ahead)


def weighted_clean(proteins: DataFrame, weights: DataFrame, attempts: int = 50, seed: int = 320, method: str = "ablation_cai_type_iis") -> DataFrame:
    """Codons by frequency; the first of `attempts` without an assembly site, else the last."""
    return attempted(proteins, f"weighted|{seed}", clean(by_shares(weights), attempts), method)


def steered_clean(proteins: DataFrame, weights: DataFrame, target: float = 43.5, attempts: int = 50, seed: int = 320, method: str = "ablation_cai_gc_type_iis") -> DataFrame:
    """Codons drawn by frequency over one plus the distance of the prefix's GC percent from the target, in attempts as weighted_clean()."""
    rows = weights.filter("w is not null").select("aa", "codon", code_letter(F.col("codon")).alias("x"), F.greatest(F.round(F.col("frequency") * 1000000), F.lit(1)).cast("long").alias("f"))
    gc = F.translate("x", LETTERS, "".join(str(GC_OF[x]) for x in LETTERS)).cast("int")
    each = rows.groupBy("aa").agg(F.sort_array(F.collect_list(F.struct("codon", gc.alias("g"), "f", "x"))).alias("c"))
    held = lambda a: F.max(F.when(F.col("aa") == a, F.transform("c", lambda c: F.struct(c["f"].alias("f"), c["g"].alias("g"), c["x"].alias("x")))))
    of = entries(each.agg(F.array(*[held(a) for a in [*map(chr, range(65, 91)), "*"]]).alias("table")).first()["table"])
    often, g, letters = (by_byte({a: [read(c) for c in cs] for a, cs in of.items()}) for read in (lambda c: c["f"], lambda c: c["g"], lambda c: ord(c["x"])))
    number, words, sites, known = NUMBERS, WORDS, site_bytes(), []

    def make(aa: Texts, keys: list[bytes], final: np.ndarray) -> Texts:
        if not known:
            known.append(batches.site_table(sites, words))
        # An attempt that holds a site is another's turn, unless it is the last: it goes no further.
        held = lambda x: known[0][(number[x[0]] * (batches.NONE + 1) + number[x[1]]) * (batches.NONE + 1) + number[x[2]]] > 0
        given_up = lambda rows, made, at: held((made[at - 2], made[at - 1], made[at])) & ~final[rows]
        return batches.steered(aa, batches.draws(keys, aa.lengths), target, often, g, letters, given_up)

    good = clean(make, attempts, WORTH)

    def run(aa: Texts, keys: list[bytes]) -> list[str | None]:
        lacking = batches.counts(letters[aa.letters, 0] == 0, aa) > 0
        fit = np.flatnonzero(~lacking)
        made = iter(good(aa.take(fit), [keys[i] for i in fit.tolist()]))
        return [None if odd else next(made) for odd in lacking.tolist()]

    return attempted(proteins, f"steered|{seed}", run, method)


def ramped(made: DataFrame, weights: DataFrame, residues: int = 50, seed: int = 320) -> DataFrame:
    """Candidates whose first residues take a codon of their least frequent quarter, by frequency; residues of one codon stay."""
    order = F.struct((-F.col("f")).alias("f"), "codon", "x")
    rows = weights.filter("w is not null").select("aa", "codon", code_letter(F.col("codon")).alias("x"), F.greatest(F.round(F.col("frequency") * 1000000), F.lit(1)).cast("long").alias("f"))
    each = rows.groupBy("aa").agg(F.sort_array(F.collect_list(order)).alias("c"))
    low = each.withColumn("c", F.slice("c", F.greatest(F.lit(1), F.floor(F.size("c") * 3 / 4)).cast("int") + 1, F.size("c"))).filter("size(c) > 0")
    rare = low.select("aa", F.explode("c").alias("c")).select("aa", F.col("c.codon").alias("codon"), (-F.col("c.f") / F.lit(1000000.0)).alias("frequency"), F.lit(1.0).alias("w"))
    of = entries(shares_table(rare).first()["table"])
    letters, bounds = by_byte({a: [*map(ord, e["letters"])] for a, e in of.items()}).astype(np.uint8), by_byte({a: e["bounds"] for a, e in of.items()})
    bounds[letters == 0] = SIXTEEN

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        aa, old = Texts.of(batch.column("aa").to_pylist()), batch.column("codes").to_pylist()
        head = aa.kept(aa.places() < residues)
        at = (bounds[head.letters] <= batches.draws(keys_of(batch), head.lengths)[:, None]).sum(1)
        new = Texts(letters[head.letters, np.minimum(at, letters.shape[1] - 1)], head.lengths).texts()
        return {"_new": [None if own is None else "".join([x if x != "\0" else own[i : i + 1] for i, x in enumerate(made)]) + own[len(made) :] for made, own in zip(new, old)]}

    rows = seeded(made.select("seq_id", "aa", "replicate", "codes"), f"ramp|{seed}", "replicate")
    return candidates(batches.mapped(rows, "aa", {"_new": pa.string()}, run, drop=("_key", "codes")), "ramp", "_new", F.col("replicate"))


def second_codon(made: DataFrame, weights: DataFrame) -> DataFrame:
    """Candidates whose second codon starts with GC, else with G, where its residue has such a codon: the most frequent of them, the first by letters on ties. One that starts with G stays."""
    likes = F.when(F.col("codon").startswith("GC"), 2).when(F.col("codon").startswith("G"), 1)
    best = weights.filter("w is not null").filter(F.col("codon").startswith("G")).groupBy("aa").agg(F.max(F.struct(likes, "frequency", F.translate("codon", "ACGT", "TGCA"), code_letter(F.col("codon")).alias("x")))["x"].alias("x"))
    table = F.broadcast(best.agg(F.map_from_entries(F.collect_list(F.struct("aa", "x"))).alias("second")))
    other = F.col("second")[F.substring("aa", 2, 1)]
    starts_with_g = "".join(letter_of(c) for c in code() if c[0] == "G")
    swap = (F.length("aa") >= 2) & other.isNotNull() & ~F.lit(starts_with_g).contains(F.substring("codes", 2, 1))
    return candidates(made.join(table), "second_codon", F.when(swap, F.overlay("codes", other, F.lit(2))).otherwise(F.col("codes")), F.col("replicate"))


def native(proteins: DataFrame, sequences: DataFrame) -> DataFrame:
    """Each protein's own coding sequence, as it is, where there is one: seq_id, aa, method, replicate, cds."""
    return proteins.join(sequences.select("seq_id", F.col("dna").alias("cds")).filter("cds <> ''"), "seq_id").select("seq_id", "aa", F.lit("native_reference").alias("method"), F.lit(0).alias("replicate"), "cds")


# Scores.


def score(candidates: DataFrame, weights: DataFrame, gc_low: float = 40.0, gc_high: float = 47.0, sites: dict[str, tuple[str, ...]] = TYPE_IIS, bases: bool = True, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds cds (unless bases is false), identity, gc, sites, cai and the four pass flags to candidates, of codes or of cds; and for each of the other weights by name cai_ and the name.

    A candidate with neither (its method failed) keeps null metrics and false flags. CAI leaves stops out; a sense codon
    without a weight, or no sense codon at all, makes it 0.
    """
    stop = by_byte({x: [1] for x, a in zip(LETTERS, RESIDUES) if a == "*"}, 1)[:, 0].astype(bool)

    def logs_of(table: DataFrame) -> np.ndarray:
        logs = {r["codon"]: r["l"] for r in table.select("codon", F.when(F.col("w") > 0, F.ln("w")).alias("l")).collect()}  # 64 rows
        log = np.full(256, np.nan)
        for x, c in zip(LETTERS, code()):
            if logs.get(c) is not None or stop[ord(x)]:
                log[ord(x)] = 0.0 if stop[ord(x)] else logs[c]
        return log

    adapted = {"cai": logs_of(weights)} | {f"cai_{name}": logs_of(table) for name, table in (others or {}).items()}
    residue, place = np.full(256, ord("X"), np.uint8), np.full(256, 64)
    residue[[*map(ord, LETTERS)]] = [*map(ord, RESIDUES)]
    place[[*map(ord, "TCAG")]] = range(4)
    spelling, patterns, given = BASES, [s.encode() for pair in sites.values() for s in pair], "cds" in candidates.columns
    by_codons = None if given or any(len(x) > 7 for x in patterns) else site_counter(patterns)
    gc_bytes = GC_BYTES
    first, none = FIRST_LETTER, ord(NO_CODON)

    def ended(t: Texts) -> Texts:
        """Without one last stop."""
        last = np.zeros(len(t.letters), bool)
        last[(t.starts + t.lengths - 1)[t.lengths > 0]] = True
        return t.kept(~(last & (t.letters == ord("*"))))

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column("cds" if given else "codes").to_pylist()
        held = Texts.of(texts)
        codes = batches.read_codes(held, place, first, none) if given else held
        cds = held if given else batches.spelt(held, spelling) if bases or by_codons is None else None
        if by_codons is None:
            long, gc, hits = cds.lengths, batches.counts((cds.letters == ord("G")) | (cds.letters == ord("C")), cds), batches.site_counts(cds, patterns)
        else:
            long, gc, hits = 3 * codes.lengths, batches.counts(gc_bytes[codes.letters], codes), by_codons(codes)
        made = Texts(residue[codes.letters], codes.lengths)
        inner = stop[codes.letters] & (codes.places() < np.repeat(codes.lengths - 1, codes.lengths))
        aa, back = ended(Texts.of(batch.column("aa").to_pylist())), ended(made)
        n = np.minimum(aa.lengths, back.lengths)
        a, b = (t.kept(t.places() < np.repeat(n, t.lengths)) for t in (aa, back))
        same = batches.counts(a.letters == b.letters, a)
        return {
            **({"cds": [None if t is None else s for t, s in zip(texts, cds.texts())]} if bases else {}), "_made": [t is not None for t in texts], "_n": long, "_gc": gc,
            "_sense": codes.lengths - batches.counts(stop[codes.letters], codes), **{f"_log_{c}": [None if x != x else x for x in batches.sums(log[codes.letters], codes).tolist()] for c, log in adapted.items()},
            "_aa": aa.lengths, "_same": same, "_back": (same == aa.lengths) & (aa.lengths == back.lengths), "sites": [None if t is None else k for t, k in zip(texts, hits.tolist())],
            "_odd": (batches.counts(codes.letters == none, codes) > 0) | (batches.counts(inner, codes) > 0),
        }

    kinds = {**({"cds": pa.string()} if bases else {}), "_made": pa.bool_(), "_n": pa.int64(), "_gc": pa.int64(), "_sense": pa.int64(), **{f"_log_{c}": pa.float64() for c in adapted}, "_aa": pa.int64(), "_same": pa.int64(), "_back": pa.bool_(), "sites": pa.int32(), "_odd": pa.bool_()}
    rows = batches.mapped(candidates, "cds" if given else "codes", kinds, run, drop=() if bases else ("cds", "codes"))
    is_made, frame = F.col("_made"), F.col("_n") % 3 == 0
    mean = lambda c: F.exp(F.col(f"_log_{c}") / F.col("_sense"))
    identity = F.when(F.col("_aa") == 0, F.lit(0.0)).when(F.col("_back"), F.lit(1.0)).otherwise(F.col("_same") / F.col("_aa").cast("double"))
    columns = [c for c in candidates.columns if c not in ("cds", "codes")]
    return (
        rows.withColumns({c: F.when(is_made, F.coalesce(F.round(F.when((F.col("_sense") > 0) & frame, mean(c)), 6), F.lit(0.0))) for c in adapted})
        .withColumn("identity", F.when(is_made & F.col("aa").isNotNull(), F.round(identity, 6)))
        .withColumn("gc", F.round(F.when(is_made, F.coalesce(F.col("_gc") * F.lit(100.0) / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0))), 2))
        .withColumn("biological_pass", is_made & F.col("aa").isNotNull() & F.col("_back") & frame & ~F.col("_odd"))
        .withColumn("assembly_pass", F.coalesce(F.col("sites") == 0, F.lit(False)))
        .withColumn("gc_pass", F.coalesce(F.col("gc").between(gc_low, gc_high), F.lit(False)))
        .withColumn("multi_pass", F.col("biological_pass") & F.col("assembly_pass") & F.col("gc_pass"))
        .select(*columns, *(["cds"] if bases else []), *adapted, "identity", "gc", "sites", "biological_pass", "assembly_pass", "gc_pass", "multi_pass")
    )


def failed(proteins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proteins that can be made, others with `error`): a residue without a codon is named, never the sequence."""
    odd = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace("aa", "[ACDEFGHIKLMNPQRSTVWY*]", ""), ""))), ",")
    judged = proteins.withColumn("error", F.when(F.length("aa") == 0, "empty protein").when(F.col("aa").rlike("[^ACDEFGHIKLMNPQRSTVWY*]"), F.concat(F.lit("no codon for: "), odd)))
    return judged.filter("error is null").drop("error"), judged.filter("error is not null")


def run_methods(proteins: DataFrame, weights: DataFrame, methods: dict[str, Callable[[DataFrame], DataFrame]], natives: DataFrame | None = None, bases: bool = True) -> DataFrame:
    """All methods over all proteins, scored, with or without their bases; a protein that cannot be made is an error row of every method. methods: by name, proteins to candidates."""
    good, bad = failed(proteins)
    made = [score(f(good), weights, bases=bases) for f in reversed(methods.values())]  # those named last take longest; their tasks start first
    if natives is not None:
        made.append(score(native(proteins, natives), weights, bases=bases))
    ok = reduce(DataFrame.unionByName, made).withColumns({"status": F.lit("ok"), "error": F.lit(None).cast("string")})
    nothing = {**({"cds": "string"} if bases else {}), "cai": "double", "identity": "double", "gc": "double", "sites": "int"}
    errors = bad.withColumn("method", F.explode(F.array(*map(F.lit, methods)))).withColumns(
        {"replicate": F.lit(0), "status": F.lit("error"), **{c: F.lit(None).cast(t) for c, t in nothing.items()}, **{c: F.lit(False) for c in ("biological_pass", "assembly_pass", "gc_pass", "multi_pass")}}
    )
    return ok.unionByName(errors)


def summary(results: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """Per method: sequences, row-weighted pass rates and mean CAI, rounded to 4; and the means of other columns, mean_ before their names."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4).alias(c.replace("pass", "rate"))
    return results.groupBy("method").agg(
        F.countDistinct("seq_id").alias("n_ok"), F.count(F.lit(1)).alias("n_rows"),
        *[rate(c) for c in ("biological_pass", "assembly_pass", "gc_pass", "multi_pass")], *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("cai", *others)],
    )


#: What becomes of a candidate, in the order of the tests.
CATEGORIES = ("passed", "biological", "gc_and_sites", "gc_only", "sites_only")


def failures(results: DataFrame) -> DataFrame:
    """Per method and category, sequences' worth of rows: each row weighs 1 / its method's replicates. Categories without rows are there with 0."""
    kind = (
        F.when(F.col("multi_pass"), "passed").when(~F.col("biological_pass"), "biological")
        .when(~F.col("gc_pass") & ~F.col("assembly_pass"), "gc_and_sites").when(~F.col("gc_pass"), "gc_only").otherwise("sites_only")
    )
    rows = results.withColumn("category", kind)
    held = [F.count(F.when(F.col("category") == c, 1)).alias(c) for c in CATEGORIES]
    each = rows.groupBy("method", "seq_id").agg(F.count(F.lit(1)).alias("n"), *held)  # exchanged once, a row a sequence
    counts = each.groupBy("method").agg(F.sum("n").alias("n"), F.count("seq_id").alias("s"), *[F.sum(c).alias(c) for c in CATEGORIES])
    every = counts.select("method", "n", "s", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("k")) for c in CATEGORIES])).alias("x"))
    return every.select("method", "x.category", F.round(F.col("x.k") / (F.col("n") / F.col("s")), 6).alias("weight"))


def gc_bounds(aa: Column) -> tuple[Column, Column]:
    """The least and the most G and C that any coding sequence of the protein can hold."""
    counts = {a: [sum(b in "GC" for b in c) for c in cs] for a, cs in sorted(_choices().items())}
    held = lambda a: F.length(aa) - F.length(F.replace(aa, F.lit(a)))
    total = lambda of: reduce(lambda x, y: x + y, [held(a) * of(n) for a, n in counts.items()]).cast("long")
    return total(min), total(max)
