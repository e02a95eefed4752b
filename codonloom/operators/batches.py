"""What tasks do over Arrow batches, where a step for every codon is too slow as a lambda of Spark's: numpy over the letters of a batch's rows in one array.

Only numbers and letters come in: tables are made by the callers. The functions travel to the executors by value.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5
from math import sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters of a slice of a batch, one row at least.
MOST_LETTERS = 2 << 20
#: The same for steps of many passes over all letters, whose numbers are to stay in a core's cache.
FEW_LETTERS = 1 << 18


class Texts:
    """Texts as one array of letters and where each starts; null is empty here."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray):
        self.letters, self.lengths = letters, lengths
        self.starts = np.cumsum(lengths) - lengths

    @staticmethod
    def of(texts: list[str | None]) -> Texts:
        """One byte a character: one that is no ASCII becomes '?', which no table knows."""
        raw = [(t or "").encode("ascii", "replace") for t in texts]
        return Texts(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64))

    def rows(self) -> np.ndarray:
        """The row of each letter."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def places(self) -> np.ndarray:
        """The place of each letter in its row."""
        return np.arange(len(self.letters)) - np.repeat(self.starts, self.lengths)

    def kept(self, keep: np.ndarray) -> Texts:
        """Only the letters to keep."""
        return self if keep.all() else Texts(self.letters[keep], counts(keep, self))

    def take(self, rows: np.ndarray) -> Texts:
        n = self.lengths[rows]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return Texts(self.letters[np.repeat(self.starts[rows], n) + inner], n)

    def texts(self) -> list[str]:
        whole = self.letters.tobytes().decode("latin-1")
        return [whole[s : s + n] for s, n in zip(self.starts.tolist(), self.lengths.tolist())]


def counts(values: np.ndarray, of: Texts) -> np.ndarray:
    """Sums of whole numbers by row."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[of.starts + of.lengths] - upto[of.starts]


def sums(values: np.ndarray, of: Texts) -> np.ndarray:
    """Sums by row; 0 for an empty one."""
    out, full = np.zeros(len(of.lengths)), of.lengths > 0
    if full.any():
        out[full] = np.add.reduceat(values, of.starts[full])
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = MOST_LETTERS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of `most` letters at most, or one row."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


Run = Callable[[pa.RecordBatch], dict[str, list]]


def mapped(rows: DataFrame, column: str, made: dict[str, pa.DataType], run: Run, drop: tuple[str, ...] = (), most: int = MOST_LETTERS) -> DataFrame:
    """rows with the columns that run makes of a slice of them, bounded by the letters of `column`; those to drop are only handed to run."""
    kept = [f for f in rows.schema.fields if f.name not in (*made, *drop)]
    names, types = [f.name for f in kept], list(made.values())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                new = run(part)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *[pa.array(new[n], t) for n, t in zip(made, types)]], [*names, *made])

    return rows.mapInArrow(each, StructType([*kept, *[StructField(n, from_arrow_type(t)) for n, t in made.items()]]))


#: Messages of md5 done at a time, so that their numbers stay in a core's cache, and letters of a message that is one block of md5.
MESSAGES, ONE_BLOCK = 1 << 14, 55
_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_words(words: np.ndarray, used: int) -> np.ndarray:
    """md5 of messages of one block, four numbers each; words: 16 rows of the messages' numbers, of which those from `used` on are 0 but the last two."""
    m = words.shape[1]
    a, b, c, d = (np.full(m, x, np.uint32) for x in _START)
    f, g = np.empty(m, np.uint32), np.empty(m, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            k = i
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            k = (5 * i + 1) % 16
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            k = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            k = 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        if k < used or k == 14:
            f += words[k]
        turn = _TURNS[kind][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    return np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), _START)], axis=1)


def draws(keys: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """For each row as many whole numbers below 65536 as its length: the 16-bit parts of md5 over (key, block), eight a block."""
    blocks = -(-lengths // 8)
    starts = np.cumsum(blocks) - blocks
    row = np.repeat(np.arange(len(keys)), blocks)
    number = np.arange(len(row)) - starts[row]
    raw, size = np.empty((len(row), 16), np.uint8), np.array([len(k) + 1 for k in keys], np.int64)
    spelt = [b"%d" % n for n in range(int(blocks.max(initial=0)))]
    width = max([len(x) for x in spelt[-1:]], default=1)
    signs = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in spelt]), np.uint8).reshape(-1, width)
    digits = np.array([*map(len, spelt)], np.int64)[number]
    long = size[row] + digits > ONE_BLOCK
    for i in np.flatnonzero(long).tolist():
        raw[i] = np.frombuffer(md5(keys[row[i]] + b"|%d" % number[i]).digest(), np.uint8)
    heads = np.frombuffer(b"".join([(k + b"|")[:64].ljust(64, b"\0") for k in keys]), np.uint8).reshape(-1, 64)
    short = np.flatnonzero(~long)
    for i in range(0, len(short), MESSAGES):
        at = short[i : i + MESSAGES]
        text, each, n, k = heads[row[at]], np.arange(len(at)), number[at], digits[at]
        end = size[row[at]]
        for j in range(int(k.max())):
            has = each if (k > j).all() else np.flatnonzero(k > j)
            text[has, end[has] + j] = signs[n[has], j]
        end = end + k
        text[each, end] = 0x80
        text[:, 56], text[:, 57] = (8 * end) & 255, (8 * end) >> 8
        raw[at] = md5_words(np.ascontiguousarray(text.view("<u4").T), int(end.max()) // 4 + 1).astype("<u4", copy=False).view(np.uint8)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return raw.view(np.uint16).reshape(-1).byteswap()[np.repeat(starts * 8, lengths) + within]


def chosen(bounds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each residue that has codons makes of each draw below 65536, from the upper bounds and letters of its codons, and by residue where its part begins; the last part is that of all others, 0."""
    known = [a for a in range(256) if letters[a].any()]
    table = np.zeros((len(known) + 1, 1 << 16), np.uint8)
    place = np.full(256, len(known))
    for i, a in enumerate(known):
        at = np.searchsorted(bounds[a], np.arange(1 << 16), "right")
        table[i], place[a] = letters[a][np.minimum(at, letters.shape[1] - 1)], i
    return table, place << 16


def shared(aa: Texts, numbers: np.ndarray, table: np.ndarray, place: np.ndarray) -> Texts:
    """The codon letters that draws choose, of chosen(). A residue without codons gives none."""
    made = table.reshape(-1)[place[aa.letters] + numbers]
    return Texts(made, aa.lengths).kept(made > 0)


def modulo(aa: Texts, numbers: np.ndarray, choices: np.ndarray, letters: np.ndarray) -> Texts:
    """The codon letters by draws modulo the number of a residue's codons."""
    n = choices[aa.letters]
    made = letters[aa.letters, numbers % np.maximum(n, 1)]
    return Texts(made, aa.lengths).kept(n > 0)


def gc_hundredths(codes: Texts, gc: np.ndarray) -> np.ndarray:
    """GC percent to 2 places, half up, in hundredths; 0 for an empty sequence."""
    m = np.maximum(3 * codes.lengths, 1)
    return (2 * counts(gc[codes.letters], codes) * 10000 + m) // (2 * m)


def band_gap(codes: Texts, gc: np.ndarray, low: float, high: float) -> np.ndarray:
    """0 inside the GC band, else the distance from its middle."""
    share = gc_hundredths(codes, gc) / 100.0
    return np.where((share >= low) & (share <= high), 0.0, np.abs(share - (low + high) / 2))


def site_counts(cds: Texts, sites: list[bytes]) -> np.ndarray:
    """Occurrences of all sites by row, overlapping ones too."""
    found, base = np.zeros(len(cds.lengths), np.int64), cds.letters.tobytes()
    ends = cds.starts + cds.lengths
    for site in sites:
        at, i = [], base.find(site)
        while i >= 0:
            at.append(i)
            i = base.find(site, i + 1)
        if at:
            where = np.array(at)
            row = np.searchsorted(ends, where, "right")
            inside = where + len(site) <= ends[row]  # a hit across two rows is none
            found += np.bincount(row[inside], minlength=len(found))
    return found


#: By codon letter its number, from 0; that of none.
NONE = 64


def site_table(sites: list[bytes], words: list[bytes]) -> np.ndarray:
    """By three codons' numbers (of words, or NONE) how many sites, of seven bases at most, begin in the first."""
    if any(len(x) > 7 for x in sites):
        raise ValueError("a site of over seven bases is not within three codons")
    base = np.array([[*w] for w in words] + [[0, 0, 0]], np.uint8)
    n = np.arange(NONE + 1)
    nine = [x for k in range(3) for x in np.broadcast_arrays(*[base[n, j].reshape([-1 if i == k else 1 for i in range(3)]) for j in range(3)])]
    found = np.zeros((NONE + 1,) * 3, np.uint8)
    for site in sites:
        for start in range(3):
            found += reduce(np.logical_and, [nine[start + i] == x for i, x in enumerate(site)])
    return found.reshape(-1)


def codon_sites(codes: Texts, number: np.ndarray, table: np.ndarray) -> np.ndarray:
    """site_counts() of the bases that codon letters stand for, by site_table(): nothing is spelt. number: by letter, NONE for one that is no codon."""
    own = number[codes.letters]
    later = [np.full(len(own), NONE, own.dtype) for _ in range(2)]
    last = np.zeros(len(own), bool)
    last[(codes.starts + codes.lengths - 1)[codes.lengths > 0]] = True
    later[0][:-1] = own[1:]
    later[0][last] = NONE
    later[1][:-1] = later[0][1:]
    later[1][last] = NONE
    return counts(table[(own * (NONE + 1) + later[0]) * (NONE + 1) + later[1]], codes)


def spelt(codes: Texts, bases: np.ndarray) -> Texts:
    """Three bases a codon letter."""
    return Texts(bases[codes.letters].reshape(-1), 3 * codes.lengths)


def tried(n: int, tries: range, make: Callable[[np.ndarray, np.ndarray], Texts], away: Callable[[Texts], np.ndarray], last: bool = False, ahead: int = 0) -> list[str | None]:
    """For each of n rows the first attempt that is not away (0), else the nearest, the first of equally near ones, or the last one. Only rows without a good attempt are tried again.

    make gets rows and their attempts. Where fewer rows than `ahead` are left, several of their attempts are made at once, so that a step over all rows stays worth its call.
    """
    best, gap, left, k = [None] * n, np.full(n, np.inf), np.arange(n), 0
    while len(left) and k < len(tries):
        some = tries[k : k + max(1, ahead // len(left))]
        codes = make(np.tile(left, len(some)), np.repeat(np.array(some), len(left)))
        least, chosen, at = gap[left], np.full(len(left), -1), np.arange(len(left))
        for i, far in enumerate(away(codes).reshape(len(some), -1)):
            better = (least > 0) & ((far < least) | last)
            least[better], chosen[better] = far[better], i
        gap[left] = least
        has = chosen >= 0
        for j, text in zip(left[has].tolist(), codes.take((chosen * len(left) + at)[has]).texts()):
            best[j] = text
        left, k = left[least > 0], k + len(some)
    return best


def walked(aa: Texts, step: Callable[[np.ndarray, np.ndarray, int, np.ndarray], tuple[np.ndarray, np.ndarray]], given_up: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Texts:
    """Letters chosen residue by residue, in all rows at once: step(places in the array, residue, its place, gc so far) gives what each adds to gc and its letter.

    given_up(rows, letters so far, places) names rows whose rest does not matter; it stays 0.
    """
    order = np.argsort(-aa.lengths, kind="stable")
    starts, longest = aa.starts[order], aa.lengths[order]
    out, gc = np.zeros(len(aa.letters), np.uint8), np.zeros(len(order))
    on = np.ones(len(order), bool)
    for k in range(int(longest[0]) if len(longest) else 0):
        n = int(np.searchsorted(-longest, -k, "left"))
        if not n:
            break
        at = starts[:n] + k
        added, out[at] = step(at, aa.letters[at], k, gc[:n])
        gc[:n] += added
        if given_up is not None and k > 1:
            on[:n] &= ~given_up(order[:n], out, at)
            if k % 16 == 0:
                order, starts, longest, gc = order[on], starts[on], longest[on], gc[on]
                on = np.ones(len(order), bool)
    return Texts(out, aa.lengths)


def by_codon(table: np.ndarray, kind: type = float) -> np.ndarray:
    """A table of residues by codons the other way round, so that a codon's values of all rows lie together."""
    return np.ascontiguousarray(table.T.astype(kind))


def to_target(aa: Texts, target: float, g: np.ndarray, letters: np.ndarray) -> Texts:
    """The codon that brings the GC percent so far, to 2 places, nearest to the target; by residue the codons' G and C and letters, in the order of ties, 0 for none.

    Whole numbers of far fewer than 53 bits are divided as doubles, whose floor is exact.
    """
    g, x, none = by_codon(g), by_codon(letters, np.uint8), by_codon(np.where(letters > 0, 0.0, np.inf))

    def step(at: np.ndarray, residue: np.ndarray, k: int, gc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        adds, m = np.take(g, residue, 1), 3 * k + 3
        away = np.abs(np.floor(((gc + adds) * 20000 + m) / (2 * m)) / 100.0 - target)
        best = (away + np.take(none, residue, 1)).argmin(0)
        return adds[best, np.arange(len(best))], x[best, residue]

    return walked(aa, step)


def steered(aa: Texts, numbers: np.ndarray, target: float, f: np.ndarray, g: np.ndarray, letters: np.ndarray, given_up: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None) -> Texts:
    """Codons drawn by frequency (f, in millionths, 0 for none) over one plus the distance of the prefix's GC percent from the target, in whole numbers; divided as in to_target()."""
    aim, most = int(target * 1000), f.shape[1] - 1
    often, known, g, x, numbers = by_codon(f * 1000), by_codon(f > 0), by_codon(g), by_codon(letters, np.uint8), numbers.astype(float)

    def step(at: np.ndarray, residue: np.ndarray, k: int, gc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        adds, m = np.take(g, residue, 1), 3 * k + 3
        away = np.abs((gc + adds) * 100000 - aim * m)
        away /= m
        np.floor(away, out=away)
        away += 1000
        upto = np.take(often, residue, 1)
        upto /= away
        np.floor(upto, out=upto)
        upto += np.take(known, residue, 1)
        for i in range(1, len(upto)):
            upto[i] += upto[i - 1]
        best = np.minimum((upto * 65536 <= numbers[at] * upto[-1]).sum(0), most)
        return adds[best, np.arange(len(best))], x[best, residue]

    return walked(aa, step, given_up)


def read_codes(cds: Texts, place: np.ndarray, first: int, none: int) -> Texts:
    """The letters of whole codons; `none` for one with another base. place: by base 0 to 3, else a number of 64 or more."""
    whole = cds.kept(cds.places() < np.repeat(cds.lengths - cds.lengths % 3, cds.lengths))
    at = place[whole.letters.reshape(-1, 3)] @ np.array([16, 4, 1])
    return Texts(np.where(at < 64, at + first, none).astype(np.uint8), whole.lengths // 3)


def is_gc(t: Texts) -> np.ndarray:
    return (t.letters == ord("G")) | (t.letters == ord("C"))


def percent(part: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Percent of each number in another; 0 of nothing."""
    return np.where(of > 0, part * 100.0 / np.maximum(of, 1), 0.0)


def upto(values: np.ndarray) -> np.ndarray:
    """Sums of whole numbers before each place, and of all at the end."""
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def window_shares(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(GC percent, row) of windows each half a size apart, with one at the end; a shorter text is one window, an empty one has 0."""
    last, step, gc = np.maximum(t.lengths - size, 0), max(1, size // 2), upto(is_gc(t))
    plain = last // step + 1
    n = plain + (last % step > 0)
    row = np.repeat(np.arange(len(n)), n)
    start = t.starts[row] + np.minimum((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step, last[row])
    width = np.minimum(size, t.lengths)[row]
    return percent(gc[start + width] - gc[start], width), row


def edges(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Where a new value or a new row begins."""
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return np.flatnonzero(new)


def letter_runs(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, letter, length) of the longest runs of one letter."""
    row = t.rows()
    at = edges(t.letters, row)
    return row[at], t.letters[at], np.diff(np.r_[at, len(row)])


def most(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The greatest value of each of n rows, 0 without any."""
    out = np.zeros(n, np.int64)
    np.maximum.at(out, row, values)
    return out


def words(t: Texts, k: int) -> np.ndarray:
    """A number for the k letters from each place on, equal for equal ones; one that would go beyond its row means nothing."""

    def narrowed(numbers: np.ndarray) -> tuple[np.ndarray, int]:
        found, at = np.unique(numbers, return_inverse=True)
        return at.astype(np.int64), max(1, int(len(found) - 1).bit_length())

    def joined(a: np.ndarray, a_bits: int, width: int, b: np.ndarray, b_bits: int) -> tuple[np.ndarray, int]:
        if a_bits + b_bits > 62:
            (a, a_bits), (b, b_bits) = narrowed(a), narrowed(b)
        later = np.zeros_like(b)
        later[: max(len(b) - width, 0)] = b[width:]
        return (a << b_bits) | later, a_bits + b_bits

    if t.letters.dtype == np.uint8:  # few letters: numbered by a table, without a sort
        known = np.zeros(256, bool)
        known[t.letters] = True
        one, bits = (np.cumsum(known) - 1)[t.letters], max(1, int(known.sum() - 1).bit_length())
    else:
        one, bits = narrowed(t.letters)
    made, width = None, 0
    size, power = 1, (one, bits)
    while k:
        if k & 1:
            made = power if made is None else joined(*made, width, *power)
            width += size
        k >>= 1
        if k:
            power, size = joined(*power, size, *power), 2 * size
    return made[0]


def repeated_words(t: Texts, k: int) -> np.ndarray:
    """By row how many different words of k letters it holds twice or more."""
    if not len(t.letters):
        return np.zeros(len(t.lengths), np.int64)
    inside = t.places() <= np.repeat(t.lengths - k, t.lengths)
    held = Texts(words(t, k)[inside], np.maximum(t.lengths - k + 1, 0))
    for s, n in zip(held.starts.tolist(), held.lengths.tolist()):
        held.letters[s : s + n].sort()
    row = held.rows()
    at = edges(held.letters, row)
    return np.bincount(row[at[np.diff(np.r_[at, len(row)]) > 1]], minlength=len(t.lengths))


def tandems(t: Texts, unit: int, copies: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end): units of so many letters that follow each other `copies` times or more, from left to right as many as there are."""
    same = t.letters[:-unit] == t.letters[unit:]
    same &= (t.places() + unit < np.repeat(t.lengths, t.lengths))[: len(same)]
    turns = np.flatnonzero(np.diff(np.r_[False, same, False]))
    first, length = turns[::2], turns[1::2] - turns[::2]
    long = length >= unit * (copies - 1)
    row = np.searchsorted(t.starts + t.lengths, first[long], "right")
    end, least = -1, unit * (copies - 1)
    for r, s, n, base in zip(row.tolist(), first[long].tolist(), length[long].tolist(), t.starts[row].tolist()):
        begin = max(s, end)  # a span takes its letters away from the next one
        if s + n - begin >= least:
            end = begin + unit * (1 + (s + n - begin) // unit)
            yield r, begin - base, end - base


def window_sums(values: np.ndarray, t: Texts, width: np.ndarray | int, room: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sum, row) of the `width` values from each place on, wherever `room` letters (as a rule the same number) are left in the row. Both can differ by row."""
    width, room = (np.broadcast_to(x, t.lengths.shape) for x in (width, width if room is None else room))
    at = np.flatnonzero(t.places() + np.repeat(room, t.lengths) <= np.repeat(t.lengths, t.lengths))
    before, row = upto(values), t.rows()[at]
    return before[at + width[row]] - before[at], row
