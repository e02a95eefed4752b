"""Input contexts, validation reports, scores, dinucleotides and files, against plain computations."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from codonloom.functions.codes import code
from codonloom.operators import dinucleotides, intake, scoring
from codonloom.operators.edits import synonyms
from codonloom.sources import tables

CODE = code()


def test_input_types(spark):
    cases = {"ATGGCC": ("dna", "dna"), " atg gcc\n": ("dna", "dna"), "MKKGEL": ("protein", "protein"), "MA": ("ambiguous", "protein"), "ATGA": ("ambiguous", "protein"), "ATGMCC": ("ambiguous", "dna"), "": ("ambiguous", None), "AT1G": ("protein", None)}
    rows = spark.createDataFrame([(s,) for s in cases], "raw string")
    got = {r.raw: (r.detected, r.resolved) for r in intake.resolved(rows, "raw").collect()}
    assert got == cases
    wrong = intake.resolved(rows, "raw", "dna").filter("raw = 'MKKGEL'").first()
    assert wrong.refused == "expected dna, detected protein" and wrong.resolved is None
    assert intake.resolved(spark.createDataFrame([(None,)], "raw string"), "raw").first().refused == "empty"


def test_contexts(spark):
    cases = [
        ("ATGGCCTAA", ("cds", None, "MA", True, [], [])), (">x y\natg\r\ngcc taa\n", ("cds", None, "MA", True, [], [])), ("ATGTAAGCC", ("cds", None, "M*A", False, ["internal_stop"], ["no_stop"])),
        ("GCCGC", ("cds", None, "", False, ["frame"], ["no_start", "no_stop"])), ("AC", ("cds", None, "", False, ["frame"], ["no_start", "no_stop"])), ("MKL*", ("protein", None, "MKL", True, [], [])),
        ("MK*L", (None, "inner_stop_mark", None, False, [], [])), ("*", (None, "no_residue", None, False, [], [])), ("MKO1", (None, "invalid: 1, O", None, False, [], [])),
        (" \n", (None, "empty", None, False, [], [])), (">x\nATG\n>y\nATG", (None, "many_records", None, False, [], [])), ("ATG\n>x", (None, "header_not_first", None, False, [], [])), (None, (None, "empty", None, False, [], [])),
    ]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, raw string")
    got = {r.i: r for r in intake.context(rows, "raw").collect()}
    for i, (_, want) in enumerate(cases):
        r = got[i]
        assert (r.input_type, r.refused, r.protein, r.generation_allowed, r.errors, r.warnings) == want, cases[i]
    assert got[1].header == "x y" and got[1].stop_codon == "TAA" and got[0].gc == 44.4 and got[2].internal_stops == 1
    assert intake.context(rows.limit(0), "raw").count() == 0


def test_input_checks(spark):
    rows = spark.createDataFrame([(0, "ATGGCCTAA"), (1, "atgtaagccn"), (2, "ATGXCC"), (3, ""), (4, None)], "i int, s string")
    got = {r.i: (r.level, r.errors, r.warnings, r.stop_positions) for r in intake.checked_dna(rows, "s").collect()}
    assert got[0] == ("ok", [], [], [3])
    assert got[1] == ("warning", [], ["AMBIGUOUS_DNA", "FRAME_ERROR", "INTERNAL_STOP"], [2])
    assert got[2] == ("error", ["INVALID_DNA_CHARS"], [], [])
    assert got[3] == got[4] == ("warning", [], ["EXTREME_GC"], [])
    assert intake.checked_dna(rows, "s", trim=True).filter("i = 1").first().sequence == "ATGTAAGCC"


def plain_report(aa: str, s: str, motifs: tuple[str, ...]) -> dict:
    gc = lambda x: 100.0 * sum(b in "GC" for b in x) / len(x) if x else 0.0
    last = max(len(s) - 60, 0)
    wins = [gc(s[i : i + 60]) for i in sorted({*range(0, last + 1, 30), last})] if s else []
    found: set[tuple[int, int]] = set()
    for m in range(2, 7):
        i = 0
        while i <= len(s) - 3 * m:
            j = i + m
            while s[j : j + m] == s[i : i + m]:
                j += m
            if j - i >= 3 * m:
                found.add((i, j))
                i = j
            else:
                i += 1
    back = "".join(CODE.get(s[i : i + 3], "X") for i in range(0, len(s) - len(s) % 3, 3))
    back = back[:-1] if back.endswith("*") and not aa.endswith("*") else back
    return {
        "identity": sum(a == b for a, b in zip(aa, back)) / len(aa), "gc": gc(s), "gc_window_min": min(wins, default=0.0), "gc_window_max": max(wins, default=0.0), "gc_window_outliers": sum(not 30 <= w <= 70 for w in wins), "first_30_gc": gc(s[:30]),
        "internal_stops": sum(s[i : i + 3] in ("TAA", "TAG", "TGA") for i in range(0, len(s) - len(s) % 3 - 3, 3)), "invalid_codons": (len(s) % 3 > 0) + sum("N" in s[i : i + 3] for i in range(0, len(s) - len(s) % 3, 3)),
        "forbidden_motifs": sum(s.startswith(m, i) for m in motifs for i in range(len(s))), "homopolymers": len(re.findall(r"(.)\1{5,}", s)), "repeats": len(found),
    }


def test_validation_report(spark):
    rng, motifs = random.Random(3), ("ATA", "GGTCTC")
    rows = [(0, "MA", ""), (1, "MA", "ATGGCCTAA"), (2, "MKKKKK", "ATG" + "AAA" * 5), (3, "M", "ATATATATATCGCGCGN")]
    for i in range(4, 40):
        s = "".join(rng.choice("AAACGT") for _ in range(rng.randrange(3, 260)))
        rows.append((i, "".join(CODE[s[k : k + 3]] for k in range(0, len(s) - len(s) % 3, 3)), s))
    got = intake.validation_report(spark.createDataFrame(rows, "i int, aa string, cds string"), forbidden=motifs).collect()
    for r in got:
        want = plain_report(r.aa, r.cds, motifs)
        assert {k: pytest.approx(v) for k, v in want.items()} == {k: r[k] for k in want}, r.cds
        assert r.passed == (r.cds != "" and len(r.cds) % 3 == 0 and want["identity"] == 1 and not want["invalid_codons"] and not want["internal_stops"])
    strict = intake.validation_report(spark.createDataFrame([(1, "I", "ATA")], "i int, aa string, cds string"), forbidden=motifs, forbidden_fail=True).first()
    assert strict.errors == ["forbidden_motifs"] and not strict.passed


def test_golden_cai_and_scores(spark):
    golden = spark.createDataFrame([("GCC", 0.5), ("GCT", None)], "codon string, w double")
    working = spark.createDataFrame([("GCC", "A", 0.3), ("GCT", "A", 0.4), ("TAA", "*", 1.0), ("ATG", "M", 0.0)], "codon string, aa string, frequency double")
    weights = scoring.filled_weights(golden, working)
    assert {r.codon: r.w for r in weights.collect()} == {"GCC": 0.5, "GCT": 1.0, "ATG": None}
    rows = spark.createDataFrame([(0, "GCCGCTTAA"), (1, "GCCG"), (2, "ATGTAA"), (3, "")], "seq_id int, dna string")
    got = {r.seq_id: r.cai for r in scoring.golden_cai(rows, weights).collect()}
    assert got == {0: 0.707, 1: 0.0, 2: 0.0, 3: 0.0}
    scored = scoring.composite(spark.createDataFrame([(1, "GGCC" * 5, 0.9)], "seq_id int, dna string, cai double"), scoring.profiles(spark)).collect()
    assert {r.profile: r.score for r in scored}["balanced"] == round(0.5 * 0.9 / 0.8, 3)
    with_mfe = scoring.composite(spark.createDataFrame([(1, "GGCC" * 5, 0.9)], "seq_id int, dna string, cai double"), scoring.profiles(spark), mfe=F.lit(1.0)).filter("profile = 'balanced'").first()
    assert with_mfe.score == pytest.approx(0.5 * 0.9 + 0.2)


def test_blended(spark):
    high = spark.createDataFrame([("GCC", "A", 0.6), ("GCT", "A", 0.4), ("ATG", "M", 1.0)], "codon string, aa string, frequency double")
    low = spark.createDataFrame([("GCC", 0.2), ("GCT", 0.8)], "codon string, frequency double")
    got = {r.codon: (r.frequency, r.per_thousand, r.preferred) for r in scoring.blended(high, low, 0.5).collect()}
    assert got == {"GCC": (0.4, 200.0, "GCT"), "GCT": (0.6, 300.0, "GCT"), "ATG": (1.0, 1000.0, "ATG")}
    with pytest.raises(ValueError):
        scoring.blended(high, low, 1.5)


def plain_passes(s: str, freq: dict, w: dict, mode: str, floor: float) -> tuple[str, int]:
    cai = lambda x: math.exp(sum(math.log(w[c]) for c in cs) / len(cs)) if (cs := [x[i : i + 3] for i in range(0, len(x), 3) if CODE[x[i : i + 3]] != "*"]) else 0.0
    near = lambda x, k: sum(x[i : i + 2] in ("CG", "TA") for i in range(max(0, k - 1), min(len(x) - 1, k + 3)))
    others, start = synonyms(freq), cai(s)
    least = {"aggressive": 0.0, "balanced": floor, "cai_preserving": start - 0.003}[mode]
    for n in range(1, 6):
        before = s
        for k in range(0, len(s), 3):
            for alt in others.get(s[k : k + 3], []):
                if near(t := s[:k] + alt + s[k + 3 :], k) < near(s, k):
                    s = t
                    break
        if s == before:
            return s, n
        if mode != "aggressive" and cai(s) < least:
            return before, n
    return s, 5


@pytest.mark.parametrize("mode", dinucleotides.MODES)
def test_fewer_dinucleotides(spark, mode):
    rng = random.Random(5)
    w = {c: rng.uniform(0.2, 1) for c, a in CODE.items() if a != "*"}
    sense = sorted(w)
    texts = ["".join(rng.choice(sense) for _ in range(n)) + end for n in (1, 2, 3, 40, 255, 256, 257, 600) for end in ("", "TAA")]
    bad = ["", "ATGA", "ATGTAAGCC", "ATGNCC"]
    rows = spark.createDataFrame(list(enumerate(texts + bad)), "seq_id int, cds string")
    got = {r.seq_id: r for r in dinucleotides.fewer_pairs(rows, w, w, mode=mode, cai_floor=0.5).collect()}
    spoken = lambda s: "".join(CODE[s[i : i + 3]] for i in range(0, len(s), 3))
    for i, s in enumerate(texts):
        assert (got[i].cds, got[i].rounds) == plain_passes(s, w, w, mode, 0.5), i
        assert spoken(got[i].cds) == spoken(s) and got[i].after <= got[i].before and got[i].error is None
    assert [got[len(texts) + i].error for i in range(4)] == ["empty", "frame", "internal_stop", "invalid_base"]
    assert [got[len(texts) + i].cds for i in range(4)] == bad


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(c, a, 0.5) for c, a in CODE.items()], "codon string, aa string, frequency double")
    path = f"{tmp_path}/table"
    first = tables.write_codon_table(rows, path, "all").first()
    assert first.n_codons == 64 and first.sha256 == tables.write_codon_table(rows.orderBy(F.desc("codon")), path, "all").first().sha256
    assert {tuple(r) for r in tables.read_codon_table(spark, path).collect()} == {tuple(r) for r in rows.collect()}
    (tmp_path / "odd.json").write_text('{"codons": {"GCC": {"aa": "A", "frequency": 0.25}, "GCT": {"aa": "A"}, "GCA": 5, "GCG": {"frequency": 1}}}')
    assert [tuple(r) for r in tables.read_codon_table(spark, f"{tmp_path}/odd.json").collect()] == [("GCC", "A", 0.25)]
    (tmp_path / "none.json").write_text("{}")
    with pytest.raises(Exception, match="no 'codons'"):
        tables.read_codon_table(spark, f"{tmp_path}/none.json").collect()

    said = spark.createDataFrame([(1, 'a "b"\tc', 0.5), (2, None, None)], "id int, note string, v double")
    tables.write_delimited(said, f"{tmp_path}/out", ["v", "id", "note"])
    back = tables.read_delimited(spark, f"{tmp_path}/out", "v double, id int, note string", ["id", "note"])
    assert {tuple(r) for r in back.collect()} == {(1, 'a "b"\tc'), (2, None)}
    (tmp_path / "lines.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n   \n')
    assert sorted(r.id for r in tables.read_json_lines(spark, f"{tmp_path}/lines.jsonl", "id int").collect()) == [1, 2]

    for sample, text in {"s1": "Name\tLength\tTPM\na\t5\t1.5\nb\t6\t2\n", "s2": "Name\tLength\tTPM\nb\t6\t7\n"}.items():
        (tmp_path / sample).mkdir()
        (tmp_path / sample / "quant.sf").write_text(text)
    got = tables.merged_quantities(spark, str(tmp_path), "TPM", ["s1", "s2"])
    assert {tuple(r) for r in got.select("Name", "s1", "s2").collect()} == {("a", "1.5", "0"), ("b", "2", "7")}
    with pytest.raises(ValueError):
        tables.merged_quantities(spark, str(tmp_path), "Reads", ["s1"])


def test_confident(spark):
    rows = spark.createDataFrame([(1, "3", "0.01", "mk l"), (2, "5", "0.001", "MKL"), (3, "x", "0", "A"), (4, "", "0", "B"), (5, "9", "", "C"), (6, "9", "0.5", "D"), (7, "9", "0", " "), (8, "9", "0", None), (9, "2.5", "0", "E")], "i int, p string, f string, s string")
    assert sorted(tuple(r) for r in tables.confident(rows, "p", "f", "s", "i", 2.0, 0.1).collect()) == [(1, "MKL"), (9, "E")]
