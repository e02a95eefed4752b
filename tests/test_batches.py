"""Steps over Arrow batches against plain computations, residue by residue."""

import os
import random
from hashlib import md5
from itertools import groupby
from math import exp, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonloom.functions.codes import TYPE_IIS, code
from codonloom.operators import batches, clusters, compare, dinucleotides, edits, frontier, generate, intake, review, scans, scoring, usage
from codonloom.sources import staging

CODE = code()
WEIGHTS = {c: 0.05 + random.Random(c).random() for c, a in CODE.items() if a != "*"}
CHOICES = {a: sorted(c for c in CODE if CODE[c] == a) for a in CODE.values()}


def table(spark):
    rows = [(c, a, WEIGHTS.get(c), WEIGHTS.get(c) or 0.0) for c, a in CODE.items()]
    return spark.createDataFrame(rows, "codon string, aa string, w double, frequency double").withColumn("per_thousand", F.col("frequency") * 10)


def proteins(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (1, 7, 8, 9, 64, 300)] + [""]
    return texts, spark.createDataFrame(list(enumerate(texts)), "seq_id long, aa string")


def spelt(df):
    return {(r["seq_id"], r["replicate"]): r["cds"] for r in df.withColumn("cds", generate.spelt(F.col("codes"))).collect()}


def draw(i, n, k, seed=320):
    return int(md5(f"{seed}|{i}|{n}|{k // 8}".encode()).hexdigest()[4 * (k % 8) :][:4], 16)


def test_random_codons_follow_their_draws(spark):
    texts, df = proteins(spark)
    want = {(i, n): "".join(CHOICES[a][draw(i, n, k) % len(CHOICES[a])] for k, a in enumerate(t)) for i, t in enumerate(texts) for n in range(2)}
    made = generate.random_synonymous(df, 2)
    assert spelt(made) == want
    assert "lambda" not in made._jdf.queryExecution().toString().lower()  # no step for every codon is left to an expression


def test_gc_target_walks_each_row(spark):
    texts, df = proteins(spark)
    want = {}
    for i, t in enumerate(texts):
        cds = ""
        for a in t:
            cds += min(CHOICES[a], key=lambda c: (abs(round(sum(b in "GC" for b in cds + c) * 100 / len(cds + c) + 1e-9, 2) - 43.5), -WEIGHTS[c], c))
        want[i, 0] = cds
    assert spelt(generate.gc_target(df, table(spark))) == want


def test_scores_of_made_and_of_given_sequences(spark):
    weights, (texts, df) = table(spark), proteins(spark)
    made = generate.random_synonymous(df, 1)
    given = made.select("seq_id", "aa", "method", "replicate", generate.spelt(F.col("codes")).alias("cds"))
    rows = generate.score(made, weights).orderBy("seq_id").collect()
    assert rows == generate.score(given, weights).select(*rows[0].__fields__).orderBy("seq_id").collect()
    for r, t in zip(rows, texts):
        cds = r["cds"]
        codons = [cds[k : k + 3] for k in range(0, len(cds), 3)]
        assert r["cai"] == (round(exp(sum(log(WEIGHTS[c]) for c in codons) / len(codons)), 6) if t else 0.0) and r["identity"] == (1.0 if t else 0.0)
        assert r["gc"] == (round(sum(b in "GC" for b in cds) * 100 / len(cds), 2) if t else 0.0) and r["biological_pass"]
        assert r["sites"] == sum(cds.startswith(s, k) for pair in TYPE_IIS.values() for s in pair for k in range(len(cds)))
    odd = spark.createDataFrame([(1, "MK", "ATGAA"), (2, "MK", "ATGTAAAAA"), (3, "MK", None), (4, "MA", "ATGNCC"), (5, "MK*", "ATGAAATAA"), (6, "RLR", "CGTCTCGTCTC" + "G")], "seq_id long, aa string, cds string")
    found = {r["seq_id"]: r for r in generate.score(odd, weights).collect()}
    assert [found[k]["biological_pass"] for k in range(1, 7)] == [False, False, False, False, True, False]
    assert found[1]["cai"] == 0.0 and found[3]["cai"] is None and found[3]["sites"] is None and found[4]["cai"] == 0.0 and found[6]["sites"] == 2 and found[2]["identity"] == 0.5


def test_draws_hash_blocks_together(spark, monkeypatch):
    """Before: a call of md5 for every eight residues."""
    keys, lengths = [b"a|1", b"", b"k" * 40, b"k" * 52, b"k" * 53, b"k" * 70, b"steered|320|7000001|49"], np.array([1, 0, 9, 170, 30, 9, 9000])
    plain = [int(md5(k + b"|%d" % (i // 8)).hexdigest()[4 * (i % 8) :][:4], 16) for k, n in zip(keys, lengths.tolist()) for i in range(n)]
    assert batches.draws(keys, lengths).tolist() == plain and batches.draws([], lengths[:0]).tolist() == []
    monkeypatch.setattr(batches, "md5", None)
    assert batches.draws(keys[:3], lengths[:3]).tolist() == plain[:10]


def test_sites_of_codon_letters_are_those_of_their_bases():
    rng, sites = random.Random(4), [x.encode() for pair in TYPE_IIS.values() for x in pair] + [b"GGTCTC", b"AAAAA"]
    held = batches.Texts.of(["".join(rng.choice(generate.LETTERS) for _ in range(n)) for n in (0, 1, 2, 3, 2000, 5)] + [generate.letter_of("AAA") * 4, generate.NO_CODON * 3])
    bases = batches.spelt(held, generate.BASES)
    table = batches.site_table(sites, generate.WORDS)
    assert batches.codon_sites(held, generate.NUMBERS, table).tolist() == batches.site_counts(bases, sites).tolist()


def test_attempts_made_together_or_given_up_change_nothing(spark, monkeypatch):
    """Before: an attempt with a site was made to its end, one round of attempts at a time."""
    rng, weights = random.Random(12), table(spark)
    texts = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (900, 700, 400, 400, 60, 3)] + ["", "MB"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, aa string").coalesce(1)
    run = lambda n: spelt(generate.steered_clean(df, weights, attempts=n))
    found, steps = run(6), batches.steered
    monkeypatch.setattr(generate, "WORTH", 0)
    monkeypatch.setattr(batches, "steered", lambda *a: steps(*a[:6]))
    assert run(6) == found and all(len(v) == 3 * len(texts[i]) for (i, _), v in found.items() if v is not None)


def test_one_scoring_for_several_tables(spark):
    """Before: candidates were written and scored once for each codon table, and their bases came back though nothing read them."""
    weights, (_, df) = table(spark), proteins(spark)
    other = weights.withColumn("w", F.when(F.col("codon") != "GCC", F.sqrt("w")))
    made = generate.random_synonymous(df, 2)
    plain = [generate.score(made, w).drop("cds").orderBy("seq_id", "replicate") for w in (weights, other)]
    both = generate.score(made, weights, bases=False, others={"x": other}).orderBy("seq_id", "replicate")
    assert both.drop("cai_x").collect() == plain[0].collect() and [r["cai_x"] for r in both.collect()] == [r["cai"] for r in plain[1].collect()]
    given = spark.createDataFrame([(1, "MK", "ATGAA"), (2, "MK", None), (3, "MA", "ATGNCC")], "seq_id long, aa string, cds string")
    assert generate.score(given, weights, bases=False).collect() == generate.score(given, weights).drop("cds").collect()


def test_plain_bases_are_reviewed_as_they_are(spark):
    """Before: every sequence was rewritten letter by letter, and letters were sorted to be numbered."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT") for _ in range(300)) + "ACGTTGCAACGTTGCAACGTT" * 2 for _ in range(4)]
    odd = [" ".join([t[:50].lower(), t[50:].replace("T", "u") + "\n"]) for t in texts]
    rules, _ = review.criteria(spark)
    known = {r["criterion"]: r.asDict() for r in rules.collect()}
    rows = lambda ts: spark.createDataFrame([(i, 0.5, t) for i, t in enumerate(ts)], "seq_id long, cai double, cds string").coalesce(1)
    seen = [[r["seen"] for r in review.measures(rows(ts), known).orderBy("seq_id").collect()] for ts in (texts, odd)]
    assert seen[0] == seen[1] and all(x[4]["high"] > 0 for x in seen[0])
    plan = review.measures(rows(texts), known)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and batches.words(batches.Texts.of(["ACCA", "N"]), 2).tolist()[0] != batches.words(batches.Texts.of(["ACCA", "N"]), 2).tolist()[1]


@pytest.mark.parametrize("odd", [{}, {"CTA": 0.0, "CTT": 0.0, "TTG": 0.001, "TTA": 1.0, "CTG": 0.9}])
def test_best_sequences_are_written_over_batches(spark, odd):
    """Before: a step of a lambda for every residue."""
    kinds, (_, df) = frontier.Kinds(WEIGHTS | odd), proteins(spark)
    made = frontier.best_sequences(df, kinds, 40.0, 60.0)
    chosen = frontier.best_states(df, kinds, {"": (40.0, 60.0)}).filter("feasible").drop("g").withColumnRenamed("rest", "g")
    found = sorted(map(tuple, made.collect()))
    assert found and found == sorted(map(tuple, frontier.written(chosen, kinds).collect()))
    assert "lambda" not in made._jdf.queryExecution().toString().lower()


def test_sites_across_two_rows_are_none():
    held = batches.Texts.of(["GGT", "CTC", "", "AGGTCTC", None])
    assert batches.site_counts(held, [b"GGTCTC"]).tolist() == [0, 0, 0, 1, 0] and batches.sums(np.ones(13), held).tolist() == [3, 3, 0, 7, 0]


def test_sites_are_edited_within_the_row(spark):
    seqs = spark.createDataFrame([(1, "ATGGAATTCGAATTCTAA"), (2, None), (3, "ATGGCC" + "GAATTC" * 12 + "AAATAA")], "seq_id long, cds string")
    done = edits.without_sites(seqs, {"EcoRI": "GAATTC"}, {c: 0.5 for c in CODE}, rounds=10)
    assert "lambda" not in done._jdf.queryExecution().toString().lower()  # before: a written table a round
    found = {r["seq_id"]: r for r in done.collect()}
    assert found[1]["cds"] == "ATGGAGTTCGAGTTCTAA" and [x["position"] for x in found[1]["removed"]] == [3, 9] and found[2]["cds"] is None and found[2]["removed"] == []
    assert len(found[3]["removed"]) == 10 and [x["reason"] for x in found[3]["unresolved"]] == ["max_iter_reached"] * 2


def test_blended_halves_go_up(spark):
    """Quotients just below a half, which SQL's scaled rounding takes up."""
    low = [k for k in range(1, 5000) if repr(k / 10000 * 1000 / 2)[-1] == "9" and k / 10000 * 1000 / 2 * 10 % 1 == 0.5][:3]
    assert len(low) == 3
    for k in low:
        df = spark.createDataFrame([("AAA", "K", k / 10000), ("AAG", "K", 1 - k / 10000)], "codon string, aa string, frequency double")
        assert {r["codon"]: r["per_thousand"] for r in scoring.blended(df, df).collect()}["AAA"] == (k * 10 // 2 + 5) // 10 / 10


def test_sketches_rule_out_no_link(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ACDEFGHIKL") for _ in range(4))
    base = ["".join(word() for _ in range(60)) for _ in range(8)]
    texts = base + [b[: 240 - n] + "".join(word() for _ in range(n // 4)) for b in base for n in (20, 60, 100, 160)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, aa string")
    words = [{t[k : k + 9] for k in range(len(t) - 8)} for t in texts]
    every = clusters.sketched(clusters.signatures(df, "aa"), "aa")
    both = every.select(F.col("seq_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bitsa")).crossJoin(every.select(F.col("seq_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bitsb"))).filter("a < b")
    rows = both.select("a", "b", "na", "nb", clusters.most_common("a", "b").alias("most")).collect()
    common = {(r["a"], r["b"]): len(words[r["a"]] & words[r["b"]]) for r in rows}
    assert all(r["most"] >= common[r["a"], r["b"]] for r in rows)
    apart = [r for r in rows if common[r["a"], r["b"]] == 0]
    assert apart and all(r["most"] < 0.5 * (r["na"] + r["nb"] - r["most"]) for r in apart)  # so their words are never sent
    found = {tuple(r) for r in clusters.linked(df).collect()}
    assert all(2 * common[p] >= len(words[p[0]] | words[p[1]]) for p in found) and len(found) >= 8


def test_clusters_leave_only_themselves(spark, monkeypatch):
    """In rounds the same clusters are found, and what was made on the way is gone: before, every step's tables and shuffles stayed on the disk."""
    rng = random.Random(9)
    base = ["".join(rng.choice("ACDEFGHIKL") for _ in range(120)) for _ in range(12)]
    texts = base + [b[:100] + b[::-1][:n] for b in base for n in (5, 20)] + [b[:60] for b in base] + base[:3] + ["ÄÖ" + base[0], "MK", None]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, aa string").repartition(5)
    folder = staging.shared_dir(spark).removeprefix("file://")
    found, before = [], set(os.listdir(folder))
    for few in (clusters.FEW, 0):
        monkeypatch.setattr(clusters, "FEW", few)
        found.append({tuple(r) for r in clusters.clustered(df).collect()})
    assert found[0] == found[1] and 12 <= len({c for _, c in found[0]}) < 20
    assert all(name.startswith("clusters-") for name in set(os.listdir(folder)) - before)
    signed = {r["seq_id"]: r for r in clusters.signatures(df, "aa").collect()}
    words = clusters.word_hashes(texts, clusters.WORD)
    for t in (clusters.once(words), clusters.minimizers(words, clusters.SPAN)):
        kind = "words" if len(t.letters) == len(clusters.once(words).letters) else "keys"
        assert [t.take(np.array([i])).letters.tolist() for i in signed] == [sorted(r[kind]) for r in signed.values()]


@pytest.mark.parametrize("odd", [{}, {"CTA": 0.0, "CTT": 0.0, "TTG": 0.001, "TTA": 1.0, "CTG": 0.9}])
def test_frontier_within_rows_equals_its_rounds(spark, odd):
    """The queries of the frontier use the rows' own arrays: before, three states a residue were written for each kind of residue."""
    kinds, rng = frontier.Kinds(WEIGHTS | odd), random.Random(6)
    texts = ["".join(rng.choice(frontier.KINDS) for _ in range(rng.randint(1, 40))) for _ in range(8)] + ["LLLLLRRRR", "MB", "", "MAK*"]
    df, spans = spark.createDataFrame(list(enumerate(texts)), "seq_id long, aa string"), {"a": (40.0, 47.0), "b": (0.0, 100.0), "c": (99.5, 99.6)}
    states, back = frontier.frontier(df, kinds)
    rows = lambda x: sorted(map(tuple, x.select("seq_id", "range", "feasible", "g", F.round("cai", 9)).collect()), key=str)
    assert rows(frontier.ranges_of(df, kinds, spans)) == rows(frontier.under_ranges(states, spans))
    chosen = frontier.under_ranges(states, {"a": spans["a"]}).filter("feasible").select("seq_id", "g")
    assert sorted(map(tuple, frontier.best_sequences(df, kinds, *spans["a"]).collect())) == sorted(map(tuple, frontier.rebuilt(chosen, back, df, kinds).collect()))


ODD_TEXTS = ["", "A", "ACGT" * 20, "GGTCTC" * 12, "ATATATATATCGCGCGCGA" * 4, "N" * 70 + "ACGTAC", "".join(random.Random(3).choice("ACGTN") for _ in range(400)), "CAGCAGCAGCAGAAAAAAAAACAG" * 3]


def test_reviews_are_made_of_batches_as_of_rows(spark):
    rules, _ = review.criteria(spark)
    seqs = spark.createDataFrame([(i, s, 0.9) for i, s in enumerate([*ODD_TEXTS, None])], "seq_id long, cds string, cai double")
    matrix, decisions = review.review(seqs, rules, ("seq_id",))
    assert "lambda" not in review.measures(seqs, {r["criterion"]: r.asDict() for r in rules.collect()})._jdf.queryExecution().toString().lower()
    got = {(r["seq_id"], r["criterion"]): (r["low"], r["high"]) for r in matrix.collect()}
    gc = lambda s: sum(b in "GC" for b in s) * 100.0 / len(s) if s else 0.0
    for i, s in enumerate(ODD_TEXTS):
        last = max(len(s) - 60, 0)
        windows = [gc(s[k : k + 60]) for k in {*range(0, last + 1, 30), last}]
        words = [s[k : k + 18] for k in range(len(s) - 17)] if len(s) >= 36 else []
        places = lambda ms: float(sum(s.startswith(m, k) for m in ms for k in range(len(s))))
        run = float(max((len(list(g)) for x, g in groupby(s) if x in "ACGT"), default=0))
        want = {"overall_gc": (gc(s),) * 2, "local_gc": (min(windows), max(windows)), "repeats": (float(sum(words.count(w) > 1 for w in set(words))),) * 2, "homopolymers": (run,) * 2,
                "type_iis": (places([x for pair in TYPE_IIS.values() for x in pair]),) * 2, "forbidden_motifs": (places(["AATAAA", "GTAAGT", "ATTTA"]),) * 2}
        assert {c: got[i, c] for c in want} == want
    assert got[len(ODD_TEXTS), "repeats"] == (None, None) and decisions.count() == len(ODD_TEXTS) + 1


def test_window_scans_and_means_are_made_of_batches(spark):
    seqs = spark.createDataFrame([(i, s) for i, s in enumerate(ODD_TEXTS)], "seq_id long, dna string")
    plans = [scans.gc_extremes(seqs), scans.local_gc(seqs), scans.dinucleotide_hotspots(seqs), usage.cai(seqs, table(spark)), usage.mean_weight(seqs, table(spark), 0.001)]
    for made in plans:
        said = made._jdf.queryExecution().toString().lower()
        assert "lambda" not in said and "window" not in said and "explode" not in said
    extremes, local, hot, adapted, floored = ({r[0]: tuple(r[1:]) for r in made.collect()} for made in plans)
    gc = lambda s: sum(b in "GC" for b in s)
    for i, s in enumerate(ODD_TEXTS):
        windows = [gc(s[k : k + 50]) for k in range(len(s) - 49)]
        assert local[i] == (" ".join(str(2 * g) for g in windows),)
        assert extremes.get(i) == ((sum(g * 100 < 1250 for g in windows), sum(g * 100 > 3750 for g in windows)) if len(s) >= 50 else None)
        size = min(len(s), 50)
        pairs = [[sum(s[j : j + 2] == x for j in range(k, k + size - 1)) / max(size, 1) > 0.05 for k in range(len(s) - size + 1)] for x in ("CG", "TA")]
        assert hot.get(i) == (tuple(map(sum, pairs)) if len(s) >= 2 else None)
        codons = [s[k : k + 3] for k in range(0, len(s) - 2, 3)]
        sense = [WEIGHTS.get(c) for c in codons if CODE.get(c) != "*"]
        fit = len(s) % 3 == 0 and sense and None not in sense
        assert adapted[i][0] == pytest.approx(exp(sum(map(log, sense)) / len(sense)) if fit else 0.0)
        assert floored[i][0] == pytest.approx(exp(sum(log(WEIGHTS.get(c, 0.001)) for c in codons) / len(codons)) if codons else 0.0)


def test_kept_records_are_those_of_the_filter(spark):
    rng = random.Random(9)
    texts = ["ATG" + "".join(rng.choice(["GCT", "GAA", "CTG", "AAA"]) for _ in range(n)) + rng.choice(["TAA", ""]) for n in (30, 30, 19, 40, 41, 5, 60)]
    rows = [(i, rng.choice(["g", "h", None]), "x", s + odd) for i, (s, odd) in enumerate((s, odd) for s in texts * 2 for odd in ("", "N", "A"))]
    seqs = spark.createDataFrame(rows, "seq_id long, gene string, header string, dna string")
    want = usage.cds_filter(seqs).filter("reason is null").select("seq_id", "gene", "cds")
    assert sorted(map(str, usage.kept_cds(seqs).collect())) == sorted(map(str, want.collect())) and want.count() > 3
    counts = {r["codon"]: r["n"] for r in usage.codon_counts(seqs, "dna").collect()}
    assert counts == {c: sum(s[k : k + 3] == c for *_, s in rows for k in range(0, len(s), 3)) for c in CODE}


def test_failures_weigh_rows_by_replicates(spark):
    rows = [("a", 1, True, True, True), ("a", 1, True, False, True), ("a", 2, False, True, True), ("b", 1, True, False, False)]
    df = spark.createDataFrame(rows, "method string, seq_id long, biological_pass boolean, gc_pass boolean, assembly_pass boolean").withColumn("multi_pass", F.expr("biological_pass and gc_pass and assembly_pass"))
    made = generate.failures(df)
    assert "expand" not in made._jdf.queryExecution().toString().lower()  # distinct sequences are not counted by doubled rows
    assert {(r["method"], r["category"]): r["weight"] for r in made.collect() if r["weight"]} == {("a", "passed"): 0.666667, ("a", "gc_only"): 0.666667, ("a", "biological"): 0.666667, ("b", "gc_and_sites"): 1.0}


def test_resamples_are_drawn_in_batches(spark):
    rows = [(m, i, (i * k) % 3 / 2) for i in range(40) for k, m in ((1, "a"), (2, "b"))]
    made = compare.resampled(spark.createDataFrame(rows, "method string, seq_id long, v double"), 30, 7)
    times = {(i, r): sum(int(md5(f"boot|7|{i}|{r}".encode()).hexdigest()[:8], 16) >= p for p in compare.POISSON) for i in range(40) for r in range(30)}
    got = {(x["method"], x["r"]): (x["s"], x["k"]) for x in made.collect()}
    for m in "ab":
        own = [(i, v) for n, i, v in rows if n == m]
        assert got[m, -1] == (sum(v for _, v in own), 40)
        assert all(got[m, r] == (sum(times[i, r] * v for i, v in own), sum(times[i, r] for i, _ in own)) for r in range(30))
    assert "lambda" not in made._jdf.queryExecution().toString().lower() and "explode" not in made._jdf.queryExecution().toString().lower()


def test_ramps_and_reports_are_made_of_batches(spark):
    texts, df = proteins(spark)
    made = generate.ramped(generate.random_synonymous(df, 1), table(spark))
    assert all("".join(CODE[c] for c in map("".join, zip(*[iter(s)] * 3))) == texts[i] for (i, _), s in spelt(made).items())
    report = intake.validation_report(df.withColumn("cds", F.lit("ATG" * 9)))
    fewer = dinucleotides.fewer_pairs(df.select("seq_id", F.lit("ATG" * 9).alias("cds")), WEIGHTS, WEIGHTS)
    assert [(r["repeats"], r["homopolymers"]) for r in report.collect()] == [(2, 0)] * len(texts)  # by threes and by sixes
    for plan in (made, report, fewer):
        assert "extract_all" not in plan._jdf.queryExecution().toString().lower()


def test_sequence_usage_exchanges_no_row_of_its_own_id(spark):
    rng = random.Random(23)
    rows = [(i, "".join(rng.choice("ACGTN") for _ in range(rng.choice((0, 2, 3, 50, 301))))) for i in range(40)] + [(None, "ACGACGT"), (5, "ACGACG"), (None, "ACG"), (5, "TTT"), (90, None), (91, "A\nC\u00e9\U0001f600G")]
    seqs = spark.createDataFrame(rows, "seq_id long, dna string")
    counts = {}
    for i, t in rows:
        for k in range(0, len(t or "") - 2, 3):
            key = (i, t[k : k + 3])
            counts[key] = counts.get(key, 0) + 1
    totals = {}
    for (i, _), n in counts.items():
        totals[i] = totals.get(i, 0) + n
    got = usage.sequence_usage(seqs).collect()
    assert len(got) == len(counts) and {(r["seq_id"], r["codon"]): (r["n"], r["frequency"]) for r in got} == {k: (n, n / totals[k[0]]) for k, n in counts.items()}
    top = usage.top_codons(seqs, 2).collect()
    want = {(i, c): counts[i, c] for i in totals for c in sorted((c for j, c in counts if j == i), key=lambda c: (-counts[i, c], c))[:2]}
    assert len(top) == len(want) and {(r["seq_id"], r["codon"]): r["n"] for r in top} == want
    alone = usage.sequence_usage(seqs.filter("seq_id < 5"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
