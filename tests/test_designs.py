"""Frontier, generation, edits, comparisons, reviews, clusters and hits against plain computations and hand values."""

import os
import random
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from codonloom.functions.codes import code
from codonloom.operators import clusters, compare, edits, frontier, generate, ranges, review, scans
from codonloom.streaming import events as stream

CODE = code()
WEIGHTS = {c: 0.05 + random.Random(c).random() for c, a in CODE.items() if a != "*"}


def proteins(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, aa string")


def table(spark, weights=WEIGHTS):
    rows = [(c, a, weights.get(c), weights.get(c) or 0.0) for c, a in CODE.items()]
    return spark.createDataFrame(rows, "codon string, aa string, w double, frequency double").withColumn("per_thousand", F.col("frequency") * 10)


def best_logs(protein, weights):
    """The frontier residue by residue: best scaled log weight of each G and C total."""
    states = {0: 0}
    for a in protein:
        new = {}
        for g, l in states.items():
            for c, x in CODE.items():
                if x == a and weights.get(c, 0) > 0:
                    k = g + sum(b in "GC" for b in c)
                    new[k] = max(new.get(k, -(10**30)), l + round(log(weights[c]) * frontier.SCALE))
        states = new
    return states


@pytest.mark.parametrize("odd", [{}, {c: 0.5 for c in WEIGHTS}, {"CTA": 0.0, "CTT": 0.0, "TTG": 0.001, "TTA": 1.0, "CTG": 0.9}, {"CGT": 0.0, "CGA": 0.0, "AGG": 0.0, "AGA": 0.7}])
def test_frontier_equals_a_walk_over_residues(spark, odd):
    weights, rng = WEIGHTS | odd, random.Random(3)
    kinds = frontier.Kinds(weights)
    assert kinds.rounds or len(odd) in (0, 61)
    texts = ["".join(rng.choice(frontier.KINDS) for _ in range(rng.randint(1, 40))) for _ in range(6)] + ["LLLLLRRRR", "MB", "", "MAK*"]
    df = proteins(spark, *texts)
    states, back = frontier.frontier(df, kinds)
    found = {}
    for r in states.collect():
        found.setdefault(r["seq_id"], {})[r["g"]] = r["l"]
    want = {i: best_logs(t.rstrip("*"), weights) for i, t in enumerate(texts) if t and "B" not in t}
    assert found == want
    chosen = [(i, rng.choice(sorted(s))) for i, s in want.items()]
    made = {r["seq_id"]: r["cds"] for r in frontier.rebuilt(spark.createDataFrame(chosen, "seq_id long, g long"), back, df, kinds).collect()}
    for i, g in chosen:
        codons = [made[i][k : k + 3] for k in range(0, len(made[i]), 3)]
        assert "".join(CODE[c] for c in codons) == texts[i].rstrip("*") and sum(b in "GC" for b in made[i]) == g
        assert sum(round(log(weights[c]) * frontier.SCALE) for c in codons) == want[i][g]


def test_frontier_bounds_and_infeasible_ranges(spark):
    weights = {"ATG": 1.0, "GCT": 0.5, "GCC": 1.0, "GCA": 0.4, "GCG": 0.8, "AAA": 1.0, "AAG": 0.9}
    states, _ = frontier.frontier(proteins(spark, "MA", "MK"), frontier.Kinds(weights))
    found = {(r["seq_id"], r["range"]): (r["feasible"], r["cai"]) for r in frontier.under_ranges(states, {"a": (50, 70), "b": (90, 100), "c": (16, 34), "d": (0, 100)}).collect()}
    assert found[0, "a"] == (True, 1.0) and found[1, "b"] == (False, None) and found[1, "c"][0] and found[1, "d"][1] >= found[1, "c"][1]


def test_every_method_keeps_the_protein(spark):
    weights, rng = table(spark), random.Random(1)
    aa = proteins(spark, *["".join(rng.choice(frontier.KINDS) for _ in range(n)) for n in (1, 30, 200, 700)])
    made = [
        generate.greedy(aa, weights), generate.random_synonymous(aa, 2), generate.gc_target(aa, weights), generate.balanced(aa, weights), generate.assembly_friendly(aa, weights),
        generate.weighted_clean(aa, weights, 12), generate.steered_clean(aa, weights, attempts=12), generate.ramped(generate.balanced(aa, weights), weights), generate.second_codon(generate.greedy(aa, weights), weights),
    ]
    for df in made:
        rows = df.withColumn("back", generate.protein_of(F.col("codes"))).withColumn("cds", generate.spelt(F.col("codes"))).collect()
        assert len(rows) >= 4 and all(r["back"] == r["aa"] == "".join(CODE[r["cds"][k : k + 3]] for k in range(0, len(r["cds"]), 3)) for r in rows), rows[0]["method"]
    again = generate.assembly_friendly(aa.repartition(3), weights)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, made[4].collect()))


def test_steering_pulls_gc_to_its_target(spark):
    aa = proteins(spark, *["".join(random.Random(k).choice("ARNDCQEGHILKFPSTV") for _ in range(300)) for k in range(8)])
    flat = table(spark, {c: 0.5 for c in WEIGHTS})
    gc = lambda df: df.select(F.avg(generate.gc_share(F.col("codes")))).first()[0]
    low, high = (gc(generate.steered_clean(aa, flat, target, 1)) for target in (35.0, 60.0))
    assert low < high


def test_attempts_stop_at_the_first_clean_one(spark):
    aa, flat = proteins(spark, *["GLGLETGSEDV" * 12] * 5), table(spark, {c: 0.5 for c in WEIGHTS})
    clean = generate.weighted_clean(aa, flat, 50).withColumn("sites", generate.site_count(F.col("codes"))).collect()
    tried = {}
    for n in range(50):
        numbers = generate.draws("weighted|320", F.col("seq_id"), F.lit(n), F.length("aa"))
        rows = aa.join(generate.shares_table(flat)).withColumn("codes", generate.drawn(F.col("aa"), numbers, F.col("table"))).withColumn("sites", generate.site_count(F.col("codes")))
        for r in rows.collect() if len([x for x in tried.values() if x[1] == 0]) < 5 else []:
            if tried.get(r["seq_id"], (None, 1))[1]:
                tried[r["seq_id"]] = (r["codes"], r["sites"])
    assert {r["seq_id"]: (r["codes"], r["sites"]) for r in clean} == tried


def test_failed_proteins_are_error_rows(spark):
    weights = table(spark)
    rows = generate.run_methods(proteins(spark, "MAK", "MBXA", ""), weights, {"greedy_cai": lambda p: generate.greedy(p, weights)}, spark.createDataFrame([(0, "ATGGCTAAA"), (1, "ATGNNN"), (0 + 7, "ATG")], "seq_id long, dna string")).collect()
    found = {(r["seq_id"], r["method"]): r for r in rows}
    assert found[0, "native_reference"]["biological_pass"] and found[0, "greedy_cai"]["status"] == "ok"
    bad = found[1, "greedy_cai"]
    assert bad["status"] == "error" and bad["error"] == "no codon for: B,X" and bad["cai"] is None and bad["multi_pass"] is False and found[2, "greedy_cai"]["error"] == "empty protein"


EVEN = {c: 0.5 for c in CODE}


@pytest.mark.parametrize(
    "seq,sites,frequencies,cds,removed,unresolved",
    [
        ("ATGGAATTCGAGTAA", {"EcoRI": "GAATTC"}, EVEN, "ATGGAGTTCGAGTAA", [("EcoRI", 3, "GAA->GAG")], []),
        ("GGACTC", {"Custom": "GGACTC"}, {"GGA": 0.1, "GGT": 0.9, "GGC": 0.8}, "GGCCTC", [("Custom", 0, "GGA->GGC")], []),
        ("ATGGCCTAA", {"Boundary": "CCTAA"}, EVEN, "ATGGCCTAA", [], [("Boundary", 4, "outside_cds")]),
        ("ATGGGATGA", {"Stop": "ATGA"}, EVEN, "ATGGGATGA", [], [("Stop", 5, "outside_cds")]),
        ("ATGTGG", {"Fixed": "ATGTGG"}, EVEN, "ATGTGG", [], [("Fixed", 0, "no_synonymous_substitution")]),
    ],
)
def test_site_removal(spark, seq, sites, frequencies, cds, removed, unresolved):
    (r,) = edits.without_sites(spark.createDataFrame([(1, seq)], "seq_id long, cds string"), sites, frequencies).collect()
    assert r["cds"] == cds and [tuple(x) for x in r["removed"]] == removed and [(x["name"], x["position"], x["reason"]) for x in r["unresolved"]] == unresolved


def test_site_removal_keeps_proteins_and_brings_no_site(spark):
    rng = random.Random(4)
    sense = [c for c, a in CODE.items() if a != "*"]
    texts = ["".join(rng.choice(sense) for _ in range(40)) + "GAATTCGGTCTC" + "".join(rng.choice(sense) for _ in range(20)) for _ in range(25)] + ["ATGG", "ATGTAAATG", "ATGNNN"]
    seqs = spark.createDataFrame(list(enumerate(texts)), "seq_id long, cds string")
    sites = {"EcoRI": "GAATTC", "PstI": "CTGCAG"}
    done = {r["seq_id"]: r for r in edits.without_sites(seqs, sites, EVEN).collect()}
    back = lambda s: "".join(CODE.get(s[k : k + 3], "X") for k in range(0, len(s) - 2, 3))
    assert [done[i]["error"] for i in (25, 26, 27)] == ["frame", "internal_stop", "invalid_base"]
    for i, t in enumerate(texts[:25]):
        r = done[i]
        assert back(r["cds"]) == back(t) and ("GAATTC" not in r["cds"] or r["unresolved"])
    after = spark.createDataFrame([(i, r["cds"]) for i, r in done.items()], "seq_id long, cds string")
    every = sites | edits.BUILT_IN
    assert edits.new_findings(edits.findings(seqs, every), edits.findings(after, every)).count() == 0
    clean = edits.domesticated(seqs.limit(10), "golden_gate", EVEN, 20).filter("error is null").collect()
    assert all(not any(s in r["cds"] for s in ("GGTCTC", "GAGACC", "GAAGAC", "GTCTTC", "CGTCTC", "GAGACG")) or r["unresolved"] for r in clean)


def test_custom_sites_are_judged(spark):
    good, bad = edits.site_table(spark, [("a", "gaattc"), ("a", "GGATCC"), ("b", "GAATTC"), (None, "ACGU"), ("x", "AC"), ("y", "AXGT"), ("z", None)])
    assert {tuple(r) for r in good.collect()} == {("a", "GAATTC"), ("ACGT", "ACGT")}
    assert Counter(r["reason"] for r in bad.collect()) == Counter(["duplicate_name", "duplicate_sequence", "length", "invalid_base", "empty"])


def test_bootstrap_brackets_and_narrows(spark):
    def intervals(n):
        rows = [(m, i, bool(random.Random(f"{m}{i}").random() < p)) for m, p in (("a", 0.7), ("b", 0.3)) for i in range(n)]
        df = spark.createDataFrame(rows, "method string, seq_id long, multi_pass boolean")
        return {r["what"]: r for r in compare.bootstrap(df, 150, against={"a": ["b"]}).collect()}

    small, large = intervals(60), intervals(1500)
    for found in (small, large):
        assert all(r["lower"] <= r["observed"] <= r["upper"] for r in found.values()) and set(found) == {"a", "b", "a - b"}
    assert all(large[k]["upper"] - large[k]["lower"] < 0.5 * (small[k]["upper"] - small[k]["lower"]) for k in small)


def test_layers_pivots_and_differences(spark):
    rows = [("r", 1, True, 0.5, "ok"), ("r", 1, False, 0.7, "ok"), ("r", 2, True, 0.9, "ok"), ("g", 1, True, 1.0, "ok"), ("g", 2, False, None, "error")]
    df = spark.createDataFrame(rows, "method string, seq_id long, p boolean, cai double, status string").withColumns({c: F.col("p") for c in compare.RATES})
    found = {r["layer"]: r for r in compare.layer_summary(df, {"L0": "r", "L1": "g"}).collect()}
    assert (found["L0"]["multi_rate"], found["L0"]["mean_cai"], found["L0"]["n_sequences"]) == (0.75, 0.75, 2) and (found["L1"]["multi_rate"], found["L1"]["n_errors"]) == (1.0, 1)
    summary = spark.createDataFrame([("A", "m", 0.5, "x"), ("B", "m", 0.25, "x"), ("A", "n", 0.1, "x")], "profile_id string, method string, mean_cai double, note string")
    long = compare.long_metrics(summary)
    assert {(r["method"], r["shift_B_vs_A"]) for r in compare.shifts(long, ["A", "B"]).collect()} == {("m", -0.25), ("n", None)}
    a, b = (long.filter(F.col("profile_id") == x) for x in "AB")
    both = compare.differences(a, b)
    assert {(r["method"], r["diff"], r["match"]) for r in both.collect()} == {("m", -0.25, False), ("n", None, None)}
    assert tuple(compare.verdict(both).first()) == ("DIVERGED", 1, 1, 1) and compare.verdict(compare.differences(a, a)).first()["verdict"] == "PASS"


def test_reviews_and_dispositions(spark):
    seqs = spark.createDataFrame([(1, "ATG" + "GCT" * 30 + "GGTCTC" + "GCT" * 10 + "TAA", 0.9), (2, "ATGGCTGAACTGTTTGGT" * 2, 0.9), (3, "ATGGCTGAA", 0.9)], "seq_id long, cds string, cai double")

    def decide(*overrides):
        rows = [(c, m, low, high, None, None) for c, m, low, high in overrides]
        rules, bad = review.criteria(spark, spark.createDataFrame([("overall_gc", None, 0.0, 100.0, None, None), *rows], review.CRITERIA))
        return review.review(seqs, rules, ("seq_id",)), bad

    off = [(c, "ignored", None, None) for c in ("local_gc", "homopolymers", "forbidden_motifs")]
    (matrix, first), _ = decide()
    assert first.filter("seq_id = 1").first()["decision"] == "FAIL" and matrix.count() == 21
    (_, softer), _ = decide(("type_iis", "preferred", None, None))
    assert softer.filter("seq_id = 1").first()["decision"] == "CONDITIONAL_PASS"
    (_, none), _ = decide(("type_iis", "ignored", None, None), ("repeats", "ignored", None, None), *off)
    assert {r["decision"] for r in none.collect()} == {"PASS"} and none.first()["explanation"] == "All active acceptance criteria passed."
    (_, repeat), _ = decide(("type_iis", "ignored", None, None), *off)
    assert repeat.filter("seq_id = 2").first()["explanation"] == "repeats require review."
    _, bad = decide(("cai", "blocking", None, None), ("local_gc", None, 80.0, 20.0), ("nothing", None, None, None))
    assert {r["criterion"] for r in bad.collect()} == {"cai", "local_gc", "nothing"}
    said = spark.createDataFrame([(1, "accept_with_exception", ""), (2, "accept", None), (3, "perhaps", "x")], "seq_id long, disposition string, reason string")
    final, refused = review.disposed(first, said, ("seq_id",))
    assert {r["seq_id"] for r in refused.collect()} == {1, 3} and {r["seq_id"]: r["final_state"] for r in final.collect()}[1] is None
    final, refused = review.disposed(first, said.withColumn("reason", F.lit("because")).filter("seq_id < 3"), ("seq_id",))
    assert refused.count() == 0 and {r["seq_id"]: (r["final_state"], r["decision"]) for r in final.collect()}[1] == ("MANUALLY_ACCEPTED", "FAIL")


def test_clusters_find_nine_of_ten_links(spark):
    rng, rows = random.Random(6), []
    for f in range(12):
        base = [rng.choice(frontier.KINDS) for _ in range(200)]
        for _ in range(8):
            near = list(base)
            for k in rng.sample(range(200), 5):
                near[k] = rng.choice(frontier.KINDS)
            rows.append("".join(near))
    rows += ["".join(rng.choice(frontier.KINDS) for _ in range(200)) for _ in range(20)] + [rows[0], "MK", "MK", ""]
    found = {r["seq_id"]: r["cluster"] for r in clusters.clustered(proteins(spark, *rows)).collect()}
    words = [{r[k : k + clusters.WORD] for k in range(len(r) - clusters.WORD + 1)} for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if words[a] and len(words[a] & words[b]) >= 0.5 * len(words[a] | words[b]) or rows[a] == rows[b]]
    assert len(links) > 100 and sum(found[a] == found[b] for a, b in links) >= 0.9 * len(links)
    root = list(range(len(rows)))
    for a, b in links * 12:
        root[a] = root[b] = min(root[a], root[b])
    assert all(root[a] == root[b] for a in range(len(rows)) for b in range(a) if found[a] == found[b])  # never more than all links join


def test_cluster_split_fills_eval_with_whole_clusters(spark):
    rows = [(i, c) for c, n in ((0, 6), (10, 6), (20, 3), (30, 1)) for i in range(c, c + n)]
    found = {r["seq_id"]: r["split"] for r in clusters.cluster_split(spark.createDataFrame(rows, "seq_id long, cluster long"), 0.5).collect()}
    assert {i for i, s in found.items() if s == "eval"} == {*range(6), *range(10, 16)}
    lone = clusters.cluster_split(spark.createDataFrame([(1, 1), (2, 1)], "seq_id long, cluster long"), 0.5).collect()
    assert {r["seq_id"]: r["split"] for r in lone} == {1: "eval", 2: "train"}


def test_hits_across_pieces(spark):
    contig = "".join(random.Random(2).choice("ACGT") for _ in range(1000))
    pieces = clusters.pieces_of(spark.createDataFrame([("c", contig)], "contig string, seq string"), 64)
    hits = spark.createDataFrame([(1, "q", "c", 60, 300, 0.0), (2, "q", "c", 300, 60, 0.0), (3, "q", "c", 990, 1200, 0.0), (4, "q", "x", 1, 5, 0.0), (5, "q", "c", 1, 5, 1.0), (6, "q", "c", 64, 64, 0.0)], "hit_id long, query string, contig string, start long, end long, evalue double")
    found = {r["hit_id"]: r["seq"] for r in clusters.cut_hits(hits, pieces, size=64).collect()}
    assert found == {1: contig[59:300], 2: edits.complement(contig[59:300]), 3: contig[989:], 6: contig[63]}


def test_tandem_repeats_equal_a_walk(spark):
    def walk(s):
        found, spans = [], set()
        for m in range(2, 7):
            i = 0
            while i <= len(s) - 3 * m:
                n = 1
                while s[i + n * m : i + n * m + m] == s[i : i + m]:
                    n += 1
                if n >= 3 and (i, i + n * m) not in spans:
                    found.append((i, i + n * m, s[i : i + m], n))
                    spans.add((i, i + n * m))
                i += n * m if n >= 3 else 1
        return sorted(found)

    rng = random.Random(9)
    texts = ["ATATATGCGC", "AAAAAAAAAAAA", "", "ACACACACGTGTGTACGACGACG"] + ["".join(rng.choice("AC") for _ in range(80)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id long, dna string")
    found = {}
    for r in scans.tandem_repeats(df).collect():
        found.setdefault(r["seq_id"], []).append((r["start"], r["end"], r["motif"], r["copies"]))
    assert all(sorted(found.get(i, [])) == walk(t) for i, t in enumerate(texts))


def test_ranks_within_keys_over_ranges(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", i * 37 % 101, i) for i in range(300)]
    got = {r["i"]: (r["r"], r["n"]) for r in ranges.numbered(spark.createDataFrame(rows, "key string, o long, i long").repartition(5), "key", ["o", "i"]).collect()}
    for key in {r[0] for r in rows}:
        own = sorted((o, i) for k, o, i in rows if k == key)
        assert [got[i] for _, i in own] == [(n + 1, len(own)) for n in range(len(own))]


def test_reviewed_stream_survives_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "ATGTAAGCC"), (2, "ATGG"), (3, "ATGG")], "seq_id long, dna string").coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema("seq_id long, dna string").parquet(source)
    stream.review_into(read(), out, state).awaitTermination()
    os.remove(f"{state}/commits/0")  # the batch was written, but the driver died before it said so
    for x in (f"{state}/commits/.0.crc",):
        os.path.exists(x) and os.remove(x)
    spark.createDataFrame([(4, "GCATAT"), (5, "ATGG")], "seq_id long, dna string").coalesce(1).write.mode("append").parquet(source)
    stream.review_into(read(), out, state).awaitTermination()
    found = sorted((r["seq_id"], r["verdict"]) for r in stream.read_results(spark, out).collect())
    assert found == [(1, "STOP"), (2, "FRAME"), (4, "GC")]
