"""Hand values of the scans, and streams against the same frames read at once."""

import pytest
from pyspark.sql import functions as F

from codonloom.functions import scalar as p
from codonloom.operators import generate, scans
from codonloom.sources.corpus import sequences
from codonloom.streaming import events as stream

DIR = "/root/testdata/sf0.001"


def rows(spark, *texts, name="dna"):
    return spark.createDataFrame(list(enumerate(texts)), f"seq_id long, {name} string")


def test_every_letter_lies_in_one_piece(spark):
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    want = spark.read.parquet(f"{DIR}/documents.parquet").agg(F.sum(letters)).first()[0]
    found = sequences(spark, DIR).agg(F.sum(F.length("dna")), F.count("*"), F.countDistinct("seq_id")).first()
    assert found[0] == want and found[1] == found[2]


def test_invalid_codons(spark):
    found = rows(spark, "ATGNN", "ATGNNN", "ATG").select("seq_id", F.inline(p.invalid_codons(F.col("dna")))).collect()
    assert [(r["seq_id"], r["pos"], r["reason"]) for r in found] == [(0, 1, "partial"), (1, 1, "invalid_base")]


def test_rare_codon_runs(spark):
    weights = spark.createDataFrame([("AAA", 0.1), ("GCC", 1.0)], "codon string, w double")
    found = scans.rare_codon_runs(rows(spark, "AAAAAAGCC", "AAA" * 3 + "GCC", "GCC" + "AAA" * 5, "AAAAAATAAAAA", "A" * 10), weights).collect()
    assert {(r["seq_id"], r["codon_index"], r["run_length"], r["severity"]) for r in found} == {(1, 0, 3, "medium"), (2, 1, 5, "high")}


def test_tm_segments(spark):
    apart = "I" * 25 + "DEKRQNST" * 8
    found = {r["seq_id"]: r["tm_count"] for r in scans.tm_segments(rows(spark, apart * 3, "I" * 25 + "DEKR" * 8, "DEKRQNST" * 8, name="aa")).collect()}
    assert found == {0: 3, 1: 1}


@pytest.mark.parametrize("case", [(3, -1.0, True, "HIGH"), (1, 0.3, False, "HIGH"), (1, 0.9, True, "MEDIUM"), (0, 1.0, False, "LOW")])
def test_risk(spark, case):
    assert spark.range(1).select(p.risk(*map(F.lit, case[:3]))).first()[0] == case[3]


def test_gc_extremes_and_bounds(spark):
    found = scans.gc_extremes(rows(spark, "A" * 51, "G" * 50, "AC" * 30, "A" * 49)).collect()
    assert {r["seq_id"]: (r["n_low"], r["n_high"]) for r in found} == {0: (2, 0), 1: (0, 1), 2: (0, 0)}
    low, high = generate.gc_bounds(F.lit("MA"))
    assert tuple(spark.range(1).select(low, high).first()) == (3, 4)


def test_stream_equals_batch(spark):
    want = {tuple(r) for r in stream.window_counts(stream.read_events(spark, DIR)).collect()}
    live = stream.window_counts(stream.read_events(spark, DIR, stream=True))
    job = live.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    job.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == want


def test_stream_gives_each_key_once(spark):
    key = "event_type"
    events = stream.read_events(spark, DIR, stream=True)
    job = stream.once(events, key, "4000 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    job.awaitTermination()
    found = [r[key] for r in spark.table("once").collect()]
    assert len(found) == len(set(found)) == stream.once(stream.read_events(spark, DIR), key).count()


def test_overlapping_hits_are_all_found(spark):
    found = scans.motif_hits(rows(spark, "ATTTATTTATTTA", "CATTTA", "ATTT", ""), {"ATTTA": "x"}).collect()
    assert sorted((r["seq_id"], r["start"]) for r in found) == [(0, 0), (0, 4), (0, 8), (1, 1)]
    found = scans.motif_hits(rows(spark, "AAAAA"), {"AAA": "x"}).collect()
    assert sorted(r["start"] for r in found) == [0, 1, 2]


def test_scans_need_no_shuffle(spark):
    seqs = rows(spark, "ATGC" * 30)
    for found in (scans.polya(seqs), scans.polya_clusters(seqs), scans.at_runs(seqs), scans.homopolymers(seqs), scans.repeats(seqs), scans.gc_extremes(seqs), scans.splice_pairs(seqs)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_repeats_give_all_places(spark):
    found = scans.repeats(rows(spark, "ACGTA" + "TTTTT" + "ACGTA", "AAAAAA", "ACG"), 5).collect()
    assert {(r["seq_id"], r["kmer"], r["count"], r["first"], tuple(r["starts"])) for r in found} == {(0, "ACGTA", 2, 0, (0, 10)), (1, "AAAAA", 2, 0, (0, 1))}


@pytest.mark.parametrize("case", [("x gene=ab;c", "ab"), ("x GENE:q1|z", "q1"), ("mygene=no.3 y", "mygene=no"), ("transcript:t1.2 y", "t1"), ("Transcript:.5", None), ("a.b", "a.b"), ("", None)])
def test_gene_id(spark, case):
    assert spark.range(1).select(p.gene_id(F.lit(case[0]))).first()[0] == case[1]


def test_random_codons_keep_the_protein(spark):
    aa = spark.createDataFrame([(1, "MKTAYIAKLW" * 7 + "*"), (2, "M")], "seq_id long, aa string")
    found = generate.random_synonymous(aa, 2).withColumn("cds", generate.spelt(F.col("codes"))).withColumn("back", p.translate_dna(F.col("cds"))).collect()
    assert all(r["back"] == r["aa"] for r in found) and len({r["cds"] for r in found if r["seq_id"] == 1}) == 2


def test_verdict_on_a_stream_equals_the_table(spark, tmp_path):
    rows(spark, "ATGTAAGCC", "ATGG", "GCATAT", "GGGCCC").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("seq_id long, dna string").parquet(str(tmp_path / "in")).select("seq_id", stream.verdict(F.col("dna")).alias("v"))
    job = live.writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).start()
    job.awaitTermination()
    assert {tuple(r) for r in spark.table("verdicts").collect()} == {(0, "STOP"), (1, "FRAME"), (2, "GC"), (3, "GC")}
