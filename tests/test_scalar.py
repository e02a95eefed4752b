"""Hand values of the per-sequence metrics."""

import pytest
from pyspark.sql import functions as F

from codonloom.functions import scalar as p
from codonloom.operators import scans, usage


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("s,gc", [("", 0.0), ("ATGC", 50.0), ("GGCC", 100.0)])
def test_gc(spark, s, gc):
    assert value(spark, p.gc_percent(F.lit(s))) == gc


def test_translate_and_identity(spark):
    assert value(spark, p.translate_dna(F.lit("ATGGCTTTC"))) == "MAF"
    assert value(spark, p.translate_dna(F.lit("ATGNNNT"))) == "MX"
    assert value(spark, p.translate_dna(F.lit("AT"))) == ""
    assert value(spark, p.aa_identity(F.lit("MAF"), p.translate_dna(F.lit("ATGGCTTAA")))) == pytest.approx(2 / 3)
    assert value(spark, p.aa_identity(F.lit("MA"), F.lit("MA*"))) == 1.0


def test_stops_and_complement(spark):
    assert value(spark, p.internal_stops(F.lit("ATGTAAGCC"))) == 1
    assert value(spark, p.internal_stops(F.lit("ATGTAA"))) == 0
    assert value(spark, p.reverse_complement(F.lit("AACG"))) == "CGTT"
    assert value(spark, p.normalize_dna(F.lit(" au g\n"))) == "ATG"


def test_cai(spark):
    weights = spark.createDataFrame([("ATG", 1.0), ("GCT", 0.25)], "codon string, w double")
    rows = spark.createDataFrame([(1, "ATGGCT"), (2, "ATGG"), (3, "ATGCCC")], "seq_id long, dna string")
    found = {r["seq_id"]: r["cai"] for r in usage.cai(rows, weights).collect()}
    assert found[1] == pytest.approx(0.5) and found[2] == 0.0 and found[3] == 0.0


def test_windows_and_runs(spark):
    row = spark.createDataFrame([(1, "A" * 30 + "G" * 30)], "seq_id long, dna string")
    assert [r["gc"] for r in scans.gc_windows(row, 30, 30).orderBy("start").collect()] == [0.0, 100.0]
    runs = spark.createDataFrame([(1, "C" + "A" * 7 + "C"), (2, "C" + "A" * 8 + "C"), (3, "T" * 10)], "seq_id long, dna string")
    assert {(r["seq_id"], r["start"], r["severity"]) for r in scans.homopolymers(runs).collect()} == {(2, 1, "medium"), (3, 0, "high")}


def test_splice_pairs_use_the_first_donor_only(spark):
    row = spark.createDataFrame([(1, "GTAAGTAAG" + "A" * 30 + "CAG")], "seq_id long, dna string")
    assert [(r["donor"], r["acceptor"]) for r in scans.splice_pairs(row).collect()] == [(0, 39)]
