"""Small inputs worked out by hand (FIXTURES.md)."""

import math

import pytest
from pyspark.sql import functions as F

from readlake.functions import reads as R
from readlake.operators import cells, compare, evaluate, intervals, models, quality, sampling


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_headers(spark):
    heads = ["@r1 CB:Z:AAAC UB:Z:GGT", "@AAAC_GGT#read7", "@AAAC", "@x_y CB:Z:AAAC"]
    reads = cells.parse_headers(spark.createDataFrame(enumerate(heads), "read_id int, header string"))
    assert [tuple(r)[2:] for r in sorted(reads.collect())] == [("AAAC", "GGT", "cb_tag"), ("AAAC", "GGT", "underscore"), ("AAAC", None, "other"), ("AAAC", "y", "cb_tag")]
    assert rows(cells.reads_per_cell(reads), "barcode", "n_reads") == [("AAAC", 4)]
    assert cells.umis_per_cell(reads).first()["umis"] == 2


BEST = [("r1", "c", 0, 100), ("r2", "c", 60, 160), ("r3", "c", 90, 390), ("r4", "c", 290, 490), ("r5", "c", 60, 90), ("r6", "d", 0, 100), ("r7", "c", 60, 60)]


def test_best_overlap(spark):
    tx = spark.createDataFrame([("T1", "c", 1, 100, 0), ("T2", "c", 51, 300, 1)], "transcript_id string, chrom string, start int, end int, ord int")
    got = intervals.assign_best_overlap(spark.createDataFrame(BEST, "read_id string, chrom string, start int, end int"), tx, bucket=64)
    assert [(a, b, round(c, 9)) for a, b, c in rows(got, "read_id", "transcript_id", "overlap_fraction")] == [("r1", "T1", 0.99), ("r2", "T2", 1.0), ("r3", "T2", 0.7), ("r5", "T1", 1.0)]
    with pytest.raises(ValueError):
        intervals.assign_best_overlap(tx, tx, coords="other")


def test_alignment_metrics(spark):
    df = spark.createDataFrame([("10S50M5I45M5D10S", 10, 110, 200, 120, 100, 21), ("10S50M5I45M5D10S", 10, 110, 200, 120, 100, None)], "cigar string, start int, end int, tl int, rl int, al int, nm int")
    c = F.col
    m, i, d = (R.cigar_count(c("cigar"), k) for k in "MID")
    a, b = df.select(m, i, d, R.cigar_count(c("cigar"), "S"), R.cigar_count(c("cigar"), "H"), R.read_coverage(c("start"), c("end"), c("tl")), R.aligned_fraction(c("al"), c("rl")), R.read_accuracy(m, i, d, c("nm"))).collect()
    assert tuple(a) == (95, 5, 5, 20, 0, 0.5, 100 / 120, 0.8) and b[7] is None


def test_primary_alignment(spark):
    df = spark.createDataFrame([("a", 60, 0.9, None, "T1", 0), ("a", 60, 0.8, 0.7, "T2", 1), ("b", 10, 0.5, 0.6, "T1", 2), ("b", 20, 0.4, 0.5, "T2", 3)], "read_id string, mapq int, aligned_fraction double, read_accuracy double, transcript_id string, ord int")
    assert rows(quality.primary_alignment(df, ["ord"]), "read_id", "transcript_id", "read_accuracy") == [("a", "T1", None), ("b", "T2", 0.5)]
    assert rows(quality.primary_alignment(df, ["ord"], fill_nulls=True), "read_id", "transcript_id", "read_accuracy") == [("a", "T1", 0.7), ("b", "T2", 0.5)]
    assert "WindowGroupLimit" in quality.primary_alignment(df, ["ord"])._jdf.queryExecution().executedPlan().toString()


def test_depth_and_bins(spark):
    al = spark.createDataFrame([("t", 0, 4), ("t", 2, 4), ("t", 2, 4)], "transcript_id string, start int, end int")
    tx = spark.createDataFrame([("t", 4)], "transcript_id string, length int")
    runs = intervals.depth(al, tx)
    assert rows(runs, "seg_start", "seg_end", "depth") == [(0, 2, 1), (2, 4, 3)]
    value = lambda n, norm: [r[1] for r in rows(intervals.bin_depth(runs, tx, n, norm), "bin", "value")]
    assert value(2, "none") == [1, 3] and value(2, "sum") == [0.25, 0.75] and value(2, "max") == [1 / 3, 1]
    assert all(math.isclose(a, b, abs_tol=1e-7) for a, b in zip(value(2, "mean100"), [50, 150]))
    assert value(5, "sum") == [0.0] * 5
    profile = intervals.bin_depth(runs, tx, 4, "none")
    end = intervals.end_mass(profile, 4).first()
    assert (end["five_prime"], end["three_prime"], end["ratio"], end["category"]) == (0.25, 0.75, 3.0, "strongly 3'-biased")


def test_sequence_features(spark):
    seqs = spark.createDataFrame(enumerate(["GGGGCCCCAA", "", "AAAAAAAAAA", "A" * 20 + "T" * 20, "G" * 30, "ggggccccaa"]), "seq_id int, seq string")
    got = {r.seq_id: r for r in models.sequence_features(seqs).collect()}
    a = got[0]
    assert (a.length, a.gc_content, a.five_prime_gc, a.three_prime_gc, a.gc_skew, a.complexity, a.hairpin_potential, a.g_quadruplex_potential, a.homopolymer_ratio) == (10, 0.8, 0.8, 0.8, 0, 1, 0, 0, 0.4)
    assert set(tuple(got[1])[1:]) == {0} and got[5].gc_content == 0.8
    assert (got[2].complexity, got[2].homopolymer_ratio, got[2].gc_skew) == (1 / 7, 1, 0)
    assert got[3].hairpin_potential == 1.0 and got[4].hairpin_potential == 0 and got[4].g_quadruplex_potential == 15 / 16
    windows = {r.seq_id: r.complexity for r in models.sequence_features(seqs, norm="windows").collect()}
    assert windows[0] == 1 and windows[2] == 1 / 7
    assert models.sequence_features(seqs, least=11).count() == 2


def test_comparison(spark):
    e = spark.createDataFrame([("b1", "t1", 2), ("b1", "t2", 1)], "barcode string, transcript_id string, expected_count long")
    o = spark.createDataFrame([("b1", "t1", 1), ("b2", "t1", 3)], "barcode string, transcript_id string, observed_count long")
    c = evaluate.compare_counts(e, o)
    assert rows(c, "barcode", "transcript_id", "expected_count", "observed_count", "detected", "detection_rate") == [("b1", "t1", 2, 1, True, 0.5), ("b1", "t2", 1, 0, False, 0.0), ("b2", "t1", 0, 3, True, 0.0)]
    s = evaluate.detection_summary(c).first()
    assert (s["expected"], s["detected"], s["rate"], round(s["correlation"], 6)) == (2, 2, 1.0, -0.654654)
    assert rows(evaluate.per_transcript_metrics(c), "transcript_id", "expected", "observed", "detection_rate") == [("t1", 2, 4, 1.0), ("t2", 1, 0, 0.0)]
    none = evaluate.compare_counts(e, o.limit(0))
    assert evaluate.detection_summary(none).first()["correlation"] == 0


def test_column_resolution(spark):
    df = spark.createDataFrame([("SPIKE1", "b", 2), (None, "b", 1), ("x", "b", 3)], "Transcript_ID string, cell_barcode string, umi_count int")
    assert rows(evaluate.resolve_count_columns(df, "spike"), "barcode", "transcript_id", "observed_count") == [("b", "SPIKE1", 2)]
    with pytest.raises(ValueError, match="transcript, count"):
        evaluate.resolve_count_columns(df.toDF("gene", "cell", "n"))


def test_length_bins(spark):
    df = spark.createDataFrame([(x,) for x in (100, 200, 300, 400, 500)], "length int")
    edges = compare.length_bin_edges(df, 5)
    assert edges == [0, 180, 260, 340, 420, math.inf]
    assert rows(df.select("length", R.length_bin(F.col("length"), edges).alias("b")), "length", "b") == [(100, 0), (200, 1), (300, 2), (400, 3), (500, 4)]
    assert compare.length_bin_edges(df.limit(0), 5) == list(compare.FIXED_EDGES)


def test_matched_lengths(spark):
    data = [("R", "T1", 1000), ("o", "A", 905), ("o", "B", 1080), ("o", "C", 1101), ("o", "D", 899)]
    df = spark.createDataFrame(data, "dataset string, transcript_id string, transcript_length int")
    assert rows(compare.match_by_length(df, "R", 0.1, 1), "dataset", "ref_transcript", "transcript_id", "length") == [("o", "T1", "B", 1080)]
    assert compare.match_by_length(df, "R", 0.1, 2).count() == 0


def test_truncation(spark):
    assert sampling.n_to_insert(900, 0.1) == 100
    with pytest.raises(ValueError):
        sampling.n_to_insert(900, 0.6)
    df = spark.createDataFrame([(0, "ACGTACGTAC", None, 4, 0.5), (1, "ACGTACGTAC", "JJJJJJJJJJ", 4, 0.9), (2, "ACGTACGTAC", None, 50, 0.3), (3, "ACGTACGTAC", None, None, 0.3)], "k int, seq string, qual string, target int, position double")
    three = {r.k: r for r in sampling.truncate_reads(df, True).collect()}
    other = {r.k: r for r in sampling.truncate_reads(df).collect()}
    assert (three[0].seq, other[0].seq, three[1].seq, other[1].seq) == ("TACG", "TACG", "CGTA", "ACGT")
    assert three[0].qual == "IIII" and three[1].qual == "JJJJ" and three[2].seq == three[3].seq == "ACGTACGTAC"


def test_profile_similarity(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 2.0), ("b", 0, 2.0), ("b", 1, 4.0), ("b", 2, 4.0), ("c", 0, 0.0), ("c", 1, 0.0), ("c", 2, 0.0)], "dataset string, bin int, value double")
    got = {(r.a, r.b): round(r.cosine, 9) for r in compare.profile_similarity(df).collect()}
    assert got[("a", "b")] == got[("a", "a")] == 1 and got[("a", "c")] == 0 and got[("a", "b")] == got[("b", "a")]
