"""Work that grows with the places of intervals and not with the pairs of those that lie alike."""

import random

from readlake.operators import intervals


def test_only_different_places_meet(spark, monkeypatch):
    rng = random.Random(1)
    reads = [(i, "c", s, s + n) for i, (s, n) in enumerate((rng.randrange(8) * 10, rng.choice((0, 15, 40))) for _ in range(400))]
    tx = [(k, "c", s, s + n, 500 - k) for k, (s, n) in enumerate((rng.randrange(6) * 10, rng.choice((20, 30, 60))) for _ in range(300))]
    seen = []
    plain = intervals.overlapping

    def counted(left, right, **settings):
        seen.extend((left.count(), right.count()))
        return plain(left, right, **settings)

    monkeypatch.setattr(intervals, "overlapping", counted)
    r = spark.createDataFrame(reads, "read_id long, chrom string, start long, end long")
    t = spark.createDataFrame(tx, "transcript_id long, chrom string, start long, end long, ord long")
    got = {(x.read_id, x.transcript_id, x.overlap_fraction) for x in intervals.assign_best_overlap(r, t).collect()}
    want = set()
    for i, _, s, e in reads:
        hits = [(-(min(e, b) - max(s, a)) / (e - s), o, k) for k, _, a, b, o in tx if e > s and a < e and s < b]
        if hits and -min(hits)[0] >= 0.5:
            want.add((i, min(hits)[2], -min(hits)[0]))
    assert got == want
    assert seen[0] <= 24 and seen[1] <= 18


def test_end_mass_adds_in_the_order_of_the_bins(spark):
    values = [0.1, 0.2, 0.3, 0.25, 0.15, 0.2]
    rows = spark.createDataFrame([("t", i, v) for i, v in reversed(list(enumerate(values)))], "transcript_id string, bin int, value double").coalesce(1)
    got = intervals.end_mass(rows, 6).first()
    a, b = (0.1 + 0.2) + 0.3, (0.25 + 0.15) + 0.2
    assert (got.five_prime, got.ratio) == (a / (a + b), b / a)


def test_a_table_of_a_comparison_waits_for_no_other(spark, monkeypatch):
    from readlake.operators import compare, quantiles
    from readlake.plans import workflows

    def refused(*_, **__):
        raise AssertionError("not asked for")

    monkeypatch.setattr(quantiles, "saved", refused)
    monkeypatch.setattr(compare, "match_by_length", refused)
    rows = spark.createDataFrame([("A", 1, 7, 100, 10, 60, 30, 50, 50, 1.0, 0.5, 0.9)], "dataset string, read_id long, transcript_id long, transcript_length int, start int, end int, mapq int, aligned_length int, read_length int, aligned_fraction double, read_coverage double, read_accuracy double")
    tables = workflows.compare_datasets(rows, "A", 20, 1)
    assert {"quality", "lengths", "by_length", "similarity", "matched"} <= set(tables)
    assert tables["lengths"].first()["n"] == 1 and tables["by_length"].count() == 20 and tables["similarity"].count() == 1


def test_windows_are_measured_once_and_only_where_bins_lie(spark):
    from readlake.operators import models

    local = models.local_profiles(spark.createDataFrame([(1, "ACGT" * 250), (3, "AC" * 10)], "seq_id long, seq string"), 100)
    assert "MapInPandas" not in local._jdf.queryExecution().toString()
    profile = spark.createDataFrame([(t, b, 1.0) for t in (1, 2, 3) for b in range(4)], "transcript_id long, bin int, value double")
    lengths = spark.createDataFrame([(1, 300, 0), (2, 300, 0), (3, 300, 0)], "transcript_id long, length int, length_bin int")
    density = spark.createDataFrame([(0, i, 0.001) for i in range(1000)], "length_bin int, i int, y double")
    design = models.positional_design_enhanced(profile, lengths, density, 4, local=local)
    assert "MapIn" not in design._jdf.queryExecution().toString()
    got = {(r.transcript_id, r.bin): (r.local_gc, r.kmer_ACG) for r in design.collect()}
    assert len(got) == 12 and all(got[t, b][0] == (0.0 if t == 2 else 0.5) for t in (1, 2, 3) for b in range(4))
    assert got[1, 3][1] == 25 / 98 and got[3, 3][1] == 0.0


def test_profiles_by_place_equal_those_of_all_pairs(spark):
    from pyspark.sql import functions as F

    from readlake.operators import cells
    from readlake.plans import workflows

    rng = random.Random(2)
    reads = [(i, rng.randrange(3), s, s + rng.choice((5, 30, 90))) for i, s in enumerate(rng.choices(range(0, 200, 40), k=300))]
    tx = [(k, k % 3, 20 * (k % 4), 20 * (k % 4) + 60, 100 + 40 * (k % 2)) for k in range(1, 90)]
    r = spark.createDataFrame(reads, "read_id long, chrom long, start long, end long")
    t = spark.createDataFrame(tx, "transcript_id long, chrom long, start long, end long, length int")
    own, lengths, members = workflows._placed(r, t)
    got = {(x.transcript_id, x.bin): x.value for x in intervals.bin_depth(intervals.depth(cells.min_reads(own, 2), lengths), lengths, 4).withColumnRenamed("transcript_id", "own").join(members, "own").collect()}
    met = intervals.interval_reads(t, r).join(t.select(F.col("transcript_id").cast("string"), (F.col("start") - 1).alias("o")), "transcript_id")
    shift = F.when(F.col("by_name"), 0).otherwise(F.col("o"))
    pairs = met.select("transcript_id", "read_id", (F.col("start") - shift).alias("start"), (F.col("end") - shift).alias("end"))
    sizes = t.select(F.col("transcript_id").cast("string"), "length")
    want = {(x.transcript_id, x.bin): x.value for x in intervals.bin_depth(intervals.depth(cells.min_reads(pairs, 2), sizes), sizes, 4).collect()}
    assert got == want and len(got) == 89 * 4
    assert own.count() * 10 < pairs.count()


def test_one_piece_of_documents_is_measured_by_all_cores(spark, tmp_path):
    from readlake.plans import bindings, queries

    spark.createDataFrame([(i, "ACGT" * (i % 50)) for i in range(2000)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert bindings.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() == 1
    for rows in (queries.sequence_features(spark, str(tmp_path)), queries._features(spark, str(tmp_path))):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 2000


def test_learners_meet_equal_features_in_bundles(spark, monkeypatch):
    from pyspark.sql import functions as F

    from readlake.operators import models

    monkeypatch.setattr(models, "BUNDLES", 8)
    rows = spark.range(4000).select(F.col("id").alias("transcript_id"), (F.col("id") % 4).cast("int").alias("bin"), (F.col("id") % 4).cast("double").alias("a"), F.lit(1.0).alias("b"), (F.col("id") % 4 * 10 + F.col("id") % 7).cast("double").alias("value"))
    own = models.bundled(rows, ["a", "b"])
    assert own.count() <= 32 and own.agg(F.sum("_weight"), F.sum(F.col("_weight") * F.col("value"))).first()[:] == rows.agg(F.count("*"), F.sum("value")).first()[:]
    seen, plain = [], models._kept
    monkeypatch.setattr(models, "_kept", lambda r, c: seen.append(r.count()) or plain(r, c))
    mean = {x.a: x.m for x in rows.groupBy("a").agg(F.avg("value").alias("m")).collect()}
    for model in (models.fit_forest(rows, ["a", "b"], trees=10, depth=3), models.fit_boosted(rows, ["a", "b"], rounds=40, depth=2, rate=0.5)):
        got = models.by_features(rows, model.transform, ["a", "b"])
        assert got.count() == 4000 and set(got.columns) == {"transcript_id", "bin", "value", "prediction"}
        assert all(abs(x.prediction - mean[float(x.bin)]) < 1.5 for x in got.collect())
    forest = models.fit_bagged_forest(rows, ["a", "b"], trees=4, bags=2, depth=3)
    assert max(seen) <= 32 and models.oob_score(forest, models.by_features(rows, forest.each, ["a", "b"])).first().r2 > 0.9


def test_medians_of_small_groups_are_not_sorted_together(spark, monkeypatch):
    import statistics

    from pyspark.sql import functions as F

    from readlake.operators import quantiles

    rng = random.Random(3)
    rows = [(g, float(rng.randrange(9)) if rng.random() < 0.9 else None) for g in [None, 1, 2, 2, 3] for _ in range(rng.randrange(5, 40))] + [(4, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    want = {g: statistics.median([x for k, x in rows if k == g and x is not None]) for g in (None, 1, 2, 3)}
    monkeypatch.setattr(quantiles, "SMALL", 30)
    assert {r.g: r.m for r in quantiles.medians(df, {"m": F.col("x")}, ["g"]).collect()} == want
    monkeypatch.setattr(quantiles, "SMALL", 1000)
    monkeypatch.setattr(quantiles, "saved", lambda _: 1 / 0)
    assert {r.g: r.m for r in quantiles.medians(df, {"m": F.col("x")}, ["g"]).collect()} == want


def test_all_pairs_are_dealt_by_their_number(spark, monkeypatch):
    from collections import Counter

    from pyspark.sql import functions as F

    for name, value in {"READS": 4, "TOGETHER": 8, "MET": 50, "PAIRS": 2000}.items():
        monkeypatch.setattr(intervals, name, value, raising=False)
    rng = random.Random(4)
    reads = [(i % 250, "c", s, s + n) for i, (s, n) in enumerate((rng.randrange(-4, 8) * 10, rng.choice((0, 15, 40, 300))) for _ in range(400))]
    reads += [(7, "c", 5, 20)] * 60 + [(None, "c", 5, 20), (None, "c", 5, 20), (1, None, 5, 20), (2, "d", 9, 30), (3, "5", 1, 2), (3, "5", 1, 2)]
    tx = [(k, "c", s, s + n) for k, (s, n) in enumerate((rng.randrange(6) * 10, rng.choice((0, 20, 30, 60))) for _ in range(200))]
    tx += [(900, "c", 1, 40)] * 30 + [(None, "c", 1, 40), (901, "d", 31, 90), (902, "d", 30, 90), (903, None, 1, 40)]
    r = spark.createDataFrame(reads, "read_id long, chrom string, start long, end long")
    t = spark.createDataFrame(tx, "transcript_id long, chrom string, start long, end long")
    found = intervals.interval_reads(t, r)
    got = found.withColumn("task", F.spark_partition_id()).collect()
    text = lambda x: None if x is None else str(x)
    named = {c for _, c, _, _ in reads if c} & {text(k) for k, *_ in tx}
    want = Counter((c, i, s, e, True) for i, c, s, e in reads if c in named)
    for k, chrom, a, b in tx:
        want.update((text(k), i, s, e, False) for i, c, s, e in reads if text(k) not in named and c == chrom and chrom and e > s and b > a - 1 and s < b and a - 1 < e)
    assert Counter((x.transcript_id, x.read_id, x.start, x.end, x.by_name) for x in got) == want
    assert sum(want.values()) > 40_000 and named == {"5"}
    assert max(Counter(x.task for x in got).values()) < 20_000 and len({x.task for x in got}) > 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_boosted_metrics_has_all_rounds_of_the_operator(spark, monkeypatch):
    import inspect

    from readlake.operators import models
    from readlake.plans import queries

    class Seen(Exception):
        pass

    plain, given = models.fit_boosted, {}

    def fit(design, **options):
        given.update(inspect.signature(plain).bind(design, **options).arguments)
        raise Seen

    monkeypatch.setattr(models, "fit_boosted", fit)
    try:
        queries.QUERIES["boosted_metrics"](spark, "/root/testdata/sf0.001")
    except Seen:
        pass
    assert given and given.get("rounds", 100) == 100 and given.get("depth", 6) == 6 and given.get("subsample", 0.8) == 0.8
