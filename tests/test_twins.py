"""Operators against the plainest version of themselves on random small inputs, and properties."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.functions import reads as R
from readlake.operators import cells, compare, density, intervals, models, quality, quantiles, sampling


def test_best_overlap_is_the_nested_loop(spark):
    r = random.Random(1)
    reads = [(i, r.randrange(3), s, s + r.randrange(0, 400)) for i in range(150) for s in [r.randrange(3000)]]
    tx = [(i, r.randrange(3), s, s + r.randrange(1, 900), i) for i in range(60) for s in [r.randrange(3000)]]
    got = intervals.assign_best_overlap(spark.createDataFrame(reads, "read_id int, chrom int, start int, end int"), spark.createDataFrame(tx, "transcript_id int, chrom int, start int, end int, ord int"), min_overlap=0.3, bucket=250)
    want = {}
    for i, c, s, e in reads:
        best, who = 0.0, None
        for t, tc, ts, te, _ in tx:
            if c == tc and e > s:
                f = max(0, min(e, te) - max(s, ts)) / (e - s)
                if f > best:
                    best, who = f, t
        if who is not None and best >= 0.3:
            want[i] = (who, best)
    assert {x.read_id: (x.transcript_id, x.overlap_fraction) for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_depth_and_bins_base_by_base(spark):
    r = random.Random(2)
    lengths = {f"t{i}": r.randrange(1, 120) for i in range(25)}
    al = [(t, s, s + r.randrange(0, 60)) for _ in range(300) for t in [r.choice(list(lengths))] for s in [r.randrange(-10, lengths[t] + 5)]]
    tx = spark.createDataFrame(list(lengths.items()), "transcript_id string, length int")
    runs = intervals.depth(spark.createDataFrame(al, "transcript_id string, start int, end int"), tx)
    base = {t: [0] * n for t, n in lengths.items()}
    for t, s, e in al:
        for p in range(max(0, s), min(e, lengths[t])):
            base[t][p] += 1
    got = {t: [None] * n for t, n in lengths.items()}
    for x in runs.collect():
        got[x.transcript_id][x.seg_start : x.seg_end] = [x.depth] * (x.seg_end - x.seg_start)
    assert got == base
    n = 10
    means = {(t, i): (sum(d[i * len(d) // n : (i + 1) * len(d) // n]) / m if (m := (i + 1) * len(d) // n - i * len(d) // n) else 0.0) for t, d in base.items() for i in range(n)}
    for norm in ("none", "sum", "max", "mean100"):
        for x in intervals.bin_depth(runs, tx, n, norm).collect():
            own = [means[(x.transcript_id, i)] for i in range(n)]
            v = own[x.bin]
            want = {"none": v, "sum": 0.0 if lengths[x.transcript_id] < n or not sum(own) else v / sum(own), "max": v / max(own) if max(own) else 0.0, "mean100": 100 * v / (sum(own) / n + 1e-10)}[norm]
            assert math.isclose(x.value, want, abs_tol=1e-9)
    matrix = intervals.profile_matrix(intervals.bin_depth(runs, tx, n), n)
    assert {(x.transcript_id, x.bin): x.value for x in intervals.profile_rows(matrix, n).collect()} == means


def test_each_record_of_a_read_has_a_row(spark):
    reads = [("a", "c", 0, 100), ("a", "c", 500, 600), ("a", "c", 0, 100), ("b", "c", 0, 10)]
    tx = [("T1", "c", 0, 80, 0), ("T2", "c", 10, 90, 1), ("T3", "c", 500, 590, 2)]
    got = intervals.assign_best_overlap(spark.createDataFrame(reads, "read_id string, chrom string, start int, end int"), spark.createDataFrame(tx, "transcript_id string, chrom string, start int, end int, ord int"))
    assert sorted((x.read_id, x.transcript_id, x.overlap_fraction) for x in got.collect()) == [("a", "T1", 0.8), ("a", "T1", 0.8), ("a", "T3", 0.9), ("b", "T1", 1.0)]


def test_depth_of_a_long_contig_in_blocks(spark, monkeypatch):
    """A contig of 100 million places: the same runs as in one sweep, over many tasks, and no sweep
    over the events of a whole contig."""
    r = random.Random(6)
    size = 100_000_000
    al = [("c", s, s + r.choice((5, 300, 3_000_000))) for _ in range(3000) for s in [r.randrange(-50, size)]]
    df, tx = spark.createDataFrame(al, "transcript_id string, start int, end int"), spark.createDataFrame([("c", size), ("d", 5), ("e", 0)], "transcript_id string, length int")
    runs = intervals.depth(df, tx)
    got = sorted((x.transcript_id, x.seg_start, x.seg_end, x.depth) for x in runs.collect())
    step = defaultdict(int, {0: 0, size: 0})
    for _, s, e in al:
        if min(e, size) > max(s, 0):
            step[max(s, 0)] += 1
            step[min(e, size)] -= 1
    places, now, want = sorted(step), 0, []
    for a, b in zip(places, places[1:]):
        now += step[a]
        want.append(("c", a, b, now))
    assert got == [*want, ("d", 0, 5, 0)]
    plan = runs._jdf.queryExecution().executedPlan().toString()
    swept = [line for line in plan.splitlines() if "Window [" in line and "pos" in line]
    assert swept and all("block" in line.split("], [")[1] for line in swept)


def test_quantiles_of_many_groups(spark):
    r = random.Random(9)
    rows = [(g, r.choice((None, 0.5, r.gauss(0, 1), r.gauss(0, 1e6)))) for g in ("a", "b", None) for _ in range(400)] + [("hot", 1.0)] * 500 + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {(x.g, x.metric, x.share): x.value for x in quantiles.quantiles(df, {"v": F.col("v"), "w": F.col("v") * 2}, (0.0, 0.25, 0.5, 0.99, 1.0), ["g"]).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        for q in (0.0, 0.25, 0.5, 0.99, 1.0):
            if own:
                at = (len(own) - 1) * q
                low, high = own[math.floor(at)], own[math.ceil(at)]
                want |= {(g, "v", q): low + (high - low) * (at % 1), (g, "w", q): 2 * (low + (high - low) * (at % 1))}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want)
    assert quantiles.quantiles(df.limit(0), {"v": F.col("v")}, by=["g"]).count() == 0


def test_median_of_a_group_of_millions_is_not_in_one_task(spark):
    n = 3_000_000
    df = spark.range(n).select(F.lit(1).alias("g"), (F.pmod(F.col("id") * 1_000_003, F.lit(n)).cast("double")).alias("v"))
    out = quantiles.medians(df, {"m": F.col("v")}, ["g"])
    assert out.first().m == (n - 1) / 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan
    swept = [line for line in plan.splitlines() if "Window [" in line and " v#" in line]
    assert swept and all("part#" in line for line in swept)


def lowess(points, part, robust, grid):
    """Plainly, place by place."""
    x, y = np.array(points).T
    at = np.linspace(x.min(), x.max(), grid + 1)
    k = min(len(x), max(2, math.ceil(part * len(x))))
    w, out = np.ones(len(x)), None
    for _ in range(robust + 1):
        out = np.zeros(len(at))
        for i, p in enumerate(at):
            d = np.abs(x - p)
            h = np.sort(d)[k - 1]
            own = np.where(d <= h, (1 - (d / h if h else 0 * d) ** 3) ** 3, 0) * w
            e = x - p
            s0, s1, s2, t0, t1 = (own.sum(), (own * e).sum(), (own * e * e).sum(), (own * y).sum(), (own * e * y).sum())
            out[i] = (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) if s0 * s2 - s1 * s1 > 1e-9 * s0 * s2 else t0 / s0
        off = np.abs(y - np.interp(x, at, out))
        r = off / (6 * np.median(off)) if np.median(off) else 0 * off
        w = np.where(r < 1, (1 - r * r) ** 2, 0.0)
    return out


def test_local_trend_is_the_plain_one(spark):
    r = random.Random(8)
    points = [(float(x), math.sin(x / 60) + r.gauss(0, 0.1) + (5 if r.random() < 0.05 else 0)) for _ in range(700) for x in [r.randrange(0, 400)]]
    df = spark.createDataFrame(points + [(None, 1.0), (1.0, None)], "x double, y double").repartition(5)
    for robust in (0, 2):
        got = sorted(map(tuple, quality.local_trend(df, F.col("x"), F.col("y"), 0.2, robust, 20).collect()))
        assert np.allclose([g[2] for g in got], lowess(points, 0.2, robust, 20), atol=1e-9, rtol=0)
    one = quality.local_trend(df.where("x = 7"), F.col("x"), F.col("y")).collect()
    assert len(one) == 1 and abs(one[0].y - sum(y for x, y in points if x == 7) / sum(x == 7 for x, _ in points)) < 1
    assert quality.local_trend(df.limit(0), F.col("x"), F.col("y")).count() == 0


def test_out_of_bag_score_is_the_recount(spark):
    """Votes of the bags that left a row out, counted row by row; rows fall out of a bag as often as they should."""
    r = random.Random(2)
    rows = [(i, k, r.random(), r.random()) for i in range(60) for k in range(10)]
    rows = [(*x, 3 * x[2] + (x[3] > 0.5) + r.gauss(0, 0.1)) for x in rows]
    design = spark.createDataFrame(rows, "transcript_id int, bin int, a double, b double, value double").repartition(3)
    forest = models.fit_bagged_forest(design, ["a", "b"], trees=12, bags=6, depth=5)
    votes, weights = defaultdict(list), []
    for k, bag in enumerate(forest.bags):
        own = bag.transform(design).withColumn("w", models.bag_weight(k, 42, "transcript_id", "bin")).collect()
        weights += [x.w for x in own]
        for x in own:
            if x.w == 0:
                votes[x.transcript_id, x.bin].append((x.value, x.prediction))
    assert abs(sum(w == 0 for w in weights) / len(weights) - math.exp(-1)) < 0.03 and abs(sum(weights) / len(weights) - 1) < 0.06
    y, p = zip(*((v[0][0], sum(q for _, q in v) / len(v)) for v in votes.values()))
    want = 1 - sum((a - b) ** 2 for a, b in zip(y, p)) / sum((a - sum(y) / len(y)) ** 2 for a in y)
    score = models.oob_score(forest, design).first()
    assert score.n == len(votes) > 500 and abs(score.r2 - want) < 1e-9 and want > 0.8
    inside = models.regression_metrics(forest.transform(design)).first()
    assert inside.n == 600 and inside.r2 > score.r2


def test_hexagons_are_the_nearest_centres(spark):
    r = random.Random(4)
    points = [(r.uniform(-20, 20), r.uniform(-20, 20)) for _ in range(2000)] + [(None, 1.0), (1.0, None)]
    got = {(x.cell_x, x.cell_y): x.n for x in quality.hexagon_density(spark.createDataFrame(points, "x double, y double"), F.col("x"), F.col("y"), 3.0, 5.0).collect()}
    centres = [(i, j) for i in range(-20, 21) for j in range(-20, 21) if (i - j) % 2 == 0]
    want = Counter(min(centres, key=lambda c: (x / 3 - c[0] / 2) ** 2 + 3 * (y / 5 - c[1] / 2) ** 2) for x, y in points[:-2])
    assert got == want


def test_matched_lengths_are_the_nearest(spark):
    r = random.Random(3)
    data = [(d, f"{d}{i}", r.randrange(50, 3000)) for d in "Rxy" for i in range(80)]
    got = compare.match_by_length(spark.createDataFrame(data, "dataset string, transcript_id string, transcript_length int"), "R", 0.1, 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan
    for x in got.collect():
        near = [(abs(n - x.ref_length), t, n) for d, t, n in data if d == x.dataset and x.ref_length * (1 - 0.1) <= n <= x.ref_length * (1 + 0.1)]
        assert (x.transcript_id, x.length) == ((None, None) if not near else min(near)[1:])


def test_interval_reads_falls_back_to_places(spark):
    tx = spark.createDataFrame([("T1", "c", 1, 100, 100), ("T2", "c", 51, 300, 250)], "transcript_id string, chrom string, start int, end int, length int")
    al = spark.createDataFrame([("a", "T1", 5, 9), ("b", "c", 60, 70), ("d", "c", 400, 500)], "read_id string, chrom string, start int, end int")
    assert sorted((x.transcript_id, x.read_id, x.by_name) for x in intervals.interval_reads(tx, al).collect()) == [("T1", "a", True), ("T2", "b", False)]


def test_density_is_the_kernel_sum(spark):
    r = random.Random(4)
    points = [(k % 2, r.random()) for k in range(200)] + [(7, 0.5)]
    got = density.position_density(spark.createDataFrame(points, "g int, position double"), ["g"], grid=101)
    rows = defaultdict(dict)
    for x in got.collect():
        rows[x.g][x.i] = x.y
    for g in (0, 1):
        own = [round(p, density.DECIMALS) for k, p in points if k == g]
        raw = [p for k, p in points if k == g]
        mean = sum(raw) / len(raw)
        h = 0.05 * math.sqrt(sum((p - mean) ** 2 for p in raw) / (len(raw) - 1))
        y = [sum(math.exp(-(((i / 100 - p) / h) ** 2) / 2) for p in own) for i in range(101)]
        assert all(abs(rows[g][i] - v / sum(y)) < 1e-9 for i, v in enumerate(y))
    assert set(rows[7].values()) == {1 / 101}


def test_presets_and_effects(spark):
    for name in ("cdna", "direct", "uniform"):
        shape, effect = density.preset_model(spark, name, 200)
        assert all(abs(r.s - 1) < 1e-9 for r in shape.groupBy("length_bin").agg(F.sum("y").alias("s")).collect())
        assert effect.count() == 5
    ends = {r.length_bin: r.end for r in density.dominant_end(density.preset_model(spark, "cdna", 200)[0], 200).collect()}
    assert ends[-1] == "5'"
    assert all(abs(r.effect - 1) < 1e-9 for r in density.length_effect(density.preset_model(spark, "uniform", 200)[0], 200).collect())


def test_density_model_fills_missing_bins(spark):
    tx = spark.createDataFrame([(i, 100 * (i + 1)) for i in range(10)], "transcript_id int, length int")
    al = spark.createDataFrame([(i, t, t * 7 + i, 0) for t in range(4) for i in range(30)], "read_id int, transcript_id int, start int, flag int")
    shape, effect = density.fit_density_model(al, tx, least=20, grid=50)
    assert shape.count() == 6 * 50 and effect.count() == 5
    assert all(abs(r.s - 1) < 1e-9 for r in shape.groupBy("length_bin").agg(F.sum("y").alias("s")).collect())
    with pytest.raises(ValueError):
        density.fit_density_model(al, tx, least=1000)


def reads(spark, n=600):
    rows = [(f"r{i}", f"@r{i}", "ACGTTGCA" * (30 + i % 7), "I" * 8 * (30 + i % 7), f"c{min(i % 10, 3)}" if i % 13 else None) for i in range(n)]
    return spark.createDataFrame(rows, "read_id string, header string, seq string, qual string, barcode string")


def test_mixing(spark):
    pool = spark.createDataFrame([(f"p{i}", f"t{i % 5}", "ACGTACGTGG" * 60, "J" * 600) for i in range(40)], "read_id string, transcript_id string, seq string, qual string")
    own, shape = reads(spark), density.beta_profile(spark, 1.5, 4.0, 100)
    mixed, tracking, expected = sampling.mix(own, pool, shape, rate=0.2, seed=3)
    n = sampling.n_to_insert(own.where("barcode is not null").count(), 0.2)
    rows = tracking.collect()
    assert len(rows) == n and mixed.count() == 600 + n and expected.agg(F.sum("expected_count")).first()[0] == n
    assert len({r.read_id for r in rows}) == n and all(len(r.umi) == 12 and set(r.umi) <= set("ACGT") for r in rows)
    assert all(200 <= r.sampled_length <= r.original_length == 600 for r in rows)
    added = {r.read_id: r for r in mixed.join(tracking.select("read_id", "barcode", "umi", "sampled_length"), "read_id").collect()}
    assert all(r.seq.startswith(r.barcode + r.umi) and len(r.seq) == len(r.qual) == len(r.barcode) + 12 + r.sampled_length for r in added.values())
    again = sampling.mix(own.repartition(7), pool.repartition(5), shape, rate=0.2, seed=3)[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    shares = Counter(r.barcode for r in rows)
    truth = {r.barcode: r.n_reads for r in cells.reads_per_cell(own).collect()}
    assert all(abs(shares[b] / n - truth[b] / sum(truth.values())) < 0.15 for b in truth)
    _, tracking, expected = sampling.mix(own, pool.limit(0), shape, rate=0.2, seed=3)
    assert tracking.count() == 0 and expected.count() == 0


def test_sampling_without_replacement(spark):
    pool = reads(spark)
    got = sampling.sample_reads(pool, 100, ["read_id"], 5).collect()
    assert sorted(r.draw for r in got) == list(range(100)) and len({r.read_id for r in got}) == 100


def test_draws_follow_the_profile(spark):
    profile = spark.createDataFrame([(i, i / 3, y) for i, y in enumerate((0.1, 0.2, 0.3, 0.4))], "i int, x double, y double")
    got = Counter(r.position for r in sampling.draw_position(spark.range(8000).withColumnRenamed("id", "draw"), profile, 1).collect())
    assert sum(got.values()) == 8000 and all(abs(got[i / 3] / 8000 - y) < 0.03 for i, y in enumerate((0.1, 0.2, 0.3, 0.4)))
    lengths = sampling.draw_length(spark.range(4000).withColumnRenamed("id", "draw"), spark.createDataFrame([], "read_id string, length int"), 2)
    values = sorted(r.target for r in lengths.collect())
    assert values[0] >= 200 and values[-1] <= 15000 and abs(math.log(values[2000]) - 8.5) < 0.1
    codes = sampling.barcodes(spark, 1000, 40).collect()
    assert len({r.barcode for r in codes}) == 1000 and {len(r.barcode) for r in codes} == {40}


def test_models(spark):
    r = random.Random(6)
    profile = spark.createDataFrame([(t, b, 100 + 50 * math.sin(b / 3) + r.random()) for t in range(40) for b in range(10)], "transcript_id int, bin int, value double")
    features = spark.createDataFrame([(t, 100 + t) + tuple(r.random() for _ in models.SEQUENCE_FEATURES) for t in range(30)], "transcript_id int, length int, " + ", ".join(f"{k} double" for k in models.SEQUENCE_FEATURES))
    design = models.split(models.positional_design(profile, features, 10))
    assert design.columns == ["transcript_id", "bin", *models.DESIGN, "value", "is_test"] and design.count() == 400
    assert {x.gc for x in design.where("transcript_id >= 30").collect()} == {0.5}
    by = models.split(design.drop("is_test"), by_transcript=True).groupBy("transcript_id").agg(F.countDistinct("is_test").alias("n"))
    assert {x.n for x in by.collect()} == {1}
    train = design.where("not is_test")
    for model in (models.fit_forest(train, trees=20, depth=6), models.fit_boosted(train, rounds=15, depth=3)):
        m = models.regression_metrics(model.transform(design), by=["is_test"]).collect()
        assert all(x.r2 > 0.5 for x in m)
        top = models.feature_importance(model, n=3).collect()
        assert len(top) == 3 and top[0].importance >= top[1].importance
    shape, effect = models.predict_profiles(spark, model, lengths=(500, 1000), grid=20)
    assert shape.count() == 40 and effect.count() == 2
    assert all(abs(x.m - 1) < 1e-9 for x in shape.groupBy("length_bin").agg(F.avg("y").alias("m")).collect())
    assert models.forest_settings("direct_rna") == {"trees": 200, "depth": 10, "min_leaf": 3}


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.6, 0.9, 1.5, 3.0, None)], "r double")
    assert [x[0] for x in df.select(R.bias_category(F.col("r"))).collect()] == ["strongly 5'-biased", "moderately 5'-biased", "balanced", "moderately 3'-biased", "strongly 3'-biased", "strongly 3'-biased"]
    assert [x[0] for x in df.na.drop().select(R.fit_quality(F.col("r"))).collect()] == ["limited", "moderate", "good", "excellent", "excellent"]
    assert df.limit(1).select(R.overfit(F.lit(0.9), F.lit(0.6))).first()[0] is True


def test_local_profiles(spark):
    r = random.Random(8)
    texts = ["".join(r.choices("ACGTNé", k=r.randrange(0, 90))) for _ in range(30)] + ["AAAAAAAAAA", "acgtacgtac", "short"]
    got = {(x.seq_id, x.start): (x.gc, x.entropy, x.kmers) for x in models.local_profiles(spark.createDataFrame([*enumerate(texts), (99, None)], "seq_id int, seq string"), 10).collect()}
    want = {}
    for i, t in enumerate(texts):
        for s in range(0, len(t), 10):
            w = t[s : s + 10].upper().replace("É", "é")
            counts, n = Counter(w), len(w)
            three = Counter(w[k : k + 3] for k in range(n - 2))
            want[(i, s)] = ((counts["G"] + counts["C"]) / n, -sum(c / n * math.log2(c / n) for c in counts.values()), [three[k] / max(1, n - 2) for k in models.KMERS])
    assert set(got) == set(want)
    for k, (gc, entropy, kmers) in want.items():
        assert math.isclose(got[k][0], gc, abs_tol=1e-9) and math.isclose(got[k][1], entropy, abs_tol=1e-9) and all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got[k][2], kmers))


def test_local_profiles_of_long_sequences_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(models, "WINDOWS", 2)
    rows = models.local_profiles(spark.createDataFrame([(1, "ACGTA" * 13)], "seq_id int, seq string"), 10).collect()
    assert sorted(x.start for x in rows) == [0, 10, 20, 30, 40, 50, 60]


def test_matches_grow_with_lengths_only(spark):
    """A hundred thousand transcripts of two hundred lengths: no row is made for a pair of them."""
    rows = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, "R").otherwise("x").alias("dataset"), F.col("id").cast("string").alias("transcript_id"), (F.col("id") % 200 + 900).cast("int").alias("transcript_length"))
    got = compare.match_by_length(rows, "R", 0.1, 1)
    assert got.count() == 50_000 and got.where("transcript_id is null").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        compare.match_by_length(rows.withColumn("dataset", F.col("transcript_id")), "R", 0.1, 1)


def test_choice_of_a_model(spark):
    assert density.choose_model(spark, preset="cdna")[1].count() == 5
    for wrong in ({}, {"preset": "cdna", "alignments": spark.range(1)}):
        with pytest.raises(ValueError):
            density.choose_model(spark, **wrong)
    assert models.feature_weights("direct_rna") == {"gc_content": 1.5, "complexity": 2.0, "hairpin_potential": 2.5, "g_quadruplex_potential": 2.5}


def test_measures_are_those_of_each_feature_by_itself(spark):
    """One pass over a decoded sequence gives what the features give one by one, and it is decoded once."""
    from readlake.functions import sequences as S

    r = random.Random(12)
    texts = [None, "", "a", "acgt", "GgGgG", "é" * 40, "straße ACGT", "İst" * 20, "你好ACGTacgt😀" * 9, "n" * 31]
    texts += ["".join(r.choices(letters, k=r.randrange(1, 200))) for letters in ("ACGT", "acgtn", "GGGGC", "ab cdé😀", "ATıK") for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string").repartition(3)
    s = F.col("s")
    for norm in ("capped", "windows"):
        own = df.select("seq_id", F.translate(F.coalesce("seq", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("s"))
        want = own.select("seq_id", F.length(s), S.gc_content(s), S.five_prime_gc(s), S.three_prime_gc(s), S.kmer_complexity(s, norm), S.hairpin_potential(s), S.g_quadruplex_potential(s), S.homopolymer_ratio(s), S.gc_skew(s))
        got = models.sequence_features(df, norm)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "measures(" in plan and "translate(" not in plan and "hairpin_potential(" not in plan
    assert [x.u for x in df.orderBy("seq_id").select(S.ascii_upper(F.col("seq")).alias("u")).collect()] == [t and "".join(c.upper() if c.isascii() else c for c in t) for t in texts]
