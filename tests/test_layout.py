"""Saved layouts: what is read of them, and features kept by content."""

import random

import pytest
from pyspark.sql import functions as F

from readlake.operators import models
from readlake.sources import features, layout


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "reads")
    r = random.Random(3)
    rows = [(i, f"c{r.randrange(4)}", s, s + r.choice((0, 1, 100, 5000, 3_000_000, 70_000_000))) for i in range(4000) for s in [r.randrange(-5, 60_000_000)]]
    layout.save_layout(spark.createDataFrame(rows, "read_id int, chrom string, start int, end int"), path)
    return path, rows


def test_regions_meet_what_overlaps_them(spark, saved):
    path, rows = saved
    r = random.Random(5)
    regions = [(k, f"c{r.randrange(5)}", s, s + r.choice((0, 1, 1 << 20, 7_000_000))) for k in range(40) for s in [r.randrange(0, 60_000_000)]]
    got = layout.region_reads(spark, path, spark.createDataFrame(regions, "region_id int, chrom string, start int, end int"))
    want = {(k, i) for k, c, s, e in regions for i, d, a, b in rows if c == d and a < e and s < b and e > s and b > a}
    assert {(x.r.region_id, x.l.read_id) for x in got.collect()} == want and len(want) > 100


def test_a_region_reads_few_files(spark, saved):
    path, _ = saved
    region = spark.createDataFrame([(1, "c1", 50_000_000, 50_100_000)], "region_id int, chrom string, start int, end int")
    own = layout.candidates(spark, path, region)
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile" in plan or "PartitionFilters: [tile" in plan
    assert 1 <= own.select("tile").distinct().count() <= len(layout.BIN_BITS) + 1
    assert len(own.inputFiles()) >= 1 and spark.read.parquet(path).select("tile").distinct().count() > 100
    assert layout.candidates(spark, path, region.limit(0)).count() == 0


def test_tiles_hold_every_interval(spark):
    places = [(0, 1), (0, 1 << 20), ((1 << 20) - 1, (1 << 20) + 1), (5, 5), (-3, 4), (1 << 29, (1 << 30) + 1), ((1 << 31) - 2, (1 << 31) - 1)]
    df = spark.createDataFrame([("c", a, b) for a, b in places], "chrom string, start long, end long")
    c = (F.col("chrom"), F.col("start"), F.col("end"))
    for x in df.select("start", "end", layout.tile_of(*c).alias("tile"), layout.tiles_of(*c).alias("tiles")).collect():
        assert x.tile in x.tiles and len(set(x.tiles)) == len(x.tiles)


def test_features_are_computed_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    own = spark.createDataFrame([(1, "ACGTACGTGG" * 9), (2, "acgtacgtgg" * 9), (3, None), (4, ""), (5, "GGGG" * 20)], "seq_id int, seq string")
    first = features.stored_features(own.where("seq_id < 4"), path)
    assert first.count() == 3 and len(features.versions(spark, path)) == 1
    want = sorted(map(tuple, models.sequence_features(own).collect()))
    assert sorted(map(tuple, features.stored_features(own, path).collect())) == want
    assert len(features.versions(spark, path)) == 2
    (tmp_path / "store" / "broken").mkdir()  # a version that was never finished
    monkeypatch.setattr(models, "sequence_features", None)
    again = features.stored_features(own, path)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, again.collect())) == want and "Python" not in plan and "Arrow" not in plan
    assert spark.read.parquet(*features.versions(spark, path)).count() == 3
