"""Forests grown level by level, against plain ones."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from readlake.operators import models, trees


def plain(rows, depth):
    """Predictions of the greedy tree of least squares on (x, weight, y), by x."""
    w = sum(r[1] for r in rows)
    mean = sum(r[1] * r[2] for r in rows) / w
    cost = lambda part: sum(r[1] * r[2] ** 2 for r in part) - sum(r[1] * r[2] for r in part) ** 2 / sum(r[1] for r in part)
    best = None
    for cut in sorted({r[0] for r in rows})[:-1] if depth else ():
        gain = cost(rows) - cost([r for r in rows if r[0] <= cut]) - cost([r for r in rows if r[0] > cut])
        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
            best = (gain, cut)
    if best is None:
        return {r[0]: mean for r in rows}
    return plain([r for r in rows if r[0] <= best[1]], depth - 1) | plain([r for r in rows if r[0] > best[1]], depth - 1)


def test_a_tree_is_the_greedy_one(spark, monkeypatch):
    """One feature and one bag of given weights, so nothing is drawn; also with one node a pass."""
    r = random.Random(8)
    rows = [(float(x), float(r.randrange(4)), r.gauss(x % 7, 1)) for x in range(24) for _ in range(9)]
    want = plain([x for x in rows if x[1]], 4)
    df = spark.createDataFrame(rows, "x double, w double, y double").selectExpr("x", "w", "w * y AS s").repartition(5)
    for nodes in (trees.NODES, 1):
        monkeypatch.setattr(trees, "NODES", nodes)
        forest = trees.grown(df, ["x"], ["w", "s"], trees=1, depth=4, groups=1)
        got = {x.x: x.prediction for x in forest.transform(df.select("x").distinct()).collect()}
        assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-9 for x in want)
        assert list(forest.importances) == [1.0]


def test_draws_follow_the_law():
    """Poisson of the number of equal rows, which are drawn with their labels; another tree draws anew."""
    h = np.random.default_rng(3).integers(0, 1 << 62, 100_000).astype(np.uint64)
    one = np.ones(len(h))
    for n in (1, 6, trees.TABLED, trees.TABLED + 1, 5000):
        count, total = trees.drawn(h, one * n, one * 2, one * 0.25, 42, 7)
        assert abs(count.mean() / n - 1) < 0.02 and abs(count.var() / n - 1) < 0.03
        left = total - 2 * count
        assert abs(left.mean()) < 0.02 * math.sqrt(n) and abs(left.var() / (0.25 * n) - 1) < 0.04
    a, b = (trees.drawn(h, one, one, 0 * one, 42, t)[0] for t in (1, 2))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02 and (trees.drawn(h, one, one, 0 * one, 42, 1)[0] == a).all()


def test_many_equal_rows_are_one_row_and_nothing_is_kept_for_a_row_and_a_tree(spark, monkeypatch):
    rows = spark.range(4000).select(F.col("id").alias("transcript_id"), (F.col("id") % 4).cast("int").alias("bin"), (F.col("id") % 4).cast("double").alias("a"), F.lit(1.0).alias("b"), (F.col("id") % 4 * 10 + F.col("id") % 7).cast("double").alias("value"))
    seen, plain_saved = [], trees.saved
    monkeypatch.setattr(trees, "saved", lambda df: seen.append(plain_saved(df)) or seen[-1])
    forest = models.fit_forest(rows, ["a", "b"], trees=10, depth=3)
    bags = models.fit_bagged_forest(rows, ["a", "b"], trees=4, bags=2, depth=3)
    assert [t.count() for t in seen] == [4, 4] and seen[0].columns == ["key", "h", "_n", "_s", "_q"]
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
    mean = {x.a: x.m for x in rows.groupBy("a").agg(F.avg("value").alias("m")).collect()}
    for x in forest.transform(rows).collect() + bags.transform(rows).collect():
        assert abs(x.prediction - mean[x.a]) < 1.5
    assert len(bags.bags) == 2 and forest.importances[0] == 1


def test_cuts_part_what_is_not_the_common_value(spark):
    """Half of the rows share a value; the others still have nearly all the cuts."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0.5).otherwise(F.col("id") / 20_000).alias("x"), (F.col("id") % 20).cast("double").alias("pos"), F.lit(7.0).alias("c"))
    (x, pos, c), n = trees.cuts_of(rows, ["x", "pos", "c"])
    assert n == 20_000 and len(x) == trees.BINS - 1 and sum(v < 0.4 for v in x) >= 10 and sum(v > 0.6 for v in x) >= 10
    assert list(pos) == list(range(19)) and len(c) == 0
