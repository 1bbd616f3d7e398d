"""Comparing datasets: length bins, matched lengths, and profile similarity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import METRICS
from .quantiles import with_medians

#: Datasets that one is compared with at most; their names come to the driver.
MOST_DATASETS = 1000

FIXED_EDGES = (0.0, 500.0, 1000.0, 2000.0, 5000.0, math.inf)


def length_bin_edges(lengths: DataFrame, n: int = 5, column: str = "length", approximate: bool = False) -> list[float]:
    """[0, interior quantiles, inf]; the fixed edges if there are no lengths. The one thing here
    that comes to the driver: n - 1 numbers."""
    shares = F.array(*(F.lit(k / n) for k in range(1, n)))
    how = F.percentile_approx(column, [k / n for k in range(1, n)]) if approximate else F.percentile(column, shares)
    inner = lengths.agg(how.alias("q")).first()["q"]
    return [0.0, *map(float, inner), math.inf] if inner else list(FIXED_EDGES)


def quartile_bins(rows: DataFrame) -> DataFrame:
    """(length_bin, low, high): quartile bins over the pooled distinct lengths of each dataset."""
    own = rows.select("dataset", "transcript_length").distinct()
    q = F.percentile("transcript_length", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    edges = own.agg(q.alias("q")).where("q is not null")
    return edges.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.element_at("q", i + 1).alias("low"), F.element_at("q", i + 2).alias("high"))))).select(F.col("pos").alias("length_bin"), "col.low", "col.high")


def compare_by_length_bin(rows: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Statistics of each (length_bin, dataset): n, mean and median length, and mean, median and std
    of each metric; 0 where a dataset has none. Both ends of a bin belong to it, so an edge counts
    in two; the four bins are joined as a broadcast table."""
    bins = quartile_bins(rows)
    met = rows.join(F.broadcast(bins), F.col("transcript_length").between(F.col("low"), F.col("high")))
    stats = [F.count(F.lit(1)).alias("n"), F.avg("transcript_length").alias("mean_length")]
    for m in metrics:
        stats += [F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"std_{m}")]
    middle = {"median_length": F.col("transcript_length")} | {f"median_{m}": F.col(m) for m in metrics}
    found = with_medians(met.groupBy("length_bin", "dataset").agg(*stats), met, middle, ["length_bin", "dataset"])
    grid = bins.crossJoin(rows.select("dataset").distinct())
    out = grid.join(found, ["length_bin", "dataset"], "left")
    return out.na.fill(0)


def match_by_length(rows: DataFrame, reference: str, tolerance: float = 0.1, least: int = 10) -> DataFrame:
    """For each transcript of the reference dataset with at least ``least`` reads and each other
    dataset its transcript of the nearest length within ``tolerance``, among those with as many
    reads: dataset, ref_transcript, ref_length, transcript_id, length, n. Ties go to the smaller
    id; a reference transcript without a match has a row with nulls.

    Only distinct lengths meet. They are dealt into logarithmic buckets so wide that the band spans
    one neighbour at most, and in each bucket one ordered pass up and one down give the nearest
    length on either side, so the work grows with the lengths and never with their pairs.
    """
    per = rows.groupBy("dataset", "transcript_id").agg(F.max("transcript_length").alias("length"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    names = [r[0] for r in rows.where(F.col("dataset") != reference).select("dataset").distinct().limit(MOST_DATASETS + 1).collect()]
    if len(names) > MOST_DATASETS:
        raise ValueError(f"more than {MOST_DATASETS} datasets to compare with")
    each = F.explode(F.array(*(F.lit(x) for x in sorted(names))).cast(T.ArrayType(rows.schema["dataset"].dataType)))
    place = F.floor(F.log(F.greatest(F.col("length").cast("double"), F.lit(1.0))) / F.lit(-2 * math.log(1 - tolerance)))
    refs = per.where(F.col("dataset") == reference).select(F.col("transcript_id").alias("ref_transcript"), F.col("length").alias("ref_length"))
    known = per.where(F.col("dataset") != reference).groupBy("dataset", "length").agg(F.min(F.struct("transcript_id", "n")).alias("best"))
    known = known.select("dataset", "length", F.explode(F.array(place - 1, place, place + 1)).alias("b"), F.struct("best.transcript_id", "length", "best.n").alias("hit"))
    hit = known.schema["hit"].dataType
    asked = refs.select(F.col("ref_length").alias("length")).distinct().select(each.alias("dataset"), "length", place.alias("b"), F.lit(None).cast(hit).alias("hit"))
    one = W.partitionBy("dataset", "b")
    nearest = lambda length: F.last("hit", ignorenulls=True).over(one.orderBy(length, F.col("hit").isNull()).rowsBetween(W.unboundedPreceding, 0))
    both = asked.unionByName(known).withColumns({"below": nearest(F.col("length")), "above": nearest(F.desc("length"))}).where("hit is null")
    ref, away = F.col("length").cast("double"), lambda x: F.col(f"{x}.length").cast("double")
    inside = lambda x: F.when((away(x) >= ref * F.lit(1 - tolerance)) & (away(x) <= ref * F.lit(1 + tolerance)), F.struct(F.abs(ref - away(x)).alias("off"), f"{x}.transcript_id", f"{x}.length", f"{x}.n"))
    best = both.select("dataset", F.col("length").alias("ref_length"), F.least(inside("below"), inside("above")).alias("m"))
    grid = refs.select(each.alias("dataset"), "ref_transcript", "ref_length")
    return grid.join(best, ["dataset", "ref_length"], "left").select("dataset", "ref_transcript", "ref_length", "m.transcript_id", "m.length", "m.n")


def matched_statistics(rows: DataFrame, matches: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Each match with count, mean, median and std of the metrics of its reads."""
    stats = [F.count(F.lit(1)).alias("reads")] + [f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    keys = ["dataset", "transcript_id"]
    found = with_medians(rows.groupBy(*keys).agg(*stats), rows, {f"median_{m}": F.col(m) for m in metrics}, keys)
    return matches.join(found, ["dataset", "transcript_id"], "left").na.fill(0, ["reads"])


def profile_similarity(profile: DataFrame, by: str = "dataset") -> DataFrame:
    """(a, b, cosine) of all pairs of datasets' profiles, 0 if one has no mass. Bins of equal index
    meet by an equi-join."""
    left = profile.select(F.col(by).alias("a"), "bin", F.col("value").alias("x"))
    right = profile.select(F.col(by).alias("b"), "bin", F.col("value").alias("y"))
    dots = left.join(right, "bin").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    norms = profile.groupBy(F.col(by).alias("k")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    both = dots.join(norms.select(F.col("k").alias("a"), F.col("norm").alias("na")), "a").join(norms.select(F.col("k").alias("b"), F.col("norm").alias("nb")), "b")
    return both.select("a", "b", F.coalesce(F.try_divide("dot", F.col("na") * F.col("nb")), F.lit(0.0)).alias("cosine"))


def profile_bias_metrics(profile: DataFrame, n_bins: int, by: str = "dataset") -> DataFrame:
    """Our definitions: mean of the first and last fifth of the bins over the mean, cv, and
    evenness as 1 - Gini of the bins."""
    fifth = max(1, n_bins // 5)
    rank = F.row_number().over(W.partitionBy(by).orderBy("value", "bin"))
    v, n = F.col("value"), float(n_bins)
    rows = profile.withColumn("k", rank).groupBy(by).agg(F.avg(v).alias("mean"), F.avg(F.when(F.col("bin") < fifth, v)).alias("five"), F.avg(F.when(F.col("bin") >= n_bins - fifth, v)).alias("three"), F.stddev_samp(v).alias("std"), F.sum(v * (2.0 * F.col("k") - n - 1.0)).alias("g"), F.sum(v).alias("total"))
    return rows.select(by, F.try_divide("five", "mean").alias("five_prime_bias"), F.try_divide("three", "mean").alias("three_prime_bias"), F.try_divide("std", "mean").alias("cv"), (1.0 - F.try_divide(F.col("g"), F.col("total") * n)).alias("evenness"))


def length_stratified_profile(profile: DataFrame, strata: DataFrame, key: str = "transcript_id") -> DataFrame:
    """Mean profile of each (dataset, length_bin, bin); ``strata`` (key, dataset, length_bin)."""
    return profile.join(strata, key).groupBy("dataset", "length_bin", "bin").agg(F.avg("value").alias("value"))
