"""Alignment quality: the tables behind the usual charts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions import reads as R
from readlake.scratch import saved

from .quantiles import medians, quantiles, with_medians

METRICS = ("aligned_fraction", "read_coverage", "read_accuracy")


def alignment_metrics(alignments: DataFrame) -> DataFrame:
    """The mapped alignments with their three metrics; rows without a name are left out."""
    mapped = alignments.where(~R.has_flag(F.col("flag"), R.UNMAPPED) & F.col("read_id").isNotNull())
    c = F.col
    return mapped.withColumns({"aligned_fraction": R.aligned_fraction(c("aligned_length"), c("read_length")), "read_coverage": R.read_coverage(c("start"), c("end"), c("transcript_length")), "read_accuracy": R.read_accuracy(c("M"), c("I"), c("D"), c("NM"))})


def cdna_alignments(alignments: DataFrame) -> DataFrame:
    return alignments.where(F.col("flag").isin(*R.CDNA_FLAGS) & F.col("read_id").isNotNull())


def length_filter(alignments: DataFrame, low: int, high: int) -> DataFrame:
    return alignments.where(F.col("transcript_length").between(low, high))


def primary_alignment(alignments: DataFrame, ties: Sequence[str], fill_nulls: bool = False) -> DataFrame:
    """One row for each read: highest mapq, then aligned_fraction, then ``ties``. With ``fill_nulls``
    each column takes its first value that isn't null in that order."""
    order = W.partitionBy("read_id").orderBy(F.desc("mapq"), F.desc("aligned_fraction"), *ties)
    if fill_nulls:
        whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        alignments = alignments.select("*", *(F.first(c, ignorenulls=True).over(whole).alias(f"_{c}") for c in alignments.columns if c not in ("read_id", "mapq", *ties)))
        names = [c for c in alignments.columns if c.startswith("_")]
        first = alignments.withColumn("n", F.row_number().over(order)).where("n = 1")
        return first.select(*(F.col(f"_{c}").alias(c) if f"_{c}" in names else F.col(c) for c in alignments.columns if not c.startswith("_")))
    return alignments.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def transcript_summary(primary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, transcript_id, median_coverage, max_length, reads)."""
    keys = [*by, "transcript_id"]
    rows = primary.groupBy(*keys).agg(F.max("transcript_length").alias("max_length"), F.count(F.lit(1)).alias("reads"))
    return with_medians(rows, primary, {"median_coverage": F.col("read_coverage")}, keys).select(*keys, "median_coverage", "max_length", "reads")


def alignment_summary(primary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(metric, value) rows over primary alignments, or (*by, metric, value) for each group of them."""
    full = F.count_if(F.col("read_coverage") > 0.95)
    n = F.count(F.lit(1)).cast("double")
    of_reads = primary.groupBy(*by).agg(n.alias("reads"), full.cast("double").alias("full_length"), F.try_divide(100.0 * full, n).alias("percent_full_length"))
    own = {"median_coverage": F.col("read_coverage"), "median_aligned_length": F.col("aligned_length"), "median_accuracy": F.col("read_accuracy") * 100}
    of_reads = with_medians(of_reads, primary, own, by)
    transcripts = saved(transcript_summary(primary, by))
    of_transcripts = transcripts.groupBy(*by).agg(n.alias("transcripts"))
    of_transcripts = with_medians(of_transcripts, transcripts, {"median_of_medians": F.col("median_coverage"), "median_transcript_length": F.col("max_length")}, by)
    both = of_reads.join(of_transcripts, list(by)) if by else of_reads.crossJoin(of_transcripts)  # one row each
    return both.unpivot(list(by), [c for c in both.columns if c not in by], "metric", "value")


def flag_profile(alignments: DataFrame) -> DataFrame:
    f = F.col("flag")
    count = lambda bits: F.count_if(R.has_flag(f, bits))
    return alignments.agg(F.count(F.lit(1)).alias("total"), count(R.UNMAPPED).alias("unmapped"), count(R.SECONDARY).alias("secondary"), count(R.SUPPLEMENTARY).alias("supplementary"), F.countDistinct("transcript_id").alias("references"))


def top_flags(alignments: DataFrame, by: str = "flag", n: int = 10) -> DataFrame:
    return alignments.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


def histogram(df: DataFrame, value: Column, low, high, n: int, by: Sequence[str] = ()) -> DataFrame:
    """(bin, n) or (*by, bin, n) of the values inside [low, high]; bins without any have no row."""
    inside = df.withColumn("_v", value).where(F.col("_v").between(low, high))
    return inside.groupBy(*by, R.equal_bin(F.col("_v"), low, high, n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def own_range_histogram(df: DataFrame, value: Column, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Histogram over the values' own range; if all are equal, they fall into the middle bin."""
    rows = df.withColumn("_v", value.cast("double")).where("_v is not null")
    ends = rows.agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    place = F.when(F.col("_high") > F.col("_low"), F.least(F.floor(F.try_divide((F.col("_v") - F.col("_low")) * n, F.col("_high") - F.col("_low"))).cast("int"), F.lit(n - 1))).otherwise(n // 2)
    return rows.crossJoin(F.broadcast(ends)).groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage_fraction_histogram(primary: DataFrame) -> DataFrame:
    """180 bins of read_coverage on [0.5, 1]: all, and those above 0.95."""
    inside = primary.where(F.col("read_coverage").between(0.5, 1.0))
    return inside.groupBy(R.equal_bin(F.col("read_coverage"), 0.5, 1.0, 180).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("read_coverage") > 0.95).alias("n_full"))


def hexagon_density(df: DataFrame, x: Column, y: Column, x_width: float, y_width: float, least: int = 1) -> DataFrame:
    """(cell_x, cell_y, n): counts in hexagons, as doubled coordinates: a cell's centre is at
    ``(cell_x * x_width / 2, cell_y * y_width / 2)`` where both are even or both odd.

    The centres are two rectangular lattices, one shifted by half a cell; each point goes to the nearer
    of its nearest ones in either, with y counted ``sqrt(3)`` times, so that the cells are hexagons, and
    to the even one if both are as near. Points with a null have no cell."""
    u, v = x / R.number(x_width), y / R.number(y_width)
    i, j, k, m = F.floor(u + 0.5), F.floor(v + 0.5), F.floor(u), F.floor(v)
    away = lambda a, b: (u - a) * (u - a) + (v - b) * (v - b) * 3
    even = away(i, j) <= away(k + 0.5, m + 0.5)
    cell = [F.when(even, 2 * a).otherwise(2 * b + 1).cast("long").alias(c) for a, b, c in ((i, k, "cell_x"), (j, m, "cell_y"))]
    rows = df.where(x.isNotNull() & y.isNotNull()).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") >= least)


def density_2d(df: DataFrame, x: Column, y: Column, x_width: float, y_width: float, least: int = 1) -> DataFrame:
    cells = df.groupBy(F.floor(x / R.number(x_width)).alias("cell_x"), F.floor(y / R.number(y_width)).alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))
    return cells.where(F.col("n") >= least)


def binned_trend(primary: DataFrame, bins: int = 19) -> DataFrame:
    """Mean coverage of ``bins`` equal bins of transcript length; the upper edge is exclusive."""
    ends = primary.agg(F.min("transcript_length").cast("double").alias("_low"), F.max("transcript_length").cast("double").alias("_high"))
    rows = primary.crossJoin(F.broadcast(ends)).where(F.col("transcript_length") < F.col("_high"))
    place = F.floor((F.col("transcript_length") - F.col("_low")) * R.number(bins) / (F.col("_high") - F.col("_low"))).cast("int")
    return rows.groupBy(place.alias("bin")).agg(F.avg("read_coverage").alias("mean_coverage"), F.count(F.lit(1)).alias("n"))


def local_trend(df: DataFrame, x: Column, y: Column, part: float = 0.2, robust: int = 3, grid: int = 100) -> DataFrame:
    """(i, x, y): a locally weighted linear regression (LOWESS) at ``grid + 1`` equally spaced places, null
    where it is not defined; one row if all x are equal, none without points.

    At each place the nearest ``part`` of the points count, by the tricube of their distance over that
    of the farthest; in each of ``robust`` further rounds also by the bisquare of their residual, from the
    line between the places, over six times the median of all. A place whose points all are at one x
    has their mean. Points with a null are left out.

    Points of one x are added up, and what meets the places, a table of fixed size, is one row an x; the
    distances of the farthest and the medians are exact quantiles. So no task sees all points."""
    points = saved(df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null"))
    ends = points.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).first()
    spark = df.sparkSession
    if not ends["n"]:
        return spark.createDataFrame([], "i int, x double, y double")
    low, step = ends["low"], (ends["high"] - ends["low"]) / grid
    count = grid + 1 if step > 0 else 1
    places = F.broadcast(spark.createDataFrame([(i, low + i * step) for i in range(count)], "i int, at double"))
    near = min(ends["n"], max(2, math.ceil(part * ends["n"])))
    share = (near - 1) / (ends["n"] - 1) if ends["n"] > 1 else 0.0
    sums = saved(points.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("wy")).withColumn("w", F.col("n").cast("double")))
    reach = quantiles(sums.crossJoin(places), {"d": F.abs(F.col("x") - F.col("at"))}, [share], ["i"], F.col("n")).select("i", F.col("value").alias("reach"))
    places = F.broadcast(saved(places.join(reach, "i")))

    def fitted(sums: DataFrame) -> DataFrame:
        d = F.col("x") - F.col("at")
        u = F.coalesce(F.try_divide(F.abs(d), F.col("reach")), F.lit(0.0))
        weight = F.when(F.abs(d) <= F.col("reach"), F.pow(1 - F.pow(u, 3), 3))
        met = sums.join(places, F.abs(d) <= F.col("reach")).select("i", d.alias("d"), (weight * F.col("w")).alias("w"), (weight * F.col("wy")).alias("wy"))
        w, wy, d = F.col("w"), F.col("wy"), F.col("d")
        s = met.groupBy("i").agg(F.sum(w).alias("s0"), F.sum(w * d).alias("s1"), F.sum(w * d * d).alias("s2"), F.sum(wy).alias("t0"), F.sum(wy * d).alias("t1"))
        spread = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
        line = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / spread
        value = F.when(spread > 1e-9 * F.col("s0") * F.col("s2"), line).otherwise(F.try_divide("t0", "s0"))
        return saved(places.join(s.select("i", value.alias("y")), "i", "left").select("i", F.col("at").alias("x"), "y"))

    out = fitted(sums)
    for _ in range(robust):
        ahead = out.select((F.col("i") - 1).alias("i"), F.col("y").alias("next"))
        lines = F.broadcast(out.select("i", "y").withColumnRenamed("y", "here").join(ahead, "i", "left"))
        at = (F.col("x") - low) / F.lit(step) if step > 0 else F.lit(0.0)
        place = F.least(F.floor(at), F.lit(max(0, count - 2))).cast("int")
        between = F.col("here") + F.coalesce(F.col("next") - F.col("here"), F.lit(0.0)) * (at - F.col("i"))
        off = saved(points.withColumn("i", place).join(lines, "i").select("x", "y", F.abs(F.col("y") - between).alias("off")))
        middle = F.broadcast(medians(off, {"middle": F.col("off")}))  # one row
        ratio = F.coalesce(F.try_divide(F.col("off"), 6 * F.col("middle")), F.lit(0.0))
        weight = F.when(ratio < 1, F.pow(1 - ratio * ratio, 2)).otherwise(0.0)
        weighted = off.crossJoin(middle).select("x", weight.alias("w"), (weight * F.col("y")).alias("wy"))
        out = fitted(saved(weighted.groupBy("x").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))))
    return out


def transcript_length_histogram(alignments: DataFrame) -> DataFrame:
    own = alignments.select("transcript_id", "transcript_length").dropDuplicates()
    return histogram(own, F.col("transcript_length").cast("double"), 0.0, 10000.0, 179)


def transcript_length_summary(alignments: DataFrame) -> DataFrame:
    own = alignments.select("transcript_id", "transcript_length").dropDuplicates()
    length = F.col("transcript_length")
    return own.agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(length).cast("double"), F.count(F.lit(1)).cast("double")).alias("mean"), F.median(length).alias("median"), F.min(length).alias("min"), F.max(length).alias("max"))


def read_length_histogram(tracking: DataFrame, bins: int = 29) -> DataFrame:
    """(kind, bin, n, share): original and sampled lengths over one common range."""
    long = tracking.select("original_length", "sampled_length").unpivot([], ["original_length", "sampled_length"], "kind", "length")
    counts = own_range_histogram(long, F.col("length"), bins, ["kind"])
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("kind")))


def comparative_length_histogram(rows: DataFrame, bins: int = 49, high: float = 5000.0) -> DataFrame:
    """(dataset, bin, n, density) of read_length on [0, high]: shares of the dataset's reads in the
    range, for each base."""
    counts = histogram(rows, F.col("read_length").cast("double"), 0.0, high, bins, ["dataset"])
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(W.partitionBy("dataset")) * R.number(high / bins)))


def read_length_means(tracking: DataFrame) -> DataFrame:
    """One row: reads, and their mean original and sampled length."""
    n = F.count(F.lit(1)).cast("double")
    return tracking.agg(F.count(F.lit(1)).alias("reads"), *(F.try_divide(F.sum(f"{k}_length").cast("double"), n).alias(f"mean_{k}") for k in ("original", "sampled")))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate of sums; null where either side is constant."""
    x, y = x.cast("double"), y.cast("double")
    n = F.count(F.lit(1)).cast("double")
    return F.try_divide(n * F.sum(x * y) - F.sum(x) * F.sum(y), F.sqrt(n * F.sum(x * x) - F.sum(x) * F.sum(x)) * F.sqrt(n * F.sum(y * y) - F.sum(y) * F.sum(y)))


def length_correlation(tracking: DataFrame) -> DataFrame:
    a, b = F.col("original_length"), F.col("sampled_length")
    return tracking.agg(pearson(a, b).alias("correlation"), F.min(a).alias("min_original"), F.max(a).alias("max_original"), F.min(b).alias("min_sampled"), F.max(b).alias("max_sampled"))


def truncation(tracking: DataFrame) -> DataFrame:
    """Tracked reads that were cut, with truncation and truncation_ratio."""
    a, b = F.col("original_length"), F.col("sampled_length")
    return tracking.withColumns({"truncation": a - b, "truncation_ratio": R.truncation_ratio(a, b)}).where("truncation > 0")


def truncation_summary(tracking: DataFrame) -> DataFrame:
    cut = F.col("original_length") > F.col("sampled_length")
    return tracking.agg(F.count(F.lit(1)).alias("reads"), F.count_if(cut).alias("truncated"), F.try_divide(100.0 * F.count_if(cut), F.count(F.lit(1)).cast("double")).alias("percent_truncated"))


def truncation_histogram(tracking: DataFrame, value: str = "truncation_ratio", bins: int = 30) -> DataFrame:
    return own_range_histogram(truncation(tracking), F.col(value), bins, ["transcript_id"])


def per_transcript_lengths(tracking: DataFrame) -> DataFrame:
    """Quartiles of the sampled length and the mean original length of each transcript."""
    q = F.percentile("sampled_length", F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75))))
    rows = tracking.groupBy("transcript_id").agg(q.alias("q"), F.try_divide(F.sum("original_length").cast("double"), F.count(F.lit(1)).cast("double")).alias("mean_original"), F.min("sampled_length").alias("min"), F.max("sampled_length").alias("max"))
    return rows.select("transcript_id", "min", *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))), "max", "mean_original")


def coordinate_sorted(alignments: DataFrame) -> DataFrame:
    return alignments.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")
