"""Position densities and the presets of coverage bias."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions import reads as R

from . import cells, compare
from .intervals import annotated

GRID = 1000
#: Beta parameters of the presets: overall, then each length bin (fixed values).
PRESETS = {
    "cdna": ((1.5, 4.0), ((2, 2), (1.8, 2.5), (1.6, 3), (1.5, 3.5), (1.2, 4))),
    "direct": ((2.5, 1.2), ((2, 2), (2.2, 1.8), (2.4, 1.5), (2.5, 1.2), (3, 1))),
}
#: Positions are rounded to this many decimals before equal ones are summed up.
DECIMALS = 6


def beta_profile(spark: SparkSession, a: float, b: float, n: int = GRID) -> DataFrame:
    """(i, x, y): the beta density on an even grid of [0, 1], summing to 1; its constant cancels."""
    x = F.col("id").cast("double") / F.lit(float(n - 1))
    rows = spark.range(n).select(F.col("id").cast("int").alias("i"), x.alias("x")).withColumn("y", F.pow("x", F.lit(a - 1.0)) * F.pow(1 - F.col("x"), F.lit(b - 1.0)))
    return rows.withColumn("y", F.col("y") / F.sum("y").over(W.partitionBy()))


def preset_model(spark: SparkSession, name: str, n: int = GRID) -> tuple[DataFrame, DataFrame]:
    """density (length_bin, i, x, y) and length_effect (length_bin, effect) of a preset, or of the
    uniform model; length_bin -1 is the overall density."""
    if name == "uniform":
        rows = spark.range(n).select(F.col("id").cast("int").alias("i"), (F.col("id") / float(n - 1)).alias("x"), F.lit(1.0 / n).alias("y"))
        grid = rows.crossJoin(spark.range(-1, 5).select(F.col("id").cast("int").alias("length_bin")))
        return grid.select("length_bin", "i", "x", "y"), spark.range(5).select(F.col("id").cast("int").alias("length_bin"), F.lit(1.0).alias("effect"))
    overall, bins = PRESETS[name]
    parts = [beta_profile(spark, a, b, n).select(F.lit(k - 1).alias("length_bin"), "i", "x", "y") for k, (a, b) in enumerate((overall, *bins))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    effects = [(k, float(b / a if name == "cdna" else a / b)) for k, (a, b) in enumerate(bins)]
    return out, spark.createDataFrame(effects, "length_bin int, effect double")


def position_density(points: DataFrame, by: Sequence[str], *, value: str = "position", scale: float = 0.05, absolute: bool = False, grid: int = GRID, floor: float = 1e-12) -> DataFrame:
    """Gaussian kernel density of the points of each group on an even grid of [0, 1], summing to 1:
    (*by, i, x, y); uniform where a group has fewer than two points or no spread.

    The bandwidth is ``scale`` times the sample deviation, or ``scale`` itself if ``absolute``. Equal
    positions (to ``DECIMALS``) are one weighted point, and a point meets only the grid cells where
    its kernel exceeds ``floor``, so the work is bounded by distinct positions, not by reads.
    """
    stats = points.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(value).alias("_s"))
    width = F.lit(float(scale)) if absolute else F.col("_s") * float(scale)
    stats = stats.withColumn("_h", F.when((F.col("_n") >= 2) & (width > 0), width))
    step = 1.0 / (grid - 1)
    reach = (-2.0 * math.log(floor)) ** 0.5
    weights = points.where(F.col(value).isNotNull()).groupBy(*by, F.round(value, DECIMALS).alias("_p")).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    near = weights.join(stats.where("_h is not null"), list(by))
    low = F.greatest(F.floor((F.col("_p") - F.col("_h") * reach) / step), F.lit(0)).cast("int")
    high = F.least(F.ceil((F.col("_p") + F.col("_h") * reach) / step), F.lit(grid - 1)).cast("int")
    met = near.where(low <= high).withColumn("i", F.explode(F.sequence(low, high)))
    z = (F.col("i") * step - F.col("_p")) / F.col("_h")
    sums = met.groupBy(*by, "i").agg(F.sum(F.col("_w") * F.exp(-0.5 * z * z)).alias("_y"))
    full = stats.select(*by, "_h").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).join(sums, [*by, "i"], "left")
    y = F.when(F.col("_h").isNull(), 1.0).otherwise(F.coalesce("_y", F.lit(0.0)))
    rows = full.withColumn("y", y)
    return rows.select(*by, "i", (F.col("i") * step).alias("x"), (F.col("y") / F.sum("y").over(W.partitionBy(*by))).alias("y"))


def length_effect(density: DataFrame, grid: int = GRID) -> DataFrame:
    """3' mass over 5' mass of each length bin's density, 1 where there is no 5' mass."""
    half = grid // 2
    five = F.sum(F.when(F.col("i") < half, F.col("y")).otherwise(0.0))
    three = F.sum(F.when(F.col("i") >= half, F.col("y")).otherwise(0.0))
    return density.groupBy("length_bin").agg(F.coalesce(F.try_divide(three, five), F.lit(1.0)).alias("effect"))


def dominant_end(profile: DataFrame, n: int, by: str = "length_bin") -> DataFrame:
    """3' where a profile's highest point (the first of equals) lies beyond the middle, else 5'."""
    top = profile.groupBy(by).agg(F.max_by("i", F.struct("y", -F.col("i"))).alias("at"))
    return top.select(by, F.when(F.col("at") > n / 2, "3'").otherwise("5'").alias("end"))


def pooled_positions(alignments: DataFrame, transcripts: DataFrame, least: int, edges: Sequence[float]) -> DataFrame:
    """(transcript_id, position, length_bin) of the primary alignments of annotated transcripts
    with at least ``least`` of them."""
    own = annotated(alignments.where(~R.has_flag(F.col("flag"), R.UNMAPPED) & R.is_primary(F.col("flag"))), transcripts)
    kept = cells.min_reads(own, least)
    return kept.select("transcript_id", R.relative_position(F.col("start"), F.col("transcript_length")).alias("position"), R.length_bin(F.col("transcript_length"), edges).alias("length_bin"))


def fit_density_model(alignments: DataFrame, transcripts: DataFrame, least: int = 100, bins: int = 5, grid: int = GRID) -> tuple[DataFrame, DataFrame]:
    """density (length_bin, i, x, y) with -1 for all bins together, and length_effect. A length bin
    without positions has the overall density. No positions at all raise ValueError."""
    spark = alignments.sparkSession
    edges = compare.length_bin_edges(transcripts, bins)
    points = pooled_positions(alignments, transcripts, least, edges)
    if points.limit(1).count() == 0:
        raise ValueError("no transcript has enough reads; choose a preset instead")
    overall = position_density(points.withColumn("length_bin", F.lit(-1)), ["length_bin"], grid=grid)
    each = position_density(points, ["length_bin"], grid=grid)
    all_bins = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("length_bin"))
    base = all_bins.crossJoin(overall.select("i", "x", F.col("y").alias("_all")))
    filled = base.join(each.select("length_bin", "i", "y"), ["length_bin", "i"], "left").select("length_bin", "i", "x", F.coalesce("y", "_all").alias("y"))
    density = overall.select("length_bin", "i", "x", "y").unionByName(filled)
    return density, length_effect(density.where("length_bin >= 0"), grid)


def choose_model(spark: SparkSession, *, alignments: DataFrame | None = None, transcripts: DataFrame | None = None, preset: str | None = None, **settings) -> tuple[DataFrame, DataFrame]:
    """density and length_effect, learned from ``alignments`` and ``transcripts`` or of ``preset``.
    Exactly one is to be given: a model that cannot be learned is never replaced by a preset unasked."""
    if (alignments is None) == (preset is None):
        raise ValueError("give either alignments with transcripts or a preset")
    if preset is not None:
        return preset_model(spark, preset)
    return fit_density_model(alignments, transcripts, **settings)
