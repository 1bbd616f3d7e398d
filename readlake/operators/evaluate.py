"""Scoring a quantifier: expected against observed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions import reads as R

_WANTED = {"transcript_id": ("transcript",), "barcode": ("barcode", "cell"), "observed_count": ("count", "abundance")}


def resolve_count_columns(df: DataFrame, marker: str | None = None) -> DataFrame:
    """(barcode, transcript_id, observed_count) of a table of any column names: for each, the first
    column whose name holds one of its words. With ``marker`` only transcripts that hold it, in
    either case; missing columns raise ValueError."""
    found = {want: next((c for c in df.columns if any(w in c.lower() for w in words)), None) for want, words in _WANTED.items()}
    if missing := [words[0] for want, words in _WANTED.items() if found[want] is None]:
        raise ValueError(f"no column for {', '.join(missing)} among {', '.join(df.columns)}")
    out = df.select(*(F.col(f"`{found[w]}`").alias(w) for w in ("barcode", "transcript_id", "observed_count")))
    return out if marker is None else out.where(F.contains(F.lower(F.col("transcript_id").cast("string")), F.lit(marker.lower())))


def compare_counts(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Full outer match of both tables, missing counts 0, with detected and detection_rate."""
    keys = ["barcode", "transcript_id"]
    both = expected.join(observed, keys, "full_outer").na.fill(0, ["expected_count", "observed_count"])
    e, o = F.col("expected_count"), F.col("observed_count")
    return both.select(*keys, e, o, (o > 0).alias("detected"), R.detection_rate(e, o).alias("detection_rate"))


def detection_summary(comparison: DataFrame) -> DataFrame:
    """expected, detected, rate, correlation: 0 if either side has no counts, null if one is constant."""
    e, o = F.col("expected_count"), F.col("observed_count")
    x, y = e.cast("double"), o.cast("double")
    sums = comparison.agg(F.count_if(e > 0).alias("expected"), F.count_if(o > 0).alias("detected"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    r = F.try_divide(F.expr("n * sxy - sx * sy"), F.expr("sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)"))
    rate = F.coalesce(F.try_divide(F.col("detected").cast("double"), F.col("expected").cast("double")), F.lit(0.0))
    return sums.select("expected", "detected", rate.alias("rate"), F.when((F.col("sx") == 0) | (F.col("sy") == 0), 0.0).otherwise(r).alias("correlation"))


def per_transcript_metrics(comparison: DataFrame) -> DataFrame:
    hit = F.sum(F.col("detected").cast("int")).cast("double")
    return comparison.groupBy("transcript_id").agg(F.sum("expected_count").alias("expected"), F.sum("observed_count").alias("observed"), (hit / F.count(F.lit(1)).cast("double")).alias("detection_rate"))


def detection_by_expected_bin(comparison: DataFrame, n: int = 10) -> DataFrame:
    """(bin, center, rate) over ``n`` equal bins of the expected counts' range; an empty bin has rate 0."""
    ends = comparison.agg(F.min("expected_count").cast("double").alias("low"), F.max("expected_count").cast("double").alias("high"))
    rows = comparison.crossJoin(F.broadcast(ends))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor(F.try_divide((F.col("expected_count") - F.col("low")) * R.number(n), F.col("high") - F.col("low"))).cast("int"), F.lit(n - 1))).otherwise(0)
    hit = F.sum(F.col("detected").cast("int")).cast("double")
    rates = rows.groupBy(place.alias("bin")).agg((hit / F.count(F.lit(1)).cast("double")).alias("rate"))
    grid = ends.where("low is not null").select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    center = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / n
    return grid.join(rates, "bin", "left").select("bin", center.alias("center"), F.coalesce("rate", F.lit(0.0)).alias("rate"))
