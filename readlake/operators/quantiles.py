"""Exact quantiles of many groups at once; only medians of small groups are taken in one task each.

Equal values are counted first, so a very common one is one row. The distinct values are then sorted
by range over all groups together and their counts added up: inside a range partition by a window,
and for the few groups that lie in several partitions by what the partitions before have. The values
at the wanted ranks are picked, and interpolated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.scratch import saved


def quantiles(df: DataFrame, values: Mapping[str, Column], shares: Sequence[float] = (0.5,), by: Sequence[str] = (), count: Column | None = None) -> DataFrame:
    """(*by, metric, share, value): for every group of ``by`` and each named value its quantiles, between
    ranks in proportion. Nulls don't count, NaN is the largest number, a group without values has no row.
    With ``count`` a row stands for as many."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), value.cast("double").alias("v")) for name, value in values.items()))).alias("x")
    key = F.struct(*by, F.col("x.metric").alias("metric"))
    rows = df.select(*by, each, (F.lit(1) if count is None else count).cast("long").alias("times")).where("x.v is not null and times > 0")
    counts = rows.groupBy(key.alias("g"), F.col("x.v").alias("v")).agg(F.sum("times").alias("n"))
    dealt = saved(saved(counts).repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    pieces = dealt.groupBy("g", "part").agg(F.sum("n").alias("n"))
    group = W.partitionBy("g")
    pieces = pieces.select("g", "part", (F.sum("n").over(group.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(group).alias("total"), F.count(F.lit(1)).over(group).alias("parts"))
    cut = F.broadcast(pieces.where("parts > 1").drop("parts"))  # at most two groups a partition
    inside = W.partitionBy("part", "g")
    rows = dealt.withColumns({"own": F.sum("n").over(inside.orderBy("v")), "size": F.sum("n").over(inside)}).join(cut, ["g", "part"], "left")
    last = F.col("own") + F.coalesce("before", F.lit(0)) - 1
    total = F.coalesce("total", "size")
    place = lambda q: (total - 1) * F.lit(float(q))
    wanted = F.array(*(F.struct(F.lit(float(q)).alias("share"), place(q).alias("at")) for q in shares))
    met = rows.select("g", "v", last.alias("last"), (last - F.col("n") + 1).alias("first"), F.explode(wanted).alias("w"))
    low, high, part = F.floor("w.at"), F.ceil("w.at"), F.col("w.at") - F.floor("w.at")
    here = lambda rank: rank.between(F.col("first"), F.col("last"))
    picked = met.where(here(low) | here(high)).groupBy("g", F.col("w.share").alias("share")).agg(F.max(part).alias("part"), F.max(F.when(here(low), F.col("v"))).alias("low"), F.max(F.when(here(high), F.col("v"))).alias("high"))
    value = F.when(F.col("part") == 0, F.col("low")).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    return picked.select("g.*", "share", value.alias("value"))


#: Rows of a group whose median one task takes by itself.
SMALL = 10_000


def medians(df: DataFrame, values: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(*by, a column a value) with the exact medians, a row a group that has any. Groups of at most ``SMALL``
    rows are aggregated at once; only larger ones are sorted over many tasks."""
    if not by:
        return _sorted_medians(df, values, by)
    each = [F.median(v.cast("double")).alias(name) for name, v in values.items()]
    any_value = F.coalesce(*(F.col(name) for name in values)).isNotNull()
    large = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SMALL).drop("_n")
    if large.isEmpty():
        return df.groupBy(*by).agg(*each).where(any_value)
    keys = F.broadcast(large.withColumnsRenamed({c: f"_{c}" for c in by}))  # fewer than rows / SMALL
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    few = df.join(keys, same, "left_anti").groupBy(*by).agg(*each).where(any_value)
    return few.unionByName(_sorted_medians(df.join(keys, same, "left_semi"), values, by))


def _sorted_medians(df: DataFrame, values: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    found = quantiles(df, values, by=by)
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name in values))


def with_medians(aggregated: DataFrame, df: DataFrame, values: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``aggregated``, a row a group of ``by``, with the medians of the rows of ``df``; null where there are none."""
    own = medians(df, values, by)
    if not by:
        return aggregated.crossJoin(F.broadcast(own))  # one row each
    other = own.withColumnsRenamed({c: f"_{c}" for c in by})
    on = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    return aggregated.join(other, on, "left").drop(*(f"_{c}" for c in by))
