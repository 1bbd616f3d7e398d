"""What the corpus operators share: cutting lineage, spreading rows and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.scratch import checkpoint_dir, delete, new_path, saved, saved_buckets, scope
from readlake.sources.tables import spread

__all__ = ["checkpoint_dir", "delete", "each_copy", "join_hot", "new_path", "saved", "saved_buckets", "scope", "spread", "uniform", "whole_text"]

#: A key is hot if it has more than this part of all rows; so fewer keys than its inverse are.
HOT_PART = 1000
#: Equal rows that one task makes at once.
COPIES = 100_000


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``left``, of ``total`` rows, with ``right``, one row a key that tells in column
    ``size`` how many rows of ``left`` have it. Keys with more than ``1 / HOT_PART`` of them, fewer
    than ``HOT_PART`` whatever the input, are broadcast and their rows stay where they are; only
    the others meet by a shuffle. ``size`` does not come out."""
    hot = F.broadcast(right.where(F.col(size) > total / HOT_PART).drop(size))
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(cold.join(right.where(F.col(size) <= total / HOT_PART).drop(size), key))


def each_copy(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with a column ``copy`` that numbers equal rows from 0, so that every row has a
    key of its own which does not depend on the layout. Equal rows are counted on the way and made
    again, ``COPIES`` in a piece, so a row that repeats very often passes through no single task."""
    counted = saved(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")))
    most = counted.agg(F.max("_n")).first()[0] or 0
    if most <= 1:
        return counted.withColumn("copy", F.lit(0).cast("long")).drop("_n")
    pieces = counted.withColumn("_piece", F.explode(F.expr(f"sequence(0L, (_n - 1L) div {COPIES}L)")))
    if most > COPIES:
        pieces = pieces.repartition(*df.columns, "_piece")
    return pieces.withColumn("copy", F.explode(F.expr(f"sequence(_piece * {COPIES}L, least(_n, (_piece + 1L) * {COPIES}L) - 1L)"))).drop("_n", "_piece")


def whole_text(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def uniform(*columns) -> Column:
    """A number in [0, 1) that depends on the values alone, so that reruns agree."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 11)
    return bits.cast("double") * F.lit(2.0**-53)
