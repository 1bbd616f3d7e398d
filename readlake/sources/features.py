"""Sequence features that are computed once for each sequence and kept by its content.

The store is a folder of versions. A version is written whole before it counts, which its marker
says, and holds the features of sequences that no earlier one has; so a broken run leaves nothing
that is read, and two runs at once at worst keep the same features twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions import sequences as S
from readlake.operators import models
from readlake.scratch import saved


def digest(seq) -> F.Column:
    """Of the letters in capitals; a null sequence is an empty one."""
    return F.sha2(S.ascii_upper(F.coalesce(seq, F.lit(""))).cast("binary"), 256)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions of a store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [str(x.getPath().toString()) for x in fs.listStatus(where) if x.isDirectory()]
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(f for f in found if fs.exists(marker(f"{f}/_SUCCESS")))


def stored_features(sequences: DataFrame, path: str) -> DataFrame:
    """``models.sequence_features`` of each row (seq_id, seq), from the store at ``path``; what it doesn't have is
    computed, once for each different sequence, and added to it. If it has all, nothing is computed and
    no Python runs. Equal sequences share their features whatever their ids and letter case."""
    spark = sequences.sparkSession
    own = sequences.select("seq_id", "seq", digest(F.col("seq")).alias("digest"))
    there = versions(spark, path)
    new = own.groupBy("digest").agg(F.first("seq").alias("seq"))
    if there:
        new = new.join(spark.read.parquet(*there).select("digest"), "digest", "left_anti")
    new = saved(new)  # looked at twice: whether there is any, and for its features
    if not new.isEmpty():
        models.sequence_features(new.select(F.col("digest").alias("seq_id"), "seq")).withColumnRenamed("seq_id", "digest").write.parquet(f"{path}/{uuid.uuid4().hex}")
    found = spark.read.parquet(*versions(spark, path)).dropDuplicates(["digest"])
    return own.select("seq_id", "digest").join(found, "digest").drop("digest")
