"""Tables written in the shared folder of ``spark.checkpoint.dir`` to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

class _Scopes(threading.local):
    """The open scopes of a thread, so that two jobs of one driver don't end each other's."""

    def __init__(self):
        self.open: list[str] = []


_scopes = _Scopes()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in local
    mode, as in tests; on a cluster, where executors could not see it, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession) -> str:
    """A path of its own in the innermost scope, or in the application's folder."""
    folder = _scopes.open[-1] if _scopes.open else f"{checkpoint_dir(spark)}/readlake-{spark.sparkContext.applicationId}"
    return f"{folder}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a later loss of executors
    costs no recomputation, and what follows sees real sizes and reads only its columns. The files
    stay until their scope ends, or else until ``clear``."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_buckets(df: DataFrame, key: str, pieces: int) -> DataFrame:
    """Like ``saved``, in ``pieces`` buckets of hashed keys, each sorted: a join by the key brings the other
    side to the buckets and leaves them where they are."""
    spark = df.sparkSession
    name = f"readlake_{uuid.uuid4().hex}"
    writer = df.repartition(pieces, key).write.bucketBy(pieces, key).sortBy(key)
    writer.option("path", new_path(spark)).saveAsTable(name)
    return spark.table(name)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system; nothing happens where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is saved inside is deleted at the end, so only results already written may outlive it."""
    _scopes.open.append(new_path(spark))
    try:
        yield
    finally:
        delete(spark, _scopes.open.pop())


def clear(spark: SparkSession) -> None:
    """Delete all that this application has saved outside scopes; frames made of it are dead then."""
    delete(spark, f"{checkpoint_dir(spark)}/readlake-{spark.sparkContext.applicationId}")
