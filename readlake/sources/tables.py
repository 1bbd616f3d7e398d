"""Headered CSV and Parquet tables, and saved models of coverage bias."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "transcript_map": "read_id string, transcript_id string, overlap_fraction double, read_length int, alignment_length int",
    "tracking": "read_id string, original_read_id string, barcode string, umi string, transcript_id string, original_length int, sampled_length int",
    "expected": "barcode string, transcript_id string, expected_count long",
    "comparison": "barcode string, transcript_id string, expected_count long, observed_count double, detected boolean, detection_rate double",
    "density": "length_bin int, i int, x double, y double",
    "length_effect": "length_bin int, effect double",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer pieces than there are cores is dealt over the shuffle
    partitions in turn, whatever its keys, since what follows costs far more than moving its rows; any other stays
    where it is read. Only where rows are worked on depends on it, never a result. For tables as
    they are read: counting the pieces only plans the scan."""
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def read_table(spark: SparkSession, path: str, name: str | None = None, form: str = "parquet") -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name else spark.read
    return reader.csv(path, header=True) if form == "csv" else reader.parquet(path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.parquet(path)


def save_density_model(density: DataFrame, effect: DataFrame, path: str) -> None:
    write_table(density, f"{path}/density")
    write_table(effect, f"{path}/length_effect")


def load_density_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, f"{path}/density", "density"), read_table(spark, f"{path}/length_effect", "length_effect")
