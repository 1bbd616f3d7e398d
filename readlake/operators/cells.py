"""Cells, molecules and reads of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions import reads as R

from .quality import own_range_histogram


def parse_headers(reads: DataFrame, header: str = "header") -> DataFrame:
    """The reads with barcode, umi and header_format."""
    h = F.col(header)
    return reads.withColumns({"barcode": R.barcode(h), "umi": R.umi(h), "header_format": R.header_format(h)})


def reads_per_cell(reads: DataFrame, barcode: str = "barcode") -> DataFrame:
    """barcode, n_reads; reads without a barcode are left out."""
    return reads.where(F.col(barcode).isNotNull()).groupBy(F.col(barcode).alias("barcode")).agg(F.count(F.lit(1)).alias("n_reads"))


def cell_summary(reads: DataFrame) -> DataFrame:
    """One row about the cells of parsed reads."""
    cells = reads.where("barcode is not null").groupBy("barcode").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("header_format") == k).alias(k) for k in ("cb_tag", "underscore", "other")))
    return cells.agg(
        F.count(F.lit(1)).alias("cells"), F.sum("n").alias("total_reads"), F.try_divide(F.sum("n").cast("double"), F.count(F.lit(1)).cast("double")).alias("mean_reads"), F.median("n").alias("median_reads"), F.min("n").alias("min_reads"), F.max("n").alias("max_reads"),
        F.sum("cb_tag").alias("cb_tag"), F.sum("underscore").alias("underscore"), F.sum("other").alias("other"), F.min(F.length("barcode")).alias("min_barcode"), F.max(F.length("barcode")).alias("max_barcode"),
    )


def umis_per_cell(reads: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("umi") if approximate else F.countDistinct("umi")
    return reads.where("barcode is not null and umi is not null").groupBy("barcode").agg(count.alias("umis"), F.min(F.length("umi")).alias("shortest"), F.max(F.length("umi")).alias("longest"))


def umi_summary(reads: DataFrame, approximate: bool = False) -> DataFrame:
    per = umis_per_cell(reads, approximate)
    return per.agg(F.count(F.lit(1)).alias("cells_with_umi"), F.sum("umis").alias("total_umis"), F.try_divide(F.sum("umis").cast("double"), F.count(F.lit(1)).cast("double")).alias("mean_umis"), F.min("shortest").alias("min_umi"), F.max("longest").alias("max_umi"))


def reads_per_transcript(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_reads"))


def transcript_statistics(mapped: DataFrame) -> DataFrame:
    return reads_per_transcript(mapped).agg(F.coalesce(F.sum("n_reads"), F.lit(0)).alias("total_reads"), F.count(F.lit(1)).alias("transcripts"), F.max("n_reads").alias("most_reads"))


def expected_counts(tracking: DataFrame) -> DataFrame:
    return tracking.groupBy("barcode", "transcript_id").agg(F.count(F.lit(1)).alias("expected_count"))


def min_reads(alignments: DataFrame, least: int) -> DataFrame:
    """Alignments of transcripts with at least ``least`` of them; with a column ``times`` a row is as many."""
    counted = alignments.groupBy("transcript_id").agg(F.sum("times").alias("n_reads")) if "times" in alignments.columns else reads_per_transcript(alignments)
    many = counted.where(F.col("n_reads") >= least).select("transcript_id")
    return alignments.join(many, "transcript_id", "left_semi")


def top_transcripts(alignments: DataFrame, n: int = 20) -> DataFrame:
    return reads_per_transcript(alignments).orderBy(F.desc("n_reads"), "transcript_id").limit(n)


def select_reads(reads: DataFrame, wanted: DataFrame, pattern: str | None = None) -> DataFrame:
    """Reads whose id is in ``wanted`` (read_id), or whose header matches ``pattern`` in either case."""
    if pattern is not None:
        return reads.where(F.col("header").rlike(f"(?i){pattern}"))
    return reads.join(wanted.select("read_id").distinct(), "read_id", "left_semi")


def assigned_reads(reads: DataFrame, mapped: DataFrame, order: str) -> DataFrame:
    """Reads with their transcript; of several rows of a read the last by ``order`` holds."""
    last = mapped.groupBy("read_id").agg(F.max_by("transcript_id", order).alias("transcript_id"))
    return reads.join(last, "read_id")


def transcripts_per_cell(tracking: DataFrame) -> DataFrame:
    return tracking.groupBy("barcode").agg(F.countDistinct("transcript_id").alias("transcripts"))


def transcripts_per_cell_summary(tracking: DataFrame) -> DataFrame:
    t = F.col("transcripts")
    n, s, ss = F.count(F.lit(1)).cast("double"), F.sum(t).cast("double"), F.sum(t * t).cast("double")
    return transcripts_per_cell(tracking).agg((s / n).alias("mean"), F.sqrt(F.try_divide(ss - s * s / n, n - 1)).alias("std"), F.min(t).alias("min"), F.max(t).alias("max"))


def transcripts_per_cell_histogram(tracking: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n) of the cells' numbers of distinct transcripts over their own range."""
    return own_range_histogram(transcripts_per_cell(tracking), F.col("transcripts"), bins)
