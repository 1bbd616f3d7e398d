"""Alignments laid out by place, so that a query of regions reads only the files that can hold them.

Places are cut into bins of several widths, and an interval lies in the smallest bin that holds it
whole. The bin, with a hash of the reference, is the partition column ``tile``: a region can only
overlap what lies in a few tiles, which becomes a filter of partitions; inside a tile rows are sorted
by place, so the file's own statistics leave out most of what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.operators.intervals import overlapping

#: Bits of the widths of the bins, from the narrowest; places are below ``1 << TOP_BITS``.
BIN_BITS, TOP_BITS = (20, 23, 26, 29), 32
#: Groups of references.
HOMES = 64


def _offsets() -> list[tuple[int, int]]:
    """(bits, number of the first bin) of each width, the widest first; 0 holds everything."""
    out, first = [], 1
    for bits in reversed(BIN_BITS):
        out.append((bits, first))
        first += 1 << (TOP_BITS - bits)
    return out


def _bins() -> int:
    bits, first = _offsets()[-1]
    return first + (1 << (TOP_BITS - bits))


def _home(chrom: Column) -> Column:
    return F.pmod(F.xxhash64(chrom.cast("string")), F.lit(HOMES))


def tile_of(chrom: Column, start: Column, end: Column) -> Column:
    """The tile of the interval [start, end); one that is empty or begins before 0 is in the widest bin."""
    number = F.lit(0).cast("long")
    low, high = start.cast("long"), F.greatest(end.cast("long") - 1, start.cast("long"))
    for bits, first in _offsets():
        a, b = F.shiftright(low, bits), F.shiftright(high, bits)
        number = F.when((low >= 0) & (a == b), a + first).otherwise(number)
    return (_home(chrom) * _bins() + number).cast("int")


def tiles_of(chrom: Column, start: Column, end: Column) -> Column:
    """All tiles whose intervals may overlap [start, end), as an array."""
    low, high = F.greatest(start.cast("long"), F.lit(0)), F.greatest(end.cast("long") - 1, F.lit(0))
    bins = [F.array(F.lit(0).cast("long"))]
    for bits, first in _offsets():
        a = F.shiftright(low, bits)
        bins.append(F.sequence(a + first, F.greatest(a, F.shiftright(high, bits)) + first))
    return F.transform(F.concat(*bins), lambda b: (_home(chrom) * _bins() + b).cast("int"))


def save_layout(alignments: DataFrame, path: str, key: str = "chrom", start: str = "start", end: str = "end") -> None:
    """The alignments in tiles, each sorted by reference and place. A tile that is large lies in several
    files, as rows are dealt by ranges of (tile, reference, place)."""
    rows = alignments.withColumn("tile", tile_of(F.col(key), F.col(start), F.col(end)))
    rows.repartitionByRange("tile", key, start).sortWithinPartitions("tile", key, start).write.partitionBy("tile").mode("overwrite").parquet(path)


def candidates(spark: SparkSession, path: str, regions: DataFrame, key: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """The saved alignments in tiles that a region may overlap: a filter of partitions. The wanted tiles
    come to the driver, which lists the tiles anyway; there are as many at most as the layout has."""
    tiles = regions.select(F.explode(tiles_of(F.col(key), F.col(start), F.col(end))).alias("tile")).distinct()
    saved = spark.read.parquet(path)
    there = {int(f.rsplit("/tile=", 1)[1].split("/")[0]) for f in saved.inputFiles()}
    wanted = sorted(there & {r["tile"] for r in tiles.collect()})
    return saved.where(F.col("tile").isin(wanted))


def region_reads(spark: SparkSession, path: str, regions: DataFrame, key: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """(l: alignment, r: region) of all pairs of saved alignments and regions that overlap, half-open."""
    own = candidates(spark, path, regions, key, start, end).drop("tile")
    return overlapping(own, regions, key=key, start=start, end=end)
