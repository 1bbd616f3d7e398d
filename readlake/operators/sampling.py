"""Seeded sampling and the mixing of control reads into a dataset.

Draws are functions of (seed, row id) through a 64-bit hash, so they don't depend on partitioning.
A cell is drawn as the cell of a uniformly drawn read: the same law as cumulative weights, but an
equi-join on row numbers instead of a range join. Rows that share an id may swap numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions import reads as R

from . import cells

CELLS_OF_PROFILE = 1000
#: Ranges of the hash in which rows are numbered, as a power of two.
BLOCK_BITS = 14
#: Parameters of the log-normal law of lengths where none were sampled, and its bounds.
LOG_MEAN, LOG_STD, SHORTEST, LONGEST = 8.5, 0.5, 200, 15000


def n_to_insert(total: int, rate: float) -> int:
    """Reads to add so that they make up ``rate`` of all; 0 < rate <= 0.5."""
    if not 0 < rate <= 0.5:
        raise ValueError("the insertion rate must lie in (0, 0.5]")
    return int(total * rate / (1 - rate))


def numbered(df: DataFrame, order: Sequence[str], name: str = "row", seed: int = 1) -> DataFrame:
    """Rows numbered from 0 in the order of a hash of ``order``: within ``BLOCKS`` ranges of the hash
    by a window, each range after those before it by their counts; no task sees all rows and nothing
    is counted beforehand."""
    h = R.hash_bits(seed, *order)
    own = df.withColumn("_h", h).withColumn("_block", F.shiftright("_h", R.DRAW_BITS - BLOCK_BITS))
    starts = own.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_block", (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_start"))  # at most 2**BLOCK_BITS rows
    inside = F.row_number().over(W.partitionBy("_block").orderBy("_h", *order)) - 1
    return own.withColumn("_in", inside).join(starts, "_block").withColumn(name, F.col("_start") + F.col("_in")).drop("_block", "_in", "_start", "_h")


def draw_rows(draws: DataFrame, pool: DataFrame, order: Sequence[str], seed: int, take: Sequence[str]) -> DataFrame:
    """Each draw (column ``draw``) with the ``take`` columns of a uniformly drawn row of ``pool``; none if that is empty."""
    rows = numbered(pool.select(*dict.fromkeys([*order, *take])), order, "_row").select("_row", *take)
    size = pool.agg(F.count(F.lit(1)).alias("_size"))  # one row
    drawn = draws.crossJoin(F.broadcast(size)).where("_size > 0").withColumn("_row", F.pmod(R.hash_bits(seed, "draw"), F.col("_size")))
    return drawn.drop("_size").join(rows, "_row").drop("_row")


def assign_cells(draws: DataFrame, reads: DataFrame, order: Sequence[str], seed: int) -> DataFrame:
    """Each draw with a barcode, by the cells' shares of the reads."""
    return draw_rows(draws, reads.where("barcode is not null"), order, seed, ["barcode"])


def sample_reads(pool: DataFrame, n: int, order: Sequence[str], seed: int) -> DataFrame:
    """n rows of ``pool`` with a column ``draw`` from 0; with replacement only if the pool is smaller."""
    if pool.count() < n:
        return draw_rows(pool.sparkSession.range(n).withColumnRenamed("id", "draw"), pool, order, seed, pool.columns)
    return numbered(pool, order, "draw", seed).where(F.col("draw") < n).select("draw", *pool.columns)


def length_distribution(reads: DataFrame, k: int, seed: int, low: int = SHORTEST, high: int = LONGEST) -> DataFrame:
    """Lengths in [low, high] of a sample of ``k`` reads, or of all if there are fewer."""
    chosen = numbered(reads.select("read_id", F.length("seq").alias("length")), ["read_id"], "draw", seed).where(F.col("draw") < k)
    return chosen.select("read_id", "length").where(F.col("length").between(low, high))


def draw_length(draws: DataFrame, lengths: DataFrame, seed: int, low: int = SHORTEST, high: int = LONGEST) -> DataFrame:
    """A target length for each draw: of a drawn row of ``lengths``, else log-normal in the bounds."""
    if not lengths.isEmpty():
        return draw_rows(draws, lengths, ["read_id"], seed, ["length"]).withColumnRenamed("length", "target")
    u, v = 1 - R.hash_uniform(seed, "draw"), R.hash_uniform(seed + 1, "draw")
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
    value = F.floor(F.exp(LOG_MEAN + LOG_STD * normal)).cast("int")
    return draws.withColumn("target", F.greatest(F.lit(low), F.least(F.lit(high), value)))


def draw_position(draws: DataFrame, profile: DataFrame, seed: int) -> DataFrame:
    """A grid value x for each draw, with probability y of ``profile`` (i, x, y). The cumulative
    cells are cut at thousandths, so a draw finds its cell by an equi-join on one of those."""
    total = W.partitionBy()
    run = W.partitionBy().orderBy("i")
    cum = profile.select("i", "x", (F.sum("y").over(run) / F.sum("y").over(total)).alias("hi"), F.col("y"))
    cum = cum.withColumn("lo", F.coalesce(F.lag("hi").over(run), F.lit(0.0))).withColumn("hi", F.when(F.col("i") == F.max("i").over(total), 1.0).otherwise(F.col("hi"))).where("hi > lo")
    scale = float(CELLS_OF_PROFILE)
    cut = cum.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") * scale).cast("int"), F.least(F.floor(F.col("hi") * scale).cast("int"), F.lit(CELLS_OF_PROFILE - 1)))))
    u = draws.withColumn("_u", R.hash_uniform(seed, "draw")).withColumn("_b", F.floor(F.col("_u") * scale).cast("int"))
    met = u.join(F.broadcast(cut.select("_b", "lo", "hi", F.col("x").alias("position"))), "_b").where("_u >= lo and _u < hi")
    return met.drop("_b", "_u", "lo", "hi")


def barcodes(spark: SparkSession, n: int, length: int = 16, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", R.random_bases(length, seed, F.col("id")).alias("barcode"))


def truncate_reads(reads: DataFrame, three_prime_preset: bool = False) -> DataFrame:
    """Reads (seq, qual, target, position) cut to their target; a missing quality is all 'I'."""
    n = F.length("seq")
    target = R.truncation_target(n, F.col("target"))
    start = R.truncation_start(n, target, F.col("position"), three_prime_preset)
    qual = F.coalesce(F.col("qual"), F.repeat(F.lit("I"), n))
    return reads.withColumns({"_t": target, "_s": start}).withColumns({"seq": R.truncated(F.col("seq"), F.col("_s"), F.col("_t")), "qual": R.truncated(qual, F.col("_s"), F.col("_t"))}).drop("_t", "_s")


def tag_reads(reads: DataFrame, prefix: str = "control_read") -> DataFrame:
    """Barcode and UMI in front of the bases, and an id that tells where the read comes from."""
    extra = F.length("barcode") + F.length("umi")
    name = F.concat(F.lit(f"{prefix}_"), (F.col("draw") + 1).cast("string"), F.lit("_BC_"), "barcode", F.lit("_UMI_"), "umi", F.lit("_orig_"), "original_read_id")
    return reads.withColumns({"seq": F.concat("barcode", "umi", "seq"), "qual": F.concat(F.repeat(F.lit("I"), extra), "qual"), "read_id": name})


def mix(reads: DataFrame, pool: DataFrame, profile: DataFrame, *, rate: float, seed: int, umi_length: int = 12, three_prime_preset: bool = False, model_lengths: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix a sample of ``pool`` (read_id, transcript_id, seq, qual) into ``reads`` (read_id, header,
    seq, qual, barcode): (mixed reads, tracking, expected counts).

    Reads are added until they make up ``rate``; each gets a cell by the cells' shares, a random
    UMI, and is cut to a drawn length at a position drawn from ``profile``. An empty pool adds
    nothing and leaves tracking and expected empty.
    """
    n = n_to_insert(reads.where("barcode is not null").count(), rate)
    n = 0 if pool.isEmpty() else n
    taken = sample_reads(pool.select("read_id", "transcript_id", "seq", "qual"), n, ["read_id"], seed).withColumnRenamed("read_id", "original_read_id")
    taken = assign_cells(taken, reads, ["read_id"], seed + 1).withColumn("umi", R.random_bases(umi_length, seed + 2, F.col("draw")))
    taken = taken.withColumn("original_length", F.length("seq"))
    if model_lengths:
        taken = draw_length(taken, length_distribution(reads, 10_000, seed + 3), seed + 4)
        taken = truncate_reads(draw_position(taken, profile, seed + 5), three_prime_preset)
    taken = taken.withColumn("sampled_length", F.length("seq"))
    tagged = tag_reads(taken)
    tracking = tagged.select("read_id", "original_read_id", "barcode", "umi", "transcript_id", "original_length", "sampled_length")
    added = tagged.select("read_id", F.col("read_id").alias("header"), "seq", "qual")
    mixed = reads.select("read_id", "header", "seq", "qual").unionByName(added)
    return mixed, tracking, cells.expected_counts(tracking)


def split_rows(*columns: str, seed: int = 42, test: float = 0.2) -> Column:
    """Whether a row belongs to the test part, by the hash of its key columns."""
    return R.hash_bits(seed, *columns) % 100 < int(round(100 * test))
