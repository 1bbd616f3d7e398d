"""Column expressions of reads, alignments and profiles. All of them run inside Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 4, 16, 256, 2048
CDNA_FLAGS = (0, 16, 256, 272)


def number(x) -> Column:
    return F.lit(float(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, number(0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


# --- headers -----------------------------------------------------------------


def _part(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def barcode(header: Column) -> Column:
    """After ``CB:Z:``, else the id up to its first underscore."""
    return F.coalesce(_part(header, r"CB:Z:(\S+)"), _part(header, r"^@?([^_\s]+)"))


def umi(header: Column) -> Column:
    """After ``UB:Z:``, else the id's second part by underscores, up to ``#``."""
    return F.coalesce(_part(header, r"UB:Z:(\S+)"), _part(header, r"^@?[^_\s]*_([^_#\s]+)"))


def header_format(header: Column) -> Column:
    return F.when(header.contains("CB:Z:"), "cb_tag").when(header.rlike(r"^@?[^_\s]*_"), "underscore").otherwise("other")


# --- alignments --------------------------------------------------------------


def cigar_count(cigar: Column, op: str) -> Column:
    """Sum of the lengths of one operation; only M, I, D, S and H are ever asked for."""
    runs = F.regexp_extract_all(cigar, F.lit(rf"(\d+){op}"), F.lit(1))
    return F.when(~F.contains(cigar, F.lit(op)), 0).otherwise(F.aggregate(runs, F.lit(0), lambda total, x: total + x.cast("int")))


def aligned_fraction(aligned: Column, read_length: Column) -> Column:
    return ratio(aligned, read_length)


def read_coverage(start: Column, end: Column, transcript_length: Column) -> Column:
    return ratio(end - start, transcript_length)


def read_accuracy(m: Column, i: Column, d: Column, nm: Column) -> Column:
    """Matching part of the aligned columns; null without an edit distance."""
    return F.when(nm.isNotNull(), ratio(m + i + d - nm, m + i + d))


def has_flag(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(bits) != 0


def is_primary(flag: Column) -> Column:
    return ~has_flag(flag, SECONDARY | SUPPLEMENTARY)


def relative_position(start: Column, transcript_length: Column) -> Column:
    return F.try_divide(start.cast("double"), transcript_length.cast("double"))


# --- bins and labels ---------------------------------------------------------


def equal_bin(x: Column, low, high, n: int) -> Column:
    """Index of x among n equal bins of [low, high], whose upper end belongs to the last one."""
    low, high = (v if isinstance(v, Column) else number(v) for v in (low, high))
    return F.least(F.floor((x - low) * number(n) / (high - low)).cast("int"), F.lit(n - 1))


def length_bin(length: Column, edges: Sequence[float]) -> Column:
    """First i with edges[i] <= length < edges[i + 1], else the last bin."""
    out = F.lit(len(edges) - 2)
    for i in range(len(edges) - 3, -1, -1):
        out = F.when((length >= edges[i]) & (length < edges[i + 1]), i).otherwise(out)
    return out


def truncation_ratio(original: Column, sampled: Column) -> Column:
    return F.try_divide((original - sampled).cast("double"), original.cast("double"))


def detection_rate(expected: Column, observed: Column) -> Column:
    return F.when(expected > 0, observed.cast("double") / expected.cast("double")).otherwise(number(0))


def bias_category(three_to_five: Column) -> Column:
    """Label of a 3'/5' mass ratio; a null ratio (no 5' mass) counts as infinite."""
    # fixed values: labels and limits
    r = F.coalesce(three_to_five, number("inf"))
    return (
        F.when((r >= 0.8) & (r <= 1.2), "balanced").when(r > 2, "strongly 3'-biased").when(r > 1.2, "moderately 3'-biased").when(r < 0.5, "strongly 5'-biased").otherwise("moderately 5'-biased")
    )


def fit_quality(test_r2: Column) -> Column:
    # fixed values: labels and limits
    return F.when(test_r2 > 0.9, "excellent").when(test_r2 > 0.7, "good").when(test_r2 > 0.5, "moderate").otherwise("limited")


def overfit(train_r2: Column, test_r2: Column) -> Column:
    return train_r2 - test_r2 > 0.2


# --- reads that are made -----------------------------------------------------


#: Bits of a draw: as many as 15 hexadecimal digits hold, so any engine that has MD5 can repeat it.
DRAW_BITS = 60


def hash_bits(seed: int, *columns) -> Column:
    """60 bits that depend on the seed and the values alone; columns are taken as text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)).cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")


def hash_uniform(seed: int, *columns) -> Column:
    """[0, 1), by the values alone."""
    return F.shiftright(hash_bits(seed, *columns), DRAW_BITS - 53).cast("double") * number(2.0**-53)


def _bases(bits: Column, n: int) -> Column:
    """n letters of ACGT, two bits of a number for each."""
    letter = lambda k: F.substring(F.lit("ACGT"), F.call_function("shiftright", bits, 2 * k).bitwiseAND(3).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: letter(k)), "")


def random_bases(length: int, seed: int, *columns) -> Column:
    """A string of ACGT, by the values alone; each draw gives half as many letters as it has bits."""
    each = DRAW_BITS // 2
    return F.concat(*(_bases(hash_bits(seed + start, *columns), min(each, length - start)) for start in range(0, length, each)))


def truncated(text: Column, start: Column, target: Column) -> Column:
    return F.substr(text, start.cast("int") + 1, target.cast("int"))


def truncation_start(length: Column, target: Column, position: Column, three_prime_preset: bool) -> Column:
    """Where a piece of ``target`` bases begins, for a position in [0, 1]."""
    where = position if three_prime_preset else 1 - position
    return F.greatest(F.lit(0), F.least(F.floor((length - target) * where).cast("int"), (length - target).cast("int")))


def truncation_target(length: Column, target: Column) -> Column:
    return F.when(target.isNull() | (target <= 0), length).otherwise(F.least(target, length)).cast("int")
