"""Features of base sequences. Upper case is ASCII only, so that lengths and counts don't change."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

END_BASES = 50
#: Hairpin arms: bases compared, and the distance between the arms' starts.
ARM, APART, HAIRPIN_LEAST = 10, 20, 30
WINDOW, MANY_G = 15, 10
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def ascii_upper(s: Column) -> Column:
    """A text of one byte a character goes the short way."""
    return F.when(F.octet_length(s) == F.length(s), F.upper(s)).otherwise(F.translate(s, string.ascii_lowercase, string.ascii_uppercase))


def base_count(s: Column, bases: str) -> Column:
    return F.length(s) - F.length(F.translate(s, bases, ""))


def gc_content(s: Column) -> Column:
    return F.coalesce(F.try_divide(base_count(s, "GC").cast("double"), F.length(s).cast("double")), F.lit(0.0))


def gc_skew(s: Column) -> Column:
    g, c = base_count(s, "G"), base_count(s, "C")
    return F.coalesce(F.try_divide((g - c).cast("double"), (g + c).cast("double")), F.lit(0.0))


def five_prime_gc(s: Column) -> Column:
    return gc_content(F.substring(s, 1, END_BASES))


def three_prime_gc(s: Column) -> Column:
    return gc_content(F.right(s, F.lit(END_BASES)))


def homopolymer_ratio(s: Column) -> Column:
    """Longest run of one base over the length."""
    runs = F.regexp_extract_all(s, F.lit("A+|C+|G+|T+"), F.lit(0))
    return F.coalesce(F.try_divide(F.array_max(F.transform(runs, F.length)).cast("double"), F.length(s).cast("double")), F.lit(0.0))


@pandas_udf(LongType())
def distinct_kmers(s: pd.Series) -> pd.Series:
    """Distinct k-mers, k = min(4, n // 2) or 1 for n up to 4; by characters."""

    def count(text) -> int:
        if not text:
            return 0
        k = min(4, len(text) // 2) if len(text) > 4 else 1
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes) - k + 1
        key = np.zeros(n, np.uint64)
        for j in range(k):  # a code point has 21 bits; three fit, the fourth is mixed in by an odd factor
            key = (key * np.uint64(0x9E3779B97F4A7C15)) + codes[j : j + n]
        return len(np.unique(key))

    return s.map(count).astype("int64")


def kmer_complexity(s: Column, norm: str = "capped") -> Column:
    """Distinct k-mers over the windows, or over as many as there could be ('capped')."""
    return complexity_of(distinct_kmers(s), F.length(s), norm)


def complexity_of(distinct: Column, n: Column, norm: str = "capped") -> Column:
    """``kmer_complexity`` of a sequence of length ``n`` with so many distinct k-mers."""
    if norm not in ("windows", "capped"):
        raise ValueError(norm)
    size = F.when(n > 4, F.least(F.lit(4), F.floor(n / 2).cast("int"))).otherwise(1)
    windows = n - size + 1
    most = windows if norm == "windows" else F.least(F.pow(F.lit(4.0), size).cast("long"), windows.cast("long"))
    least = size if norm == "windows" else F.lit(0)  # the window norm has no value for a single window
    return F.when(n > least, F.try_divide(distinct.cast("double"), most.cast("double"))).otherwise(0.0)


@pandas_udf(DoubleType())
def hairpin_potential(s: pd.Series) -> pd.Series:
    """Best match of ten bases with the complement of those twenty further on."""

    def score(text) -> float:
        n = len(text) if text else 0
        if n <= HAIRPIN_LEAST:
            return 0.0
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        b = np.frombuffer(text.translate(_COMPLEMENT).encode("utf-32-le", "surrogatepass"), np.uint32)
        base = np.isin(a, np.frombuffer("ACGT".encode("utf-32-le"), np.uint32))
        same = ((a[:-APART] == b[APART:]) & base[:-APART]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(same)])
        starts = n - HAIRPIN_LEAST
        return float((total[ARM : ARM + starts] - total[:starts]).max()) / ARM

    return s.map(score).astype("float64")


@pandas_udf(DoubleType())
def g_quadruplex_potential(s: pd.Series) -> pd.Series:
    """Part of the windows of 15 bases that hold more than ten G; the last window isn't looked at."""

    def score(text) -> float:
        n = len(text) if text else 0
        if n < WINDOW:
            return 0.0
        g = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == ord("G")
        total = np.concatenate([[0], np.cumsum(g)])
        starts = n - WINDOW
        return float(np.count_nonzero(total[WINDOW : WINDOW + starts] - total[:starts] > MANY_G)) / (n - WINDOW + 1)

    return s.map(score).astype("float64")


#: What ``measures`` gives: counts of G, C and of both at the ends, distinct k-mers, the longest run of one base, and two potentials.
_MEASURED = StructType([*(StructField(c, LongType()) for c in ("g", "c", "five", "three", "kmers", "run")), *(StructField(c, DoubleType()) for c in ("hairpin", "quad"))])


def _codes(text: str) -> np.ndarray:
    """The code points of a text, ASCII letters in upper case."""
    if text.isascii():
        return np.frombuffer(text.encode().upper(), np.uint8)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes - np.where((codes >= ord("a")) & (codes <= ord("z")), np.uint32(32), np.uint32(0))


def _measured(text: str) -> tuple:
    """All of ``_MEASURED`` of one text that is not empty, which is decoded once."""
    x = _codes(text)
    n = len(x)
    # bases by number, 1 to 4, such that two that pair add up to 5; all else is 0
    base = _BASE[x] if x.dtype == np.uint8 else np.where(x < 128, _BASE[np.minimum(x, 127)], np.int8(0))
    g, c = base == 3, base == 2
    both = g | c
    k = min(4, n // 2) if n > 4 else 1
    if x.dtype == np.uint8:
        key = x[: n - k + 1].astype(np.uint32)
        for j in range(1, k):
            key = key << np.uint32(7) | x[j : n - k + 1 + j]
    else:  # a code point has 21 bits; three fit, the fourth is mixed in by an odd factor
        key = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            key = key * np.uint64(0x9E3779B97F4A7C15) + x[j : n - k + 1 + j]
    key.sort()
    kmers = 1 + np.count_nonzero(key[1:] != key[:-1])
    ends = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1], [True]]))
    run = int((np.diff(ends) * (base[ends[:-1]] > 0)).max())
    hairpin = quad = 0.0
    if n > HAIRPIN_LEAST:
        total = np.zeros(n - APART + 1, np.int64)
        np.cumsum((base[:-APART] + base[APART:] == 5) & (base[:-APART] > 0) & (base[APART:] > 0), out=total[1:])
        starts = n - HAIRPIN_LEAST
        hairpin = float((total[ARM : ARM + starts] - total[:starts]).max()) / ARM
    if n >= WINDOW:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(g, out=total[1:])
        starts = n - WINDOW
        quad = float(np.count_nonzero(total[WINDOW : WINDOW + starts] - total[:starts] > MANY_G)) / (n - WINDOW + 1)
    count = np.count_nonzero
    return count(g), count(c), count(both[:END_BASES]), count(both[-END_BASES:]), kmers, run, hairpin, quad


_BASE = np.zeros(256, np.int8)
_BASE[[ord(b) for b in "ACGT"]] = (1, 2, 3, 4)


@pandas_udf(_MEASURED)
def measures(s: pd.Series) -> pd.DataFrame:
    rows = [_measured(text) if text else (0, 0, 0, 0, 0, 0, 0.0, 0.0) for text in s]
    return pd.DataFrame(rows, columns=_MEASURED.names)


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))
