"""Sequencing text formats as DataFrames. Every reader goes through Spark's own text source, so any
path that Spark can open will do; lines never leave the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.functions import reads as R
from readlake.functions.sequences import reverse_complement

TRANSCRIPTS = "transcript_id string, chrom string, start int, end int, strand string, length int, ord long"
_NO_LENGTH = 1000
#: Why a line is no record.
REASONS = ("fields", "flag", "place", "alignment")


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, n, line) with the lines of each file numbered from 0 in its order.

    A block of a file is read by one task from its first line to its last, so ids that increase
    along a partition are consecutive there: a line's number is its distance from the block's first
    id, plus the lines of the blocks before. One row a block is all that is counted beforehand.
    """
    lines = spark.read.text(_paths(paths)).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = F.sum("lines").over(W.partitionBy("file").orderBy("block")) - F.col("lines")
    starts = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    return lines.join(starts, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("n"), "line")


def read_fastq(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """read_id, header, seq, qual of 4-line records; ``.gz`` by suffix. Each file is numbered by
    itself, so records keep together however it is split."""
    part = F.col("n") % 4
    line = lambda k: F.max(F.when(part == k, F.col("line")))
    rows = _lines(spark, paths).groupBy("file", F.floor(F.col("n") / 4).alias("rec")).agg(line(0).alias("header"), line(1).alias("seq"), line(3).alias("qual"))
    return rows.where(F.col("header").startswith("@")).select(F.regexp_extract("header", r"^@(\S*)", 1).alias("read_id"), "header", "seq", "qual")


def read_fasta(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """seq_id, seq, length; a record's lines are joined in order. A new line with ``>`` ends a record,
    so Spark's text source gives one row each and nothing is moved. Files begin with ``>``; blank
    lines before it are left out."""
    record = F.regexp_replace("value", r"^\s*>?", "")
    rows = spark.read.option("lineSep", "\n>").text(_paths(paths)).select(record.alias("r")).where("r <> ''")
    body = F.when(F.col("r").contains("\n"), F.regexp_replace(F.col("r"), r"^[^\n]*\n", "")).otherwise("")
    seq = F.regexp_replace(body, r"^\s+|\s*\n\s*|\s+$", "")
    return rows.select(F.regexp_extract("r", r"^(\S*)", 1).alias("seq_id"), seq.alias("seq")).withColumn("length", F.length("seq"))


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """(n, f): the fields of lines that are no comments; n orders them, files by name."""
    rows = _lines(spark, path).where(~F.col("line").startswith("#"))
    files = rows.groupBy("file").agg((F.max("n") + 1).alias("lines"))
    before = files.select("file", (F.sum("lines").over(W.orderBy("file")) - F.col("lines")).alias("before"))  # one row a file
    return rows.join(before, "file").select((F.col("n") + F.col("before")).alias("n"), F.split("line", "\t").alias("f"))


def _attribute(attributes: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(attributes, pattern, 1), F.lit(""))


def _last(rows: DataFrame) -> DataFrame:
    kept = rows.groupBy("transcript_id").agg(F.max_by(F.struct("chrom", "start", "end", "strand", "ord"), "ord").alias("r"))
    return kept.select("transcript_id", "r.chrom", "r.start", "r.end", "r.strand", (F.col("r.end") - F.col("r.start") + 1).alias("length"), "r.ord")


def read_gtf(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """``TRANSCRIPTS`` of an annotation; the last row of an id holds.

    strict: features named transcript, id from the attribute transcript_id, quoted or bare. lenient:
    also mRNA, in any case, and the id may be ``ID=`` without its prefix; rows whose numbers don't
    parse are skipped; if there is no transcript at all, every row of 8 fields or more is one,
    named by its first field. gff_end: the id is what follows the first ``=``, the length its end.
    """
    if mode not in ("strict", "lenient", "gff_end"):
        raise ValueError(mode)
    rows = _fields(spark, path)
    f = F.col("f")
    start, end = f[3].try_cast("int") if mode != "strict" else f[3].cast("int"), f[4].try_cast("int") if mode != "strict" else f[4].cast("int")
    strict_id = _attribute(f[8], r"transcript_id[ =]+\"?([^\";\s]+)")
    if mode == "strict":
        own = rows.where((F.size(f) >= 9) & (f[2] == "transcript"))
        ids = strict_id
    elif mode == "lenient":
        own = rows.where((F.size(f) >= 9) & F.lower(f[2]).isin("transcript", "mrna"))
        ids = F.coalesce(strict_id, _attribute(f[8], r"ID=(?:[^:;]*:)?([^;\s]+)"))
    else:
        own = rows.where((F.size(f) >= 9) & F.lower(f[2]).isin("transcript", "mrna"))
        ids = _attribute(f[8], r"=([^;]+)")
    out = own.select(ids.alias("transcript_id"), f[0].alias("chrom"), start.alias("start"), end.alias("end"), f[6].alias("strand"), F.col("n").alias("ord")).where("transcript_id is not null and start is not null and end is not null")
    out = _last(out)
    if mode == "gff_end":
        out = out.withColumn("length", F.col("end"))
    if mode == "lenient" and out.limit(1).count() == 0:
        length = F.coalesce(end - start + 1, F.lit(_NO_LENGTH))
        every = rows.where(F.size(f) >= 8).select(f[0].alias("transcript_id"), f[0].alias("chrom"), F.coalesce(start, F.lit(1)).alias("start"), F.coalesce(end, F.lit(_NO_LENGTH)).alias("end"), f[6].alias("strand"), length.alias("length"), F.col("n").alias("ord"))
        last = every.groupBy("transcript_id").agg(F.max_by(F.struct("chrom", "start", "end", "strand", "length", "ord"), "ord").alias("r"))
        out = last.select("transcript_id", "r.chrom", "r.start", "r.end", "r.strand", "r.length", "r.ord")
    return out


def _parsed(lines: DataFrame) -> DataFrame:
    """Fields of SAM lines that are no header, with the reason why one is no record (null: it is one). A line
    is split once: as the row of an array of one the fields are a column that filters on them don't make again."""
    f = F.col("f")
    nm = F.regexp_extract("value", r"\tNM:i:(\d+)", 1).try_cast("int")
    rows = lines.where(~F.col("value").startswith("@")).select("*", F.explode(F.array(F.split("value", "\t"))).alias("f"))
    field = lambda i: F.get(f, F.lit(i))
    named = lambda c: F.nullif(c, F.lit("*"))
    rows = rows.withColumns({"flag": field(1).try_cast("int"), "start": field(3).try_cast("int") - 1, "mapq": field(4).try_cast("int"), "cigar": named(field(5)), "transcript_id": named(field(2))})
    unmapped = R.has_flag(F.col("flag"), R.UNMAPPED)
    reason = F.when(F.size(f) < 11, "fields").when(F.col("flag").isNull(), "flag").when(F.col("start").isNull(), "place").when(~unmapped & (F.col("transcript_id").isNull() | F.col("cigar").isNull()), "alignment")
    return rows.select("*", field(0).alias("read_id"), field(9).alias("seq"), field(10).alias("qual"), nm.alias("NM"), reason.alias("reason")).drop("f")


def with_measures(records: DataFrame, references: DataFrame) -> DataFrame:
    """Records (transcript_id, start, cigar, NM, ...) with operation counts, spans, reference lengths from
    ``references`` (transcript_id, transcript_length) and metrics. An unmapped record has no operations."""
    counts = {op: R.cigar_count(F.coalesce("cigar", F.lit("")), op) for op in "MIDSHNX"} | {"EQ": R.cigar_count(F.coalesce("cigar", F.lit("")), "=")}
    rows = records.withColumns(counts)
    spans = {"end": F.col("start") + F.col("M") + F.col("D") + F.col("N") + F.col("X") + F.col("EQ"), "aligned_length": F.col("M") + F.col("I") + F.col("X") + F.col("EQ"), "read_length": F.col("M") + F.col("I") + F.col("S") + F.col("X") + F.col("EQ")}
    rows = rows.withColumns(spans).join(references, "transcript_id", "left")
    metrics = {"aligned_fraction": R.aligned_fraction(F.col("aligned_length"), F.col("read_length")), "read_coverage": R.read_coverage(F.col("start"), F.col("end"), F.col("transcript_length")), "read_accuracy": R.read_accuracy(F.col("M"), F.col("I"), F.col("D"), F.col("NM"))}
    return rows.withColumns(metrics).drop("N", "X", "EQ")


def read_alignments(spark: SparkSession, path: str | Sequence[str], skip_corrupt: bool = False, keep_unmapped: bool = False, counts: Observation | None = None) -> DataFrame:
    """Mapped records of SAM text with operation counts and metrics, and with ``keep_unmapped`` the others
    too. Records that don't parse are skipped (``rejected_records`` has them), and with ``skip_corrupt``
    so is what follows a break in a compressed file. Reference lengths come from the ``@SQ`` lines of all
    files; a reference that has two lengths is an error.

    ``counts`` observes, in the same pass, lines that are no header, those ``kept``, ``unmapped`` ones left
    out and those rejected for each reason."""
    lines = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).text(_paths(path))
    sq = lines.where(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", r"SN:(\S+)", 1).alias("transcript_id"), F.regexp_extract("value", r"LN:(\d+)", 1).try_cast("int").alias("length"))
    sizes = sq.groupBy("transcript_id").agg(F.min("length").alias("low"), F.max("length").alias("high"))
    clash = F.raise_error(F.concat(F.lit("two lengths of reference "), "transcript_id")).cast("int")
    references = sizes.select("transcript_id", F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNotNull(), clash).alias("transcript_length"))
    rows = _parsed(lines)
    left_out = F.lit(False) if keep_unmapped else R.has_flag(F.col("flag"), R.UNMAPPED)
    kept = F.col("reason").isNull() & ~left_out
    if counts is not None:
        reasons = [F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r) for r in REASONS]
        rows = rows.observe(counts, F.count(F.lit(1)).alias("lines"), F.count_if(kept).alias("kept"), F.count_if(F.col("reason").isNull() & left_out).alias("unmapped"), *reasons)
    names = ("read_id", "flag", "transcript_id", "start", "mapq", "cigar", "seq", "qual", "NM")
    return with_measures(rows.where(kept).select(*names), references)


def rejected_records(spark: SparkSession, path: str | Sequence[str], skip_corrupt: bool = False) -> DataFrame:
    """(file, line, reason): the lines of SAM text that are neither headers nor records. Reasons: too few
    ``fields``, a ``flag`` or a ``place`` that is no number, an ``alignment`` without reference or operations."""
    lines = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).text(_paths(path)).select("value", F.col("_metadata.file_path").alias("file"))
    return _parsed(lines).where("reason is not null").select("file", F.col("value").alias("line"), "reason")


def alignments_to_reads(alignments: DataFrame) -> DataFrame:
    """Names, bases and qualities of primary records as they were read: reversed where the flag says so.
    Of several primary records of a read the one of the smallest flag, reference and place is taken."""
    record = F.struct("flag", "transcript_id", "start", "cigar", "seq", "qual")
    own = alignments.where(R.is_primary(F.col("flag"))).groupBy("read_id").agg(F.min(record).alias("r")).select("read_id", "r.*")
    back = R.has_flag(F.col("flag"), R.REVERSE)
    return own.select("read_id", F.concat(F.lit("@"), "read_id").alias("header"), F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def annotation_from_sequences(sequences: DataFrame) -> DataFrame:
    """GTF lines (value) that make every sequence a transcript with one exon, 1..length on '+'."""
    attributes = F.concat(F.lit('gene_id "'), "seq_id", F.lit('"; transcript_id "'), "seq_id", F.lit('";'))
    rows = sequences.select("seq_id", "length", F.explode(F.array(F.lit("transcript"), F.lit("exon"))).alias("feature"))
    return rows.select(F.concat_ws("\t", "seq_id", F.lit("readlake"), "feature", F.lit("1"), F.col("length").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attributes).alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    header = F.when(F.col("header").startswith("@"), F.col("header")).otherwise(F.concat(F.lit("@"), "header"))
    return reads.select(F.concat_ws("\n", header, "seq", F.lit("+"), "qual").alias("value"))


def write_fastq(reads: DataFrame, path: str, compression: str | None = None) -> None:
    """4-line records, one file for each partition."""
    fastq_lines(reads).write.mode("overwrite").text(path, compression=compression)


def concat_sequences(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def merge_alignments(*parts: DataFrame) -> DataFrame:
    """All alignments in coordinate order within range partitions."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.repartitionByRange("transcript_id", "start").sortWithinPartitions("transcript_id", "start")


def merge_alignment_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The alignments of all files in coordinate order. A file that is missing is left out, and one
    that is broken gives the records before the break. ValueError if none is there."""
    parts = []
    for path in paths:
        try:
            parts.append(read_alignments(spark, path, skip_corrupt=True))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not parts:
        raise ValueError("no alignment file is there")
    return merge_alignments(*parts)


def record_count(alignments: DataFrame) -> DataFrame:
    """One row with the number of records, n."""
    return alignments.agg(F.count(F.lit(1)).alias("n"))
