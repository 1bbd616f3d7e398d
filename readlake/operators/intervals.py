"""Interval joins, depth, and binned coverage profiles.

Intervals meet in buckets of equal width by an equi-join, so a theta join never becomes a nested
loop; of the buckets that two intervals share, only the one where the later of them starts keeps
the pair, so nothing has to be made distinct. Depth is kept as runs of equal value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlake.scratch import saved

#: Least width of a bucket, and places whose depth is swept together.
LEAST_BUCKET, DEPTH_BLOCK = 100, 1 << 16
#: Of all pairs: ids of reads and of transcripts that lie alike in a row, transcripts that a read meets in one piece of a
#: bucket, and pairs that are looked at in one piece. None of them leaves anything out; there are at most so many tasks.
READS, TOGETHER, MET, PAIRS, TASKS = 16, 256, 1 << 14, 1 << 24, 20_000


def bucket_width(intervals: DataFrame, start: str = "start", end: str = "end") -> int:
    """A width that an interval of mean length spans about twice: buckets hold few intervals that don't
    meet, and intervals few buckets. One number comes to the driver."""
    mean = intervals.where(F.col(end) > F.col(start)).agg(F.avg(F.col(end) - F.col(start))).first()[0]
    return max(LEAST_BUCKET, int(mean or 0))


def _bucket(x: Column, width: int) -> Column:
    return F.floor(x / width).cast("long")


def overlapping(left: DataFrame, right: DataFrame, *, key: str = "chrom", start: str = "start", end: str = "end", bucket: int | None = None) -> DataFrame:
    """Pairs of rows (structs ``l`` and ``r``) of equal ``key`` whose [start, end) overlap. Without a
    ``bucket`` its width comes from ``right``, the annotation. A bucket where very many rows of
    ``left`` pile up is a skewed key of a plain equi-join, which Spark splits while it runs."""
    bucket = bucket or bucket_width(right, start, end)
    a = left.where(F.col(end) > F.col(start)).select(F.struct(*left.columns).alias("l"), F.col(key).alias("k"), F.explode(F.sequence(_bucket(F.col(start), bucket), _bucket(F.col(end) - 1, bucket))).alias("b"))
    c = right.where(F.col(end) > F.col(start)).select(F.struct(*right.columns).alias("r"), F.col(key).alias("k"), F.explode(F.sequence(_bucket(F.col(start), bucket), _bucket(F.col(end) - 1, bucket))).alias("b"))
    l_start, r_start = F.col(f"l.{start}"), F.col(f"r.{start}")
    meet = (l_start < F.col(f"r.{end}")) & (r_start < F.col(f"l.{end}")) & (F.col("b") == _bucket(F.greatest(l_start, r_start), bucket))
    return a.join(c, ["k", "b"]).where(meet).select("l", "r")


def assign_best_overlap(reads: DataFrame, transcripts: DataFrame, *, min_overlap: float = 0.5, coords: str = "reference", order: str = "ord", bucket: int | None = None) -> DataFrame:
    """Each read's transcript of the largest overlapped part: read_id, transcript_id,
    overlap_fraction, read_length, alignment_length.

    Reads (read_id, chrom, start, end[, read_length]) and transcripts (transcript_id, chrom, start,
    end, ``order``). ``coords='reference'`` compares the numbers as they are; ``'half_open'`` first
    takes the 1-based start of a transcript back by one. Ties go to the first in file order; reads
    of no length and those below ``min_overlap`` have no row. A read with several records has a row
    for each, equal ones too.

    Only different places meet, each is decided once and then joined to its reads, so the pairs grow
    with the places and neither with the reads nor with the transcripts that lie alike.
    """
    if coords not in ("reference", "half_open"):
        raise ValueError(coords)
    if coords == "half_open":
        transcripts = transcripts.withColumn("start", F.col("start") - 1)
    length = "read_length" if "read_length" in reads.columns else None
    own = reads.select("read_id", "chrom", "start", "end", *([length] if length else []))
    places = own.select("chrom", "start", "end").distinct()
    pairs = overlapping(places, _leading(transcripts.select("transcript_id", "chrom", "start", "end", F.col(order).alias("ord"))), bucket=bucket)
    size = F.col("end") - F.col("start")
    fraction = (F.least("l.end", "r.end") - F.greatest("l.start", "r.start")).cast("double") / (F.col("l.end") - F.col("l.start")).cast("double")
    # the pairs of a task are aggregated before anything is moved
    first = F.min(F.struct((-F.col("fraction")).alias("minus"), F.col("r.ord").alias("ord"), F.col("r.transcript_id").alias("transcript_id"))).alias("best")
    best = pairs.withColumn("fraction", fraction).where(F.col("fraction") >= min_overlap).groupBy("l.chrom", "l.start", "l.end").agg(first)
    rows = own.join(best, ["chrom", "start", "end"])
    return rows.select("read_id", "best.transcript_id", (-F.col("best.minus")).alias("overlap_fraction"), (F.col(length) if length else size).cast("int").alias("read_length"), size.cast("int").alias("alignment_length"))


def _leading(transcripts: DataFrame) -> DataFrame:
    """The transcripts that can be the best of a read: of equal places the first, and none that lies in a
    longer one of the same start or end and comes after it."""
    name = F.struct("ord", "transcript_id")
    rows = transcripts.where("end > start").groupBy("chrom", "start", "end").agg(F.min(name).alias("name"))
    for same, longest in (("start", F.desc("end")), ("end", F.asc("start"))):
        longer = W.partitionBy("chrom", same).orderBy(longest).rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("before", F.min("name").over(longer)).where("before is null or name < before").drop("before")
    return rows.select("name.transcript_id", "chrom", "start", "end", "name.ord")


def interval_reads(transcripts: DataFrame, alignments: DataFrame) -> DataFrame:
    """Alignments of each transcript: those whose reference is the transcript, and for transcripts
    without any those that overlap its place. ``alignments`` (read_id, chrom, start, end); columns
    transcript_id, read_id, start, end, by_name."""
    by_name = alignments.select(F.col("chrom").cast("string").alias("transcript_id"), "read_id", "start", "end").join(transcripts.select(F.col("transcript_id").cast("string").alias("transcript_id")).distinct(), "transcript_id", "left_semi")
    rest = transcripts.withColumn("transcript_id", F.col("transcript_id").cast("string")).join(by_name.select("transcript_id").distinct(), "transcript_id", "left_anti")
    place = _all_pairs(alignments.select("read_id", F.col("chrom").cast("string").alias("chrom"), "start", "end"), rest.select("transcript_id", F.col("chrom").cast("string").alias("chrom"), (F.col("start") - 1).alias("start"), "end"))
    return by_name.withColumn("by_name", F.lit(True)).unionByName(place.withColumn("by_name", F.lit(False)))


def _alike(rows: DataFrame, name: str, most: int) -> DataFrame:
    """Rows that lie alike as lists ``own`` of about ``most`` names, in as many rows (``row``) as that takes.
    Equal rows are counted and dealt over those rows too, so one that repeats makes no longer list."""
    place = ["chrom", "start", "end"]
    each = rows.where("end > start").groupBy(name, *place).agg(F.count(F.lit(1)).alias("times"))
    dealt = each.join(each.groupBy(*place).agg(F.ceil(F.sum("times") / most).alias("rows")), place)
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.least("times", "rows") - 1)).alias("i"))
    copies = F.expr("cast(times div rows + if(i < times % rows, 1, 0) as int)")
    names = F.flatten(F.collect_list(F.array_repeat(F.struct(F.col(name).alias("name")), copies)))  # in structs, lest nulls be left out
    own = dealt.groupBy(*place, F.pmod(F.pmod(F.xxhash64(name), "rows") + F.col("i"), "rows").alias("row")).agg(names.alias("own"))
    return saved(own.withColumn("own", F.col("own.name")))


def _all_pairs(reads: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Every read of every transcript that it overlaps: transcript_id, read_id, start, end (of the read).

    The rows are as many as the pairs, so that bytes say little of the work. Places meet, with the ids that lie
    there, and a bucket is cut into pieces by the pairs that it may hold: into parts of its transcripts, each of
    which all its reads meet, and these into parts of the reads, to each of which the transcripts are copied. A row
    of reads makes at most about ``READS`` times ``MET`` rows at once, and a piece looks at about ``PAIRS``."""
    right = _alike(transcripts, "transcript_id", TOGETHER)
    width = bucket_width(right)
    first = _bucket(F.col("start"), width)
    buckets = F.explode(F.sequence(first, _bucket(F.col("end") - 1, width))).alias("b")

    def sides(own: DataFrame, side: str) -> DataFrame:
        rows = own.select(F.col("chrom").alias("k"), buckets, F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.col("own").alias(side), "row", first.alias("first"))
        return rows.withColumn(f"{side}_first", F.col("b") == F.col("first")).drop("first")

    left, right = sides(_alike(reads, "read_id", READS), "l"), sides(right, "r")
    many = lambda rows, side: rows.groupBy("k", "b").agg(F.sum(F.size(side)).alias(f"{side}_many"), F.count(F.lit(1)).alias(f"{side}_rows"))
    parts = F.least(F.ceil(F.col("l_many") * F.least("r_many", F.lit(MET)) / PAIRS), "l_rows")
    dealt = saved(many(left, "l").join(many(right, "r"), ["k", "b"]).select("k", "b", parts.alias("ls"), F.ceil(F.col("r_many") / MET).alias("rs"), (F.col("l_many") * F.col("r_many")).alias("pairs")))
    tasks = -(-(dealt.agg(F.sum("pairs")).first()[0] or 0) // PAIRS)
    tasks = min(max(tasks, reads.sparkSession.sparkContext.defaultParallelism), TASKS)

    def pieces(rows: DataFrame, side: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(f"{side}_start", f"{side}_end", "row"), f"{side}s").alias(f"{side}p")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)).alias(f"{other}p")
        own = rows.join(dealt, ["k", "b"]).select("k", "b", f"{side}_start", f"{side}_end", f"{side}_first", side, part, each)
        return own.repartition(tasks, "k", "b", "lp", "rp")  # a given number of tasks is not lowered for few bytes

    # of the buckets that both lie in, the one where the later starts
    meet = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("l_first") | F.col("r_first"))
    met = pieces(left, "l", "r").join(pieces(right, "r", "l"), ["k", "b", "lp", "rp"]).where(meet)
    met = met.select(F.explode("r").alias("transcript_id"), "l", "l_start", "l_end")
    return met.select("transcript_id", F.explode("l").alias("read_id"), F.col("l_start").alias("start"), F.col("l_end").alias("end"))


def annotated(alignments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Alignments of annotated transcripts only, with their transcript_length."""
    lengths = transcripts.select("transcript_id", F.col("length").alias("transcript_length"))
    return alignments.drop("transcript_length").join(lengths, "transcript_id")


def depth(alignments: DataFrame, lengths: DataFrame) -> DataFrame:
    """Runs of equal depth: transcript_id, seg_start, seg_end, depth, over the whole of every
    transcript of ``lengths`` (transcript_id, length). Alignments are clipped to it; a sweep over
    starts and ends replaces the bases, and events of one place are summed before they move. With a column
    ``times`` a row stands for as many alignments.

    Events are swept in blocks of ``DEPTH_BLOCK`` places, each for itself; what the blocks before have
    added up to, and where the next one begins, comes from a table of one row a block, so a long
    contig is swept in many tasks and a run may cross any number of blocks."""
    times = F.col("times").cast("long") if "times" in alignments.columns else F.lit(1).cast("long")
    clipped = alignments.join(lengths, "transcript_id").select("transcript_id", F.greatest(F.col("start"), F.lit(0)).cast("int").alias("start"), F.least("end", "length").cast("int").alias("end"), times.alias("times")).where("end > start")
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.col("times").alias("step")), F.struct(F.col("end").alias("pos"), (-F.col("times")).alias("step")))).alias("e")
    whole = F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).cast("long").alias("step")), F.struct(F.col("length").cast("int").alias("pos"), F.lit(0).cast("long").alias("step")))).alias("e")
    events = clipped.select("transcript_id", ends).unionByName(lengths.select("transcript_id", whole)).select("transcript_id", "e.pos", "e.step")
    block = F.expr(f"cast(pos div {DEPTH_BLOCK} as int)").alias("block")
    steps = events.groupBy("transcript_id", block, "pos").agg(F.sum("step").alias("step"))
    blocks = events.groupBy("transcript_id", block).agg(F.sum("step").alias("total"), F.min("pos").alias("first"))
    along = W.partitionBy("transcript_id").orderBy("block")  # one row a block
    carried = blocks.select("transcript_id", "block", (F.sum("total").over(along) - F.col("total")).alias("before"), F.lead("first").over(along).alias("next"))
    order = W.partitionBy("transcript_id", "block").orderBy("pos")
    runs = steps.select("transcript_id", "block", F.col("pos").alias("seg_start"), F.lead("pos").over(order).alias("inside"), F.sum("step").over(order).alias("own"))
    met = runs.join(carried, ["transcript_id", "block"])
    out = met.select("transcript_id", "seg_start", F.coalesce("inside", "next").alias("seg_end"), (F.col("own") + F.col("before")).cast("long").alias("depth"))
    return out.where("seg_end is not null")


def flip_by_strand(runs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Runs of '-' transcripts counted from their other end."""
    own = runs.join(transcripts.select("transcript_id", "strand", F.col("length").alias("whole")), "transcript_id")
    minus = F.col("strand") == "-"
    return own.select("transcript_id", F.when(minus, F.col("whole") - F.col("seg_end")).otherwise(F.col("seg_start")).alias("seg_start"), F.when(minus, F.col("whole") - F.col("seg_start")).otherwise(F.col("seg_end")).alias("seg_end"), "depth")


def bin_depth(runs: DataFrame, lengths: DataFrame, n_bins: int, norm: str = "none") -> DataFrame:
    """Mean depth of each of ``n_bins`` bins [i*L div n, (i+1)*L div n): transcript_id, bin, value.

    ``sum``: shares of the whole, all 0 where the transcript has fewer bases than bins; ``mean100``:
    100 * v / (mean + 1e-10); ``max``: v / max, 0 where that is 0. An empty bin is 0. A run meets
    only the bins that it touches.
    """
    if norm not in ("none", "sum", "mean100", "max"):
        raise ValueError(norm)
    n = F.lit(n_bins).cast("long")
    own = runs.join(lengths.select("transcript_id", F.col("length").cast("long").alias("L")), "transcript_id")
    low, high = F.expr(f"(bin * L) div {n_bins}"), F.expr(f"((bin + 1) * L) div {n_bins}")
    touched = F.sequence(F.expr(f"greatest(seg_start * {n_bins}L div L - 1, 0L)"), F.expr(f"least((seg_end - 1) * {n_bins}L div L + 1, {n_bins - 1}L)"))
    met = own.where("L > 0").withColumn("bin", F.explode(touched)).withColumn("shared", F.least(F.col("seg_end"), high) - F.greatest(F.col("seg_start"), low)).where("shared > 0")
    sums = met.groupBy("transcript_id", "bin").agg(F.sum(F.col("depth") * F.col("shared")).alias("bases"))
    grid = lengths.select("transcript_id", F.col("length").cast("long").alias("L"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin"))
    width = high - low
    value = F.coalesce(F.try_divide(F.col("bases").cast("double"), width.cast("double")), F.lit(0.0))
    rows = grid.join(sums, ["transcript_id", "bin"], "left").select("transcript_id", F.col("bin").cast("int").alias("bin"), "L", value.alias("value"))
    one = W.partitionBy("transcript_id")
    if norm == "sum":
        share = F.coalesce(F.try_divide(F.col("value"), F.sum("value").over(one)), F.lit(0.0))
        rows = rows.withColumn("value", F.when(F.col("L") < n_bins, 0.0).otherwise(share))
    elif norm == "mean100":
        rows = rows.withColumn("value", 100 * F.col("value") / (F.avg("value").over(one) + F.lit(1e-10)))
    elif norm == "max":
        rows = rows.withColumn("value", F.coalesce(F.try_divide(F.col("value"), F.max("value").over(one)), F.lit(0.0)))
    return rows.drop("L")


def profile_matrix(profile: DataFrame, n_bins: int) -> DataFrame:
    """transcript_id, bin_1 .. bin_n."""
    wide = profile.groupBy("transcript_id").pivot("bin", list(range(n_bins))).agg(F.first("value"))
    return wide.select("transcript_id", *(F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"bin_{i + 1}") for i in range(n_bins)))


def profile_rows(matrix: DataFrame, n_bins: int) -> DataFrame:
    """The long form of ``profile_matrix``."""
    return matrix.unpivot("transcript_id", [f"bin_{i + 1}" for i in range(n_bins)], "name", "value").select("transcript_id", (F.substring("name", 5, 9).cast("int") - 1).alias("bin"), "value")


def end_mass(profile: DataFrame, n_bins: int, by: str = "transcript_id") -> DataFrame:
    """Share of a profile in its 5' and 3' half, their ratio (null without 5' mass), and its label."""
    from readlake.functions.reads import bias_category

    # added up in the order of the bins: any other may move a ratio across the limit of a label
    ordered = profile.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("bins"))
    half = lambda inside: F.aggregate(F.filter("bins", inside), F.lit(0.0), lambda total, x: total + F.coalesce(x["value"], F.lit(0.0)))
    rows = ordered.select(by, half(lambda x: x["bin"] < n_bins // 2).alias("a"), half(lambda x: x["bin"] >= n_bins // 2).alias("b")).where("a + b > 0")
    return rows.select(by, (F.col("a") / (F.col("a") + F.col("b"))).alias("five_prime"), (F.col("b") / (F.col("a") + F.col("b"))).alias("three_prime"), F.try_divide("b", "a").alias("ratio")).withColumn("category", bias_category(F.col("ratio")))


def top_covered(alignments: DataFrame, n: int = 50) -> DataFrame:
    """The alignments of the ``n`` transcripts with the most of them; ties by id."""
    top = alignments.groupBy("transcript_id").count().orderBy(F.desc("count"), "transcript_id").limit(n)
    return alignments.join(F.broadcast(top.select("transcript_id")), "transcript_id", "left_semi")


def mean_depth(alignments: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """transcript_id, length, mean_depth; the length is annotated, else that of the header, else the largest end."""
    seen = alignments.groupBy("transcript_id").agg(F.max("transcript_length").alias("header"), F.max("end").alias("last")) if "transcript_length" in alignments.columns else alignments.groupBy("transcript_id").agg(F.lit(None).cast("int").alias("header"), F.max("end").alias("last"))
    if lengths is not None:
        seen = seen.join(lengths.select("transcript_id", F.col("length").alias("annotated")), "transcript_id", "left")
    else:
        seen = seen.withColumn("annotated", F.lit(None).cast("int"))
    own = seen.select("transcript_id", F.coalesce("annotated", "header", "last").alias("length"))
    runs = depth(alignments, own)
    bases = runs.groupBy("transcript_id").agg(F.sum(F.col("depth") * (F.col("seg_end") - F.col("seg_start"))).alias("bases"))
    return own.join(bases, "transcript_id").select("transcript_id", "length", F.try_divide(F.col("bases").cast("double"), F.col("length").cast("double")).alias("mean_depth"))
