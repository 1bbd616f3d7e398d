"""Workflows over whole datasets: compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.functions.reads import fit_quality, length_bin, overfit
from readlake.operators import cells, compare, density, evaluate, intervals, models, quality
from readlake.scratch import saved


class Tables(Mapping[str, DataFrame]):
    """Tables by name, each made when it is first asked for: some write what they need beforehand, which
    those who want another table don't wait for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def evaluate_quantifier(expected: DataFrame, output: DataFrame, marker: str | None = None) -> dict[str, DataFrame]:
    """Comparison, summary, metrics of transcripts and detection by expected count."""
    comparison = evaluate.compare_counts(expected, evaluate.resolve_count_columns(output, marker))
    return {"comparison": comparison, "summary": evaluate.detection_summary(comparison), "per_transcript": evaluate.per_transcript_metrics(comparison).orderBy("detection_rate", "transcript_id"), "by_expected": evaluate.detection_by_expected_bin(comparison)}


def alignment_quality(alignments: DataFrame, ties: Sequence[str], fill_nulls: bool = False) -> dict[str, DataFrame]:
    """Metrics, primary alignments, and the tables of the quality report."""
    metrics = quality.alignment_metrics(alignments)
    primary = quality.primary_alignment(metrics, ties, fill_nulls)
    points = primary.where("read_accuracy is not null").select(F.col("read_accuracy").alias("position"), F.lit(0).alias("all"))
    return {
        "metrics": metrics, "primary": primary, "summary": quality.alignment_summary(primary), "transcripts": quality.transcript_summary(primary), "coverage_histogram": quality.coverage_fraction_histogram(primary),
        "length_coverage": quality.density_2d(primary, F.col("transcript_length").cast("double"), F.col("read_coverage"), 100.0, 0.05), "trend": quality.binned_trend(primary), "lengths": quality.transcript_length_histogram(metrics),
        "accuracy": density.position_density(points, ["all"]),
    }


def compare_datasets(rows: DataFrame, reference: str, n_bins: int = 100, least: int = 10, *, wanted: DataFrame | None = None, ties: Sequence[str] = ("transcript_id", "start"), edges: Sequence[float] = compare.FIXED_EDGES) -> Mapping[str, DataFrame]:
    """Datasets side by side: the quality of each, profiles, their similarity and bias by dataset and
    by length bin, length bins and matched lengths. ``rows`` are metric rows with dataset, read_id,
    transcript_id, transcript_length, start and end; only reads of ``wanted`` (read_id) if given."""
    if wanted is not None:
        rows = cells.select_reads(rows, wanted)
    keyed = rows.withColumn("key", F.concat_ws("\u0001", F.col("dataset"), F.col("transcript_id").cast("string")))
    lengths = keyed.groupBy("key").agg(F.max("transcript_length").alias("length"), F.first("dataset").alias("dataset"))
    each = lengths.select(F.col("key").alias("transcript_id"), "length")
    per = intervals.bin_depth(intervals.depth(keyed.select(F.col("key").alias("transcript_id"), "start", "end"), each), each, n_bins, "mean100")
    strata = lengths.select(F.col("key").alias("transcript_id"), "dataset", length_bin(F.col("length"), edges).alias("length_bin"))
    profile = per.join(strata, "transcript_id").groupBy("dataset", "bin").agg(F.avg("value").alias("value"))
    primary = quality.primary_alignment(rows.withColumn("read_id", F.struct("dataset", "read_id")), ties)
    tables = Tables(
        quality=partial(quality.alignment_summary, primary, ["dataset"]), lengths=partial(quality.comparative_length_histogram, primary), profile=lambda: profile, by_length=partial(compare.length_stratified_profile, per, strata),
        similarity=partial(compare.profile_similarity, profile), bias=partial(compare.profile_bias_metrics, profile, n_bins), length_bins=partial(compare.compare_by_length_bin, rows), matches=partial(compare.match_by_length, rows, reference, least=least),
        matched=lambda: compare.matched_statistics(rows, tables["matches"]),
    )
    return tables


def mixing_diagnostics(tracking: DataFrame, alignments: DataFrame | None = None, lengths: DataFrame | None = None, n_bins: int = 100) -> dict[str, DataFrame]:
    """The tables of a mix; with alignments and transcript lengths also the profiles of the transcripts
    with the most reads, each as a part of its own height, and their mass at both ends."""
    out = {
        "lengths": quality.read_length_histogram(tracking), "means": quality.read_length_means(tracking), "correlation": quality.length_correlation(tracking), "truncation": quality.truncation_summary(tracking),
        "truncation_ratio": quality.truncation_histogram(tracking), "per_transcript": quality.per_transcript_lengths(tracking), "per_cell": cells.transcripts_per_cell(tracking).orderBy(F.desc("transcripts"), "barcode"),
        "per_cell_summary": cells.transcripts_per_cell_summary(tracking), "per_cell_histogram": cells.transcripts_per_cell_histogram(tracking),
    }
    if alignments is not None and lengths is not None:
        top = intervals.top_covered(alignments)
        own = lengths.join(top.select("transcript_id").distinct(), "transcript_id", "left_semi")
        profile = intervals.bin_depth(intervals.depth(top, own), own, n_bins, "max")
        out |= {"top_covered": top, "matrix": intervals.profile_matrix(profile, n_bins), "end_mass": intervals.end_mass(profile, n_bins)}
    return out


def assign_transcripts(reads: DataFrame, transcripts: DataFrame, **settings) -> dict[str, DataFrame]:
    assigned = intervals.assign_best_overlap(reads, transcripts, **settings)
    return {"map": assigned, "statistics": cells.transcript_statistics(assigned), "per_transcript": cells.reads_per_transcript(assigned)}


def coverage_matrix(alignments: DataFrame, lengths: DataFrame, n_bins: int = 100) -> DataFrame:
    return intervals.profile_matrix(intervals.bin_depth(intervals.depth(alignments, lengths), lengths, n_bins, "sum"), n_bins)


def coverage_design(alignments: DataFrame, lengths: DataFrame, features: DataFrame, n_bins: int = 100, *, technology: str = "default", least: int = 15, seed: int = 42, members: DataFrame | None = None) -> DataFrame:
    """The saved design of the transcripts with at least ``least`` reads, with ``is_test``. With a column
    ``times`` a row stands for as many reads; with ``members`` (transcript_id, own) the others are those
    of ``own`` transcripts, whose profile each of their members has."""
    kept = cells.min_reads(alignments, least)
    own = lengths.join(kept.select("transcript_id").distinct(), "transcript_id", "left_semi")
    profile = intervals.bin_depth(intervals.depth(kept, own), own, n_bins, "mean100")
    if members is not None:
        profile = profile.withColumnRenamed("transcript_id", "own").join(members, "own").select("transcript_id", "bin", "value")
    return saved(models.split(models.positional_design(profile, features, n_bins, models.feature_weights(technology)), seed=seed))


def learn_coverage(alignments: DataFrame, lengths: DataFrame, features: DataFrame, n_bins: int = 100, *, technology: str = "default", boosted: bool = False, least: int = 15, seed: int = 42, settings: Mapping | None = None, members: DataFrame | None = None):
    """Learn a tree model of positional coverage: (model, predictions with is_test, metrics by part).
    The design is written to the shared folder once; every pass of the learner reads it there."""
    design = coverage_design(alignments, lengths, features, n_bins, technology=technology, least=least, seed=seed, members=members)
    fit = models.fit_boosted if boosted else models.fit_forest
    options = dict(settings or ({} if boosted else models.forest_settings(technology)))
    model = fit(design.where("not is_test"), seed=seed, **options)
    made = models.by_features(design, model.transform) if boosted else model.transform(design)
    predicted = made.select("transcript_id", "bin", "value", "prediction", "is_test")
    return model, predicted, models.regression_metrics(predicted, by=["is_test"])


def score_coverage(alignments: DataFrame, lengths: DataFrame, features: DataFrame, n_bins: int = 100, *, technology: str = "default", least: int = 15, seed: int = 42, bags: int = 10) -> DataFrame:
    """(part, n, r2, mse, mae) of a bagged forest: its training part, its test part, and out of bag."""
    design = coverage_design(alignments, lengths, features, n_bins, technology=technology, least=least, seed=seed)
    training = design.where("not is_test")
    forest = models.fit_bagged_forest(training, seed=seed, bags=bags, **models.forest_settings(technology))
    names = [f"_bag_{k}" for k in range(bags)]
    every = forest.each(design.select(*models.DESIGN, *models.KEYS, "value", "is_test")).select(*models.KEYS, "value", "is_test", *names)
    every = forest.out_of_bag(every.withColumn("mean", sum((F.col(c) for c in names), F.lit(0.0)) / bags))
    # each row counts in its part, and out of bag where a bag has left it out
    part = F.struct(F.when(F.col("is_test"), "test").otherwise("train").alias("part"), F.col("mean").alias("prediction"))
    left_out = F.when(~F.col("is_test") & F.col("prediction").isNotNull(), F.struct(F.lit("out_of_bag").alias("part"), "prediction"))
    judged = every.select("value", F.explode(F.array(part, left_out)).alias("x")).where("x is not null")
    return models.regression_metrics(judged.select("value", "x.*"), by=["part"])


def _placed(alignments: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``intervals.interval_reads`` for profiles: reads with ``times``, lengths, and members (transcript_id, own).
    Equal reads are one row that counts as many times, and transcripts of one place and length share the
    profile of the smallest id; those with reads by name have their own. So the pairs grow with the places."""
    text = lambda c: F.col(c).cast("string").alias(c)
    reads = alignments.groupBy(text("chrom"), "start", "end").agg(F.count(F.lit(1)).alias("times"))
    places = transcripts.select(text("transcript_id"), text("chrom"), "start", "end", "length")
    names = places.join(reads.select(F.col("chrom").alias("transcript_id")).distinct(), "transcript_id", "left_semi")
    rest = places.join(names.select("transcript_id"), "transcript_id", "left_anti")
    alike = ["chrom", "start", "end", "length"]
    classes = saved(rest.groupBy(*alike).agg(F.min("transcript_id").alias("own")))
    same = reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in alike))
    members = rest.alias("r").join(classes.alias("c"), same).select("r.transcript_id", "c.own").unionByName(names.select("transcript_id", F.col("transcript_id").alias("own")))
    by_name = reads.join(names.select(F.col("transcript_id").alias("chrom")).distinct(), "chrom", "left_semi").select(F.col("chrom").alias("transcript_id"), "start", "end", "times")
    met = intervals.overlapping(reads, classes.select("own", "chrom", (F.col("start") - 1).alias("start"), "end"))
    by_place = met.select(F.col("r.own").alias("transcript_id"), (F.col("l.start") - F.col("r.start")).alias("start"), (F.col("l.end") - F.col("r.start")).alias("end"), "l.times")
    lengths = classes.select(F.col("own").alias("transcript_id"), "length").unionByName(names.select("transcript_id", "length"))
    return by_name.unionByName(by_place), lengths, members


def evaluate_coverage(alignments: DataFrame, transcripts: DataFrame, features: DataFrame, n_bins: int = 100, **settings) -> dict[str, DataFrame]:
    """Learn on the reads of each transcript, by name or by place, and judge the model: metrics,
    quality (train_r2, test_r2, fit, overfit), importance and predictions. ``alignments`` (read_id,
    chrom, start, end), ``transcripts`` (transcript_id, chrom, start, end, length)."""
    own, lengths, members = _placed(alignments, transcripts)
    named = features.withColumn("transcript_id", F.col("transcript_id").cast("string"))
    model, predicted, metrics = learn_coverage(own, lengths, named, n_bins, members=members, **settings)
    r2 = metrics.agg(F.max(F.when(~F.col("is_test"), F.col("r2"))).alias("train_r2"), F.max(F.when(F.col("is_test"), F.col("r2"))).alias("test_r2"))
    fit = r2.select("train_r2", "test_r2", fit_quality(F.col("test_r2")).alias("fit"), overfit(F.col("train_r2"), F.col("test_r2")).alias("overfit"))
    return {"metrics": metrics, "quality": fit, "importance": models.feature_importance(model), "predictions": predicted}
