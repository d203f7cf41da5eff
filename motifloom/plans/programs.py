"""Whole programs as functions (C1 to C12 of the survey), and the operators that only they use."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from motifloom.functions import physics, sequence
from motifloom.operators import convolution, coverage, intervals, labels, metrics, models, motif, sampling, stats
from motifloom.operators.ordered import numbered


def tf_feature_table(windows: DataFrame, genome: DataFrame, motifs: dict[str, np.ndarray], chunk: int = 1 << 16) -> DataFrame:
    """For windows (row_id, contig, start, stop) a column of the best score of every motif; windows that are
    clipped at a contig's end are left out."""
    seqs = intervals.fetch(genome, windows, chunk=chunk).join(windows.select("row_id", (F.col("stop") - F.col("start")).alias("w")), "row_id").where(F.length("seq") == F.col("w")).drop("w")
    return motif.scan(seqs, motifs).groupBy("row_id").pivot("motif", list(motifs)).agg(F.max("site_score"))


def motif_features(windows: DataFrame, seqs: DataFrame, matrix: np.ndarray, *, skip_ambiguous: bool = False, balance: bool = False) -> DataFrame:
    """For labelled windows the mean, maximum and quantiles of a motif's scores."""
    rows = labels.unambiguous(windows) if skip_ambiguous else windows
    rows = sampling.balanced(rows, "row_id") if balance else rows
    scored = motif.scan(rows.select("row_id").join(seqs, "row_id"), matrix).select("row_id", "site_score")
    return rows.join(motif.region_scores(scored, ["row_id"]), "row_id")


def with_imputed(scored: DataFrame, peak_score: str, num: int = 20) -> DataFrame:
    """Ambiguous labels (-1) of scored rows become 1 above a threshold of their peaks' scores and 0 at or below it:
    that of ``num`` thresholds under which the calls (scores above 0.5) have the largest F1.  They stay where there is no
    ambiguous row or no such threshold."""
    rows = scored.withColumn("called", (F.col("score") > 0.5).cast("int")).withColumn("_votes", F.col("score")).withColumn("score", F.col(peak_score).cast("double"))
    best = metrics.best_threshold(rows, metrics.threshold_grid(rows, num)).first()
    return scored if best is None else scored.withColumn("label", labels.imputed(F.col("label"), F.col(peak_score), best["threshold"]))


def cross_validate(features: DataFrame, columns: list[str], n: int = 5, *, peak_score: str | None = None, **options) -> DataFrame:
    """Measures of a forest for every fold of contigs, trained on the clean labels of the other
    contigs; with a column ``peak_score`` the ambiguous labels of each fold are imputed first (``with_imputed``)."""
    folds = sampling.folds(features.where(~F.col("contig").isin(*labels.TEST_CONTIGS)), "contig", n)
    rows = features.join(folds, "contig")
    parts = [models.forest_scores(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i), columns, **options) for i in range(n)]
    if peak_score:
        parts = [with_imputed(p, peak_score) for p in parts]
    return metrics.evaluate(reduce(DataFrame.unionByName, parts), ["fold"])


def region_summary(regions: DataFrame, reads: DataFrame, fragment: int) -> DataFrame:
    """Length, mean and largest smoothed coverage of the positions of each region, from runs of equal coverage."""
    runs = coverage.coverage_runs(reads, fragment, ["contig"])
    pairs = intervals.overlap_join(regions.select("row_id", "contig", "start", "stop"), runs, bin_width=4096)
    shared = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    found = pairs.groupBy("row_id").agg(F.sum(shared * F.col("r_cov")).alias("total"), F.max("r_cov").alias("cov_max"))
    length = F.col("stop") - F.col("start")
    return regions.join(found, "row_id", "left").select("row_id", length.alias("length"), (F.coalesce("total", F.lit(0.0)) / length).alias("cov_mean"), F.coalesce("cov_max", F.lit(0.0)).alias("cov_max"))


def sample_dataset(peaks: DataFrame, files: DataFrame, tfs: list[str], *, n_peaks: int | None = None, include_ambiguous: bool = True) -> DataFrame:
    """For each sample its first peaks by signal with clean labels of all factors; samples without the files
    that they need are left out."""
    ok = labels.eligible(files, include_ambiguous)
    rows = sampling.top_per_group(peaks.join(ok, "sample_id", "left_semi"), ["sample_id"], [F.desc("signal_value"), F.col("row_id")], n_peaks)
    # intervals meet within their sample: sample and contig are one key
    place = F.struct("sample_id", "contig").alias("contig")
    pairs = intervals.overlap_join(rows.select("row_id", place, "start", "stop"), files.select(place, "start", "stop", "tf_id", "pk_type")).withColumn("hit", (intervals.overlap_fraction() > 0.5).cast("int"))
    per_tf = pairs.groupBy("row_id", F.col("r_tf_id").alias("tf_id")).agg(F.max(F.when(F.col("r_pk_type") == "optimal", F.col("hit")).otherwise(0)).alias("o"), F.max(F.when(F.col("r_pk_type") == "relaxed", F.col("hit")).otherwise(0)).alias("r"))
    label = F.when(F.col("o") == 1, 1).when(F.col("r") == 1, -1).otherwise(0)
    wide = per_tf.withColumn("label", label).groupBy("row_id").pivot("tf_id", tfs).agg(F.max("label"))
    return rows.join(wide, "row_id", "left").na.fill(0, tfs)


def topped_up(seqs: DataFrame, background: DataFrame, spark: SparkSession, length: int, least: int) -> DataFrame:
    """A background of at least ``least`` sequences, and of as many as the largest round; random ones are added."""
    largest = seqs.groupBy("round").count().agg(F.max("count")).first()[0] or 0
    n = max(0, max(least, largest) - background.count())
    more = spark.range(n).select((-F.col("id") - 1).alias("seq_id"), sequence.random_sequence(F.col("id"), length, 1).alias("seq"))
    return background.select("seq_id", "seq").unionByName(more)


def upsampled(seqs: DataFrame, n: int, key: str = "seq_id") -> DataFrame:
    """n rows by going through the rows again and again in order of a number."""
    rows = numbered(seqs, [], [key])
    times = F.floor((n - F.col("row_upto")) / F.col("row_total")) + 1
    return rows.where(F.col("row_upto") <= n).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times))).drop("row_upto", "row_total")


def zipped(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """Rows by position in each side's order, of numbers."""
    return numbered(left, [], [order_left]).drop("row_total").join(numbered(right, [], [order_right]).drop("row_total"), "row_upto").drop("row_upto")


def best_affinity(sites: DataFrame, grid: list[float], keys: list[str]) -> DataFrame:
    """Of a grid of chemical potentials that whose occupancies explain the coverage best: the least sum of
    -ln(occupancy + 1e-12) times coverage; the smallest of equal ones."""
    wide = sites.withColumn("mu", F.explode(F.array(*map(F.lit, grid))))
    cost = F.sum(-F.ln(physics.occupancy(F.col("mu"), F.col("energy")) + 1e-12) * F.col("cov"))
    costs = wide.groupBy(*keys, "mu").agg(cost.alias("cost"))
    return costs.groupBy(*keys).agg(F.min(F.struct("cost", "mu")).alias("x")).select(*keys, F.col("x.mu").alias("mu"), F.col("x.cost").alias("cost"))


def chemical_affinity(sites: DataFrame, keys: list[str], fragment: int, limit: int, motif_length: int) -> DataFrame:
    """Minus the affinity 0, 1, 2, ... up to ``limit`` under which the occupancy of a region's positions, weighted
    by accessibility, as shares of their sum and smoothed over twice a fragment, explains the reads best; the first of
    equal ones.  ``sites``: pos, score, access and cov; the first motif_length + 1 positions have no score.

    All affinities are columns of the arrays that chunks are convolved as, so rows are positions and halos only."""
    rows = sites.select(*keys, F.col("pos").cast("long").alias("pos"), *(F.col(c).cast("double").alias(c) for c in ("score", "access", "cov")))
    rows = coverage.behind_first(rows, keys, motif_length + 1)
    rows = coverage.with_sums(rows, keys, _top=F.max("access")).withColumn("weight", F.col("access") / F.col("_top")).drop("_top")
    occ = [physics.logistic(F.col("score") / physics.RT - float(c)) * F.col("weight") for c in range(limit)]
    totals = [f"_t{c}" for c in range(limit)]
    rows = coverage.with_sums(rows, keys, **{t: F.sum(o) for t, o in zip(totals, occ)})
    rows = rows.select(*keys, "pos", "score", "weight", "cov", F.array(*totals).alias("_totals"))
    rows = rows.select(*keys, "pos", "cov", *((o / F.col("_totals")[c]).alias(f"_s{c}") for c, o in enumerate(occ)))
    n = 2 * fragment
    kernel = np.bartlett(n) / np.bartlett(n).sum()
    ahead = (n - 1) // 2

    def run(x: np.ndarray, own: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
        smooth = convolution.same(x[:, 1:], kernel)[own]
        cost = -(np.log(np.maximum(smooth, 0.0) + 1e-12) * x[own, :1]).sum(0)
        return [np.arange(limit), cost]

    parts = convolution.in_chunks(rows, keys, ["cov", *(f"_s{c}" for c in range(limit))], (n - 1 - ahead, ahead), run, [("c", LongType()), ("cost", DoubleType())])
    cost = parts.groupBy(*keys, "c").agg(F.sum("cost").alias("cost"))
    best = cost.groupBy(*keys).agg(F.min(F.struct("cost", "c")).alias("x"))
    return best.select(*keys, (-F.col("x.c").cast("double")).alias("affinity"), F.col("x.cost").alias("cost"))


def matrix_of_regions(regions: DataFrame, tracks: dict[str, DataFrame]) -> DataFrame:
    """C11, K3: 0 or 1 for every region and named set of intervals that it touches."""
    out = regions.select("row_id")
    for name, df in tracks.items():
        hits = intervals.overlap_join(regions.select("row_id", "contig", "start", "stop"), df.select("contig", "start", "stop")).select("row_id").distinct().withColumn(name, F.lit(1))
        out = out.join(hits, "row_id", "left").na.fill(0, [name])
    return out


def rank_curve(df: DataFrame, order: list[str], cuts: list[int], a: str, b: str) -> DataFrame:
    """Rank correlation of the first rows of an order, for several numbers of rows."""
    rows = numbered(df.orderBy(*order).limit(max(cuts)), [], order).withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).where(F.col("row_upto") <= F.col("cut"))
    return stats.spearman(rows, ["cut"], a, b)


def by_range(column: Column, width: float) -> Column:
    """The bin that a plot would show a value in."""
    return F.floor(column / width) * width
