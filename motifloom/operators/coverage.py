"""Coverage and tracks by position (G15, G16, M11 to M20 of the survey)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.functions.physics import logistic
from motifloom.operators.convolution import convolved
from motifloom.operators.ordered import few
from motifloom.operators.scratch import written


def coverage_runs(reads: DataFrame, width: int, keys: list[str], chunk: int = 1 << 16) -> DataFrame:
    """Runs of equal coverage (keys, ``start``, ``stop``, ``cov``) of fragments of a width that begin at the
    reads' ends; a fragment adds 1 / (width + 1).

    A fragment is a rise and a fall in every chunk of positions that it touches; equal events are summed before they
    move, and coverage is their running sum within a chunk, so runs end at chunks."""
    begin = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("aend") - width)
    counted = reads.withColumn("begin", begin).groupBy(*keys, "begin").agg(F.count("*").alias("n"))
    parts = counted.select(*keys, "n", "begin", F.explode(F.sequence(F.floor(F.col("begin") / chunk), F.floor((F.col("begin") + width - 1) / chunk))).alias("_chunk"))
    rise = F.greatest(F.col("begin"), F.col("_chunk") * chunk)
    fall = F.least(F.col("begin") + width, (F.col("_chunk") + 1) * chunk)
    events = parts.select(*keys, "_chunk", F.explode(F.array(F.struct(rise.alias("at"), F.col("n").alias("d")), F.struct(fall.alias("at"), (-F.col("n")).alias("d")))).alias("e"))
    events = events.groupBy(*keys, "_chunk", F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    own = Window.partitionBy(*keys, "_chunk").orderBy("start")
    runs = events.select(*keys, "start", F.lead("start").over(own).alias("stop"), F.sum("d").over(own).alias("n"))
    return runs.where("n > 0").select(*keys, "start", "stop", (F.col("n") / (width + 1)).alias("cov"))


def fragment_coverage(reads: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Coverage (``pos``, ``cov``) of every covered position."""
    runs = coverage_runs(reads, width, keys)
    return runs.select(*keys, F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"), "cov")


def normalised(cov: DataFrame, keys: list[str], total: float = 1e6) -> DataFrame:
    """Coverage scaled to a total."""
    sums = cov.groupBy(*keys).agg(F.sum("cov").alias("_sum"))
    return cov.join(sums, keys).withColumn("cov", total * F.col("cov") / F.col("_sum")).drop("_sum")


def triangle(fragment: int) -> np.ndarray:
    """The weights of a smoothing over twice a fragment."""
    n = 2 * fragment
    return 1 - np.abs(2 * np.arange(n) / (n - 1) - 1) if n > 1 else np.ones(1)


def smoothed(cov: DataFrame, keys: list[str], fragment: int) -> DataFrame:
    """Convolution with a triangle of width 2 * fragment, then shares of the total."""
    rows = convolved(cov.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("cov").cast("double").alias("cov")), keys, ["cov"], triangle(fragment))
    rows = rows if few(cov) else written(rows, "smoothed")
    return with_sums(rows, keys, _total=F.sum("cov")).withColumn("cov", F.col("cov") / (F.col("_total") + 1e-6)).drop("_total")


def with_sums(rows: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Rows beside aggregates of their keys, by a join of a row for each key; null keys are keys like others."""
    own = rows.groupBy(*keys).agg(*(c.alias(n) for n, c in sums.items())).select(*(F.col(k).alias(f"_k_{k}") for k in keys), *sums)
    return rows.join(own, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*(f"_k_{k}" for k in keys))


def behind_first(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows behind the first n positions of their key."""
    first = rows.select(*keys, "pos").withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where(F.col("_i") <= n)  # n rows a key leave a task
    last = first.groupBy(*keys).agg(F.max("pos").alias("_last")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_last")
    return rows.join(last, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).where("pos > _last").drop("_last", *(f"_k_{k}" for k in keys))


def weights(cov: DataFrame, keys: list[str], motif_length: int) -> DataFrame:
    """Coverage by its largest value, without the first motif_length + 1 positions."""
    rows = with_sums(cov, keys, _top=F.max("cov")).withColumn("weight", F.col("cov") / F.col("_top")).drop("_top")
    return behind_first(rows, keys, motif_length + 1)


def z_scores(track: DataFrame, keys: list[str], value: str) -> DataFrame:
    """M13."""
    rows = with_sums(track, keys, _mean=F.avg(value), _spread=F.stddev_pop(value))
    return rows.withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_spread")).drop("_mean", "_spread")


def log_accessibility(cov: Column) -> Column:
    """M14."""
    return F.ln(1 + F.greatest(cov, F.lit(0.0)))


def max_pooled(track: DataFrame, keys: list[str], value: str, size: int, stride: int | None = None) -> DataFrame:
    """Maxima of windows of a size every ``stride`` positions (the last ones may be short)."""
    stride = stride or size
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / stride) + 1)
    rows = track.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(F.col("pos") / stride).cast("long"))))
    return rows.groupBy(*keys, "window").agg(F.max(value).alias(value))


def concentration_occupancy(sites: DataFrame, keys: list[str], concentrations: list[float], rt: float) -> DataFrame:
    """Mean and largest weighted occupancy over concentrations."""
    rows = sites.withColumn("c", F.explode(F.array(*map(F.lit, concentrations)))).withColumn("occ", logistic(F.ln("c") - F.col("energy") / rt) * F.col("weight"))
    return rows.groupBy(*keys, "c").agg(F.avg("occ").alias("occ_mean"), F.max("occ").alias("occ_max"))


def site_occupancy(energy: Column, mu: Column, access: Column, sample: Column) -> Column:
    """Sigmoid of chemical potential, sample and accessibility terms less the energy."""
    return logistic(mu + sample + access - energy)
