"""Sampling, batches and folds by hashes and ranks (R1 to R10, W1 to W3, W11 to W14, U5 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.operators.ordered import numbered, running


def draw(key: Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 2**60) from a key of any type, the same in any SQL engine: digits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int | None) -> DataFrame:
    """The first n rows of each group in an order; all for None."""
    if n is None:
        return df
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_i") <= n).drop("_i")


def by_rank(df: DataFrame, keys: list[str], key: str, n: int | None, *, use_top: bool = True, seed: int = 0, signal: str = "signal_value") -> DataFrame:
    """N rows of each group, those of the largest signal and then the smallest start, or drawn by a seed."""
    return top_per_group(df, keys, [F.desc(signal), "start", key] if use_top else [draw(F.col(key), seed), key], n)


def balanced(df: DataFrame, key: str, label: str = "label", seed: int = 0) -> DataFrame:
    """Of each class as many rows as the smallest has, drawn without replacement."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))
    ranked = numbered(df.withColumn("_draw", draw(F.col(key), seed)), [label], ["_draw", key])
    return ranked.join(F.broadcast(least), F.col("row_upto") <= F.col("_least")).select(*df.columns)  # one row


def with_replacement(df: DataFrame, key: str, n: int, label: str = "label", seed: int = 0) -> DataFrame:
    """R2: n / 2 draws with replacement of each class, in shuffled order (``draw_id``)."""
    ranked = numbered(df.withColumn("_draw", draw(F.col(key), seed)), [label], ["_draw", key])
    sizes = df.groupBy(label).agg(F.count("*").alias("_m"))
    draws = sizes.withColumn("draw_id", F.explode(F.sequence(F.lit(0), F.lit(n // 2 - 1)))).withColumn("row_upto", F.pmod(draw(F.concat_ws(":", label, "draw_id"), seed + 1), F.col("_m")) + 1)
    return ranked.join(draws.drop("_m"), [label, "row_upto"]).select(*df.columns, "draw_id")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows with their place in a shuffled order of ranges: no task sees all rows."""
    return df.withColumn("draw", draw(F.col(key), seed)).repartitionByRange("draw", key).sortWithinPartitions("draw", key)


def resampled(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """N draws with replacement in proportion to a weight: systematic positions on the running sum.

    A row is drawn as often as positions fall on its stretch; only rows and counts are joined, never rows and rows."""
    rows = running(df, [], [key], {"_w": F.col(weight)})
    share = n / F.col("_w_total")
    shift = (seed * 0.6180339887 + 0.5) % 1
    times = F.floor(F.col("_w_upto") * share + shift) - F.floor((F.col("_w_upto") - F.col(weight)) * share + shift)
    return rows.withColumn("copies", times.cast("int")).where("copies > 0").select(*df.columns, "copies")


def folds(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Distinct values in order, cut into n runs; the first runs have one more.  An error for fewer values.
    The distinct values (contigs, samples) are sorted by one task."""
    values = df.select(column).distinct()
    if values.limit(n).count() < n:
        raise ValueError(f"{n} folds need as many values")
    return values.withColumn("fold", F.ntile(n).over(Window.partitionBy(F.lit(0)).orderBy(column)) - 1)


def stratified(df: DataFrame, key: str, label: str = "label", n: int = 5, seed: int = 0) -> DataFrame:
    """Folds of equal shares of each class."""
    ranked = numbered(df.withColumn("_draw", draw(F.col(key), seed)), [label], ["_draw", key])
    return ranked.withColumn("fold", F.pmod(F.col("row_upto") - 1, F.lit(n))).select(*df.columns, "fold")


def cross_validation(samples: DataFrame, contig_folds: DataFrame, single_sample: bool = False) -> DataFrame:
    """(fold, held_out, sample_id, contig, role): every sample is held out once with every fold of contigs; it
    is trained on other samples (or, with ``single_sample``, on itself) and other contigs.

    The samples, a few hundred, are one array beside every contig; the result has contigs x folds x samples rows by its
    definition, made where the contigs are."""
    every = samples.agg(F.sort_array(F.collect_set("sample_id")).alias("_all"), F.lit(0).alias("_one"))
    turns = contig_folds.agg(F.sort_array(F.collect_set("fold")).alias("_folds"), F.lit(0).alias("_one"))
    rows = contig_folds.select("contig", F.col("fold").alias("own"), F.lit(0).alias("_one")).join(F.broadcast(every), "_one").join(F.broadcast(turns), "_one")  # one row each
    rows = rows.select("contig", "own", "_all", F.explode("_folds").alias("fold")).select("contig", "own", "fold", "_all", F.explode("_all").alias("held_out")).select("contig", "own", "fold", "held_out", F.explode("_all").alias("sample_id"))
    same, inside = F.col("sample_id") == F.col("held_out"), F.col("own") == F.col("fold")
    role = F.when(same & inside, "validation").when((same if single_sample else ~same) & ~inside, "train")
    return rows.withColumn("role", role).where("role is not null").select("held_out", "fold", "sample_id", "contig", "role")


def head_tail(df: DataFrame, order: list[str], share: float, keys: list[str]) -> DataFrame:
    """The first int(n * share) rows are ``train``, the others ``validation``."""
    split = F.when(F.col("row_upto") <= F.floor(F.col("row_total") * share), "train").otherwise("validation")
    return numbered(df, keys, order).withColumn("split", split).select(*df.columns, "split")


def every_nth(df: DataFrame, order: list[str], keys: list[str], n: int = 5) -> DataFrame:
    """One of every n rows of an order, from the first on."""
    return numbered(df, keys, order).where(F.pmod(F.col("row_upto") - 1, F.lit(n)) == 0).select(*df.columns)


def batches(df: DataFrame, order: list[str], keys: list[str], size: int) -> DataFrame:
    """The ``batch`` of each row, the last one short."""
    return numbered(df, keys, order).withColumn("batch", F.floor((F.col("row_upto") - 1) / size)).select(*df.columns, "batch")


def allocation(sizes: DataFrame, batch: int, key: str = "sample_id") -> DataFrame:
    """Shares of a batch in proportion to ``n``, rounded down, the first ones getting what remains."""
    all_ = Window.partitionBy(F.lit(0))
    rows = sizes.withColumn("base", F.floor(batch * F.col("n") / F.sum("n").over(all_)).cast("long"))
    rows = rows.withColumn("left", batch - F.sum("base").over(all_)).withColumn("i", F.row_number().over(all_.orderBy(key)))
    return rows.select(key, (F.col("base") + F.when(F.col("i") <= F.col("left"), 1).otherwise(0)).alias("n_batch"))
