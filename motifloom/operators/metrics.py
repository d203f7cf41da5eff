"""Evaluation of scores against labels (G20 to G27 of the survey).  Ambiguous labels (-1) are left out throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.operators.ordered import running
from motifloom.operators.stats import quantiles

LEVELS = (0.50, 0.25, 0.10, 0.05)


def confusion(df: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts, accuracies with 1e-6 in their denominators, and F1 (0 where it is undefined)."""
    pos, hit = F.col("label") == 1, F.col("score") > threshold
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    x = df.where("label <> -1").groupBy(*keys).agg(count(pos & hit)("tp"), count(pos)("p"), count(~pos & ~hit)("tn"), count(~pos)("n"), count(hit)("called"))
    x = x.withColumns({"positive_accuracy": F.col("tp") / (F.col("p") + 1e-6), "negative_accuracy": F.col("tn") / (F.col("n") + 1e-6)})
    return x.withColumns({"balanced_accuracy": (F.col("positive_accuracy") + F.col("negative_accuracy")) / 2, "f1": F.when(F.col("p") + F.col("called") > 0, 2 * F.col("tp") / (F.col("p") + F.col("called"))).otherwise(0.0)}).drop("called")


def by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives by distinct score: all curves follow from these, so ties and skew meet before any sort."""
    return df.where("label <> -1").groupBy(*keys, "score").agg(F.sum("label").cast("double").alias("pos"), F.sum(1 - F.col("label")).cast("double").alias("neg"))


def auroc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve, ties counting half; NaN where one class is missing."""
    rows = running(by_score(df, keys), keys, ["score"], {"_n": F.col("neg")}).withColumn("won", F.col("pos") * (F.col("_n_upto") - F.col("neg") / 2))
    p, n = F.sum("pos"), F.sum("neg")
    return rows.groupBy(*keys).agg(F.when((p > 0) & (n > 0), F.sum("won") / (p * n)).otherwise(F.lit(float("nan"))).alias("auroc"))


def pr_curve(df: DataFrame, keys: list[str]) -> DataFrame:
    """(score, precision, recall) of every threshold; and of the next higher one, 1 and 0 for the highest."""
    rows = by_score(df, keys).withColumn("_down", -F.col("score"))
    rows = running(rows, keys, ["_down"], {"_p": F.col("pos"), "_n": F.col("neg")})
    tp, fp = F.col("_p_upto"), F.col("_n_upto")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    above = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    return rows.select(*keys, "score", (tp / (tp + fp)).alias("precision"), (tp / F.col("_p_total")).alias("recall"), above.alias("precision_above"), (tp0 / F.col("_p_total")).alias("recall_above"))


def auprc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Trapezoid area under the precision-recall curve, from precision 1 at recall 0."""
    step = (F.col("recall") - F.col("recall_above")) * (F.col("precision") + F.col("precision_above")) / 2
    return pr_curve(df, keys).groupBy(*keys).agg(F.sum(step).alias("auprc"))


def recall_at_fdr(df: DataFrame, keys: list[str], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """The largest recall with a false discovery rate within each level, 0 if there is none."""
    return pr_curve(df, keys).groupBy(*keys).agg(*(F.coalesce(F.max(F.when(1 - F.col("precision") <= c, F.col("recall"))), F.lit(0.0)).alias(f"recall_at_{round(100 * c):02d}_fdr") for c in levels))


def evaluate(df: DataFrame, keys: list[str]) -> DataFrame:
    """All measures, a row for each key."""
    return confusion(df, keys).join(auroc(df, keys), keys).join(auprc(df, keys), keys).join(recall_at_fdr(df, keys), keys)


def roll_up(results: DataFrame, columns: tuple[str, ...] = ("balanced_accuracy", "auroc", "auprc", "f1")) -> DataFrame:
    """Mean, least and largest value over folds."""
    return results.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))


def mean_skipping_nan(results: DataFrame, column: str) -> DataFrame:
    """The sum without NaN by the number of all results."""
    return results.agg((F.sum(F.when(F.isnan(column), 0.0).otherwise(F.col(column))) / F.count("*")).alias("mean"))


def threshold_grid(df: DataFrame, num: int) -> list[float]:
    """The scores of ambiguous rows at shares 0, 1/(num-1), 2/(num-1), ... below 1, and 1.0 at last."""
    probs = [i / (num - 1) for i in range(num - 1)]
    scores = df.where("label = -1").select(F.col("score").cast("double").alias("score"))
    row = quantiles(scores, [], "score", tuple(probs), names=[f"t{i}" for i in range(len(probs))]).first()
    return [x for x in row if x is not None] + [1.0]


def best_threshold(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """The threshold on ambiguous rows' scores (those at or below it become 0, others 1) that gives the largest F1
    of the calls ``called``; the first of equal ones, none where F1 is never above 0.  Labels are set to 0 one threshold
    after the other, so a smaller threshold after a larger one sets no others."""
    top = [max(thresholds[: i + 1]) for i in range(len(thresholds))]
    turns = F.array(*(F.struct(F.lit(i).alias("turn"), F.lit(t).alias("threshold"), F.lit(m).alias("top")) for i, (t, m) in enumerate(zip(thresholds, top))))
    grid = df.withColumn("x", F.explode(turns))
    truth = F.when(F.col("label") == -1, F.when(F.col("score") > F.col("x.top"), 1).otherwise(0)).otherwise(F.col("label"))
    counts = grid.withColumn("truth", truth).groupBy("x.turn", "x.threshold").agg(F.sum(F.col("truth") * F.col("called")).alias("tp"), F.sum("truth").alias("p"), F.sum("called").alias("c"))
    f1 = counts.withColumn("f1", F.when(F.col("p") + F.col("c") > 0, 2 * F.col("tp") / (F.col("p") + F.col("c"))).otherwise(0.0)).where("f1 > 0")
    return f1.agg(F.max(F.struct("f1", (-F.col("turn")).alias("m"), "threshold")).alias("x")).where("x is not null").select(F.col("x.threshold").alias("threshold"), F.col("x.f1").alias("f1"))
