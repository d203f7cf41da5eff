"""Models over feature tables (L8, L9 of the survey), by Spark's own trees."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.operators.stats import spearman


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def forest_scores(train: DataFrame, test: DataFrame, features: list[str], *, depth: int = 10, trees: int = 20, seed: int = 0) -> DataFrame:
    """The test rows with the forest's share of votes for label 1; ambiguous rows are not trained on."""
    rows = assembled(train.where("label <> -1"), features).withColumn("label", F.col("label").cast("double"))
    model = RandomForestClassifier(maxDepth=depth, numTrees=trees, seed=seed, labelCol="label", featuresCol="features").fit(rows)
    return model.transform(assembled(test.withColumnRenamed("label", "truth"), features)).select(*[c for c in test.columns if c != "label"], F.col("truth").alias("label"), vector_to_array("probability")[1].alias("score"))


def boosted_correlation(train: DataFrame, test: DataFrame, features: list[str], target: str, *, rounds: int = 10, seed: int = 0) -> DataFrame:
    """Rank correlation of boosted predictions of ln(1 + target) with the target."""
    log = F.log1p(F.col(target).cast("double"))
    model = GBTRegressor(maxIter=rounds, seed=seed, labelCol="_y", featuresCol="features").fit(assembled(train.withColumn("_y", log), features))
    return spearman(model.transform(assembled(test, features)).withColumn("_all", F.lit(1)), ["_all"], "prediction", target).drop("_all")
