"""Interval files read by region: the same rows as a filter gives, from few pages."""

import random

import pytest
from pyspark.sql import functions as F

from motifloom.sources import indexed


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(f"chr{rng.randint(1, 3)}", s, s + rng.randint(1, 200), f"n{i}") for i, s in enumerate(rng.randrange(10_000_000) for _ in range(60_000))]
    rows += [("chr1", 5_000_000, 5_000_000, "empty"), (None, 1, 5, "none"), ("chr9", 0, 10**9, "long")]
    path = str(tmp_path_factory.mktemp("indexed") / "peaks")
    df = spark.createDataFrame(rows, "contig string, start long, stop long, name string").repartition(5)
    indexed.write_indexed(df, path, rows=500)
    return path, rows


@pytest.mark.parametrize("region", [("chr1", 5_000_000, 5_001_000), ("chr2", 0, 300), ("chr3", 9_999_000, 20_000_000), ("chr2", 100, 100), ("chr9", 10**8, 10**8 + 1), ("chr9", 10**9, 10**9 + 1), ("chrX", 0, 10**9), ("chr1", -50, 1)])
def test_regions(spark, stored, region):
    path, rows = stored
    contig, start, stop = region
    found = indexed.read_region(spark, path, contig, start, stop)
    want = sorted(r for r in rows if r[0] == contig and r[1] < stop and r[2] > start)
    assert sorted(map(tuple, found.collect())) == want


def test_only_pages_of_the_region_are_read(spark, stored):
    path, rows = stored
    found = indexed.read_region(spark, path, "chr1", 5_000_000, 5_001_000).agg(F.count("*").alias("n"))
    few = indexed.read_region(spark, path, "chr1", 5_000_000, 5_001_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = few.count()
        plan = few.groupBy().agg(F.count("*"))
        plan.collect()
        leaves = plan._jdf.queryExecution().executedPlan().collectLeaves()
        scanned = leaves.apply(0).metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < n == found.first()["n"] <= scanned <= 3 * 500 < len(rows) / 30


def test_folder_and_empty_table(spark, stored, tmp_path):
    path, rows = stored
    assert spark.read.parquet(path).count() == len(rows)  # the index is no part of it
    parts = spark.read.parquet(path).select("contig", "start", F.input_file_name().alias("f")).groupBy("f").agg(F.min(F.struct("contig", "start")).alias("a"), F.max(F.struct("contig", "start")).alias("b")).orderBy("a").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(parts[1:], parts[2:]))
    indexed.write_indexed(spark.createDataFrame([], "contig string, start long, stop long"), str(tmp_path / "none"))
    assert indexed.read_region(spark, str(tmp_path / "none"), "chr1", 0, 10).count() == 0
