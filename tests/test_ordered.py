"""Running sums in one window and in slices: equal results, balanced slices, no job while a plan over little is built."""

import pytest
from pyspark.sql import functions as F

from motifloom.operators import ordered, scratch, stats

ROWS = [("a", i % 7 if i % 3 else None, i) for i in range(400)] + [(None, 5, i) for i in range(30)] + [("b", 1, -i) for i in range(300)] + [("c", 0, 0)]


@pytest.fixture()
def sliced(monkeypatch):
    monkeypatch.setattr(ordered, "FEW", -1)
    monkeypatch.setattr(ordered, "UNKNOWN", 9)


def plain(rows, keys):
    """(key, order, weight) -> sums by group in order, nulls first."""
    seen, out = {}, []
    for k, o, w in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        k = k if keys else ""
        seen[k] = seen.get(k, 0) + w
        out.append((k, o, w, seen[k]))
    return sorted(((*x, seen[x[0]]) for x in out), key=str)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("large", [False, True])
def test_running(spark, keys, large, sliced, monkeypatch):
    if not large:
        monkeypatch.setattr(ordered, "FEW", 1 << 64)
    df = spark.createDataFrame(ROWS, "k string, o int, w long").repartition(5)
    found = ordered.running(df, keys, ["o", "w"], {"s": F.col("w")}).collect()
    assert sorted(((r["k"] if keys else "", r["o"], r["w"], r["s_upto"], r["s_total"]) for r in found), key=str) == plain(ROWS, keys)
    assert ordered.running(df.limit(0), keys, ["o"], {"s": F.col("w")}).count() == 0


def test_slices_of_narrow_groups_and_ties(spark, sliced):
    narrow = [("n", 1_000_000 + i) for i in range(20_000)]
    wide = [("w", i * 10**6) for i in range(1000)]
    ties = [("t", 7)] * 20_000
    for rows in (narrow + wide, ties + wide, ties):
        df = spark.createDataFrame(rows, "k string, o long").repartition(6)
        sizes = [r["count"] for r in ordered.sliced(df, ["k"], ["o"]).groupBy("_slice").count().collect()]
        assert sum(sizes) == len(rows) and max(sizes) < 2 * len(rows) / 9 + 10
        numbers = ordered.numbered(df, ["k"], ["o"])
        for r in numbers.groupBy("k").agg(F.sort_array(F.collect_list("row_upto")).alias("n"), F.max("row_total").alias("m")).collect():
            assert r["n"] == list(range(1, r["m"] + 1))


def test_slices_follow_the_input(spark, sliced, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE", 4096)
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    found = ordered.sliced(df.select("o_orderkey"), [], ["o_orderkey"]).select("_slice").distinct().count()
    assert found == -(-scratch.input_bytes(df) // 4096) > 2


def test_no_job_while_a_small_plan_is_built(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    spark.sparkContext.setJobGroup("building", "building")
    try:
        stats.spearman(df, ["l_returnflag"], "l_quantity", "l_extendedprice")
        stats.quantiles(df, ["l_returnflag"], "l_quantity", (0.5, 0.9))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


def test_rank_correlation_is_the_same_in_slices(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    of = lambda: {r[0]: r[1] for r in stats.spearman(df, ["l_returnflag"], "l_quantity", "l_extendedprice").collect()}
    small = of()
    monkeypatch.setattr(ordered, "FEW", -1)
    assert of() == pytest.approx(small)
