"""Partition functions: four ways to one distribution, the lowest of several sites, denominators of rounds."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.functions.physics import RT
from motifloom.operators import partition
from motifloom.plans import fit_queries

SF = "/root/testdata/sf0.01"
STEP = 0.05


@pytest.fixture(scope="module")
def matrices(spark):
    return fit_queries.matrices(spark, SF).cache()


def spread(rows):
    out = {}
    for r in rows:
        out.setdefault(r["source"], {})[round(r["energy"] / STEP)] = r["share"]
    return out


@pytest.mark.parametrize("sites", [1, 4])
def test_ways_agree(matrices, sites):
    of = {m: spread(partition.partition_functions(matrices, ["source"], step=STEP, sites=sites, method=m).collect()) for m in partition.METHODS}
    assert len(of["enumeration"]) == matrices.select("source").distinct().count()
    for source, want in of["enumeration"].items():
        assert sum(want.values()) == pytest.approx(1.0)
        for method in ("polynomials", "fft"):
            got = of[method][source]
            assert set(got) == set(want) and all(got[b] == pytest.approx(want[b], abs=1e-12) for b in want)
        got = of["samples"][source]  # sums of shares within a bin
        low, high = min(want), max(want)
        sums = np.abs(np.cumsum([got.get(b, 0) for b in range(low, high + 1)]) - np.cumsum([want.get(b, 0) for b in range(low, high + 1)]))
        assert sums.max() < 0.02 * sites


def test_enumeration_of_plain_words(matrices):
    rows = [r for r in matrices.collect() if r["source"] == "src0"]
    energy = {r["pos"]: [r["a"], r["c"], r["g"], r["t"]] for r in rows}
    bins = [sum(int(np.floor(energy[i][b] / STEP + 0.5)) for i, b in enumerate(word)) for word in itertools.product(range(4), repeat=6)]
    got = spread(partition.partition_functions(matrices.where("source = 'src0'"), ["source"], step=STEP, method="fft").collect())["src0"]
    assert {b: bins.count(b) / 4096 for b in set(bins)} == pytest.approx(got)


def test_lowest_of_sites():
    share = np.array([0.1, 0.0, 0.4, 0.5])
    rng = np.random.default_rng(1)
    drawn = rng.choice(4, (200_000, 3), p=share).min(1)
    assert partition.of_lowest(share, 3) == pytest.approx(np.bincount(drawn, minlength=4) / 200_000, abs=5e-3)
    assert partition.of_lowest(share, 1) == pytest.approx(share)


def test_denominators_and_occupancies(matrices):
    mus = [-1.0, 0.3]
    functions = partition.partition_functions(matrices, ["source"], step=STEP, method="fft").cache()
    plain = spread(functions.collect())
    occ = lambda b, mu: 1 / (1 + np.exp((b * STEP - mu) / RT))
    for r in partition.denominators(functions, ["source"], mus, 6).collect():
        want = sum(x * np.prod([occ(b, mu) for mu in mus[: r["round"] + 1]]) for b, x in plain[r["source"]].items())
        assert r["log_sum"] == pytest.approx(np.log(want * 4**6))
    for r in partition.mean_occupancies(functions, ["source"], 0.3).collect():
        assert r["occupancy"] == pytest.approx(sum(x * occ(b, 0.3) for b, x in plain[r["source"]].items()))


def test_odd_matrices(spark):
    rows = [("one", 0, 0.0, 0.0, 0.0, 0.0), ("two", 0, -1.0, 2.0, 0.5, 0.0), ("two", 1, 0.0, 0.1, 0.2, 0.3), (None, 0, 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, pos int, a double, c double, g double, t double").withColumn("share", F.lit(9))
    for method in ("polynomials", "fft", "enumeration"):
        got = {(r["k"], round(r["energy"], 6)): r["share"] for r in partition.partition_functions(df, ["k"], step=0.1, method=method).collect()}
        assert got[("one", 0.0)] == 1.0 and got[(None, 1.0)] == got[(None, 2.0)] == pytest.approx(0.5) and got[("two", -1.0)] == pytest.approx(1 / 16)
    assert partition.partition_functions(df.limit(0), ["k"], step=0.1).count() == 0
