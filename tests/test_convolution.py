"""Convolutions in chunks against whole arrays, and coverage by events against plain counts."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.functions.physics import RT
from motifloom.operators import convolution, coverage
from motifloom.plans import programs


@pytest.mark.parametrize("n, m, block", [(1, 1, 8), (1000, 1, 64), (1000, 30, 64), (50, 200, 16), (5000, 700, 256)])
def test_overlap_add(n, m, block):
    rng = np.random.default_rng(n + m)
    x, kernel = rng.normal(size=(n, 3)), rng.normal(size=m)
    want = np.column_stack([np.convolve(x[:, i], kernel) for i in range(3)])
    assert np.allclose(convolution.overlap_add(x, kernel, block), want) and np.allclose(convolution.convolve(x, kernel), want)


@pytest.mark.parametrize("n", [1, 2, 7, 400, 901])
def test_same_has_the_kernels_middle(n):
    x, kernel = np.random.default_rng(n).normal(size=(1000, 1)), np.random.default_rng(0).normal(size=n)
    assert np.allclose(convolution.same(x, kernel)[:, 0], np.convolve(x[:, 0], kernel)[(n - 1) // 2 :][:1000])
    if n % 2:
        assert np.allclose(convolution.same(x, kernel)[:, 0], np.convolve(x[:, 0], kernel, mode="same"))


@pytest.mark.parametrize("chunk, n", [(64, 400), (1000, 400), (1 << 16, 9), (100, 2)])
def test_tracks_in_chunks(spark, chunk, n):
    """Dense and sparse tracks of several keys, null among them, with negative positions."""
    rng = np.random.default_rng(chunk)
    tracks = {"a": (-300, 3000, 1.0), "b": (0, 777, 0.2), None: (5000, 5100, 0.5)}
    rows, want, kernel = [], {}, rng.normal(size=n)
    for key, (low, high, share) in tracks.items():
        x = rng.normal(size=high - low)
        there = rng.random(high - low) < share
        smooth = convolution.same((x * there)[:, None], kernel)[:, 0]
        rows += [(key, int(low + i), float(x[i]), 1) for i in np.flatnonzero(there)]
        want.update({(key, int(low + i)): smooth[i] for i in np.flatnonzero(there)})
    df = spark.createDataFrame(rows, "k string, pos long, x double, cov int").repartition(3)
    got = {(r["k"], r["pos"]): r["x"] for r in convolution.convolved(df, ["k"], ["x"], kernel, chunk).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_rows_moved_are_positions_and_halos(spark, monkeypatch):
    """A fragment of 200 moves each position once and the halos of its chunks, not 400 rows a position."""
    df = spark.range(100_000).select(F.lit("c").alias("k"), F.col("id").alias("pos"), (F.col("id") % 13).cast("double").alias("cov"))
    sizes = []
    group = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: (sizes.append(self) if "_chunk" in c else None, group(self, *c))[1])
    found = convolution.convolved(df, ["k"], ["cov"], coverage.triangle(200), chunk=10_000)
    monkeypatch.undo()
    assert sizes[0].count() == 100_000 + 10 * 399  # nine borders and the two ends
    whole = np.convolve(np.arange(100_000) % 13, coverage.triangle(200))[199:]
    assert all(r["cov"] == pytest.approx(whole[r["pos"]], rel=1e-9) for r in found.where("pos % 997 = 0").collect())


def test_smoothing_weights_and_scores_of_null_keys(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(k, i, float(v)) for k, n in (("a", 60), (None, 40)) for i, v in enumerate(rng.random(n))], "k string, pos long, cov double")
    for key, n in (("a", 60), (None, 40)):
        x = np.array([r["cov"] for r in df.where(F.col("k").eqNullSafe(F.lit(key))).orderBy("pos").collect()])
        own = lambda d, c: [r[c] for r in d.where(F.col("k").eqNullSafe(F.lit(key))).orderBy("pos").collect()]  # noqa: B023, E731
        smooth = np.convolve(x, coverage.triangle(5))[4:][:n]
        assert own(coverage.smoothed(df, ["k"], 5), "cov") == pytest.approx(smooth / (smooth.sum() + 1e-6))
        assert own(coverage.weights(df, ["k"], 3), "weight") == pytest.approx(x[4:] / x.max())
        assert own(coverage.z_scores(df, ["k"], "cov"), "z") == pytest.approx((x - x.mean()) / x.std())


def test_affinity_with_a_long_fragment(spark):
    """Fragment 200 against a plain version over whole regions."""
    rng = np.random.default_rng(2)
    rows, want, limit = [], {}, 6
    for key in ("r1", "r2"):
        n = 1500
        score, access, cov = rng.normal(size=n), rng.random(n) + 0.1, rng.poisson(2, n).astype(float)
        rows += [(key, i, float(score[i]), float(access[i]), float(cov[i])) for i in range(n)]
        s, a, c = score[9:], access[9:] / access[9:].max(), cov[9:]
        kernel = np.bartlett(400) / np.bartlett(400).sum()
        costs = []
        for k in range(limit):
            occ = 1 / (1 + np.exp(k - s / RT)) * a
            costs.append(-(np.log(np.convolve(occ / occ.sum(), kernel)[199:][: n - 9] + 1e-12) * c).sum())
        want[key] = (-float(np.argmin(costs)), min(costs))
    df = spark.createDataFrame(rows, "k string, pos int, score double, access double, cov double").repartition(3)
    got = {r["k"]: (r["affinity"], r["cost"]) for r in programs.chemical_affinity(df, ["k"], 200, limit, 8).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], rel=1e-9) for k in want)


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_runs_of_coverage(spark, chunk):
    rng = np.random.default_rng(3)
    reads = [("c" if rng.random() < 0.9 else None, int(p), int(p) + 12, "+" if s else "-") for p, s in zip(rng.integers(0, 300, 400), rng.integers(0, 2, 400))]
    want = collections.Counter()
    for contig, pos, end, strand in reads:
        begin = pos if strand == "+" else end - 20
        want.update((contig, p) for p in range(begin, begin + 20))
    df = spark.createDataFrame(reads, "contig string, pos long, aend long, strand string")
    got, runs = {}, coverage.coverage_runs(df, 20, ["contig"], chunk).collect()
    for r in runs:
        assert r["start"] < r["stop"]
        got.update({(r["contig"], p): r["cov"] for p in range(r["start"], r["stop"])})
    assert sum(r["stop"] - r["start"] for r in runs) == len(got) == len(want)
    assert all(got[k] == pytest.approx(n / 21) for k, n in want.items())
