"""Partition functions of many matrices over energy bins (L7 of the survey): by generating functions, by enumeration and
by sampling, and the distribution of the lowest of several sites.

A matrix is rows (keys, ``pos``, ``a``, ``c``, ``g``, ``t``) of energies; its partition function is the share of all words
in each bin, where a word's bin is the sum of its bases' rounded energies.  Matrices are worked on beside each other, each
where its rows meet; a row is a few numbers, so no group is large."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from motifloom.functions.physics import occupancy


def bins_of(energies: np.ndarray, step: float) -> np.ndarray:
    """Energies in steps, halves away from zero."""
    return (np.sign(energies) * np.floor(np.abs(energies) / step + 0.5)).astype(np.int64)


def by_polynomials(bins: np.ndarray) -> tuple[int, np.ndarray]:
    """The lowest bin and the share of words in it and those above: the product of the positions' polynomials."""
    low = bins.min(1)
    out = np.ones(1)
    for row in bins - low[:, None]:
        out = np.convolve(out, np.bincount(row, minlength=row.max() + 1) / 4)
    return int(low.sum()), out


def by_fft(bins: np.ndarray) -> tuple[int, np.ndarray]:
    """The same by transforms of a length that holds all bins, multiplied."""
    low = bins.min(1)
    rows = bins - low[:, None]
    size = int(rows.max(1).sum()) + 1
    n = 1 << (size - 1).bit_length()
    product = np.ones(n // 2 + 1, complex)
    for row in rows:
        product *= np.fft.rfft(np.bincount(row, minlength=n) / 4)
    return int(low.sum()), np.maximum(np.fft.irfft(product, n)[:size], 0.0)


def by_enumeration(bins: np.ndarray) -> tuple[int, np.ndarray]:
    """The same from all words; for short matrices."""
    total = np.zeros(1, np.int64)
    for row in bins:
        total = (total[:, None] + row[None]).ravel()
    low = int(total.min())
    return low, np.bincount(total - low) / len(total)


def by_samples(bins: np.ndarray, samples: int = 100_000, seed: int = 0) -> tuple[int, np.ndarray]:
    """An estimate of the same from random words."""
    words = np.random.default_rng(seed).integers(0, 4, (samples, len(bins)))
    total = bins[np.arange(len(bins)), words].sum(1)
    low = int(total.min())
    return low, np.bincount(total - low) / samples


METHODS: dict[str, Callable[[np.ndarray], tuple[int, np.ndarray]]] = {"polynomials": by_polynomials, "fft": by_fft, "enumeration": by_enumeration, "samples": by_samples}


def of_lowest(share: np.ndarray, sites: int) -> np.ndarray:
    """The distribution of the lowest of independent sites: that of one, as 1 - (1 - its sums) ** sites, by differences."""
    below = 1 - (1 - np.minimum(np.cumsum(share), 1.0)) ** sites
    return np.diff(below, prepend=0.0)


def partition_functions(matrices: DataFrame, keys: list[str], *, step: float, sites: int = 1, method: str = "fft") -> DataFrame:
    """(keys, ``energy``, ``share``): the share of words, or of sequences of several sites by their lowest one, in every
    bin of energy that holds some."""
    of = METHODS[method]
    schema = StructType([*(matrices.schema[k] for k in keys), StructField("energy", DoubleType()), StructField("share", DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        low, share = of(bins_of(np.column_stack([table[b].to_numpy() for b in "acgt"]), step))
        share = of_lowest(share, sites)
        at = np.flatnonzero(share > 1e-15)
        own = [pa.array([table[k][0].as_py()] * len(at), table[k].type) for k in keys]
        return pa.table([*own, pa.array((at + low) * step), pa.array(share[at])], names=[*keys, "energy", "share"])

    return matrices.select(*keys, "pos", "a", "c", "g", "t").groupBy(*keys).applyInArrow(run, schema)


def mean_occupancies(functions: DataFrame, keys: list[str], mu: float) -> DataFrame:
    """(keys, ``occupancy``): the mean occupancy under each partition function."""
    return functions.groupBy(*keys).agg((F.sum(F.col("share") * occupancy(F.lit(mu), F.col("energy"))) / F.sum("share")).alias("occupancy"))


def denominators(functions: DataFrame, keys: list[str], potentials: list[float], length: int) -> DataFrame:
    """(keys, ``round``, ``log_sum``): for each round the logarithm of the sum, over the 4**length sequences, of the
    product of occupancies in all rounds so far."""
    rounds = F.posexplode(F.array(*(F.array(*map(F.lit, potentials[: i + 1])) for i in range(len(potentials))))).alias("round", "mus")
    product = F.aggregate("mus", F.lit(1.0), lambda a, mu: a * occupancy(mu, F.col("energy")))
    rows = functions.select(*keys, "energy", "share", rounds).withColumn("x", F.col("share") * product)
    return rows.groupBy(*keys, F.col("round").cast(LongType()).alias("round")).agg((F.ln(F.sum("x")) + length * float(np.log(4))).alias("log_sum"))


def word_matrices(words: DataFrame, keys: list[str], length: int, rt: float, digits: int = 3) -> DataFrame:
    """Matrices of aligned words (keys, ``word``): for each position -rt * ln(p / largest p), p being the share of each
    base with one added to its count."""
    at = words.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("base", F.substr("word", F.col("pos") + 1, F.lit(1)))
    counts = at.groupBy(*keys, "pos").agg(*(F.sum(F.when(F.col("base") == b.upper(), 1).otherwise(0)).alias(f"n{b}") for b in "acgt"))
    top = F.greatest(*(F.col(f"n{b}") for b in "acgt"))
    return counts.select(*keys, "pos", *(F.round(-rt * F.ln((F.col(f"n{b}") + 1) / (top + 1)), digits).alias(b) for b in "acgt"))
