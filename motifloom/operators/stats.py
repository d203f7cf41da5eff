"""Statistics: quantiles, ranks, histograms, correlations, counts by position."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.functions.sequence import pieces, reverse_complement
from motifloom.operators.ordered import few, numbered, running


def quantiles(df: DataFrame, keys: list[str], value: str, probs: tuple[float, ...], alpha: float = 0.4, beta: float = 0.4, names: list[str] | None = None) -> DataFrame:
    """Exact quantiles by plotting positions, a column ``q<prob>`` (or of ``names``) each.

    Where little is read, from the sorted values of each group.  Otherwise equal values are counted first, and the two
    order statistics that a quantile lies between are picked from running counts by conditional aggregates."""
    if few(df):
        names = names or [f"q{int(round(p * 100)):02d}" for p in probs]
        values = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_all"))
        some = lambda p: F.when(F.size("_all") > 0, sorted_quantile(F.col("_all"), p, alpha, beta))
        return values.select(*keys, *(some(p).alias(n) for p, n in zip(probs, names)))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    rows = running(counts, keys, ["x"], {"i": F.col("c")})
    n, out = F.col("i_total"), []
    at = lambda k: (F.col("i_upto") - F.col("c") < k) & (k <= F.col("i_upto"))
    for p, name in zip(probs, names or [f"q{int(round(p * 100)):02d}" for p in probs]):
        h = n * p + (alpha + p * (1 - alpha - beta))
        k = F.floor(F.greatest(F.lit(1.0), F.least(h, (n - 1).cast("double"))))
        g = F.greatest(F.lit(0.0), F.least(h - k, F.lit(1.0)))
        low = F.when(at(k), F.when(n == 1, F.col("x")).otherwise((1 - g) * F.col("x"))).otherwise(F.lit(0.0))
        out.append(F.sum(low + F.when(at(k + 1), g * F.col("x")).otherwise(F.lit(0.0))).alias(name))
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(*out)


def sorted_quantile(values: Column, p: float, alpha: float = 0.4, beta: float = 0.4) -> Column:
    """G5 of a sorted array that is not empty."""
    n = F.size(values)
    h = n * p + (alpha + p * (1 - alpha - beta))
    k = F.floor(F.greatest(F.lit(1.0), F.least(h, (n - 1).cast("double")))).cast("int")
    g = F.greatest(F.lit(0.0), F.least(h - k, F.lit(1.0)))
    return F.when(n == 1, values[0]).otherwise((1 - g) * F.element_at(values, k) + g * F.element_at(values, F.least(k + 1, n)))


def upper_mean(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Mean of the int(share * n) + 1 largest values, from counts of equal ones."""
    counts = df.groupBy(*keys, (-F.col(value)).alias("_x")).agg(F.count("*").alias("_c"))
    rows = running(counts, keys, ["_x"], {"_i": F.col("_c")})
    wanted = F.floor(F.col("_i_total") * share) + 1
    taken = F.greatest(F.lit(0), F.least("_c", wanted - (F.col("_i_upto") - F.col("_c"))))
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg((-F.sum(taken * F.col("_x")) / F.sum(taken)).alias("upper_mean"))


def average_ranks(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """(keys, value, ``name``): ranks from 1 of distinct values, equal ones sharing their mean rank, from running
    counts."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    return running(counts, keys, [value], {"_i": F.col("_c")}).select(*keys, value, (F.col("_i_upto") - (F.col("_c") - 1) / 2).alias(name))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The correlation of ranks.  Rows meet their ranks as counts of equal pairs; where little is read, ranks are
    taken beside each other, after one shuffle by keys."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).cast("double").alias("_va"), F.col(b).cast("double").alias("_vb"))
    if few(df):
        all_ = F.count("*").over(Window.partitionBy(*(keys or [F.lit(0)])))
        pairs = rows.withColumn("_n", F.lit(1.0)).withColumn("_all", all_)
        for value, name in (("_va", "_a"), ("_vb", "_b")):  # from the first to the last rank of equal values
            order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(value)
            pairs = pairs.withColumn(name, (F.rank().over(order) + F.round(F.cume_dist().over(order) * F.col("_all"))) / 2)
    else:
        pairs = rows.groupBy(*keys, "_va", "_vb").agg(F.count("*").cast("double").alias("_n"))
        for value, name in (("_va", "_a"), ("_vb", "_b")):
            ranks = average_ranks(rows, value, keys, name).select(*(F.col(k).alias(f"_r_{k}") for k in keys), F.col(value).alias("_r"), name)
            pairs = pairs.join(ranks, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col(value) == F.col("_r")]).drop("_r", *(f"_r_{k}" for k in keys))
    n, sa, sb = F.sum("_n"), F.sum(F.col("_n") * F.col("_a")), F.sum(F.col("_n") * F.col("_b"))
    # mean and deviation of ranks are of one order, so nothing cancels in these sums
    sums = pairs.groupBy(*keys).agg(n.alias("_n"), sa.alias("_sa"), sb.alias("_sb"), F.sum(F.col("_n") * F.col("_a") * F.col("_a")).alias("_aa"), F.sum(F.col("_n") * F.col("_b") * F.col("_b")).alias("_bb"), F.sum(F.col("_n") * F.col("_a") * F.col("_b")).alias("_ab"))
    cov, va, vb = (F.col(p) / F.col("_n") - F.col(x) / F.col("_n") * F.col(y) / F.col("_n") for p, x, y in (("_ab", "_sa", "_sb"), ("_aa", "_sa", "_sa"), ("_bb", "_sb", "_sb")))
    return sums.select(*keys, F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("spearman"))


def grid_best(df: DataFrame, keys: list[str], grid: list[float], score, target: str) -> DataFrame:
    """Of a grid of parameters that whose ``score(parameter)`` has the largest rank correlation with a column;
    the smallest of equal ones."""
    wide = df.withColumn("parameter", F.explode(F.array(*map(F.lit, grid)))).withColumn("_score", score(F.col("parameter")))
    found = spearman(wide, [*keys, "parameter"], "_score", target).where("spearman is not null")
    best = F.max(F.struct("spearman", (-F.col("parameter")).alias("m")))
    grouped = found.groupBy(*keys) if keys else found.groupBy()
    return grouped.agg(best.alias("x")).select(*keys, (-F.col("x.m")).alias("parameter"), F.col("x.spearman").alias("spearman"))


def rank_groups(df: DataFrame, order: list[str], groups: int, keys: list[str], name: str = "bin") -> DataFrame:
    """floor(i * groups / n) of the position i in an order."""
    return numbered(df, keys, order).withColumn(name, F.floor((F.col("row_upto") - 1) * groups / F.col("row_total"))).select(*df.columns, name)


def histogram_2d(df: DataFrame, a: Column, b: Column, width: float) -> DataFrame:
    """Counts of pairs by cells."""
    return df.groupBy(F.floor(a / width).alias("a_bin"), F.floor(b / width).alias("b_bin")).agg(F.count("*").alias("n"))


def split_histogram(df: DataFrame, value: str, low: float, width: float) -> DataFrame:
    """A histogram in which each value is divided between the two bins it lies between."""
    at = (F.col(value) - low) / width
    parts = df.select(F.floor(at).alias("bin"), (1 - (at - F.floor(at))).alias("w")).unionAll(df.select((F.floor(at) + 1).alias("bin"), (at - F.floor(at)).alias("w")))
    return parts.groupBy("bin").agg(F.sum("w").alias("weight"))


def running_minimum_cdf(hist: DataFrame, n_sites: int) -> DataFrame:
    """Of a distribution over bins that of the smallest of ``n_sites`` independent draws."""
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))
    cdf = hist.withColumn("cdf", 1 - F.pow(F.greatest(F.lit(0.0), 1 - F.sum("weight").over(w) / total), F.lit(n_sites)))
    return cdf.select("bin", (F.col("cdf") - F.coalesce(F.lag("cdf").over(w), F.lit(0.0))).alias("weight"))


CODES = np.full(256, -1, np.int64)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def counted_words(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, Counter]:
    """The words of k letters A, C, G, T of some texts as numbers, how often each occurs, and counts of other words."""
    codes = CODES[np.frombuffer("\n".join(texts).encode("ascii", "replace"), np.uint8)]
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), Counter()
    number, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        number = number * 4 + codes[i : i + n]
        known &= codes[i : i + n] >= 0
    words, counts = np.unique(number[known], return_counts=True)
    other: Counter = Counter()
    if known.sum() < sum(max(0, len(t) - k + 1) for t in texts):
        plain = set("ACGT")
        for t in texts:
            if not plain.issuperset(t):
                other.update(w for w in (t[i : i + k] for i in range(len(t) - k + 1)) if not plain.issuperset(w))
    return words, counts, other


def kmer_counts(seqs: DataFrame, k: int, seq_col: str = "seq", both_strands: bool = True) -> DataFrame:
    """Counts of all words, over both strands.  Words are counted on one strand as numbers, each task sums up its
    own; the other strand's counts are the same numbers under the reverse complements."""
    if k > 31:
        raise ValueError("words of at most 31 letters")
    letters = np.frombuffer(b"ACGT", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        other: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
            for i in range(0, len(words), 1 << 16):
                digits = words[i : i + (1 << 16), None] // 4 ** np.arange(k - 1, -1, -1) % 4
                names = letters[digits].tobytes().decode()
                yield pa.RecordBatch.from_arrays([pa.array([names[j : j + k] for j in range(0, len(names), k)], pa.string()), pa.array(counts[i : i + (1 << 16)])], names=["kmer", "n"])
            if other:
                yield pa.RecordBatch.from_arrays([pa.array(list(other), pa.string()), pa.array(list(other.values()), pa.int64())], names=["kmer", "n"])
            held.clear()
            other.clear()

        for batch in batches:
            texts, size, part = [t for t in batch.column(0).to_pylist() if t], 0, []
            for t in [*texts, None]:
                if t is not None:
                    part.append(t)
                    size += len(t)
                if part and (t is None or size > 1 << 20):
                    words, counts, rest = counted_words(part, k)
                    held.append((words, counts))
                    other.update(rest)
                    part, size = [], 0
            if sum(len(w) for w, _ in held) + len(other) > 1 << 22:
                yield from out()
        if held:
            yield from out()

    counts = seqs.select(F.upper(seq_col).alias("seq")).mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
    if not both_strands:
        return counts
    strand = F.explode(F.array(F.col("kmer"), reverse_complement(F.col("kmer"))))
    return counts.select(strand.alias("kmer"), "n").groupBy("kmer").agg(F.sum("n").alias("n"))


def consensus_kmer(counts: DataFrame) -> DataFrame:
    """The most frequent word; of equal ones the first in order."""
    return counts.groupBy("n").agg(F.min("kmer").alias("kmer")).orderBy(F.desc("n")).limit(1)


def position_counts(sites: DataFrame, length: int | None, seq_col: str = "site", weight: Column | None = None) -> DataFrame:
    """Weighted counts of bases by position and their share of the position; without a length at all positions."""
    rows = sites.select(F.col(seq_col).alias("_s"), (F.lit(1.0) if weight is None else weight).alias("_w"))
    rows = pieces(rows if length is None else rows.withColumn("_s", F.substring("_s", 1, length)), "_s", 1)
    counts = rows.groupBy(F.col("offset").alias("pos"), F.substr("piece", F.col("within") + 1, F.lit(1)).alias("base")).agg(F.sum("_w").alias("n")).where("base in ('A','C','G','T')")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))


def flanking_bases(sites: DataFrame, offset: int, seq_col: str = "seq", at_col: str = "offset") -> DataFrame:
    """Counts of the bases at a distance from the best sites, those beyond the ends left out."""
    at = F.col(at_col) + offset
    return sites.where((at >= 0) & (at < F.length(seq_col))).groupBy(F.substr(seq_col, at + 1, F.lit(1)).alias("base")).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy of base counts, one added to each and four to the total."""
    p = (F.col("n") + 1) / (F.sum("n").over(Window.partitionBy(*(keys or [F.lit(0)]))) + 4)
    rows = counts.withColumn("_p", p)
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg((-F.sum(F.col("_p") * F.ln(F.col("_p") + 1e-6))).alias("entropy"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows by rows of the class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.select(label, (F.sum("n").over(Window.partitionBy(F.lit(0))) / F.col("n")).alias("weight"))


def renormalised(score: Column, prior: Column, alpha: float = 0.05) -> Column:
    """A score that was trained with one share of positives, for another."""
    odds = score / (1 - score) * (alpha / (1 - alpha)) / (prior / (1 - prior))
    return odds / (1 + odds)


def summaries(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Length and mean, largest and smallest value of each column of a region's positions."""
    aggs = [F.count("*").alias("length")] + reduce(list.__add__, [[F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min")] for c in columns])
    return df.groupBy(*keys).agg(*aggs)
