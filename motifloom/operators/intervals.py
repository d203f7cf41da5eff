"""Intervals: half-open [start, stop) on a contig (P1 to P3, J1 to J4, D4 of the survey)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = 1 << 20  # pairs compared at a time


def centred(peaks: DataFrame, half_width: int) -> DataFrame:
    """Windows of twice the half width about the summits; those that would start at 0 or before are dropped."""
    start = F.col("start") + F.col("summit") - half_width
    return peaks.withColumns({"start": start, "stop": start + 2 * half_width, "summit": F.lit(half_width).cast("long")}).where(F.col("start") > 0)


def window(start: Column, summit: Column, half_width: int) -> tuple[Column, Column]:
    """(start, stop) of a window about a summit."""
    return start + summit - half_width, start + summit + half_width


def padded(start: Column, stop: Column, fragment: int) -> tuple[Column, Column]:
    """Two fragments more on either side, not below 0."""
    return F.greatest(F.lit(0), start - 2 * fragment), stop + 2 * fragment


def identifier() -> Column:
    """``contig:start-stop_summit``."""
    return F.concat(F.col("contig"), F.lit(":"), F.col("start"), F.lit("-"), F.col("stop"), F.lit("_"), F.col("summit"))


def uniform_width(peaks: DataFrame) -> int | None:
    """The one width that all intervals have; an error if there are several."""
    low, high = peaks.agg(F.min(F.col("stop") - F.col("start")), F.max(F.col("stop") - F.col("start"))).first()
    if low != high:
        raise ValueError(f"intervals have widths from {low} to {high}")
    return low


def overlap_join(left: DataFrame, right: DataFrame, *, bin_width: int = 512, how: str = "inner") -> DataFrame:
    """Pairs of intervals (contig, start, stop) that share a position; the right side's columns get the
    prefix ``r_``.

    Both sides are listed by the bins they touch and joined on contig and bin, so hot contigs are dealt by bin.  A pair
    is kept only in the bin where its overlap begins: no second shuffle removes duplicates.  ``how``: inner, or left to
    keep intervals without partners (J3), which by an outer join of the pairs takes a key ``row_id`` on the left."""
    def binned(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / bin_width))))

    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    pairs = binned(left, "start", "stop").join(binned(r, "r_start", "r_stop").withColumnRenamed("bin", "r_bin"), (F.col("contig") == F.col("r_contig")) & (F.col("bin") == F.col("r_bin")) & (F.col("start") < F.col("r_stop")) & (F.col("r_start") < F.col("stop")))
    pairs = pairs.where(F.col("bin") == F.floor(F.greatest("start", "r_start") / bin_width)).drop("bin", "r_bin")
    if how == "inner":
        return pairs
    return left.join(pairs.select("row_id", *(f"r_{c}" for c in right.columns)), "row_id", "left")


def overlap_fraction() -> Column:
    """Overlap by length of the right interval."""
    return (F.least("stop", "r_stop") - F.greatest("start", "r_start")) / (F.col("r_stop") - F.col("r_start"))


class Observed:
    """The observed intervals of a block, told apart by their places in the order of preference (row number)."""

    def __init__(self, rows: pa.Table):
        self.rows = rows.sort_by([("order", "descending")]).combine_chunks()  # nulls last
        self.start, self.stop = (self.rows[c].to_numpy() for c in ("start", "stop"))
        self.length = self.stop - self.start
        self.by_start = np.argsort(self.start, kind="stable")
        self.by_length = np.lexsort((self.start, self.length))
        self.borders = np.flatnonzero(np.diff(self.length[self.by_length], prepend=-1, append=-1))

    def best(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every region the largest fraction of an observed interval that it overlaps, 0 if none, and the first of
        those that have it.  Either all overlaps are compared or one candidate for each length, whichever are fewer."""
        sorted_start = self.start[self.by_start]
        first, last = np.searchsorted(sorted_start, start - self.length.max(), "right"), np.searchsorted(sorted_start, stop, "left")
        counts = np.maximum(last - first, 0)
        if counts.sum() <= 4 * len(start) * (len(self.borders) - 1):
            return self._by_pairs(start, stop, first, counts)
        return self._by_lengths(start, stop)

    def _by_pairs(self, start: np.ndarray, stop: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fraction, best = np.zeros(len(start)), np.full(len(start), len(self.start))
        some = np.flatnonzero(counts)
        for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(counts[some]) // PAIRS)) + 1) if len(some) else ():
            n = counts[part]
            ends = np.cumsum(n)
            region = np.repeat(part, n)
            at = self.by_start[np.arange(ends[-1]) + np.repeat(first[part] - ends + n, n)]
            x = (np.minimum(stop[region], self.stop[at]) - np.maximum(start[region], self.start[at])) / self.length[at]
            fraction[part] = np.maximum(np.maximum.reduceat(x, ends - n), 0)
            best[part] = np.minimum.reduceat(np.where(x == fraction[region], at, len(self.start)), ends - n)
        return fraction, best

    def _by_lengths(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals of one length those that begin between region start and region stop - length, in either order,
        overlap most; if there are none, then the nearest on one of both sides.  A region is done when its fraction is
        more than longer intervals can have."""
        fraction, best = np.zeros(len(start)), np.full(len(start), len(self.start))
        open_ = np.arange(len(start))
        for lo, hi in zip(self.borders[:-1], self.borders[1:]):
            at = self.by_length[lo:hi]
            own, length = self.start[at], self.length[at[0]]
            open_ = open_[fraction[open_] <= np.minimum(stop[open_] - start[open_], length) / length]
            s, e = start[open_], stop[open_]
            low, high, most = np.minimum(s, e - length), np.maximum(s, e - length), np.minimum(e - s, length)
            i, j = np.searchsorted(own, low, "left"), np.searchsorted(own, high, "right")
            before, after = np.maximum(i - 1, 0), np.minimum(i, len(own) - 1)
            left, right = np.where(i > 0, most - (low - own[before]), 0), np.where(i < len(own), most - (own[after] - high), 0)
            inside = np.flatnonzero(i < j)
            overlap = np.maximum(left, right)
            overlap[inside] = most[inside]
            found = np.minimum(np.where(left == overlap, at[before], len(self.start)), np.where(right == overlap, at[after], len(self.start)))
            found[inside] = lowest(at, i[inside], j[inside])
            x = overlap / length
            better = (overlap > 0) & ((x > fraction[open_]) | ((x == fraction[open_]) & (found < best[open_])))
            fraction[open_[better]], best[open_[better]] = x[better], found[better]
        return fraction, best


def lowest(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest of ``values[first:last]`` for every pair, from minima of runs whose lengths are powers of two."""
    out, step = np.empty(len(first), values.dtype), 1
    size = last - first
    while (size >= step).any():
        own = (size >= step) & (size < 2 * step)
        out[own] = np.minimum(values[first[own]], values[last[own] - step])
        values, step = np.minimum(values[:-step], values[step:]), 2 * step
    return out


def _best_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block, observed ones first: these are held, deduplicated as they are, and the regions pass."""
    block, held, observed = None, [], None
    for batch in batches:
        place = [batch["contig"].dictionary_encode().indices.to_numpy(), batch["block"].to_numpy(), batch["is_region"].to_numpy(zero_copy_only=False)]
        borders = np.flatnonzero(np.any([np.diff(x.astype(np.int64), prepend=0, append=0) != 0 for x in place], 0))
        for lo, hi in zip((edges := np.unique([0, *borders, len(batch)]))[:-1], edges[1:]):
            rows = batch.slice(lo, hi - lo)
            if (own := (rows["contig"][0].as_py(), place[1][lo])) != block:
                block, held, observed = own, [], None
            if not place[2][lo]:
                held.append(rows)
            elif held:
                observed = observed or Observed(pa.Table.from_batches(held))
                fraction, best = observed.best(rows["start"].to_numpy(), rows["stop"].to_numpy())
                hit = np.flatnonzero(fraction > 0)
                found = observed.rows.take(pa.array(best[hit]))
                columns = [rows["key"].take(pa.array(hit)), pa.array(fraction[hit]), *(found[c].combine_chunks() for c in ("order", "score"))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "fraction", "order", "score"])


def best_overlap(regions: DataFrame, observed: DataFrame, *, key: str = "row_id", min_fraction: float = 0.5, order: str = "id", block_width: int = 1 << 14) -> DataFrame:
    """``key``, ``fraction``, ``label`` and ``score`` of every region.

    The observed interval of largest fraction counts, of equal ones the first by ``order``; the label is 1 where its
    fraction is above ``min_fraction`` and the score then is its own; regions without overlap have 0.

    No pairs are listed: equal observed intervals become one, both sides are dealt by the blocks of positions that they
    touch, and each block finds the best of its regions as arrays.  Intervals have ``stop`` after ``start``."""
    whole = "contig is not null and start < stop"
    single = observed.where(whole).groupBy("contig", "start", "stop").agg(F.max(F.struct((-F.col(order)).alias("order"), "score")).alias("x")).select("contig", "start", "stop", "x.order", "x.score")
    wanted = regions.where(whole).select("contig", "start", "stop", F.col(key).alias("key"), F.lit(True).alias("is_region"))
    blocks = F.explode(F.sequence(F.floor(F.col("start") / block_width), F.floor((F.col("stop") - 1) / block_width)))
    rows = single.withColumn("is_region", F.lit(False)).unionByName(wanted, allowMissingColumns=True).withColumn("block", blocks)
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "contig", "block").sortWithinPartitions("contig", "block", "is_region")
    schema = T.StructType([T.StructField("key", regions.schema[key].dataType), T.StructField("fraction", T.DoubleType()), *(T.StructField(c, single.schema[c].dataType) for c in ("order", "score"))])
    best = dealt.mapInArrow(_best_in_blocks, schema).groupBy(F.col("key").alias(key)).agg(F.max(F.struct("fraction", "order", "score")).alias("x"))
    hit = F.col("x.fraction") > min_fraction
    return regions.select(key).join(best, key, "left").select(key, F.coalesce("x.fraction", F.lit(0.0)).alias("fraction"), F.when(hit, 1).otherwise(0).alias("label"), F.when(hit, F.col("x.score")).otherwise(0.0).alias("score"))


def radius_class(regions: DataFrame, observed: DataFrame, *, near: int = 300, far: int = 2000, key: str = "row_id") -> DataFrame:
    """1 with an observed interval within ``near`` of the summit, -1 with none within ``far``, else 0."""
    middle = F.col("start") + F.col("summit")
    wide = regions.select(key, F.col("contig"), (middle - far).alias("start"), (middle + far).alias("stop"), middle.alias("middle"))
    pairs = overlap_join(wide, observed.select("contig", "start", "stop"), bin_width=4096)
    close = (F.col("r_start") < F.col("middle") + near) & (F.col("r_stop") > F.col("middle") - near)
    found = pairs.groupBy(key).agg(F.max(close).alias("close"))
    return regions.select(key).join(found, key, "left").select(key, F.when(F.col("close").isNull(), -1).when(F.col("close"), 1).otherwise(0).alias("label"))


def fetch(genome: DataFrame, regions: DataFrame, *, chunk: int = 1 << 16, key: str = "row_id") -> DataFrame:
    """(key, seq) of regions from a genome stored as (contig, chunk, seq) pieces of equal length; 0-based,
    half-open, clipped at the contig's end."""
    wanted = regions.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("stop") - 1) / chunk))))
    parts = wanted.join(genome, ["contig", "chunk"])
    at = F.col("chunk") * chunk
    lo, hi = F.greatest(F.col("start") - at, F.lit(0)), F.least(F.col("stop") - at, F.lit(chunk))
    parts = parts.select(key, "chunk", F.substr("seq", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "")
    return parts.groupBy(key).agg(joined.alias("seq"))
