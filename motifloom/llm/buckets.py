"""Buckets of rows that are compared with one another: dealt into blocks, read group by group, compared in pairs.

A bucket of more than ``block`` rows is dealt into blocks by a hash; every pair of blocks is a group of its own, so no
task gets a large bucket whole.  ``side`` tells the rows of a group apart: 0 where the group is one block, else 1 or 2
for the two blocks, of which only pairs across are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.llm.shared import written

SMALL = 48  # groups up to this size are compared many at a time
STRIPE = 256  # rows of a larger group compared with the others at a time


def deal(entries: DataFrame, block: int, row: str = "num", sparse: bool = False) -> DataFrame:
    """``entries`` with ``group`` and ``side`` for ``bucket``, a 64-bit hash; rows of buckets above ``block`` come once
    for every pair of blocks that theirs is in.

    ``sparse``: most buckets are expected to hold one row; rows of these are left out before anything else is done."""
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > (1 if sparse else block))
    # written, so that its true size decides how it is joined
    known = written(sizes.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "buckets")
    mine = F.coalesce(F.pmod(F.xxhash64(row, F.lit(5)), F.col("blocks")), F.lit(0)).cast("int")
    dealt = entries.join(known, "bucket", "inner" if sparse else "left").withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    return dealt.withColumns({"group": pair_of("mine", "other"), "side": side_of("mine", "other")}).drop("blocks", "mine", "other", "bucket")


def pair_of(mine: str, other: str) -> Column:
    """The group of a bucket's pair of blocks."""
    return F.xxhash64("bucket", F.least(mine, other), F.greatest(mine, other))


def side_of(mine: str, other: str) -> Column:
    return F.when(F.col(mine) == F.col(other), 0).when(F.col(mine) < F.col(other), 1).otherwise(2).cast("byte")


def grouped(df: DataFrame) -> DataFrame:
    return df.repartition("group").sortWithinPartitions("group")


def complete(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that come sorted by ``group``, and where each begins."""
    kept: pa.Table | None = None
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            new = pa.Table.from_batches([batch.slice(at, rows)])
            kept = new if kept is None else pa.concat_tables([kept, new])
            start = starts(kept)
            if len(start) > 1:  # the last group may go on
                yield kept.slice(0, start[-1]), start[:-1]
                kept = kept.slice(start[-1])
    if kept is not None and kept.num_rows:
        yield kept, starts(kept)


def starts(rows: pa.Table) -> np.ndarray:
    group = rows["group"].to_numpy()
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def pairs(start: np.ndarray, n: int, side: np.ndarray, alike) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of rows of one group, across its sides, that ``alike(i, j)`` finds alike."""
    end = np.append(start[1:], n)
    of = np.repeat(np.arange(len(start)), end - start)
    small = end - start <= SMALL
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        across = (side[i] == 0) | (side[i] != side[j])
        i, j = i[across], j[across]
        found = alike(i, j)
        left.append(i[found])
        right.append(j[found])

    for d in range(1, SMALL):  # pairs at each distance within the small groups, all groups at once
        i = np.flatnonzero(small[of[: n - d]] & (of[: n - d] == of[d:])) if n > d else np.empty(0, int)
        if not len(i):
            break
        add(i, i + d)
    for s, e in zip(start[~small].tolist(), end[~small].tolist()):
        for at in range(s, e, STRIPE):
            i, j = np.meshgrid(np.arange(at, min(e, at + STRIPE)), np.arange(at, e), indexing="ij")
            below = i < j
            add(i[below], j[below])
    return np.concatenate(left), np.concatenate(right)


def spanning_roots(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs connect it with: minima of neighbours, then of the roots
    so far, until nothing changes."""
    root = np.arange(n)
    while True:
        old = root.copy()
        least = np.minimum(root[p], root[q])
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)
        root = np.minimum(root, root[root])
        if (root == old).all():
            return root
