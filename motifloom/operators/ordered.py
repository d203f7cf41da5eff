"""Running sums and row numbers over orders of any length, so that no task sees a whole group.

Plans that read little are one window.  Others write their rows once, ranged by group, order and a number of the row, in
slices as many as the input is large; sums run within a slice and are raised by the sums of the slices before.  As the
borders are taken from groups and orders together, and equal rows are told apart by their numbers, neither a group whose
values lie close together nor ties fill a slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.operators.scratch import input_bytes, written

#: Bytes of input up to which a plan sorts each group in one task.
FEW = 64 << 20
#: Bytes of input for a slice, and the most slices where the size is unknown.
SLICE, UNKNOWN = 16 << 20, 64


def few(df: DataFrame) -> bool:
    """Whether a plan reads so little that one task may sort it."""
    return input_bytes(df) <= FEW


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows with ``_tie``, a number, and ``_slice``: rows of smaller keys, order and number have smaller slices."""
    size = input_bytes(df)
    slices = UNKNOWN if size > 1 << 60 else max(2, -(-size // SLICE))
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(slices, *keys, *order, "_tie")
    return written(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def running(df: DataFrame, keys: list[str], order: list[str], weights: dict[str, Column]) -> DataFrame:
    """For each weight the columns ``<name>_upto``, the sum over the rows of a group up to and with this one in
    ascending order (nulls first), and ``<name>_total``, that of the group.

    The order should be of unique rows, or equal rows alike."""
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    first = Window.unboundedPreceding
    if few(df):
        rows = df.withColumns({f"_{n}": w for n, w in weights.items()})
        upto = {f"{n}_upto": F.sum(f"_{n}").over(group.orderBy(*order).rowsBetween(first, 0)) for n in weights}
        return rows.withColumns(upto).withColumns({f"{n}_total": F.sum(f"_{n}").over(group) for n in weights}).select(*df.columns, *(f"{n}_{x}" for n in weights for x in ("upto", "total")))
    rows = sliced(df.withColumns({f"_{n}": w for n, w in weights.items()}), keys, order)
    sums = rows.groupBy(*keys, "_slice").agg(*(F.sum(f"_{n}").alias(f"_{n}_sum") for n in weights))
    before = {f"_{n}_before": F.sum(f"_{n}_sum").over(group.orderBy("_slice").rowsBetween(first, 0)) - F.col(f"_{n}_sum") for n in weights}
    totals = {f"{n}_total": F.sum(f"_{n}_sum").over(group) for n in weights}
    sums = sums.withColumns({**before, **totals}).drop(*(f"_{n}_sum" for n in weights))
    own = Window.partitionBy(*keys, "_slice").orderBy(*order, "_tie").rowsBetween(first, 0)
    rows = rows.withColumns({f"_{n}_own": F.sum(f"_{n}").over(own) for n in weights})
    # null keys are groups like others
    renamed = sums.select(*(F.col(c).alias(f"_k_{c}") if c in (*keys, "_slice") else c for c in sums.columns))
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, "_slice")]
    out = rows.join(renamed, on).withColumns({f"{n}_upto": F.col(f"_{n}_own") + F.coalesce(f"_{n}_before", F.lit(0)) for n in weights})
    return out.select(*df.columns, *(f"{n}_{x}" for n in weights for x in ("upto", "total")))


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``row_upto``, the number of a row in its group from 1, and ``row_total``, the rows of the group."""
    return running(df, keys, order, {"row": F.lit(1).cast("long")})
