"""Convolutions along tracks in chunks with halos (F12, M12, G30 of the survey).

Positions are dealt into chunks by key and place; those within a kernel's reach of a border go to the neighbouring chunk
as well.  So rows move once, as positions and halos, and each chunk is convolved as an array by itself."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StructField, StructType

CHUNK = 1 << 16
DIRECT = 512  # longer kernels are convolved by transforms


def overlap_add(x: np.ndarray, kernel: np.ndarray, block: int = 1 << 11) -> np.ndarray:
    """The full convolution of the first axis, by transforms of blocks whose ends are added."""
    size = 1 << (max(block, len(kernel)) + len(kernel) - 2).bit_length()
    step = size - len(kernel) + 1
    out = np.zeros((len(x) + size, *x.shape[1:]))
    other = np.fft.rfft(kernel, size).reshape(-1, *[1] * (x.ndim - 1))
    for at in range(0, len(x), step):
        out[at : at + size] += np.fft.irfft(np.fft.rfft(x[at : at + step], size, axis=0) * other, size, axis=0)
    return out[: len(x) + len(kernel) - 1]


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The full convolution of the columns of x."""
    if len(kernel) > DIRECT:
        return overlap_add(x, kernel)
    return np.column_stack([np.convolve(x[:, i], kernel) for i in range(x.shape[1])])


def same(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The part of the convolution that is about as long as x: out[p] takes x from p + (n - 1) // 2 backwards."""
    return convolve(x, kernel)[(len(kernel) - 1) // 2 :][: len(x)]


def in_chunks(track: DataFrame, keys: list[str], columns: list[str], reach: tuple[int, int], run: Callable, fields: list[tuple[str, DataType]], chunk: int = CHUNK) -> DataFrame:
    """``run(array, places, positions)`` of every chunk: a dense array of the columns (0 where there is no position) from
    the first to the last position up to ``reach[0]`` before the chunk and ``reach[1]`` behind it, the places of the
    chunk's own positions in the array, and these positions.  It returns arrays of the fields, which follow the keys."""
    before, behind = reach
    home = F.floor(F.col("pos") / chunk)
    # a position is in the halo of the chunks that it lies at most so far from
    dealt = track.select(*keys, "pos", *columns, F.explode(F.sequence(F.floor((F.col("pos") - behind) / chunk), F.floor((F.col("pos") + before) / chunk))).alias("_chunk"), home.alias("_home"))
    schema = StructType([*(track.schema[k] for k in keys), *(StructField(n, t) for n, t in fields)])

    def of(table: pa.Table) -> pa.Table:
        at = table["_chunk"][0].as_py()
        pos = table["pos"].to_numpy()
        low = int(pos.min())  # what lies beyond the first and the last position is 0 as well
        pos = pos - low
        x = np.zeros((int(pos.max()) + 1, len(columns)))
        for i, c in enumerate(columns):
            x[pos, i] = table[c].to_numpy()
        own = np.sort(pos[table["_home"].to_numpy() == at])
        found = run(x, own, own + low) if len(own) else [np.empty(0)] * len(fields)
        given = [pa.array([table[k][0].as_py()] * len(found[0]), table[k].type) for k in keys]
        return pa.table([*given, *map(pa.array, found)], names=schema.names)

    kinds = {LongType(): pa.int64(), DoubleType(): pa.float64()}

    def typed(table: pa.Table) -> pa.Table:
        out = of(table)
        return out.cast(pa.schema([(n, out.schema.field(n).type if n in keys else kinds[t]) for n, t in zip(schema.names, (f.dataType for f in schema))]))

    return dealt.groupBy(*keys, "_chunk").applyInArrow(typed, schema)


def convolved(track: DataFrame, keys: list[str], columns: list[str], kernel: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """(keys, ``pos``, columns): the columns convolved with a kernel, at the track's positions, which are unique for a
    key; missing positions count as 0."""
    n = len(kernel)
    ahead = (n - 1) // 2

    def run(x: np.ndarray, own: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
        out = same(x, kernel)[own]
        return [pos, *(out[:, i] for i in range(out.shape[1]))]

    return in_chunks(track, keys, columns, (n - 1 - ahead, ahead), run, [("pos", LongType()), *((c, DoubleType()) for c in columns)], chunk)
