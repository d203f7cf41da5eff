"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learnt so that the signs of the rotated vectors are balanced binary codes of little
quantisation error.  Every vector is entered into several tables; the key of a table is a fixed choice of bits of the
code, so vectors whose codes differ in few bits share a key in some table.  The width of the keys follows the number of
vectors (``plan``), and the number of tables follows the width and the recall asked for.

Members of a bucket are first compared by their codes, which are 8 bytes: those with a partner within a Hamming
distance go on, and only their vectors move, to be compared by the cosine in double precision.  A pair that shares keys
in several tables is compared in the first of them.  Large buckets are compared in pairs of blocks (``buckets``).
Groups return counts and spanning links, not pairs.

Vectors of every length are compared with those of their own length.  The rotations of the ``fitted`` most frequent
lengths are fitted on at most ``sample`` vectors in all, chosen by their hashes; other lengths have a random rotation.
All vectors are indexed.

Vectors that are null, zero or hold null or non-finite components link with nothing.  Vectors are scaled by their
largest component before they are normed, so that no finite vector overflows.  Equal vectors are compared once and
counted as often as they occur.  Rows that repeat an id are vectors of their own; null ids are returned with a null
component unless they link.  An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm import buckets
from motifloom.llm.graph import components
from motifloom.llm.shared import written

BITS = 64
BLOCK = 512
PAIRS = 1 << 15  # vectors of so many pairs are compared at a time


def plan(n: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """(bits of a key, tables, largest Hamming distance) for n vectors: about 16 vectors to a bucket, tables enough to
    find a pair at the threshold with probability ``recall``, a distance three and a half deviations above its mean."""
    same = 1 - math.acos(threshold) / math.pi  # chance that a pair at the threshold agrees in a bit
    width = min(BITS // 2, max(8, math.ceil(math.log2(max(n, 1))) - 4))
    tables = math.ceil(math.log(1 - recall) / math.log1p(-(same**width))) if same < 1 else 1
    return width, tables, math.ceil(BITS * (1 - same) + 3.5 * math.sqrt(BITS * same * (1 - same)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1; no row is zero."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(x: np.ndarray, rounds: int = 50, seed: int = 17) -> np.ndarray:
    """The projection to ``BITS`` numbers by iterative quantisation: principal axes, rotated to minimise the error of
    their signs.  Vectors of fewer dimensions than bits get several rotations.

    Axes are those about the origin, as cosines are: whatever the mean of the vectors, a small angle is a small
    difference of codes."""
    _, axes = np.linalg.eigh(x.T @ x / len(x) + 1e-12 * np.eye(x.shape[1]))
    axes = axes[:, ::-1][:, :BITS]
    v, n = x @ axes, axes.shape[1]
    out = []
    for turn in range(-(-BITS // n)):
        rotation = np.linalg.qr(np.random.default_rng(seed + turn).standard_normal((n, n)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        out.append(axes @ rotation)
    return np.hstack(out)[:, :BITS]


def unlearnt(n: int, seed: int = 17) -> np.ndarray:
    """Random orthogonal directions for a length that no rotation is fitted to."""
    rng = np.random.default_rng([seed, n])
    return np.hstack([np.linalg.qr(rng.standard_normal((n, min(n, BITS))))[0] for _ in range(-(-BITS // min(n, BITS)))])[:, :BITS]


def masks(tables: int, width: int, seed: int = 17) -> np.ndarray:
    """The bits of each table's key: shuffles of all bits cut into keys, so that every bit serves equally often."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < tables:
        order = rng.permutation(BITS).astype(np.uint64)
        out += [np.bitwise_or.reduce(np.uint64(1) << order[i : i + width]) for i in range(0, BITS - width + 1, width)]
    return np.array(out[:tables], np.uint64)


def codes_of(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return (x @ projection >= 0).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64))


def by_length(x: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length among lists."""
    offsets, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length == n)
        yield own, flat[offsets[own][:, None] + np.arange(n)].astype(float)


def link(vectors: DataFrame, *, threshold: float = 0.95, recall: float = 0.999, sample: int = 20_000, fitted: int = 8, few: int = 200_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every row.

    ``recall``: chance of a pair at the threshold to share a table, if its bits agree independently."""
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.where(F.col("x").isNotNull() & ~bad & F.exists("x", lambda c: c != 0))
    # equal vectors are one, known by two hashes of their numbers
    numbers = F.transform("x", lambda c: c.cast("double") + 0.0)
    h = {f"h{i}": F.xxhash64(F.lit(i), numbers) for i in (1, 2)}
    good = good.withColumns({**h, "n": F.size("x")})
    sizes = good.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n")
    most, total = sizes.limit(fitted).collect(), sizes.agg(F.sum("k")).first()[0]
    nothing = rows.where(F.col("x").isNull() | bad | ~F.exists("x", lambda c: c != 0)).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not total:
        return _named(nothing, id_col)
    width, tables, distance = plan(total, threshold, recall)
    table_masks = masks(tables, width)

    projections = {}
    for r in most:  # at most ``sample`` vectors in all
        share = max(1, int(sample * r["k"] / total))
        chosen = good.where((F.col("n") == r["n"]) & (F.pmod("h1", F.lit(1 << 30)) <= math.ceil((1 << 30) * min(1.0, 1.5 * share / r["k"]))))
        chosen = chosen.groupBy("h1", "h2").agg(F.first("x").alias("x")).orderBy("h1").limit(share).select("x").toPandas()
        if len(chosen):
            projections[r["n"]] = learn(unit(np.stack(chosen["x"].to_numpy()).astype(float)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                code = np.zeros(part.num_rows, np.uint64)
                for own, x in by_length(pa.concat_arrays([part.column(4)])):
                    n = x.shape[1]
                    if n not in projections:
                        projections[n] = unlearnt(n)
                    code[own] = codes_of(unit(x), projections[n])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(code.view(np.int64))], names=["id", "h1", "h2", "n", "code"])

    coded = good.select("id", "h1", "h2", "n", "x").mapInArrow(encode, f"id {kind}, h1 long, h2 long, n int, code long")
    classes = coded.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("code").alias("code"))
    classes = written(classes.withColumn("num", F.monotonically_increasing_id()), "vectors")

    keys = F.transform(F.lit(table_masks.view(np.int64).tolist()), lambda m: F.col("code").bitwiseAND(m))
    entries = classes.select("num", "n", "code", F.posexplode(keys).alias("tab", "key"))
    entries = entries.select("num", "code", F.col("tab").cast("short").alias("tab"), F.xxhash64("tab", "key", "n").alias("bucket"))
    comparison = Comparison(table_masks, distance, threshold)
    dealt = buckets.grouped(buckets.deal(entries, BLOCK).select("group", "side", "tab", "num", "code"))
    near = written(dealt.mapInArrow(comparison.close, "group long, side byte, tab short, num long, code long"), "close")
    wanted = written(near.select("num").distinct().join(classes.select("num", "h1", "h2", "copies"), "num"), "wanted")
    small = F.broadcast(wanted) if wanted.count() <= few else wanted  # some 6 MB at most
    moved = good.select("h1", "h2", "x").join(small, ["h1", "h2"]).groupBy("num").agg(F.first("copies").alias("copies"), F.first("x").alias("x"))
    full = buckets.grouped(near.join(moved, "num").select("group", "side", "tab", "num", "code", "copies", "x"))
    found = written(full.mapInArrow(comparison, "num long, n long, root long"), "links")

    counts = found.groupBy("num").agg(F.sum("n").alias("linked"))
    parts = components(found.select(F.col("num").alias("u"), F.col("root").alias("v")))
    # a component is known by a number; its id is the smallest of its rows'
    known = classes.select("num", "h1", "h2", "copies", "least").join(counts, "num", "left").join(parts.withColumnRenamed("node", "num"), "num", "left")
    known = known.select("h1", "h2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "num").alias("component"), "least")
    known = written(known, "classes")
    # written first, so that the join reads exchanges on both sides and Spark can split a large component
    smallest = written(known.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    result = written(known.join(smallest, "component").select("h1", "h2", "n_links", "component_id"), "classes")
    return _named(good.select("id", "h1", "h2").join(result, ["h1", "h2"]).select("id", "n_links", "component_id").unionByName(nothing), id_col)


def _named(df: DataFrame, id_col: str) -> DataFrame:
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return df.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


class Comparison:
    """Compares the vectors of each group: by codes (``close``), or by their cosines."""

    def __init__(self, table_masks: np.ndarray, distance: int, threshold: float) -> None:
        self.masks, self.distance, self.threshold = table_masks, distance, threshold

    def candidates(self, rows: pa.Table, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs within the Hamming distance that share the table's key, and none of an earlier table."""
        code, tab, side = rows["code"].to_numpy().view(np.uint64), rows["tab"].to_numpy(), rows["side"].to_numpy()

        def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            x = code[i] ^ code[j]
            out = (np.bitwise_count(x) <= self.distance) & ((x & self.masks[tab[i]]) == 0)
            active = np.flatnonzero(out)
            for t in range(int(tab[i[active]].max()) if len(active) else 0):
                active = active[tab[i[active]] > t]
                shared = (x[active] & self.masks[t]) == 0
                out[active[shared]] = False
                active = active[~shared]
            return out

        return buckets.pairs(start, rows.num_rows, side, alike)

    def close(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a partner by codes."""
        for rows, start in buckets.complete(batches):
            used = np.unique(np.concatenate(self.candidates(rows, start)))
            if len(used):
                yield from rows.take(pa.array(used)).combine_chunks().to_batches()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in buckets.complete(batches, 1 << 12):
            i, j = self.candidates(rows, start)
            linked = np.zeros(len(i), bool)
            for own, x in by_length(rows["x"].combine_chunks()):
                x, place = unit(x), np.full(rows.num_rows, -1)
                place[own] = np.arange(len(own))
                mine = np.flatnonzero(place[i] >= 0)
                for at in range(0, len(mine), PAIRS):
                    part = mine[at : at + PAIRS]
                    linked[part] = np.einsum("ij,ij->i", x[place[i[part]]], x[place[j[part]]]) >= self.threshold
            i, j = i[linked], j[linked]
            if len(i):
                used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                p, q = place[: len(i)], place[len(i) :]
                copies = rows["copies"].to_numpy()[used]
                count = np.bincount(p, copies[q], len(used)) + np.bincount(q, copies[p], len(used))
                num = rows["num"].to_numpy()[used]
                yield pa.RecordBatch.from_arrays([pa.array(num), pa.array(count.astype(np.int64)), pa.array(num[buckets.spanning_roots(p, q, len(used))])], names=["num", "n", "root"])
