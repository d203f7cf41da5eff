"""Nearest neighbours by adaptive dimension scans of inverted lists.

Vectors are dealt into lists by their nearest centroid, and a query probes its nearest lists.  Within a list vectors are
rotated by a random orthogonal matrix and laid out in blocks of columns; the squared differences of the first j of D
rotated columns, times D / j, estimate a squared distance, so a candidate whose partial distance is too large for its
true one to be within the query's bound is abandoned by a test after each block.  Those that pass all blocks are
measured on the original vectors in double precision.  A query's own list is scanned first and gives the bound that its
other lists are scanned under.

Centroids are fitted on at most ``max(sample, 8 * lists)`` vectors, ``lists`` being at most ``max_lists``; every vector
is indexed.  How many lists are probed is learnt from the sample: enough to hold the share ``target`` of its vectors'
nearest ones.  The ``fitted`` most frequent lengths have lists; vectors of any other length are all scanned.  Lists are
scanned in blocks of at most about ``BLOCK`` vectors and ``QUERIES`` queries, so a list of any size is no large task.

Equal vectors are one, known by its smallest ids, so a vector of very many rows is scanned once.  Vectors that are null,
zero or hold null or non-finite components take no part, and vectors of different lengths have no distance.  Rows that
repeat an id are rows of their own; a null id is no query, and as a candidate it comes after equally near ones.  Queries
without candidates, and empty tables, give no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.embedding_dedup import by_length
from motifloom.llm.shared import written

BLOCK = 4096
QUERIES = 8192
COLUMNS = 16
FIRST = 64  # candidates that are scanned whole where a query has no bound yet
STEP = 1024
EVERYTHING = -1  # the list of vectors of lengths without centroids


def rotation(n: int, seed: int = 17) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng([seed, n]).standard_normal((n, n)))[0]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all of b."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        own = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first; equally near ones by number."""
    out = np.empty((len(x), k), np.int32)
    step = max(1, (1 << 22) // len(centres))
    for at in range(0, len(x), step):
        d = squared(x[at : at + step], centres)
        if k == 1:
            out[at : at + step, 0] = d.argmin(1)
        else:
            out[at : at + step] = np.argsort(d, 1, kind="stable")[:, :k]
    return out


class Lists:
    """Centroids of the vectors of one length and how many lists a query probes."""

    def __init__(self, x: np.ndarray, lists: int, target: float, neighbours: int, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        # a row's parts of centroids of centroids where there are many
        if lists <= 256:
            self.centres = k_means(x, min(lists, len(x)), rng)
        else:
            coarse = k_means(x, math.isqrt(lists), rng)
            own = nearest(x, coarse, 1)[:, 0]
            share = [math.ceil(lists * (own == i).mean()) for i in range(len(coarse))]
            self.centres = np.vstack([k_means(x[own == i], min(k, (own == i).sum()), rng) for i, k in enumerate(share) if k])
        asked = x[rng.permutation(len(x))[:256]]
        d = squared(asked, x)
        near = np.argsort(d, 1, kind="stable")[:, 1 : neighbours + 1]
        order = nearest(asked, self.centres, len(self.centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int32)[None], 1)
        needed = np.sort(np.take_along_axis(place, nearest(x, self.centres, 1)[:, 0][near], 1).ravel())
        self.probes = 1 + int(needed[min(len(needed) - 1, math.ceil(target * len(needed)))]) if len(needed) else 1


class Scan:
    """Scans blocks of lists for queries: rows come sorted by group, vectors before queries."""

    def __init__(self, neighbours: int, tolerance: float) -> None:
        self.k, self.tolerance = neighbours, tolerance

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, own = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (kind[1:] != kind[:-1])])).tolist()
            for s, e in zip(start, [*start[1:], batch.num_rows]):
                if g[s] != group:
                    group, held, own = g[s], [], None
                part = batch.slice(s, e - s)
                if not kind[s]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if own is None:
                    own = self.laid_out(held)
                for at in range(0, part.num_rows, 256):
                    yield from self.ask(part.slice(at, 256), *own)

    def laid_out(self, held: list[pa.RecordBatch]) -> tuple:
        rows = pa.Table.from_batches(held).combine_chunks()
        ((_, x),) = by_length(rows["x"].combine_chunks())
        return rows["num"].to_numpy(), rows["least"].to_numpy(zero_copy_only=False), x, self.blocks(x)

    def blocks(self, x: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            r = (x @ rotation(x.shape[1])).astype(np.float32)
        return [np.ascontiguousarray(r[:, i : i + COLUMNS]) for i in range(0, r.shape[1], COLUMNS)]

    def ask(self, queries: pa.RecordBatch, nums: np.ndarray, least: np.ndarray, x: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        asked = queries.column(2).to_numpy()
        ((_, q),) = by_length(pa.concat_arrays([queries.column(4)]))
        asked_columns = self.blocks(q)
        bound = queries.column(5).to_numpy(zero_copy_only=False).astype(float)
        bound = np.where(np.isnan(bound), np.inf, bound)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # query, candidate, distance
        at, step = 0, FIRST if np.isinf(bound).any() else STEP
        while at < len(nums):
            to = min(len(nums), at + step)
            i, j = self.passing(asked_columns, [c[at:to] for c in columns], bound, x.shape[1])
            j += at
            other = asked[i] != nums[j]
            i, j = i[other], j[other]
            d = measure(q[i] - x[j])
            i, j, d = (np.concatenate(pair) for pair in zip(best, (i, j, d)))
            order = np.lexsort((nums[j], least[j], d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            best = tuple(v[place < self.k] for v in (i, j, d))
            full = place == self.k - 1
            bound[i[full]] = np.minimum(bound[i[full]], d[full])
            at, step = to, STEP
        i, j, d = best
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(asked[i]), pa.array(nums[j]), pa.array(least[j], from_pandas=True).cast(pa.int64()), pa.array(d)], names=["asked", "num", "least", "d"])

    def passing(self, q: list[np.ndarray], x: list[np.ndarray], bound: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, candidate) that no test abandons, nor finds too large for a double."""
        partial = np.maximum(squared(q[0].astype(float), x[0].astype(float)), 0)
        i, j = np.nonzero(~(partial > self.limit(bound, COLUMNS, n)[:, None]))
        partial = partial[i, j]
        for b in range(1, len(q)):
            with np.errstate(over="ignore", invalid="ignore"):
                partial = partial + ((q[b][i] - x[b][j]) ** 2).sum(1)
            passed = ~(partial > self.limit(bound, (b + 1) * COLUMNS, n)[i])
            i, j, partial = i[passed], j[passed], partial[passed]
        return i, j

    def limit(self, bound: np.ndarray, seen: int, n: int) -> np.ndarray:
        """The largest squared difference of the first columns at which a candidate may still be within the bound:
        beyond it that has a probability which falls with ``tolerance``."""
        seen = min(seen, n)
        factor = 1 + (self.tolerance / math.sqrt(seen) if seen < n else 1e-4)
        return bound**2 * seen / n * factor**2 + 1e-9


def measure(differences: np.ndarray) -> np.ndarray:
    """Euclidean lengths, summed in the order of components; those whose squares leave the range of doubles are scaled."""
    if not len(differences):
        return np.empty(0)
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt(np.cumsum(differences**2, 1)[:, -1])
    odd = np.flatnonzero((out == 0) | np.isinf(out))
    top = np.abs(differences[odd]).max(1, keepdims=True)
    some = top[:, 0] > 0
    out[odd[some]] = top[some, 0] * np.sqrt(np.cumsum((differences[odd[some]] / top[some]) ** 2, 1)[:, -1])
    return out


def search(vectors: DataFrame, *, every: int = 100, neighbours: int = 10, target: float = 0.97, tolerance: float = 2.5, sample: int = 20_000, fitted: int = 8, max_lists: int = 1 << 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, ``id_col`` and score: the nearest rows found of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = rows.where(F.col("x").isNotNull() & ~bad & F.exists("x", lambda c: c != 0))
    numbers = F.transform("x", lambda c: c.cast("double") + 0.0)
    good = good.select("id", numbers.alias("x"), *(F.xxhash64(F.lit(i), numbers).alias(f"h{i}") for i in (1, 2)))
    # equal vectors are one class, known by its smallest ids: one more than neighbours, as a query is none of its own
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("id")))
    classes = good.withColumn("place", place).where(F.col("place") <= neighbours + 1)
    ids = F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id")))
    classes = classes.groupBy("h1", "h2").agg(F.first("x").alias("x"), ids.alias("ids"))
    classes = written(classes.withColumns({"num": F.monotonically_increasing_id(), "n": F.size("x"), "least": F.col("ids")[0]["id"]}), "classes")
    queries = good.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "h1", "h2")
    asking = classes.join(queries.select("h1", "h2").distinct(), ["h1", "h2"]).select("num", "n", "x")
    asking = written(asking, "asking")

    lengths = classes.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").limit(fitted).collect()
    fit = {}
    for r in lengths:
        k = min(max_lists, max(min(64, r["k"] // 32), r["k"] // 16_384, 1))
        some = max(sample, 8 * k)
        chosen = classes.where((F.col("n") == r["n"]) & (F.pmod("h1", F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, 1.5 * some / r["k"])))).orderBy("h1", "h2").limit(some)
        ((_, x),) = by_length(chosen.select("x").toArrow().column(0).combine_chunks())
        fit[r["n"]] = Lists(x, k, target, neighbours)
    known = spark.sparkContext.broadcast({n: (f.centres, f.probes) for n, f in fit.items()})

    def placed(all_lists: bool):
        """The nearest list of each vector, or all that it probes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [None] * batch.num_rows
                for own, x in by_length(pa.concat_arrays([batch.column(2)])):
                    centres, probes = known.value.get(x.shape[1], (None, 1))
                    found = np.full((len(own), 1), EVERYTHING) if centres is None else nearest(x, centres, probes if all_lists else 1)
                    for i, lists in zip(own.tolist(), found.tolist()):
                        out[i] = lists
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["num", "lists"])

        return run

    def lists_of(df: DataFrame, all_lists: bool) -> DataFrame:
        return df.select("num", "n", "x").mapInArrow(placed(all_lists), "num long, lists array<int>")

    index = written(lists_of(classes, False).select("num", F.col("lists")[0].alias("list")).join(classes.select("num", "n", "x", "least"), "num"), "index")
    sizes = written(index.groupBy("n", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "lists")
    probes = written(lists_of(asking, True).select("num", F.posexplode("lists").alias("place", "list")), "probes")

    def scanned(asked: DataFrame) -> DataFrame:
        """The best candidates of (num, n, x, list, bound) in each list."""
        shared = asked.groupBy("n", "list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
        deal = written(sizes.join(shared, ["n", "list"]), "deal")

        def of(column: str, salt: int):
            return F.pmod(F.xxhash64("num", F.lit(salt)), F.col(column))

        def every_one(column: str):
            return F.explode(F.sequence(F.lit(0), F.col(column) - 1))

        group = F.xxhash64("n", "list", F.col("part").cast("long"), F.col("share").cast("long")).alias("group")
        x = index.join(deal, ["n", "list"]).withColumn("part", of("parts", 3)).withColumn("share", every_one("shares"))
        q = asked.join(deal, ["n", "list"]).withColumn("share", of("shares", 5)).withColumn("part", every_one("parts"))
        x = x.select(group, F.lit(0).cast("byte").alias("kind"), "num", "least", "x", F.lit(None).cast("double").alias("bound"))
        q = q.select(group, F.lit(1).cast("byte").alias("kind"), "num", F.lit(None).cast("long").alias("least"), "x", "bound")
        dealt = x.unionByName(q).repartition("group").sortWithinPartitions("group", "kind")
        return dealt.mapInArrow(Scan(neighbours, tolerance), "asked long, num long, least long, d double")

    order = Window.partitionBy("asked").orderBy("d", F.asc_nulls_last("least"), "num")

    def best_of(df: DataFrame, name: str) -> DataFrame:
        return written(df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= neighbours).drop("place"), name)

    first = best_of(scanned(asking.join(probes.where("place = 0"), "num").withColumn("bound", F.lit(None).cast("double"))), "first")
    bounds = first.groupBy("asked").agg(F.when(F.count("*") == neighbours, F.max("d")).alias("bound"))
    later = asking.join(probes.where("place > 0"), "num").join(bounds, F.col("num") == F.col("asked"), "left").select("num", "n", "x", "list", "bound")
    best = best_of(first.unionByName(scanned(later)), "best")
    # queries whose lists hold fewer than they ask for are put to all lists
    short = best.groupBy("asked").agg(F.count("*").alias("k"))
    short = asking.join(short, F.col("num") == F.col("asked"), "left").where(F.coalesce("k", F.lit(0)) < neighbours).select("num", "n", "x")
    short = written(short, "short")
    if short.limit(1).count():
        again = scanned(short.join(sizes.select("n", "list"), "n").withColumn("bound", F.lit(None).cast("double")))
        best = best_of(best.join(short.select(F.col("num").alias("asked")), "asked", "left_anti").unionByName(again), "all")

    # a class as a query: the ids of its own others and of those found, nearest first
    near = best.join(classes.select("num", "ids"), "num").groupBy("asked").agg(F.collect_list(F.struct("d", "ids")).alias("found"))
    own = asking.select("num").join(classes.select("num", "h1", "h2", "ids"), "num").join(near, F.col("num") == F.col("asked"), "left")
    found = F.concat(F.array(F.struct(F.lit(0.0).alias("d"), "ids")), F.coalesce("found", F.expr("cast(array() AS array<struct<d: double, ids: array<struct<none: boolean, id: bigint>>>>)")))
    flat = F.flatten(F.transform(found, lambda r: F.transform(r["ids"], lambda i: F.struct(r["d"].alias("d"), i["none"].alias("none"), i["id"].alias("id")))))
    answers = written(own.select("h1", "h2", F.array_sort(flat).alias("near")), "answers")
    self_ = F.array_position("near", F.struct(F.lit(0.0).alias("d"), F.lit(False).alias("none"), F.col("query_id").alias("id"))).cast("int")
    others = F.expr("IF(self > 0, concat(slice(near, 1, self - 1), slice(near, self + 1, size(near))), near)")
    out = queries.join(answers, ["h1", "h2"]).withColumn("self", self_).withColumn("others", F.slice(others, 1, neighbours))
    out = out.select("query_id", F.posexplode("others").alias("at", "one"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.id").alias(id_col), F.col("one.d").alias("score"))
