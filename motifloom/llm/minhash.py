"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the weighted set of its runs of five words, weights being counts.  Hashed darts fall on the plane of
every element, one in a unit cell on average; those within an element's weight and below a rank that depends on the
document's total weight hit the document.  A dart's hash names a coordinate; each coordinate keeps its dart of lowest
rank, and documents of weighted Jaccard similarity s share it with probability s.  Coordinates still empty look at the
next ranks.  The work grows with the words and k log k, not with their product.

Of every coordinate a byte is kept.  Texts whose bytes agree in a band of coordinates share a bucket.  Members of a
bucket are first compared by all their bytes: those with a partner whose estimated similarity is at most five deviations
below the threshold go on, and only their shingles move, for an exact comparison.  A pair that shares several bands is
compared in the first of them.  Large buckets are compared in pairs of blocks of ``BLOCK`` texts, each a group of its
own (``buckets``).  Collisions of bands are not followed from bucket to bucket, so chains of them cost no more than their
own pairs.  Groups return links that span what they connect; classes are the components of these links.

Equal texts are one text to start with.  Texts of fewer than five words have one shingle of all their words; texts
without words are like only their equals; null texts are like nothing.  Rows that repeat id and text get the same
result.  Null ids count as larger than all others; of texts with equal ids that of the smallest hash stands for a class.
Very long texts are compared whole.  An empty table gives no rows.  Other columns are not read by ``near_duplicates``
and carried along by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm import buckets
from motifloom.llm.graph import components
from motifloom.llm.shared import checkpoint, written

WORDS = 5
BANDS, ROWS = 32, 6
BLOCK = 512  # documents
PAIRS = 1 << 14  # signatures of so many pairs are compared at a time
CHUNK = 450_000  # characters hashed at a time, where a document counts as PER_DOCUMENT more for its darts
PER_DOCUMENT = 4_000

#: Poisson(1): cumulative probabilities of 0, 1, 2, ... darts in a cell.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) * 2.0**-53


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of all runs of words, sorted by document."""
    code: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = []
    for t in texts:
        own = t.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
        sizes.append(len(own))
        ids += [code.setdefault(w, len(code)) for w in own]
    n = np.array(sizes)
    of_word = np.array([xxhash.xxh64_intdigest(w) for w in code], np.uint64)
    h = of_word[np.array(ids, np.int64)] if ids else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    s = np.zeros(len(h), np.uint64)
    for k in range(WORDS):  # short texts stop at their last word
        inside = place + k < n[doc]
        step = s[inside] * np.uint64(0x9E3779B97F4A7C15) + h[np.flatnonzero(inside) + k]
        s[inside] = mix(step)
    starts = (place + WORDS <= n[doc]) | (place == 0)
    doc, s = doc[starts], s[starts]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], s[at], np.diff(np.append(at, len(s)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """DartMinHash signatures of n weighted sets, and which of them are not empty."""
    sig, full = np.zeros((n, k), np.uint64), np.zeros((n, k), bool)
    total = np.bincount(doc, weight, n)
    reach = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300)  # ranks looked at in a turn
    live, turn = total > 0, 0
    while live.any():
        use = np.flatnonzero(live[doc])
        low, high = reach[doc[use]] * turn, reach[doc[use]] * (turn + 1)
        first = np.floor(low).astype(np.int64)
        ranks = np.ceil(high).astype(np.int64) - first
        layers = np.ceil(weight[use]).astype(np.int64)
        cells = ranks * layers
        of = np.repeat(np.arange(len(use)), cells)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        layer, rank = inner // ranks[of], inner % ranks[of] + first[of]
        seed = mix(element[use][of] + np.uint64(0x9E3779B97F4A7C15) * (layer.astype(np.uint64) * np.uint64(0x10001) + np.uint64(1)) + mix(rank.astype(np.uint64) + np.uint64(77)))
        darts = np.searchsorted(POISSON, unit(mix(seed + np.uint64(1))))
        cell = np.repeat(np.arange(len(of)), darts)
        nth = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(seed[cell] + np.uint64(0xD1342543DE82EF95) * (nth.astype(np.uint64) + np.uint64(2)))
        of = of[cell]
        depth = rank[cell] + unit(mix(dart + np.uint64(3)))
        height = layer[cell] + unit(mix(dart + np.uint64(5)))
        hit = (height < weight[use][of]) & (depth >= low[of]) & (depth < high[of])
        dart, depth, owner = dart[hit], depth[hit], doc[use][of[hit]]
        slot = owner * k + (mix(dart + np.uint64(7)) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-depth, kind="stable")  # the last write is that of lowest rank
        order = order[~full.ravel()[slot[order]]]
        sig.ravel()[slot[order]] = dart[order]
        full.ravel()[slot[order]] = True
        live &= ~full.all(1)
        turn += 1
    return sig, total > 0


def chunks(texts: list[str]) -> Iterator[slice]:
    """Ranges of texts of about ``CHUNK`` characters, or of a bounded number of documents."""
    start = size = 0
    for i, t in enumerate(texts):
        if size > CHUNK:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + PER_DOCUMENT
    if start < len(texts):
        yield slice(start, len(texts))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for part in chunks(texts):
            doc, s, count = shingles(texts[part])
            n = part.stop - part.start
            sig, some = signatures(doc, s, count.astype(float), n, BANDS * ROWS)
            sigs = [x.tobytes() if k else None for x, k in zip(sig.astype(np.uint8), some)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), batch.column(1).slice(part.start, n), pa.array(sigs, pa.binary())], names=["id", "name", "sig"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of each text, those of count c as c elements, sorted."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for part in chunks(texts):
            doc, s, count = shingles(texts[part])
            n = part.stop - part.start
            copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            elements = np.where(copy == 0, np.repeat(s, count), mix(np.repeat(s, count) + copy.astype(np.uint64)))
            ends = np.cumsum(np.bincount(np.repeat(doc, count), minlength=n))
            sets = [np.sort(x).tobytes() for x in np.split(elements, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), pa.array(sets, pa.binary())], names=["num", "set"])


class Comparison:
    """Compares the texts of each group: by signatures (``close``), or by their shingles."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold
        self.cut = threshold - 5 * math.sqrt(threshold * (1 - threshold) / (BANDS * ROWS))

    def candidates(self, rows: pa.Table, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose estimated similarity is not below the cut and that share the group's band, and none before."""
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        band, side = rows["band"].to_numpy(), rows["side"].to_numpy()

        def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.zeros(len(i), bool)
            for at in range(0, len(i), PAIRS):
                p, q = i[at : at + PAIRS], j[at : at + PAIRS]
                same = sig[p] == sig[q]
                near = np.flatnonzero(same.sum(1) >= self.cut * sig.shape[1])
                shared = same[near].reshape(-1, BANDS, ROWS).all(2)
                out[at + near[shared.any(1) & (shared.argmax(1) == band[p[near]])]] = True
            return out

        return buckets.pairs(start, rows.num_rows, side, alike)

    def close(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a partner by signatures."""
        for rows, start in buckets.complete(batches, 1 << 13):
            used = np.unique(np.concatenate(self.candidates(rows, start)))
            if len(used):
                yield from rows.take(pa.array(used)).combine_chunks().to_batches()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in buckets.complete(batches, 1 << 9):
            i, j = self.candidates(rows, start)
            linked = alike(rows["set"], i, j, self.threshold)
            if linked.any():
                used, place = np.unique(np.concatenate([i[linked], j[linked]]), return_inverse=True)
                root = buckets.spanning_roots(*np.split(place, 2), len(used))
                num = rows["num"].to_numpy()[used]
                tied = root != np.arange(len(used))
                yield pa.RecordBatch.from_arrays([pa.array(num[tied]), pa.array(num[root[tied]])], names=["u", "v"])


def alike(sets: pa.ChunkedArray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sorted sets of 64-bit numbers have a similarity of at least the threshold."""
    out = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    own = {k: np.frombuffer(sets[k].as_buffer(), np.uint64) for k in np.unique(np.concatenate([i, j])).tolist()}
    for part in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(i) else []:
        one, others = own[int(i[part[0]])], [own[k] for k in j[part].tolist()]
        sizes = np.array([len(x) for x in others])
        flat = np.concatenate(others)  # of a group's texts at most
        at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
        both = np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        out[part] = both >= threshold * (len(one) + sizes - both) - 1e-9
    return out


def classes(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", few: int = 200_000) -> DataFrame:
    """(id, name, class_id, kept) of every row; ``name`` is the MD5 of the text, ``class_id`` the smallest id of its
    class, ``kept`` whether the row stands for its class."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("id"), F.md5(docs[text_col].cast("binary")).alias("name"), docs[text_col].alias("text"))
    signed = texts.where("name is not null").mapInArrow(_sign, f"id {kind}, name string, sig binary")
    # equal texts are one, known by a number
    reps = signed.groupBy("name").agg(F.min("id").alias("least"), F.first("sig").alias("sig"))
    reps = written(reps.withColumn("num", F.monotonically_increasing_id()), "signatures")

    signatures_ = reps.where("sig is not null").select("num", "sig")
    parts = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substr("sig", b * ROWS + 1, F.lit(ROWS))))
    entries = signatures_.select("num", F.posexplode(parts).alias("band", "bucket"))
    entries = entries.select("num", F.col("band").cast("byte").alias("band"), "bucket")
    dealt = buckets.deal(entries, BLOCK, sparse=True).join(signatures_, "num")
    comparison = Comparison(threshold)
    columns = ("group", "side", "band", "num", "sig")
    near = written(buckets.grouped(dealt.select(*columns)).mapInArrow(comparison.close, "group long, side byte, band byte, num long, sig binary"), "close")

    wanted = written(near.select("num").distinct().join(reps, "num").select("num", F.col("name").alias("member"), "least"), "wanted")
    small = F.broadcast(wanted) if wanted.count() <= few else wanted  # some 20 MB at most
    own = texts.join(small, (F.col("name") == F.col("member")) & F.col("id").eqNullSafe(F.col("least")))
    sets = own.select("num", "text").mapInArrow(_gather, "num long, set binary").groupBy("num").agg(F.first("set").alias("set"))
    full = buckets.grouped(near.join(sets, "num").select(*columns, "set"))
    links = written(full.mapInArrow(comparison, "u long, v long"), "links")

    found = components(links)
    known = reps.select("name", "least", "num").join(found.withColumnRenamed("node", "num"), "num")
    first = known.groupBy("component").agg(F.min("least").alias("class_id"), F.min(F.struct(F.col("least").isNull(), "least", "name")).alias("x")).select("component", "class_id", F.col("x.name").alias("keeper"))
    first = written(first, "classes")  # so that the join reads exchanges on both sides, and Spark can split a large class
    linked = known.join(first, "component").select("name", "class_id", "keeper")
    every = reps.select("name", "least").join(linked, "name", "left").select("name", "least", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("keeper", "name").alias("keeper"))
    every = written(every, "texts")
    out = texts.select("id", "name").where("name is not null").join(every, "name")
    kept = (F.col("name") == F.col("keeper")) & F.col("id").eqNullSafe(F.col("least"))
    return out.select("id", "name", "class_id", kept.alias("kept")).unionByName(texts.where("name is null").select("id", "name", F.col("id").alias("class_id"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``id_col``, ``class_id`` and ``kept`` of every row."""
    found = classes(docs, id_col=id_col, **options)
    return found.select(F.col("id").alias(id_col), "class_id", "kept")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", few: int = 2_000_000, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one for each; null texts stay, each on its own."""
    found = checkpoint(classes(docs, id_col=id_col, text_col=text_col, **options).where("not kept").select("id", "name"))
    # most rows are kept, so what goes is the smaller side: ids and hashes, 60 bytes a row
    gone = found.distinct().withColumnRenamed("id", "gone id").withColumnRenamed("name", "gone name")
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.md5(docs[text_col].cast("binary")).alias("name"), docs[id_col].alias("id"))
    on = (F.col("name") == F.col("gone name")) & F.col("id").eqNullSafe(F.col("gone id"))
    rest = named.join(F.broadcast(gone) if found.count() * 60 <= few else gone, on, "left_anti")
    # rows that repeat both id and text are one; texts move for that only where there are such rows
    again = named.where("name is not null").groupBy("id", "name").count().where("count > 1").limit(1).count()
    if again:
        rest = rest.where("name is not null").dropDuplicates(["id", "name"]).unionByName(rest.where("name is null"))
    return rest.select("row.*")
