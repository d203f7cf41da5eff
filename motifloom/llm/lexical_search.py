"""Ranked lexical search by simultaneous traversal of inverted treaps.

Documents are read in shards of about ``shard`` rows.  In a shard every term of the queries has a treap of its postings: a
search tree over the documents in the order of their ids, and a heap over the impacts, which are the exact integers that
the postings add to a score.  A query walks the treaps of its terms together.  A range of ids is known by the root of
each treap within it; the sum of these roots' impacts bounds every score of the range, so a range whose bound cannot
enter the query's best ``k`` is left out whole.  Otherwise the document of the root of largest impact is scored and the
treaps are split at it into the ranges before and after.  Many ranges of many queries advance together as NumPy rows.
The best of a task's shards are carried from shard to shard, and those of all tasks are merged.

Queries are taken in blocks of about ``block`` rows, which with their terms are all that is broadcast.  Terms are
lower-cased from A to Z only.  Null texts, of documents and of queries, have no terms: such documents are in no result
and such queries have none.  Rows that repeat id and text are one query, and rows of one id and other texts are queries
of their own.  Repeated documents each count and are each returned.  Null ids come last among equal scores.  Very long
texts are read whole; empty tables give no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.shared import written

SHARD = 4096
ITEMS = 1 << 16  # roots of ranges that advance together
NULL_ID = np.iinfo(np.int64).max
SLICE = 256

_LOWERED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(128)).lower() + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII."""
    return text.translate(_LOWERED).split()


class Postings:
    """The length of each document that has terms, and the query terms it holds with their numbers."""

    def __init__(self, numbers) -> None:
        self.numbers = numbers

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = self.numbers.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, lengths, terms, counts = [], [], [], []
                for i, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    words = terms_of(text) if text else []
                    if words:
                        found = [(known[t], k) for t, k in Counter(words).items() if t in known]
                        rows.append(i)
                        lengths.append(len(words))
                        terms.append([t for t, _ in found])
                        counts.append([k for _, k in found])
                ids = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "length", "terms", "counts"])


class Treaps:
    """The treaps of a shard: nodes are its postings, sorted by term and document."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, terms: int) -> None:
        order = np.lexsort((doc, term))
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        start = np.searchsorted(term, np.arange(terms + 1))
        # equal impacts are ordered by a hash, so that runs of them make no chains
        keys = (self.impact * 65_536 + (self.doc * 40_503 + 12_345) % 65_536).tolist()
        left, right, self.root = [-1] * len(keys), [-1] * len(keys), np.full(terms, -1)
        for t in np.flatnonzero(start[1:] > start[:-1]).tolist():
            spine: list[int] = []
            for i in range(start[t], start[t + 1]):
                last, key = -1, keys[i]
                while spine and keys[spine[-1]] < key:
                    last = spine.pop()
                left[i] = last
                if spine:
                    right[spine[-1]] = i
                spine.append(i)
            self.root[t] = spine[0]
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def split(self, node: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For roots of ranges (low, high) those of (low, pivot) and (pivot, high), -1 where these hold nothing, and
        the impact at the pivot."""
        before, after, own = np.full(len(node), -1), np.full(len(node), -1), np.zeros(len(node), np.int64)
        at, cur = np.arange(len(node)), node
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            d, p = self.doc[cur], pivot[at]
            less, more = d < p, d > p
            new = less & (d > low[at]) & (before[at] < 0)
            before[at[new]] = cur[new]
            new = more & (d < high[at]) & (after[at] < 0)
            after[at[new]] = cur[new]
            hit = ~(less | more)
            if hit.any():
                own[at[hit]] = self.impact[cur[hit]]
                ends.append((at[hit], cur[hit]))
            cur = np.where(less, self.right[cur], np.where(more, self.left[cur], -1))
            go = cur >= 0
            at, cur = at[go], cur[go]
        if ends:
            at, cur = (np.concatenate(x) for x in zip(*ends))
            self.within(before, at[before[at] < 0], self.left[cur[before[at] < 0]], low, self.right, np.less_equal)
            self.within(after, at[after[at] < 0], self.right[cur[after[at] < 0]], high, self.left, np.greater_equal)
        return before, after, own

    def within(self, out: np.ndarray, at: np.ndarray, cur: np.ndarray, border: np.ndarray, inwards: np.ndarray, beyond) -> None:
        """Follows nodes that lie beyond a border of their range until they lie within."""
        while len(at):
            go = cur >= 0
            at, cur = at[go], cur[go]
            outside = beyond(self.doc[cur], border[at])
            out[at[~outside]] = cur[~outside]
            at, cur = at[outside], inwards[cur[outside]]


class Best:
    """The best k documents of each query so far: higher scores first, equal ones by id."""

    def __init__(self, queries: int, k: int) -> None:
        self.score, self.id = np.zeros((queries, k), np.int64), np.full((queries, k), NULL_ID)

    def may_enter(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> np.ndarray:
        last = self.score[query, -1]
        return (score > last) | ((score == last) & (score > 0) & (id_ <= self.id[query, -1]))

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        new = self.may_enter(query, score, id_) & (score > 0)
        if not new.any():
            return
        query, score, id_ = query[new], score[new], id_[new]
        touched = np.unique(query)
        k = self.score.shape[1]
        query = np.concatenate([np.repeat(touched, k), query])
        score, id_ = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), id_])
        order = np.lexsort((id_, -score, query))
        query, score, id_ = query[order], score[order], id_[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < k
        self.score[query[kept], place[kept]], self.id[query[kept], place[kept]] = score[kept], id_[kept]


class Search:
    """Traverses the treaps of each shard for all queries of a block."""

    def __init__(self, plan, k: int, shard: int = SHARD) -> None:
        self.plan, self.k, self.rows = plan, k, shard

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = self.plan.value[1]
        best, held, size = Best(len(queries), self.k), [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, self.rows):
                part = batch.slice(at, self.rows)
                held.append(part)
                size += part.num_rows
                if size >= self.rows:
                    self.shard(held, best)
                    held, size = [], 0
        if held:
            self.shard(held, best)
        q, place = np.nonzero(best.score)
        ids = best.id[q, place]
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, mask=ids == NULL_ID), pa.array(best.score[q, place])], names=["query", "doc_id", "score"])

    def shard(self, held: list[pa.RecordBatch], best: Best) -> None:
        weights, queries, total, length = self.plan.value
        rows = pa.Table.from_batches(held).combine_chunks()
        ids = rows["doc_id"].fill_null(int(NULL_ID)).to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        terms, counts = (rows[c].combine_chunks() for c in ("terms", "counts"))
        own = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
        term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
        m = 10 + (90 * rows["length"].to_numpy() * total) // length
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[own]))
        some = impact > 0
        treaps = Treaps(term[some], place[own[some]], impact[some], len(weights))
        self.traverse(treaps, queries, ids[order], best)

    def traverse(self, treaps: Treaps, queries: list[np.ndarray], ids: np.ndarray, best: Best) -> None:
        node = treaps.root[np.concatenate(queries)] if queries else np.empty(0, np.int64)
        of = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        of, node = of[node >= 0], node[node >= 0]
        n = len(queries)
        stack = [(np.arange(n), np.full(n, -1), np.full(n, len(ids)), of, node)]  # query, low, high; range of a root, root
        while stack:
            query, low, high, of, node = stack.pop()
            if not len(node):
                continue
            # ranges that hold nothing go; the others' roots lie together
            start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            query, low, high = query[of[start]], low[of[start]], high[of[start]]
            size = np.diff(np.append(start, len(of)))
            impact = treaps.impact[node]
            kept = best.may_enter(query, np.add.reduceat(impact, start), ids[low + 1])
            if not kept.any():
                continue
            query, low, high, size, own = query[kept], low[kept], high[kept], size[kept], np.repeat(kept, size)
            node, impact = node[own], impact[own]
            of, start = np.repeat(np.arange(len(size)), size), np.concatenate([[0], np.cumsum(size)[:-1]])
            if len(node) > ITEMS and len(size) > 1:
                half = len(size) // 2
                cut = start[half]
                stack.append((query[half:], low[half:], high[half:], of[cut:] - half, node[cut:]))
                stack.append((query[:half], low[:half], high[:half], of[:cut], node[:cut]))
                continue
            top = np.flatnonzero(impact == np.maximum.reduceat(impact, start)[of])
            top = top[np.concatenate([[True], of[top[1:]] != of[top[:-1]]])]
            pivot = treaps.doc[node[top]]
            before, after, at_pivot = treaps.split(node, pivot[of], low[of], high[of])
            best.add(query, np.add.reduceat(at_pivot, start), ids[pivot])
            b, a = before >= 0, after >= 0
            n = len(size)
            stack.append((np.concatenate([query, query]), np.concatenate([low, pivot]), np.concatenate([pivot, high]), np.concatenate([of[b], of[a] + n]), np.concatenate([before[b], after[a]])))


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, block: int = 1000, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_col``, rank, ``id_col`` and score: the k best documents of each item."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    asked = items.select(items[item_col].alias("item_id"), items[item_text_col].alias("text")).where("text IS NOT NULL").distinct()
    asked = written(asked, "items")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    blocks = max(1, math.ceil(asked.count() / block))
    kind = items.schema[item_col].dataType.simpleString()
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about ``block`` rows
        numbers: dict[bytes, int] = {}
        queries = [np.array(sorted({numbers.setdefault(t, len(numbers)) for t in terms_of(r["text"].encode())}), np.int64) for r in own]
        postings = texts.mapInArrow(Postings(sc.broadcast(numbers)), "doc_id long, length long, terms array<int>, counts array<long>")
        postings = written(postings, "postings")
        total, length = postings.agg(F.count("*"), F.sum("length")).first()
        found = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"query long, item_id {kind}")
        if total:
            df = F.count("*")
            weight = F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * df + 1))).cast("long")
            weights = np.zeros(len(numbers), np.int64)
            for t, w in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(weight.alias("w")).collect():
                weights[t] = w
            plan = sc.broadcast((weights, queries, total, length))
            best = postings.mapInArrow(Search(plan, k, shard), "query long, doc_id long, score long")
            order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            best = best.join(F.broadcast(found), "query").select("item_id", "rank", "doc_id", "score")
        else:
            best = found.limit(0).select("item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
        out = best if out is None else out.unionByName(best)
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
