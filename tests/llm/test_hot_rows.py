"""Rows without ids, of one id, and equal in id and text: spread over slices, with the same results as ever."""

import collections

import pytest
from pyspark.sql import functions as F

from motifloom.llm import mixing, sharding, shared

N = 20_000


def hot(spark, kind):
    ids = {"null ids": F.lit(None).cast("long"), "one id": F.lit(7).cast("long"), "equal rows": F.lit(7).cast("long"), "nothing": F.lit(None).cast("long")}[kind]
    text = {"equal rows": F.lit("two words"), "nothing": F.lit(None).cast("string")}.get(kind, F.concat(F.lit("word "), F.col("id").cast("string")))
    few = spark.range(300).select((F.col("id") + 100).alias("doc_id"), F.lit("a few more").alias("text"), F.lit("b").alias("source"))
    return spark.range(N).select(ids.alias("doc_id"), text.alias("text"), F.lit("a").alias("source")).unionByName(few)


@pytest.mark.parametrize("kind", ["null ids", "one id", "equal rows", "nothing"])
def test_no_slice_of_the_mixture_holds_many_rows(spark, monkeypatch, kind):
    sizes = []
    before = mixing.sums_before

    def spy(by_slice):
        sizes.append(by_slice)
        return before(by_slice)

    monkeypatch.setattr(mixing, "sums_before", spy)
    docs = hot(spark, kind)
    one = sorted(map(str, mixing.mix(docs.repartition(3), with_row=False).collect()))
    again = sorted(map(str, mixing.mix(docs.repartition(7), with_row=False).collect()))
    assert one == again and len(one) == N + 300
    if kind != "nothing":  # two words each
        assert max(r["slice_size"] for r in sizes[0].collect()) < 2 * 2 * mixing.ROWS_PER_SLICE
    assert len({r["row"]["text"] for r in mixing.mix(docs).where("copies > 0").collect()}) > (1 if kind in ("null ids", "one id") else 0)


@pytest.mark.parametrize("kind", ["null ids", "equal rows", "nothing"])
def test_shards_of_hot_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(sharding, "ROWS_PER_SLICE", 500)
    largest = []
    number = sharding._number

    def spy(placed, n_shards, total, id_col):
        keys = placed.groupBy("row").count().agg(F.max("count")).first()[0]
        largest.append(keys)
        return number(placed, n_shards, total, id_col)

    monkeypatch.setattr(sharding, "_number", spy)
    docs = hot(spark, kind)
    rows = sharding.shard(docs.repartition(5), 8, max_rounds=4).collect()
    counts = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == N + 300 and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert largest[0] <= 500
    assert all(r["linked"] == (kind == "equal rows" or r["doc_id"] is not None) for r in rows)


def test_keys_told_apart(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, "x").when(F.col("id") < 3900, "y").otherwise(F.col("id").cast("string")).alias("key"), (F.col("id") % 3).alias("own"))
    found = [shared.told_apart(rows.repartition(n), "key", 1000) for n in (2, 9)]
    keys = [sorted(r["key"] for r in f.collect()) for f in found]
    assert keys[0] == keys[1] and len(keys[0]) == 5000
    counts = collections.Counter(keys[0])
    assert counts.pop("y") == 900 and set(counts.values()) == {1} and "x" not in counts
    assert found[0].columns == ["key", "own"] and shared.told_apart(rows, "key", 5000) is rows
