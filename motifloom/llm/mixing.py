"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source sends its documents in a keyed shuffled order, again and again up to ``max_epochs`` times.  The virtual
finish time of a sent document is the source's cumulative tokens divided by the source's target, so that a source with
target t has sent t tokens at time 1.  The sent documents of all sources, sorted by finish time, are taken until the
total budget is spent.  A document that would start after its source has reached its target is not sent; so a source
takes its target to within one document.

Null sources are a source of their own, after all others; null texts have size 0 and are never taken.  The shuffled
order is that of hashes of ids and texts, null ones included, so null and repeated ids are spread over it.  Rows equal in
both stand next to each other and are counted one by one; which of them is taken once more is open, the rows returned are
the same.  Where there are more than a slice of such rows they have hashes by number and are spread as well.  Equal
finish times are ordered by the source's number.  Very long texts are documents like others: a source takes its target to within one.  An empty table
gives no rows.  Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.shared import checkpoint, told_apart

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source's order that one task is to sum up.
ROWS_PER_SLICE = 1_000
#: Slices of a source whose sums one task adds up.
SLICES_PER_BLOCK = 10_000


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: dict | None = None, *, max_epochs: int = 3) -> tuple[DataFrame, int]:
    """For rows (source, docs, source_size): ``place``, ``weight``, ``target``; and the total budget.

    Sources are numbered by code point, null last; without ``weights`` they weigh 1, 2, 3, repeating.  A target stops
    at ``max_epochs`` times the source's size; the excess is shared again by weight until no target is above."""
    # a source's number is its rank; ranks are taken within slices of the sorted names, so no task sees all of them
    sliced = checkpoint(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("slice", F.spark_partition_id()))
    sizes = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    before = sizes.select("slice", (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("slice").orderBy(F.col("source").asc_nulls_last()))
    placed = sliced.join(F.broadcast(before), "slice").withColumn("place", (F.col("before") + rank - 1).cast("long")).drop("before", "slice")
    if weights is None:
        placed = placed.withColumn("weight", (F.col("place") % 3 + 1).cast("long"))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)))]
        placed = placed.withColumn("weight", F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(1)).cast("long"))
    placed = placed.withColumn("limit", max_epochs * F.col("source_size"))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        stopped = F.col("limit") <= F.col("weight") * F.lit(level)
        fixed, free = placed.agg(F.sum(F.when(stopped, F.col("limit")).otherwise(0)), F.sum(F.when(stopped, 0).otherwise(F.col("weight")))).first()
        if not free:
            level = math.inf
            break
        new = (total - fixed) / free
        if new <= level:
            break
        level = new
    share = F.col("weight") * F.lit(level)
    target = F.when(F.col("limit") <= share, F.col("limit").cast("double")).otherwise(share) if total else F.lit(0.0)
    return placed.withColumn("target", target), total


def mix(docs: DataFrame, weights: dict | None = None, *, seed: int = 17, max_epochs: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", with_row: bool = True, few: int = 10_000) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target``, ``copies`` (how often it is taken) and ``taken``.

    ``with_row``: the row itself is the struct ``row``; otherwise only its id is returned."""
    carried = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if with_row else [docs[id_col]]
    sized = docs.select(*carried, docs[source_col].alias("source"), words(docs[text_col]).alias("size"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[id_col].cast("string"), F.lit("-")), F.coalesce(F.md5(docs[text_col].cast("binary")), F.lit("-")))).alias("draw"))
    if not with_row:
        sized = checkpoint(sized)  # narrow; the texts are read and counted once
    sized = told_apart(sized, "draw", ROWS_PER_SLICE)
    slim = sized.select("source", "size", "draw")
    sources = slim.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    placed, total = targets(sources, weights, max_epochs=max_epochs)
    placed = checkpoint(placed.withColumn("slices", (F.col("docs") / ROWS_PER_SLICE + 1).cast("long")))
    small = placed.count() <= few  # names of so many sources fit into a broadcast
    hinted = F.broadcast(placed) if small else placed

    # cumulative tokens in a source's shuffled order: within slices of the order, plus the slices before
    span = 16**8
    slice_ = (F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(span)).cast("long")
    rows = sized.join(hinted, sized.source.eqNullSafe(placed.source)).drop(placed.source).withColumn("slice", slice_)
    by_slice = rows.groupBy("place", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = sums_before(by_slice)
    order = Window.partitionBy("place", "slice").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = rows.withColumn("within", F.sum("size").over(order)).join(earlier, ["place", "slice"]).withColumn("upto", F.col("earlier") + F.col("within"))
    upto = upto.select(*(["row"] if with_row else [id_col]), "place", "size", "source_size", "target", "upto")
    if not with_row:
        upto = checkpoint(upto)

    def finish(epoch: int) -> Column:
        return F.try_divide(F.lit(epoch) * F.col("source_size") + F.col("upto"), "target")

    sent = F.filter(F.array(*(F.struct(finish(e).alias("finish"), (F.lit(e) * F.col("source_size") + F.col("upto") - F.col("size") < F.col("target")).alias("sent")) for e in range(max_epochs))), lambda x: x["sent"])
    queue = upto.where("size > 0").select("place", "size", F.explode(sent).alias("x")).select("place", "size", F.col("x.finish").alias("finish"))
    ranged = checkpoint(queue.repartitionByRange("finish", "place").sortWithinPartitions("finish", "place").withColumn("part", F.spark_partition_id()))
    end_finish, end_place = cut(ranged, total)
    taken_at = lambda e: (finish(e) < F.lit(end_finish)) | ((finish(e) == F.lit(end_finish)) & (F.col("place") <= F.lit(end_place)))
    started = lambda e: F.lit(e) * F.col("source_size") + F.col("upto") - F.col("size") < F.col("target")
    copies = sum((F.when((F.col("size") > 0) & started(e) & taken_at(e), 1).otherwise(0) for e in range(max_epochs)), F.lit(0)).cast("int")
    out = upto.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*(["row"] if with_row else [id_col]), "size", "source_size", "target", "copies", "taken")


def sums_before(by_slice: DataFrame) -> DataFrame:
    """For (place, slice, slice_size) the sum of a place's earlier slices, as (place, slice, earlier): within blocks of
    slices, plus the blocks before, so that no task sees more than a block of slices or the blocks of a place."""
    sizes = by_slice.withColumn("block", F.floor(F.col("slice") / SLICES_PER_BLOCK))
    blocks = sizes.groupBy("place", "block").agg(F.sum("slice_size").alias("k"))
    blocks = blocks.select("place", "block", (F.sum("k").over(Window.partitionBy("place").orderBy("block")) - F.col("k")).alias("before"))
    own = F.sum("slice_size").over(Window.partitionBy("place", "block").orderBy("slice")) - F.col("slice_size")
    return sizes.withColumn("own", own).join(blocks, ["place", "block"]).select("place", "slice", (F.col("own") + F.col("before")).alias("earlier"))


def cut(ranged: DataFrame, total: int) -> tuple[float, int]:
    """(finish, place) of the last sent document within the budget, of rows range-sorted into parts."""
    parts = ranged.groupBy("part").agg(F.sum("size").alias("n"))
    running = F.sum("n").over(Window.orderBy("part"))  # one row for each part
    crossing = parts.withColumn("upto", running).where(F.col("upto") > total).orderBy("part").select("part", (F.col("upto") - F.col("n")).alias("before")).first()
    if crossing is None:
        return math.inf, 0
    own = ranged.where(F.col("part") == crossing["part"]).withColumn("upto", F.lit(crossing["before"]) + F.sum("size").over(Window.partitionBy("part").orderBy("finish", "place").rowsBetween(Window.unboundedPreceding, 0)))
    last = own.where(F.col("upto") <= total).agg(F.max(F.struct("finish", "place")).alias("x")).first()["x"]
    if last is None:
        before = ranged.where(F.col("part") < crossing["part"]).agg(F.max(F.struct("finish", "place")).alias("x")).first()["x"]
        last = before or {"finish": -math.inf, "place": 0}
    return last["finish"], last["place"]
