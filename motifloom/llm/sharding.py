"""Sharding by balanced label propagation.

Documents are linked when their texts are equal.  Labels are shards: every row starts in the shard that its hash names
and moves, round after round, to the shard in which most of its neighbours are.  A shard admits no more linked rows in
a round than its quota leaves; a group larger than a shard fills one after the other.  As the neighbours of a row are
the other rows of its group, labels are kept as counts by group and shard, so a round joins small tables, and no links
are ever listed.  After the last round rows take the labels of their group in order, and unlinked rows, then linked
ones, leave shards that are too full; the counts of the shards end at most one apart (law ``rows``).

Null texts are linked with nothing and have no bytes; empty texts are equal texts.  Identical rows are linked rows and
take different slots, in any order; more of them than a slice holds are told apart by numbers first, as are rows without
id and text.  An empty table gives no rows.  Shards that hold equally many rows of a group are
told apart by a hash.  Very long texts are rows like others: counts are balanced, not bytes.  Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.shared import checkpoint, told_apart

#: Rows that one task is to number.
ROWS_PER_SLICE = 20_000
OVERHEAD = 16


def _of(values: list, shard: str) -> Column:
    """The value of a shard."""
    return F.lit(values)[F.col(shard)]


def _unit(column: Column, salt: str = "") -> Column:
    """A number in [0, 1) from a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), column)), 1, 8), 16, 10).cast("double") / F.lit(16.0**8)


def propagate(counts: DataFrame, n_shards: int, cap: int, max_rounds: int) -> DataFrame:
    """Moves linked rows, given as (group, shard, n), for at most ``max_rounds`` rounds; nothing lies above ``cap``
    but for chance."""
    state, joined = checkpoint(counts), 0.0
    for step in range(max_rounds):
        full = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # n_shards rows
        room = [max(0, cap - full.get(s, 0)) for s in range(n_shards)]
        salt = F.lit(f"{step}:")
        open_ = state.where(_of(room, "shard") > 0)
        # a group's label: of its shards with room the one with most of its rows
        best = open_.groupBy("group").agg(F.max(F.struct(F.col("n"), _unit(F.concat_ws(":", "group", "shard")).alias("u"), F.col("shard"))).alias("x"), F.sum("n").alias("open")).select("group", F.col("x.shard").alias("label"), F.col("x.n").alias("most"), "open")
        # its other rows want to go there, but for those in shards, now full, that hold more of the group
        wish = checkpoint(state.join(best, "group").where("shard <> label and n <= most"))
        asked = {r["label"]: r["n"] for r in wish.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        if not asked:
            break
        for r in wish.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            room[r["shard"]] += r["n"] // 2  # half of what wants to leave makes way
        part = _of([min(1.0, room[s] / asked[s]) if s in asked else 0.0 for s in range(n_shards)], "label")
        some = F.floor(F.col("n") * part + _unit(F.concat(salt, F.concat_ws(":", "group", "shard"))))
        moved = F.when(part >= 1, F.col("n")).when(F.col("open") * 8 >= _of(room, "label"), some).when(_unit(F.concat(salt, "group")) < part, F.col("n")).otherwise(0).cast("long")
        moves = wish.withColumn("moved", moved).where("moved > 0")
        new = state.unionByName(moves.select("group", "shard", (-F.col("moved")).alias("n"))).unionByName(moves.select("group", F.col("label").alias("shard"), F.col("moved").alias("n")))
        state = checkpoint(new.groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        together = state.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0]
        if together <= joined:
            break
        joined = together
    return state


def shard(docs: DataFrame, n_shards: int = 40, *, max_rounds: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of every row, and
    ``linked``: whether its text occurs again."""
    text = docs[text_col]
    group = F.md5(text.cast("binary"))
    row = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[id_col].cast("string"), F.lit("-")), F.coalesce(group, F.lit("-"))))
    rows = docs.select(
        docs[id_col],
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        group.alias("text"),
        row.alias("row"),
    )
    rows = told_apart(checkpoint(rows), "row", ROWS_PER_SLICE)
    rows = rows.withColumn("group", F.coalesce("text", F.concat(F.lit("null:"), F.col("row")))).drop("text")
    rows = rows.withColumn("start", F.floor(_unit(F.col("row")) * n_shards).cast("int"))
    total = rows.count()
    cap = -(-total // n_shards)
    by_start = rows.where("group not like 'null:%'").groupBy("group", F.col("start").alias("shard")).agg(F.count("*").alias("n"))
    linked = by_start.groupBy("group").agg(F.sum("n").alias("m")).where("m > 1")
    state = propagate(by_start.join(linked.select("group"), "group"), n_shards, cap, max_rounds)

    # rows of a group take its labels in order: numbers within slices of the group, after the slices before
    labels = state.groupBy("group").agg(F.sum("n").alias("m"), F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("parts"))  # at most n_shards entries
    # written first, so that the join below reads both sides from exchanges and Spark can split a group's rows
    ginfo = checkpoint(labels.select("group", "m", "parts", (F.col("m") / ROWS_PER_SLICE + 1).cast("int").alias("slices")))
    known = rows.join(ginfo, "group", "left")
    known = known.withColumn("slice", F.floor(_unit(F.col("row"), "s:") * F.coalesce(F.col("slices"), F.lit(1))).cast("int"))
    several = checkpoint(known.where("m is not null"))
    sliced = several.groupBy("group", "slice").agg(F.count("*").alias("k"))
    before = sliced.select("group", "slice", (F.sum("k").over(Window.partitionBy("group").orderBy("slice")) - F.col("k")).alias("before"))
    number = F.row_number().over(Window.partitionBy("group", "slice").orderBy("row")) - 1
    numbered = several.withColumn("number", number).join(before, ["group", "slice"]).withColumn("number", F.col("number") + F.col("before"))
    upto = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("shard")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["shard"].isNull() & (F.col("number") < a["seen"] + x["n"]), x["shard"]).otherwise(a["shard"]).alias("shard")))["shard"]
    columns = [id_col, "size", "text_crc32", "group", "row"]
    placed = numbered.select(*columns, upto.alias("shard"), "m").unionByName(known.where("m is null").select(*columns, F.col("start").alias("shard"), "m"))
    return _number(checkpoint(placed), n_shards, total, id_col)


def _number(placed: DataFrame, n_shards: int, total: int, id_col: str) -> DataFrame:
    """Final shards and slots: linked rows first, by group, then the others; rows beyond a shard's count fill the
    shards that lack rows."""
    slices = int(total / n_shards / ROWS_PER_SLICE) + 1
    linked = F.col("m").isNotNull()
    many = F.coalesce(F.col("m"), F.lit(0)) > ROWS_PER_SLICE
    key = F.when(linked, F.col("group")).otherwise(F.col("row"))
    at = F.struct(F.when(linked, 0).otherwise(1).alias("a"), F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(16.0**8) * slices).cast("int").alias("b"), F.when(many, F.col("group")).otherwise("").alias("c"), F.when(many, F.floor(_unit(F.col("row"), "n:") * (F.col("m") / ROWS_PER_SLICE + 1))).otherwise(0).cast("int").alias("d"))
    rows = placed.withColumn("at", at)
    sizes = rows.groupBy("shard", "at").agg(F.count("*").alias("k"))
    before = sizes.select("shard", "at", (F.sum("k").over(Window.partitionBy("shard").orderBy("at")) - F.col("k")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "at").orderBy("group", "row")) - 1
    ranked = rows.withColumn("number", number).join(before, ["shard", "at"]).withColumn("number", (F.col("number") + F.col("before")).cast("long"))
    have = {r["shard"]: r["k"] for r in sizes.groupBy("shard").agg(F.sum("k").alias("k")).collect()}  # n_shards rows
    want = {s: total // n_shards + (s < total % n_shards) for s in range(n_shards)}
    first, lack, o, d = [], [], 0, 0
    for s in range(n_shards):
        k = have.get(s, 0)
        first.append(o)
        o += max(0, k - want[s])
        if k < want[s]:
            lack.append((s, k, d, d + want[s] - k))
            d += want[s] - k
    ranked = ranked.withColumn("want", _of([want[s] for s in range(n_shards)], "shard")).withColumn("first", _of(first, "shard"))
    gaps = F.transform(F.lit([list(g) for g in lack or [(0, 0, 0, 0)]]), lambda g: F.struct(*(g[i].cast("long").alias(n) for i, n in enumerate(("shard", "have", "lo", "hi")))))
    surplus = F.col("first") + F.col("number") - F.col("want")
    gap = F.when(F.col("number") >= F.col("want"), F.element_at(F.filter(gaps, lambda g: (g["lo"] <= surplus) & (surplus < g["hi"])), 1))
    ranked = ranked.withColumn("gap", gap)
    return ranked.select(
        F.col(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.coalesce(F.col("gap.shard"), F.col("shard")).cast("int").alias("shard"),
        F.when(F.col("gap").isNotNull(), F.col("gap.have") + surplus - F.col("gap.lo")).otherwise(F.col("number")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        linked.alias("linked"),
    )
