"""The folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no folder, as in tests.
DEFAULT = "/tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset ``DEFAULT``, but only for a local master, as others
    share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or DEFAULT


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, which has its true size: a checkpoint keeps the plan's estimate, to which
    every join adds its digits, and after some twenty rounds planning takes longer than the work."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def told_apart(rows: DataFrame, key: str, many: int) -> DataFrame:
    """Rows whose ``key``, a hash of all that tells rows apart, occurs more than ``many`` times get keys of their own:
    hashes of the key and a number from 0.  Which of these equal rows has which number is open, so the keys of all
    rows together are the same whatever the partitions.  Numbers are given in parts of about ``many`` rows, so no task
    sees all rows of a key; rows are written first, so that a part keeps its rows if it is computed again."""
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > many)
    hot = written(hot.select(F.col(key).alias("_key"), F.ceil(F.col("_n") / many).cast("int").alias("_parts")), "hot")
    if not hot.limit(1).count():
        return rows
    rows = checkpoint(rows.withColumn("_row", F.monotonically_increasing_id()))
    marked = rows.join(hot, F.col(key) == F.col("_key"), "left")
    equal = marked.where("_key IS NOT NULL").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")))
    sizes = equal.groupBy("_key", "_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_key", "_part", (F.sum("_size").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_size")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_row")) - 1
    numbered = equal.withColumn("_own", number).join(before, ["_key", "_part"])
    own = F.md5(F.concat_ws(":", F.col(key), (F.col("_own") + F.col("_before")).cast("string")))
    columns = [c for c in rows.columns if c != "_row"]
    return checkpoint(marked.where("_key IS NULL").select(*columns).unionByName(numbered.select(*(own.alias(c) if c == key else F.col(c) for c in columns))))
