"""Tables that a plan writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder, as in tests.
DEFAULT = "/tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset ``DEFAULT``, but only for a local master, as others
    share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or DEFAULT


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, its lineage cut and its true size known."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, as the optimiser knows them without running a job; those of
    a source of unknown size are very many."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
