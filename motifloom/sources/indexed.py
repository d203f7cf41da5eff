"""Sorted interval files that are read by region (K12, S5 of the survey).

Intervals stand in the order of contig, start and stop over all part files, in pages of few rows.  The files' own page
indexes hold the least and largest start of each page, and a small table beside them the longest interval of each contig;
so what overlaps a region begins between two known starts, and only pages with such starts are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "_index"  # hidden from readers of the folder itself


def write_indexed(df: DataFrame, path: str, *, rows: int = 4096) -> None:
    """``df`` (contig, start, stop and others) with its index; pages have ``rows`` rows."""
    ordered = df.repartitionByRange("contig", "start", "stop").sortWithinPartitions("contig", "start", "stop")
    ordered.write.option("parquet.page.row.count.limit", rows).parquet(path)
    known = df.sparkSession.read.parquet(path)
    known.groupBy("contig").agg(F.max(F.col("stop") - F.col("start")).alias("longest"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/{INDEX}")


def read_region(spark: SparkSession, path: str, contig: str, start: int, stop: int) -> DataFrame:
    """The intervals that share a position with [start, stop) of a contig."""
    longest = spark.read.parquet(f"{path}/{INDEX}").where(F.col("contig") == contig).select("longest").first()
    rows = spark.read.parquet(path).where((F.col("contig") == contig) & (F.col("start") < stop) & (F.col("stop") > start))
    return rows.where(F.col("start") > start - longest[0]) if longest else rows.where(F.lit(False))
