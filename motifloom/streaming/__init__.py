"""Streaming forms of the engine's interval features (an addition: the batch operators need none)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and mean values of a stream of events by type and window of event time; rows later than ``late`` are
    dropped, so that state is bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def labelled_stream(peaks: DataFrame, observed: DataFrame, *, bin_width: int = 512) -> DataFrame:
    """Overlaps of a stream of intervals with a fixed table: stateless, so any output mode serves."""
    from motifloom.operators.intervals import overlap_join

    return overlap_join(peaks, observed, bin_width=bin_width)
