"""Search over a stream of sequences: the same operators, each micro-batch on its own; histograms as a running total."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.search import search
from ..sources.profiles import Profile


def stream_search(sequences: DataFrame, profiles: Sequence[Profile], **options) -> DataFrame:
    """A stream of hits; sequences: a stream with header and raw."""
    return search(sequences, profiles, key="header", text="raw", **options)


def to_sink(hits: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each micro-batch to `write`; a batch run again has the same number."""
    return hits.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def running_histogram(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """bin, n so far; for complete or update mode. State is bounded by the bins."""
    return df.select(value.cast("long").alias("bin")).where(F.col("bin").between(low, high)).groupBy("bin").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of events by event time; late rows are taken up to the watermark."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
