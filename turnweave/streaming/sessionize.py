"""Sessions of events from a stream: the same sessions as ``operators.sessionize``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.sessionize import DEFAULT_GAP


def session_stream(
    events: DataFrame, key: str, time: str, aggregates: Sequence[Column], gap: int = DEFAULT_GAP, delay: str = "1 hour"
) -> DataFrame:
    """``key, start, end`` and the aggregates of each session that the watermark has closed.

    State holds open sessions only.  Events that come more than ``delay`` behind
    the latest one are not counted (their number is in the query's progress);
    events without a time are left out, events without a key share one.
    """
    closed = (
        events.where(F.col(time).isNotNull())
        .withWatermark(time, delay)
        .groupBy(F.session_window(time, f"{int(gap)} seconds").alias("w"), key)
        .agg(*aggregates)
    )
    return closed.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in closed.columns if c not in ("w", key)])


def run_sessions(events: DataFrame, output: str, checkpoint: str, key: str, time: str, aggregates: Sequence[Column], **options) -> StreamingQuery:
    """Start a run over all that is there; a later run with the same folders goes on after it."""
    return (
        session_stream(events, key, time, aggregates, **options).writeStream.format("parquet")
        .option("path", output).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
