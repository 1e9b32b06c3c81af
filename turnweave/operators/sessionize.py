"""Sessions of events by gaps in time, for keys of any size.

A key's events are cut into slices of time.  Inside a slice every event sees the
one before it; the first event of a slice sees the last of the slice before, of
which one row per slice is enough.  Where the gap is exceeded a session begins, and
a running sum over slices numbers the sessions, so a key that holds a large part
of all events is still worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import sliced_running_sum

DEFAULT_GAP = 30 * 60
SLICE = 6 * 3600


def number_sessions(
    events: DataFrame,
    key: str,
    time: str,
    gap: int = DEFAULT_GAP,
    name: str = "session_no",
    slice_seconds: int = SLICE,
) -> DataFrame:
    """``events`` with the number (from 0) of the session of its key that an event lies in.

    A session ends when the next event comes more than ``gap`` seconds after the
    one before, as ``session_window`` has it.  Events without a time belong to no
    session and are left out; events without a key share one.
    """
    if gap <= 0 or slice_seconds <= 0:
        raise ValueError("gap and slice must be positive")
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.where(F.col(time).isNotNull()).withColumn("_at", at)
    slot = F.floor(F.col("_at") / F.lit(slice_seconds * 1_000_000)).cast("long")
    rows = rows.withColumn("_slot", F.struct(F.struct(F.lit(0), F.col(key).alias("k")).alias("k"), slot.alias("s")))
    heads = rows.groupBy("_slot").agg(F.max("_at").alias("_last"))
    along = Window.partitionBy("_slot.k").orderBy("_slot.s")
    heads = heads.select("_slot", F.lag("_last").over(along).alias("_before"))
    inside = Window.partitionBy("_slot").orderBy("_at")
    previous = F.coalesce(F.lag("_at").over(inside), F.col("_before"))
    begins = previous.isNull() | (F.col("_at") - previous > gap * 1_000_000)
    marked = rows.join(heads, "_slot").withColumn("_new", begins.cast("long")).drop("_before", "_slot")
    cut = F.floor(F.col("_at") / F.lit(slice_seconds * 1_000_000)).cast("long")
    # of events of one time the one that begins a session comes first, whatever their order in the window above
    numbered = sliced_running_sum(marked, [key], cut, [F.col("_at"), F.col("_new").desc()], {name: F.col("_new")})
    return numbered.withColumn(name, F.col(name) - 1).drop("_at", "_new")


def session_table(
    events: DataFrame, key: str, time: str, aggregates: Sequence[Column], gap: int = DEFAULT_GAP, slice_seconds: int = SLICE
) -> DataFrame:
    """``key, start, end`` and the aggregates of each session; ``end`` is the last event's time and the gap."""
    numbered = number_sessions(events, key, time, gap, slice_seconds=slice_seconds)
    ends = F.max(time) + F.make_interval(secs=F.lit(gap))
    return numbered.groupBy(key, "session_no").agg(F.min(time).alias("start"), ends.alias("end"), *aggregates).drop("session_no")
