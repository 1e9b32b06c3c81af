"""Candidate edges from a stream of turns that arrive out of order.

Turns are keyed by session.  A turn waits in the session's state until the
watermark has passed its event time; then the turns due are taken in the order of
their times, so every one meets the session as the batch form sees it.  The state
holds the turns that wait and the last ``window`` records, whatever the length of
the session.  A turn that comes after the watermark has passed its time can no
longer be placed: it is given out as a late row, not dropped.  A session silent for
``idle`` of event time is closed and its state deleted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import clean_text

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: how long after the watermark Spark still hands a row over, so that it can be told late
GRACE_DAYS = 36_500
EDGE, LATE = "edge", "late"
OUTPUT = (
    "kind string, session_id {session}, Q1_row int, Q2_row int, Q1 string, A1 string, Q2 string, "
    "turn bigint, role string, text string, event_time timestamp"
)
_WAITING = "turn bigint, at bigint, role string, text string"
_RECORDS = "pos bigint, q string, a string, open boolean"
_CLOCK = "next_pos bigint, last bigint"


# the processor travels whole, so that Python workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class CandidateProcessor(StatefulProcessor):
    """Keyed state: turns that wait, the last records, the next position and the latest time."""

    def __init__(self, window: int, idle_ms: int, asker: str, answerer: str, columns: list[str]):
        self.window = window
        self.idle_ms = idle_ms
        self.asker = asker
        self.answerer = answerer
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.records = handle.getListState("records", _RECORDS)
        self.clock = handle.getValueState("clock", _CLOCK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        late, due = [], []
        for some in rows:
            for turn, at, role, text in zip(some["turn"], some["at_ms"], some["role"], some["text"]):
                if pd.isna(turn) and pd.isna(role) and pd.isna(key[0]):
                    continue  # only moves the watermark
                missing = pd.isna(turn) or pd.isna(at)
                if missing or at <= now:
                    late.append((None if pd.isna(turn) else int(turn), role, text, None if pd.isna(at) else int(at)))
                else:
                    due.append((int(turn), int(at), role, text))
        if due:
            self.waiting.appendList(due)
            for at in {d[1] for d in due}:
                self.handle.registerTimer(at)
        if late:
            yield self._rows(key, late=late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        # rows of one time follow their turn number
        due = sorted((w for w in waiting if w[1] <= now), key=lambda w: (w[1], w[0]))
        next_pos, last = self.clock.get() if self.clock.exists() else (0, 0)
        if due:
            records = [list(r) for r in self.records.get()] if self.records.exists() else []
            edges = []
            for _, _, role, text in due:
                answer = text if role == self.answerer else ""
                for r in records:
                    if r[3]:  # only the very next turn can be the answer
                        r[2], r[3] = answer, False
                if role != self.asker:
                    continue
                edges += [(int(r[0]), int(next_pos), r[1], r[2], text) for r in records if r[1] and r[2] and text]
                records = [*records, [next_pos, text, "", True]][-self.window :]
                next_pos += 1
            last = max(last, due[-1][1])
            self.records.put([tuple(r) for r in records]) if records else self.records.clear()
            left = [w for w in waiting if w[1] > now]
            self.waiting.put(left) if left else self.waiting.clear()
            self.clock.update((next_pos, last))
            self.handle.registerTimer(last + self.idle_ms)
            if edges:
                yield self._rows(key, edges=edges)
        elif not waiting and last + self.idle_ms <= now:
            for state in (self.waiting, self.records, self.clock):
                state.clear()

    def _rows(self, key, edges=(), late=()) -> pd.DataFrame:
        session = None if pd.isna(key[0]) else key[0]
        out = [(EDGE, session, *e, None, None, None, None) for e in edges]
        out += [(LATE, session, None, None, None, None, None, t, r, x, a) for t, r, x, a in late]
        found = pd.DataFrame(out, columns=self.columns, dtype=object)
        found["event_time"] = pd.to_datetime(found["event_time"], unit="ms")
        for c in ("Q1_row", "Q2_row"):
            found[c] = found[c].astype("Int32")
        found["turn"] = found["turn"].astype("Int64")
        return found

    def close(self) -> None:
        pass


def candidate_stream(
    turns: DataFrame,
    window: int = 5,
    delay: str = "10 minutes",
    idle: str = "30 days",
    session: str = "session_id",
    order: str = "turn",
    time: str = "event_time",
    role: str = "role",
    text: str = "text",
    asker: str = "user",
    answerer: str = "assistant",
) -> DataFrame:
    """Edges and late turns (column ``kind``) of a stream of turns.

    ``delay`` is how far turns may come out of order; nothing is given out before
    the watermark, ``delay`` behind the latest event time, has passed; a row with
    nothing but a time serves to move it.  A turn without time or number counts as
    late at once.  Times within a session must
    rise with the turn number; turns of one time are taken by number.  After
    ``idle`` of silence a session is closed: turns that still come begin at
    position 0.  Edges are those of ``operators.candidates.candidate_edges``.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    grace = F.expr(f"interval {GRACE_DAYS} days")
    told = turns.select(
        F.col(session).alias("session_id"),
        F.col(order).cast("bigint").alias("turn"),
        F.col(role).alias("role"),
        clean_text(F.col(text)).alias("text"),
        F.unix_millis(F.col(time).cast("timestamp")).alias("at_ms"),
        # Spark drops rows behind the watermark: its clock runs ahead by the grace, which the delay takes off again
        (F.coalesce(F.col(time).cast("timestamp"), F.timestamp_seconds(F.lit(0))) + grace).alias("clock"),
    )
    kind = dict(turns.dtypes)[session]
    schema = OUTPUT.format(session=kind)
    columns = [f.split(" ")[0] for f in schema.split(", ")]
    idle_ms = int(turns.sparkSession.sql(f"select unix_millis(timestamp_seconds(0) + interval {idle})").first()[0])
    processor = CandidateProcessor(window, idle_ms, asker, answerer, columns)
    return (
        told.withWatermark("clock", f"{_minutes(turns, delay) + GRACE_DAYS * 1440} minutes")
        .groupBy("session_id")
        .transformWithStateInPandas(processor, schema, "Append", "EventTime")
    )


def _minutes(turns: DataFrame, interval: str) -> int:
    """An interval in whole minutes, rounded up."""
    seconds = turns.sparkSession.sql(f"select unix_seconds(timestamp_seconds(0) + interval {interval})").first()[0]
    return -(-int(seconds) // 60)


def as_edges(found: DataFrame) -> DataFrame:
    """The edge rows of a ``candidate_stream`` output, in the columns of the batch form."""
    edges = found.where(F.col("kind") == EDGE)
    return edges.select(
        F.concat_ws("_", "session_id", "Q1_row", "Q2_row").alias("edge_id"), "session_id", "Q1_row", "Q2_row",
        (F.col("Q2_row") - F.col("Q1_row")).alias("distance"), "Q1", "A1", "Q2",
    )


def late_turns(found: DataFrame) -> DataFrame:
    """The turns that came too late, as they came (texts cleaned)."""
    return found.where(F.col("kind") == LATE).select("session_id", "turn", "role", "text", "event_time")


def run_candidates(turns: DataFrame, output: str, checkpoint: str, **options) -> StreamingQuery:
    """Start a run over all that is there; a later run with the same folders goes on after it."""
    spark = turns.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)  # state with timers needs this store
    try:
        return (
            candidate_stream(turns, **options).writeStream.format("parquet").partitionBy("kind")
            .option("path", output).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
