"""Streams against their batch forms: disorder, late rows, restarts, expiry."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnweave.operators import candidates, sessionize
from turnweave.streaming import candidates as stream_candidates
from turnweave.streaming import sessionize as stream_sessions
from turnweave.streaming.replay import Replay

TURNS = "session_id long, turn long, role string, text string, event_time timestamp"
START = dt.datetime(2024, 1, 1)


def turn(session, number, role, text, minute=None):
    at = None if minute is False else START + dt.timedelta(minutes=number if minute is None else minute)
    return (session, number, role, text, at)


def dialogue(session, n, seed):
    rng = random.Random(seed)
    roles = [rng.choice(["user", "user", "assistant", "assistant", "system"]) for _ in range(n)]
    return [turn(session, i, r, "" if rng.random() < 0.1 else f"{r} {session} {i}") for i, r in enumerate(roles)]


def batch_edges(spark, rows, window):
    turns = spark.createDataFrame(rows, TURNS)
    records = candidates.records_from_turns(turns, session="session_id")
    return Counter(map(tuple, candidates.candidate_edges(records, window).collect()))


def candidate_replay(spark, **options):
    schema = spark.createDataFrame([], TURNS).schema
    return Replay(spark, schema, lambda s, out, cp: stream_candidates.run_candidates(s, out, cp, **options))


def heartbeat(spark, minute):
    return spark.createDataFrame([(None, None, None, None, START + dt.timedelta(minutes=minute))], TURNS)


def test_candidates_out_of_order_late_and_restarted(spark):
    rows = [t for s in range(6) for t in dialogue(s, 24, s)] + dialogue(None, 12, 99)
    late = turn(3, 24, "user", "too late", 3)
    lost = turn(4, 25, "user", "no time", False)
    run = candidate_replay(spark, window=5, delay="6 minutes")
    rng = random.Random(1)
    waves = [[], [], []]
    for row in rows:
        # up to five minutes out of order, never behind the watermark
        waves[min(2, (row[1] + rng.randint(0, 4)) // 10)].append(row)
    for wave in waves:
        rng.shuffle(wave)
    run.feed(spark.createDataFrame(waves[0], TURNS))
    run.feed(spark.createDataFrame(waves[1], TURNS))
    run.feed(spark.createDataFrame([*waves[2], late, lost], TURNS))
    run.feed(heartbeat(spark, 60))  # every feed is a run of its own from the checkpoint
    found = run.result(stream_candidates.OUTPUT.format(session="bigint"))
    assert Counter(map(tuple, stream_candidates.as_edges(found).collect())) == batch_edges(spark, rows, 5)
    told = {(r.session_id, r.turn, r.text, r.event_time) for r in stream_candidates.late_turns(found).collect()}
    assert told == {(3, 24, "too late", late[4]), (4, 25, "no time", None)}
    assert run.dropped == 0
    before = found.count()
    run.feed(heartbeat(spark, 61))  # nothing new: nothing comes out twice
    assert run.result(stream_candidates.OUTPUT.format(session="bigint")).count() == before


def test_candidates_of_a_closed_session_begin_again(spark):
    run = candidate_replay(spark, window=3, delay="1 minute", idle="30 minutes")
    run.feed(spark.createDataFrame([turn(1, 0, "user", "q0"), turn(1, 1, "assistant", "a0"), turn(1, 2, "user", "q1")], TURNS))
    run.feed(heartbeat(spark, 10))
    run.feed(spark.createDataFrame([turn(1, 3, "user", "q2", 12)], TURNS))  # still open
    run.feed(heartbeat(spark, 100))
    run.feed(spark.createDataFrame([turn(1, 4, "user", "q3", 200), turn(1, 5, "assistant", "a3", 201), turn(1, 6, "user", "q4", 202)], TURNS))
    run.feed(heartbeat(spark, 300))
    edges = stream_candidates.as_edges(run.result(stream_candidates.OUTPUT.format(session="bigint"))).collect()
    assert {(r.Q1_row, r.Q2_row, r.Q1, r.A1, r.Q2) for r in edges} == {(0, 1, "q0", "a0", "q1"), (0, 2, "q0", "a0", "q2"), (0, 1, "q3", "a3", "q4")}
    with pytest.raises(ValueError):
        stream_candidates.candidate_stream(None, window=0)


EVENTS = "event_id long, ts timestamp, user_id long, value double"


def some_events(seed=4):
    rng = random.Random(seed)
    rows = [(i, START + dt.timedelta(seconds=rng.randint(0, 86_400)), 1 if i % 3 else rng.randint(2, 9), float(rng.randint(0, 9))) for i in range(400)]
    rows += [(1000, START, 50, 1.0), (1001, START + dt.timedelta(seconds=600), 50, 2.0)]  # exactly the gap: one session
    rows += [(1002, START, 51, 1.0), (1003, START + dt.timedelta(seconds=601), 51, 2.0), (1004, START, 51, 4.0)]
    rows += [(1005, START, None, 1.0), (1006, START + dt.timedelta(seconds=10), None, 1.0), (1007, None, 1, 5.0)]
    return rows


def by_hand(rows, gap):
    out = Counter()
    for user in {r[2] for r in rows}:
        mine = sorted((r for r in rows if r[2] == user and r[1] is not None), key=lambda r: (r[1], r[0]))
        groups = []
        for r in mine:
            if groups and (r[1] - groups[-1][-1][1]).total_seconds() <= gap:
                groups[-1].append(r)
            else:
                groups.append([r])
        for g in groups:
            out[(user, g[0][1], g[-1][1] + dt.timedelta(seconds=gap), len(g), sum(r[3] for r in g))] += 1
    return out


def sums():
    return [F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")]


@pytest.mark.parametrize("slice_seconds", [60, 3_600, 10**6])
def test_sessions_by_gap(spark, slice_seconds):
    rows = some_events()
    events = spark.createDataFrame(rows, EVENTS)
    found = sessionize.session_table(events, "user_id", "ts", sums(), 600, slice_seconds)
    assert Counter(map(tuple, found.collect())) == by_hand(rows, 600)
    assert sessionize.session_table(events.limit(0), "user_id", "ts", sums(), 600).collect() == []
    with pytest.raises(ValueError):
        sessionize.number_sessions(events, "user_id", "ts", 0)


def test_sessions_from_a_stream_and_a_late_event(spark):
    rows = some_events()
    events = spark.createDataFrame(rows, EVENTS)
    schema = events.schema
    run = Replay(spark, schema, lambda s, out, cp: stream_sessions.run_sessions(s, out, cp, "user_id", "ts", sums(), gap=600, delay="1 hour"))
    middle = START + dt.timedelta(hours=12)
    run.feed(events.where(F.col("ts").isNull() | (F.col("ts") < F.lit(middle))))
    run.feed(events.where(F.col("ts") >= F.lit(middle)))
    late = [(5000, START + dt.timedelta(minutes=1), 1, 100.0)]
    run.feed(spark.createDataFrame([*late, (5001, START + dt.timedelta(days=9), 77, 0.0)], EVENTS))
    result = "user_id bigint, start timestamp, end timestamp, events bigint, total double"
    assert Counter(map(tuple, run.result(result).collect())) == by_hand(rows, 600)
    assert run.dropped == 1  # the late event is counted, not placed
