"""Null groups and keys give the same rows in every layout."""

from turnweave.functions.numeric import to_number
from turnweave.operators.candidates import number_records, records_from_turns, sample_candidates
from turnweave.operators.metrics import best_f1_threshold, evaluate
from turnweave.operators.prefix import sliced_running_sum
from pyspark.sql import functions as F


def test_block_layout_keeps_null_sessions_and_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 5, "user", "c"), (None, 0, "user", "d"), (2, None, "user", "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = records_from_turns(turns)
    for block in (1, 2, 100):
        cut = records_from_turns(turns, block=block)
        assert sorted(map(repr, cut.collect())) == sorted(map(repr, whole.collect()))
    assert whole.count() == 4


def test_number_records_keeps_null_session(spark):
    rows = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", None)], "session_id string, Qnumbr long")
    whole = sorted(map(repr, number_records(rows).collect()))
    assert sorted(map(repr, number_records(rows, block=2).collect())) == whole


def test_running_sum_keeps_null_group_and_slice(spark):
    rows = spark.createDataFrame([(None, 1, 1), (None, None, 2), ("a", 1, 4)], "g string, k long, v long")
    found = sliced_running_sum(rows, ["g"], F.col("k"), [F.col("k")], {"t": F.col("v")})
    assert sorted((r.g or "", r.k or 0, r.t) for r in found.collect()) == [("", 0, 2), ("", 1, 3), ("a", 1, 4)]


def test_evaluate_keeps_null_group(spark):
    rows = [(None, 1, 1, 0.9), (None, 0, 0, 0.1), ("v", 1, 1, 0.8), ("v", 0, 1, 0.7)]
    df = spark.createDataFrame(rows, "split string, edge_label int, pred int, score double")
    assert {r.split: (r.tp, r.auc) for r in evaluate(df, by=["split"]).collect()} == {None: (1, 1.0), "v": (1, 1.0)}
    assert {r.split: r.threshold for r in best_f1_threshold(df, by=["split"]).collect()} == {None: 0.9, "v": 0.8}


def test_sample_has_one_schema(spark):
    rows = [(f"e{i}", "s", 0, i, 1, "why is revenue lower", "costs rose", "what about costs") for i in range(6)]
    df = spark.createDataFrame(rows, "edge_id string, session_id string, Q1_row int, Q2_row int, distance int, Q1 string, A1 string, Q2 string")
    assert sample_candidates(df, 4).columns == sample_candidates(df, 10).columns


def test_java_number_suffixes_are_no_numbers(spark):
    texts = ["1d", "2f", "3.5", "1e3", " 7 ", "x", None, "4.D", "Infinity"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(to_number(F.col("t"), None).alias("n"))
    assert [r.n for r in rows.collect()] == [None, None, 3.5, 1000.0, 7.0, None, None, None, float("inf")]
