"""Rules as data: every kind on a sound and on a broken table."""

import pytest

from turnweave.operators import rules
from turnweave.operators.rules import Rule

SHAPE = "session_id string, Q1_row int, Q2_row int, edge_id string, edge_label int, stage1_pred_edge int, stage1_prob double, split string"
SOUND = [("a", 0, 1, "a01", 1, 1, 0.5, "train"), ("a", 0, 2, "a02", 0, 0, 0.0, "train"), ("b", 0, 1, "b01", 0, 1, 1.0, "test")]
BROKEN = [
    ("a", 0, 1, "a01", 2, 1, 0.5, "train"), ("a", 0, 2, "a01", 0, 7, 1.5, "test"), (" ", 0, 1, None, None, 1, float("nan"), "test"),
    (None, 3, 9, "x1", 0, 1, -0.5, "test"), (None, 4, 9, "x2", 0, 1, None, "test"),
]


def counts(frame):
    return {r.rule: (r.checked, r.violations) for r in frame.collect()}


def test_a_scored_split(spark):
    split = rules.scored_split_rules("s", 1)
    good = counts(rules.report({"s": spark.createDataFrame(SOUND, SHAPE)}, split))
    assert len(good) == 8 and all(v == 0 for _, v in good.values())
    rules.require({"s": spark.createDataFrame(SOUND, SHAPE)}, split)
    bad = counts(rules.report({"s": spark.createDataFrame(BROKEN, SHAPE)}, split))
    assert bad == {
        "s_keys_present": (5, 3), "s_numbers_finite": (5, 2), "s_labels": (5, 1), "s_predictions": (5, 1), "s_probabilities": (5, 2),
        "s_edge_ids": (4, 1), "s_target_candidates": (3, 1), "s_one_split": (3, 1),
    }
    with pytest.raises(RuntimeError, match=r"s_edge_ids \(1\).*s_target_candidates \(1\)"):
        rules.require({"s": spark.createDataFrame(BROKEN, SHAPE)}, split)


def test_rules_between_artifacts(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, v int")
    right = spark.createDataFrame([("b", 2), (None, 4), ("c", 5), ("c", 5)], "id string, v int")
    both = {"left": left, "right": right}
    found = counts(rules.report(both, [
        Rule("d", "left", "disjoint", ("id",), ("right",)), Rule("c", "left", "contained", ("id",), ("right",)), Rule("k", "left", "same_keys", ("id",), ("right",)),
        Rule("e", "left", "equal_columns", ("id", "v"), ("right",)), Rule("n", "left", "rows", (), (5,)), Rule("u", "right", "distinct", ("id",), (3,)),
        Rule("i", "left", "implies", ("id", "v"), ("b", 3)), Rule("gone", "nothing", "rows", (), (1,)), Rule("col", "left", "unique", ("w",)),
        Rule("far", "left", "contained", ("id",), ("nothing",)),
    ]))
    assert found == {
        "d": (3, 2), "c": (3, 1), "k": (4, 2), "e": (2, 1), "n": (3, 2), "u": (3, 0), "i": (3, 1), "gone": (0, None), "col": (0, None), "far": (0, None),
    }


def test_rules_come_from_a_table(spark):
    rows = [("p", "t", "between", ["v"], ["0", "0.5"]), ("a", "t", "among", ["name"], ["x", "y"]), ("u", "t", "unique", ["v"], None)]
    listed = rules.rules_from_table(spark.createDataFrame(rows, "name string, artifact string, kind string, columns array<string>, values array<string>"))
    assert listed == [Rule("p", "t", "between", ("v",), (0, 0.5)), Rule("a", "t", "among", ("name",), ("x", "y")), Rule("u", "t", "unique", ("v",))]
    table = spark.createDataFrame([("x", 0.1), ("z", 0.7), (None, 0.7)], "name string, v double")
    assert counts(rules.report({"t": table}, listed)) == {"p": (3, 2), "a": (3, 1), "u": (2, 1)}
    with pytest.raises(ValueError):
        rules.report({"t": table}, [Rule("x", "t", "rows", (), (1,)), Rule("x", "t", "unique", ("v",))])
    with pytest.raises(ValueError):
        rules.report({"t": table}, [Rule("x", "t", "strange")])
