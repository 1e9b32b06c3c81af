"""Channels against a plain restatement in Python, on Chinese text."""

import random

from pyspark.sql import functions as F

from turnweave.functions.lexicon import DEFAULT_LEXICON as LEX
from turnweave.operators import candidates, channels, topicshift

PIECES = [
    "募投项目投产", "毛利率", "为什么", "请正面回答", "解释一下", "感谢关注", "公告", "具体进展", "上述", "成长性",
    "重组", "承诺", "预计", "正在推进", "PVC", "是否完成", "3亿", "？", "利润增长点", "不重组", "发展规划", "因为",
]


def edges(spark, n=120, seed=9):
    rng = random.Random(seed)
    say = lambda k: "，".join(rng.sample(PIECES, k))
    rows = [
        (f"s_{i}_{i + 1}", "s", i, i + 1, rng.choice([1, 2, 3, 5, 6]), say(rng.randint(1, 4)), say(rng.randint(1, 5)), say(rng.randint(1, 5)), rng.choice([0.0, 0.004, 0.02, 0.3]))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "edge_id string, session_id string, Q1_row int, Q2_row int, distance int, Q1 string, A1 string, Q2 string, p double",
    )


def share(text, terms, n):
    return min(sum(t in text for t in terms) / n, 1.0)


def plain_complaint(r):
    unsat = share(r["A1"], LEX.unsatisfied, 2)
    if unsat > 0 and len(r["A1"]) <= 35:
        unsat = max(unsat, 0.75 if len(r["A1"]) <= 18 else 0.6)
    marks = min(sum(r["Q2"].count(c) for c in "?？") / 2, 1.0)
    pressure = max(share(r["Q2"], LEX.pressure, 2), marks * 0.25)
    explain = share(r["Q2"], LEX.explain_only, 2)
    bare = min(max(pressure - 0.7 * explain, 0), 1)
    near = r["distance"] <= 5
    levels = [0.0]
    levels += [0.58] if unsat >= 0.45 and pressure >= 0.75 and near else []
    levels += [0.80] if unsat >= 0.58 and pressure >= 0.55 and near else []
    levels += [0.56] if bare >= 0.92 and r["p"] >= 0.01 and near else []
    levels += [0.55] if bare >= 0.95 and r["distance"] <= 2 else []
    levels += [0.53] if explain >= 0.65 and unsat >= 0.45 and near else []
    return max(levels)


def plain_rule(r):
    anchor = r["Q1"] + " " + r["A1"]
    hits = [
        w for e, i, w in LEX.bridges
        if share(anchor, LEX.events[e], 2) >= 0.5 and share(r["Q2"], LEX.intents[i], 2) >= 0.5 and r["distance"] <= 5
    ]
    return max(hits, default=0.0)


def test_channels_match_plain_python(spark):
    out = channels.interaction_channels(edges(spark), "p").collect()
    assert len(out) == 120
    assert {r["stage1_complaint_prob"] > 0 for r in out} == {True, False}
    assert {r["structured_bridge_eligible"] for r in out} == {0.0, 1.0}
    for r in out:
        assert abs(r["stage1_complaint_prob"] - plain_complaint(r)) < 1e-12
        assert abs(r["structured_bridge_rule_score"] - plain_rule(r)) < 1e-12
        assert abs(r["structured_followup_action_score"] - share(r["Q2"], LEX.action, 2)) < 1e-12
        assert abs(r["structured_answer_state_score"] - share(r["A1"], LEX.answer_state, 2)) < 1e-12
        assert r["structured_answer_numeric_score"] == float(any(c.isdigit() for c in r["A1"]))
        assert r["stage1_prob"] == r["p"]
        assert 0.0 <= r["stage1_structured_prob"] <= 0.45


def test_record_features_give_the_same_channels(spark):
    rows = [("s", i, q, a) for i, (q, a) in enumerate((r["Q1"], r["A1"]) for r in edges(spark, 25).collect())]
    records = spark.createDataFrame(rows, "session_id string, pos int, Q string, A string")
    plain = candidates.candidate_edges(records).withColumn("p", F.lit(0.3))
    early = candidates.candidate_edges(
        channels.record_features(records), source=channels.SOURCE_FEATURES, target=channels.TARGET_FEATURES
    ).withColumn("p", F.lit(0.3))
    a, b = (channels.interaction_channels(x, "p") for x in (plain, early))
    assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_topic_shift_examples(spark):
    rows = [
        ("q", "a", "换个话题，分红"),
        ("公司 海参", "增长 目标", "海参 增长 目标 多少呢公司海参增长目标多少呢公司"),
        ("海参业务", "请关注", "继续 海参业务"),
        ("q", "a", ""),
    ]
    df = spark.createDataFrame(rows, "Q1 string, A1 string, Q2 string")
    got = topicshift.with_topic_shift(df).collect()
    strong = got[0]
    want = 0.0 + 0.85 + 0.35 + 0.22 + 0.18 + 0.05 + 0.03
    assert strong["topic_shift_score"] == min(want, 1.0) and strong["topic_shift_bucket"] == "easy"
    assert strong["topic_shift_flags"].startswith("strong_pattern|low_overlap_short_q2|no_overlap|new_topic_short_q2")
    assert "question_form" in got[1]["topic_shift_flags"] and "short_q2" not in got[1]["topic_shift_flags"]
    assert "continuation_marker" in got[2]["topic_shift_flags"]
    assert got[3]["topic_shift_flags"] == "low_overlap_short_q2|no_overlap|short_q2"
