"""Bootstrap by weight vectors against the same draws, edge by edge."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.operators import bootstrap, bootstrap_vectors


def plain_metrics(rows):
    """(precision, recall, f1, auc, ap) of (label, score, pred) rows."""
    tp = sum(y and p for y, _, p in rows)
    fp = sum(not y and p for y, _, p in rows)
    fn = sum(y and not p for y, _, p in rows)
    pos, neg = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    auc = ap = None
    if pos and neg:
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        ap = 0.0
        for cut in sorted(set(pos)):
            got = [y for y, s, _ in rows if s >= cut]
            ap += sum(s == cut for s in pos) / len(pos) * sum(got) / len(got)
    over = lambda a, b: a / b if b else 0.0
    return over(tp, tp + fp), over(tp, tp + fn), over(2 * tp, 2 * tp + fp + fn), auc, ap


@pytest.mark.parametrize("limits", [{}, {"SESSIONS_A_SLICE": 3, "SCORES_A_SLICE": 2, "PICKS_AT_ONCE": 50, "CELLS_AT_ONCE": 4, "VECTORS_AT_ONCE": 2}])
def test_metrics_of_every_draw(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(bootstrap_vectors, name, value)
    rng = random.Random(3)
    edges = []
    for s in range(11):
        for _ in range(60 if s == 4 else rng.randint(1, 8)):  # one session holds much of the rows
            y = int(rng.random() < 0.3 and s != 2)
            a, b = round(rng.random(), 1), rng.choice([0.5, 2.0, -1.0])
            edges.append((f"s{s}", y, a, int(a > 0.5), b, int(b > 0)))
    df = spark.createDataFrame(edges, "session_id string, edge_label int, a double, pa int, b double, pb int").repartition(3)
    sessions = spark.createDataFrame([(f"s{s}", s) for s in range(11)], "session_id string, session_idx long")
    n_draws = 7
    weights = {r.session_idx: np.frombuffer(r.weights, np.int32) for r in bootstrap_vectors.weight_vectors(sessions, n_draws).collect()}
    want = Counter((r.draw, r.session_idx) for r in bootstrap.hashed_draws(sessions, n_draws).collect())
    assert {(d, s): int(w[d]) for s, w in weights.items() for d in range(n_draws) if w[d]} == want
    long = bootstrap_vectors.long_table(df, {"A": ("a", "pa"), "B": ("b", "pb")})
    table = bootstrap_vectors.draw_metrics(long, sessions, n_draws)
    found = {(r.Model, r.draw): r for r in table.collect()}
    assert len(found) == 2 * n_draws
    by_session = defaultdict(list)
    for e in edges:
        by_session[int(e[0][1:])].append(e)
    f1 = {}
    for d in range(n_draws):
        taken = [e for s in range(11) for e in by_session[s] * want[d, s]]
        for model, score, pred in (("A", 2, 3), ("B", 4, 5)):
            expected = plain_metrics([(e[1], e[score], e[pred]) for e in taken])
            r = found[model, d]
            f1[model, d] = expected[2]
            for got, value in zip((r.Precision, r.Recall, r.F1, r.AUC, r.AP), expected):
                assert got == (None if value is None else pytest.approx(value, abs=1e-12))
    row = bootstrap_vectors.paired_differences(table, "A", n_draws).collect()
    assert len(row) == 1 and row[0].Baseline == "B"
    assert row[0].F1_Difference_Mean == pytest.approx(np.mean([f1["A", d] - f1["B", d] for d in range(n_draws)]), abs=1e-12)
    means = {(r.Model, r.Metric): r for r in bootstrap_vectors.model_intervals(table, n_draws).collect()}
    assert len(means) == 10 and means["A", "F1"].CI_Upper == pytest.approx(np.quantile([f1["A", d] for d in range(n_draws)], 0.975), abs=1e-12)


def test_rows_follow_scores_not_draws(spark):
    """No stage of the plan has sessions times draws rows: draws are made inside packed vectors only."""
    sessions = spark.range(50).selectExpr("id as session_idx", "concat('s', id) as session_id")
    assert bootstrap_vectors.weight_vectors(sessions, 300).count() == 50


def test_rates_alone_and_narrow_vectors(spark, monkeypatch):
    """Without ranking no vector of a score is made; counts travel as bytes, not as doubles."""
    monkeypatch.setattr(bootstrap_vectors, "VECTORS_AT_ONCE", 1)
    monkeypatch.setattr(bootstrap_vectors, "SESSIONS_A_SLICE", 2)
    monkeypatch.setattr(bootstrap_vectors, "SLICES_AT_ONCE", 2)
    edges = [(f"s{s}", int((s + e) % 3 == 0), (s * 7 + e) % 11 / 11, int((s + e) % 2)) for s in range(12) for e in range(1 + s % 4)]
    df = spark.createDataFrame(edges, "session_id string, edge_label int, a double, pa int")
    sessions = spark.createDataFrame([(f"s{s}", s) for s in range(12)], "session_id string, session_idx long")
    long = bootstrap_vectors.long_table(df, {"A": ("a", "pa")})
    whole = {r.draw: r for r in bootstrap_vectors.draw_metrics(long, sessions, 9).collect()}
    rates = bootstrap_vectors.draw_metrics(long, sessions, 9, ranking=False)
    assert rates.columns == ["Model", "draw", "Precision", "Recall", "F1"]
    found = rates.collect()
    assert len(found) == 9 and all((r.Precision, r.Recall, r.F1) == (whole[r.draw].Precision, whole[r.draw].Recall, whole[r.draw].F1) for r in found)
    cells = spark.createDataFrame([(s, c, 1 + s, 0) for s in range(12) for c in (3, 300)], "session_idx long, code long, pos long, neg long")
    rows = bootstrap_vectors._weighted(cells, sessions, 9, 42).collect()
    assert sorted(r.code for r in rows) == [3, 300]
    assert all(len(r.a) == 9 and r.b is None for r in rows)


def test_queries_make_no_row_a_session_and_draw(spark, monkeypatch, tmp_path):
    from turnweave.plans import queries

    text = lambda n: " ".join(f"word{(n * 7 + i * i) % 23}thing" for i in range(12))
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", text(c * 5 + t)) for c in range(100) for t in range(4 + c % 5)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(queries, "DRAWS", 15)
    test = queries._recovered(spark, str(tmp_path)).where("split = 'test'").withColumn("final_graph_score", F.round("final_graph_score", 6))
    test = test.withColumn("baseline_pred", F.col("stage1_pred_edge")).localCheckpoint()
    sessions = bootstrap.index_sessions(test, "session_id")
    draws = bootstrap.hashed_draws(sessions, 15)
    interval = bootstrap.bootstrap_ci(test, sessions, draws, 15, pred="final_graph_pred_edge", score="final_graph_score").collect()
    pair = bootstrap.paired_f1(test, sessions, draws, 15, model="final_graph_pred_edge").first()

    def refuse(*_, **__):
        raise AssertionError("a row a session and draw")

    monkeypatch.setattr(bootstrap, "hashed_draws", refuse)
    got = {r.Metric: r for r in queries.bootstrap_ci(spark, str(tmp_path)).collect()}
    assert set(got) == {r.Metric for r in interval}
    for r in interval:
        assert tuple(got[r.Metric])[1:4] == pytest.approx(tuple(r)[1:4], abs=1e-6) and got[r.Metric].BootstrapSamples == 15
    assert tuple(queries.bootstrap_paired_f1(spark, str(tmp_path)).first()) == pytest.approx(tuple(pair), abs=1e-6)
