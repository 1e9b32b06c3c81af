import itertools
import random

import pytest
from pyspark.sql import functions as F

from turnweave.operators import recovery


def graph(spark, groups=40, seed=4):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        for i in range(rng.randint(1, 5)):
            r = rng.choice([-0.3, 0.1, 0.2, 0.35, 0.35, 0.5, 0.9])
            rows.append((f"{g}_{i}", f"s{g % 7}", i, g, int(rng.random() < 0.8), r, int(rng.random() < 0.4)))
    return spark.createDataFrame(
        rows,
        "edge_id string, session_id string, Q1_row int, Q2_row int, stage2_graph_input_pred int,"
        " stage2a_local_evidence double, edge_label int",
    ), rows


def solve(items, l0, lt):
    """Best prefix by plain loops; items sorted by (-evidence, row)."""
    best, top, prefix = 0, 0.0, 0.0
    for k, r in enumerate(items, start=1):
        prefix += r
        value = prefix - l0 * k - lt * k * (k - 1) / 2.0
        if value > top:
            best, top = k, value
    return best, top


def expected(rows, l0, lt):
    chosen, objective = set(), 0.0
    groups = {}
    for row in rows:
        if row[4]:
            groups.setdefault((row[1], row[3]), []).append(row)
    for items in groups.values():
        items.sort(key=lambda x: (-x[5], x[2]))
        k, top = solve([x[5] for x in items], l0, lt)
        objective += top
        chosen |= {x[0] for x in items[:k]}
    return chosen, objective, len(groups)


@pytest.mark.parametrize("l0,lt", [(0.0, 0.0), (0.2, 0.15), (0.35, 0.0), (0.1, 0.5)])
def test_recovery_matches_loops(spark, l0, lt):
    df, rows = graph(spark)
    out = recovery.recover(df.repartition(3), l0, lt)
    want, objective, groups = expected(rows, l0, lt)
    assert {r["edge_id"] for r in out.where("final_graph_pred_edge = 1").collect()} == want
    totals = recovery.recovery_totals(out, l0, lt).first()
    assert totals["target_groups"] == groups and abs(totals["objective_total"] - objective) < 1e-9
    audit = recovery.exactness_audit(out, l0, lt).first()
    assert audit["passed"] and audit["candidate_target_groups"] == groups
    outside = out.where("stage2_graph_input_pred = 0").agg(F.max("final_graph_score"), F.max("final_graph_pred_edge")).first()
    assert tuple(outside) == (0.0, 0)


def test_audit_finds_a_wrong_edge(spark):
    df, _ = graph(spark)
    out = recovery.recover(df, 0.2, 0.15)
    broken = out.withColumn("final_graph_pred_edge", F.col("stage2_graph_input_pred"))
    assert not recovery.exactness_audit(broken, 0.2, 0.15).first()["passed"]


def test_tie_prefers_fewer_edges(spark):
    df = spark.createDataFrame(
        [("a", "s", 0, 1, 1, 0.2, 1)],
        "edge_id string, session_id string, Q1_row int, Q2_row int, stage2_graph_input_pred int,"
        " stage2a_local_evidence double, edge_label int",
    )
    row = recovery.recover(df, 0.2, 0.0).first()
    assert row["final_graph_pred_edge"] == 0 and row["stage2_graph_target_degree"] == 0


def test_grid_equals_single_runs(spark):
    df, rows = graph(spark)
    l0s, lts = (0.0, 0.2, 0.4), (0.0, 0.15)
    grid = {(r["lambda_0"], r["lambda_t"]): r for r in recovery.penalty_grid(df, l0s, lts).collect()}
    label = {r[0]: r[6] for r in rows}
    for l0, lt in itertools.product(l0s, lts):
        want, objective, _ = expected(rows, l0, lt)
        got = grid[(l0, lt)]
        assert got["PredEdges"] == len(want) and got["TP"] == sum(label[e] for e in want)
        assert abs(got["ObjectiveTotal"] - objective) < 1e-9
        from turnweave.operators import metrics

        one = metrics.ranking_metrics(recovery.recover(df, l0, lt), "edge_label", "final_graph_score").first()
        assert abs(got["AUC"] - one["auc"]) < 1e-9 and abs(got["AP"] - one["ap"]) < 1e-9


def test_grid_refuses_crowded_targets(spark):
    df, _ = graph(spark)
    crowded = df.withColumn("Q2_row", F.lit(1)).withColumn("session_id", F.lit("s"))
    with pytest.raises(Exception, match="more than 5 candidates"):
        recovery.penalty_grid(crowded, (0.0,), (0.0,), ranking=False).collect()


def test_boundary_guard():
    recovery.reject_upper_boundary("x", 0.1, (0.0, 0.1, 0.2))
    recovery.reject_upper_boundary("x", 0.1, (0.1,))
    with pytest.raises(RuntimeError):
        recovery.reject_upper_boundary("x", 0.2, (0.0, 0.1, 0.2))


@pytest.mark.parametrize("shift", [0.0, 0.0131])
def test_grid_counts_candidates_and_solves_ties(spark, monkeypatch, shift):
    """Away from thresholds no target is solved by itself; both ways give the results of the loops."""
    _, rows = graph(spark, 60, 9)
    rows = [(*r[:5], round(r[5] + shift, 6), r[6]) for r in rows]
    df = spark.createDataFrame(rows, "edge_id string, session_id string, Q1_row int, Q2_row int, stage2_graph_input_pred int, stage2a_local_evidence double, edge_label int")
    if shift:
        monkeypatch.setattr(recovery, "_solved", None)
    label = {r[0]: r[6] for r in rows}
    l0s, lts = (0.0, 0.1, 0.2, 0.35), (0.0, 0.05, 0.15)
    grid = {(r["lambda_0"], r["lambda_t"]): r for r in recovery.penalty_grid(df, l0s, lts, ranking=False).collect()}
    assert len(grid) == len(l0s) * len(lts)
    for (l0, lt), got in grid.items():
        want, objective, _ = expected(rows, l0, lt)
        assert got["PredEdges"] == len(want) and got["TP"] == sum(label[e] for e in want)
        assert abs(got["ObjectiveTotal"] - objective) < 1e-9


def test_audit_values_every_subset(spark, monkeypatch):
    """In small steps and without a row per subset, the audit still finds the one wrong target."""
    monkeypatch.setattr(recovery, "SUBSETS_AT_ONCE", 40)
    df, rows = graph(spark, 30, 11)
    out = recovery.recover(df, 0.2, 0.15)
    sizes = {}
    for r in rows:
        if r[4]:
            sizes[r[1], r[3]] = sizes.get((r[1], r[3]), 0) + 1
    assert "mask" not in recovery.exactness_audit(out, 0.2, 0.15)._jdf.queryExecution().optimizedPlan().toString()
    row = recovery.exactness_audit(out, 0.2, 0.15).first()
    assert row["enumerated_subsets"] == sum(2**m for m in sizes.values()) and row["max_candidates_per_target"] == max(sizes.values())
    one = next(r for r in rows if r[4] and r[5] > 0.3 and sizes[r[1], r[3]] == 1)
    wrong = out.withColumn("final_graph_pred_edge", F.when(F.col("edge_id") == one[0], 0).otherwise(F.col("final_graph_pred_edge")))
    row = recovery.exactness_audit(wrong, 0.2, 0.15).first()
    assert row["objective_mismatches"] == 1 and not row["passed"] and row["max_objective_gap"] == pytest.approx(one[5] - 0.2)
