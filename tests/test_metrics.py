import math
import random

import pytest
from pyspark.sql import functions as F

from turnweave.operators import bootstrap, metrics, retention


def frame(spark, n=150, seed=2, ties=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        score = round(rng.random(), 1 if ties else 6)
        rows.append((i, "s%d" % (i % 6), i % 6, i // 6 % 5, i, int(rng.random() < 0.3 + 0.4 * score), score))
    return spark.createDataFrame(
        rows, "id int, session_id string, sid int, Q1_row int, Q2_row int, edge_label int, score double"
    ), rows


def auc_ap(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    if not pos or not neg:
        return None, None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    ap, last = 0.0, 0.0
    for cut in sorted({s for s, _ in pairs}, reverse=True):
        tp = sum(1 for s, y in pairs if s >= cut and y)
        k = sum(1 for s, _ in pairs if s >= cut)
        ap += (tp / len(pos) - last) * tp / k
        last = tp / len(pos)
    return wins / (len(pos) * len(neg)), ap


def test_auc_ap_against_pair_counts(spark):
    df, rows = frame(spark)
    want = auc_ap([(r[6], r[5]) for r in rows])
    for options in ({}, {"slices": 3}, {"boundaries": [0.2, 0.55]}):
        got = metrics.ranking_metrics(df, **options).first()
        assert abs(got["auc"] - want[0]) < 1e-12 and abs(got["ap"] - want[1]) < 1e-12
    single = metrics.ranking_metrics(df.where("edge_label = 1")).first()
    assert single["auc"] is None and single["ap"] is None


def test_evaluate_equals_its_parts(spark):
    df, _ = frame(spark)
    df = df.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    whole = metrics.evaluate(df).first().asDict()
    parts = {**metrics.confusion(df).first().asDict(), **metrics.ranking_metrics(df).first().asDict()}
    assert all(abs(whole[k] - v) < 1e-12 for k, v in parts.items())


def best_cut(rows, eligible):
    total = sum(y for _, y, _ in rows)
    best = None
    for cut in {s for s, _, ok in rows if eligible(ok)}:
        chosen = [y for s, y, ok in rows if eligible(ok) and s >= cut]
        tp, n = sum(chosen), len(chosen)
        key = (2 * tp / (n + total), tp / n, -n, cut)
        best = key if best is None or key > best else best
    return best


def test_exact_threshold(spark):
    df, rows = frame(spark)
    flat = [(r[6], r[5], r[0] % 2 == 0) for r in rows]
    got = metrics.best_f1_threshold(df).first()
    assert abs(got["threshold"] - best_cut(flat, lambda _: True)[3]) < 1e-12
    got = metrics.best_f1_threshold(df, eligible=F.col("id") % 2 == 0).first()
    want = best_cut(flat, lambda ok: ok)
    assert abs(got["threshold"] - want[3]) < 1e-12 and abs(got["f1"] - want[0]) < 1e-12
    none = metrics.best_f1_threshold(df, eligible=F.lit(False)).first()
    assert math.isinf(none["threshold"]) and none["f1"] == 0.0 and none["pred_edges"] == 0


def source_ranks(rows):
    ranks = {}
    for r in rows:
        better = [o for o in rows if o[1] == r[1] and o[3] == r[3] and (-o[6], o[4]) < (-r[6], r[4])]
        ranks[r[0]] = len(better) + 1
    return ranks


def test_first_come_ranks(spark):
    df = spark.createDataFrame(
        [("s", 0, j, s) for j, s in enumerate([0.5, 0.7, 0.5, 0.7])], "session_id string, Q1_row int, Q2_row int, p double"
    )
    out = metrics.with_source_rank(df, "p").orderBy("Q2_row").collect()
    assert [r["source_rank"] for r in out] == [3, 1, 4, 2]


@pytest.mark.parametrize("recall", [0.6, 0.98])
def test_retention_search_against_loops(spark, recall):
    df, rows = frame(spark)
    ranks = source_ranks(rows)
    search = {r["TopK"]: r for r in retention.retention_search(df, "score", target_recall=recall).collect()}
    total = sum(r[5] for r in rows)
    need = math.ceil(recall * total - 1e-12)
    for k in range(1, 6):
        inside = [r for r in rows if ranks[r[0]] <= k]
        positive = sorted((r[6] for r in inside if r[5]), reverse=True)
        feasible = len(positive) >= need
        assert search[k]["Feasible"] == feasible
        cut = positive[need - 1] if feasible else None
        assert search[k]["Threshold"] == cut
        kept = [r for r in inside if cut is None or r[6] >= cut]
        assert search[k]["RetainedEdges"] == len(kept)
        assert search[k]["TruePositives"] == sum(r[5] for r in kept)
    if any(r["Feasible"] for r in search.values()):
        cut, cap, _ = retention.tune_retention(df, score="score", target_recall=recall)
        kept = retention.retain(df, cut, cap, "score")
        hit = kept.where("edge_label = 1 and stage1_pred_edge = 1").count()
        assert hit >= need
        assert retention.retention_mismatches(kept, cut, cap, "score").first()["mismatches"] == 0


def test_topk_search_against_loops(spark):
    df, rows = frame(spark)
    ranks = source_ranks(rows)
    for r in metrics.topk_threshold_search(df, (1, 3)).collect():
        want = best_cut([(x[6], x[5], ranks[x[0]] <= r["top_k"]) for x in rows], lambda ok: ok)
        assert abs(r["threshold"] - want[3]) < 1e-12 and abs(r["f1"] - want[0]) < 1e-12


def test_seeded_bootstrap_replays_numpy(spark):
    import numpy as np

    df, rows = frame(spark)
    df = df.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    sessions = bootstrap.index_sessions(df, "sid")
    draws = bootstrap.seeded_draws(spark, 6, 40, 42)
    got = {r["Metric"]: r for r in bootstrap.bootstrap_ci(df, sessions, draws, 40).collect()}
    rng = np.random.default_rng(42)
    f1, auc = [], []
    for _ in range(40):
        boot = [r for i in rng.integers(0, 6, size=6) for r in rows if r[2] == i]
        tp = sum(r[5] for r in boot if r[6] >= 0.5)
        n, total = sum(r[6] >= 0.5 for r in boot), sum(r[5] for r in boot)
        f1.append(2 * tp / (n + total))
        auc.append(auc_ap([(r[6], r[5]) for r in boot])[0])
    assert abs(got["F1"]["BootstrapMean"] - np.mean(f1)) < 1e-12
    assert abs(got["F1"]["CI_Lower"] - np.quantile(f1, 0.025)) < 1e-12
    assert abs(got["AUC"]["CI_Upper"] - np.quantile(auc, 0.975)) < 1e-12
    # the salted join, without adaptive execution, gives the same draws
    a = bootstrap.draw_ranking(df, sessions, draws, "edge_label", "score")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        b = bootstrap.draw_ranking(df, sessions, draws, "edge_label", "score").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    rows_of = lambda t: sorted((r["draw"], round(r["AUC"], 12)) for r in t)
    assert rows_of(a.collect()) == rows_of(b)


def test_hashed_draws_and_hash_index(spark):
    df, _ = frame(spark)
    sessions = bootstrap.index_sessions(df, slices=3)
    assert sorted(r["session_idx"] for r in sessions.collect()) == list(range(6))
    draws = bootstrap.hashed_draws(sessions, 20)
    per = draws.groupBy("draw").agg(F.sum("weight").alias("n")).collect()
    assert len(per) == 20 and {r["n"] for r in per} == {6}
