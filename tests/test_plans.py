import math
import random

import pytest
from pyspark.sql import functions as F

from turnweave.operators import contracts, evidence, graph, recovery, retention, scorers, splits
from turnweave.plans import queries, run, tables
from turnweave.session import lookup_join
from turnweave.sources import readers, writers

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scored(spark, n_sessions=30, seed=8):
    rng = random.Random(seed)
    rows = []
    for s in range(n_sessions):
        for i in range(8):
            for j in range(i + 1, min(i + 6, 8)):
                y = int(rng.random() < 0.3)
                p = round(min(max(rng.gauss(0.35 + 0.3 * y, 0.2), 0.01), 0.99), 3)
                rows.append((f"{s}_{i}_{j}", f"s{s}", i, j, j - i, p, y, ("train", "validation", "test")[s % 3]))
    return spark.createDataFrame(
        rows,
        "edge_id string, session_id string, Q1_row int, Q2_row int, distance int, stage1_prob double, edge_label int, split string",
    )


def test_one_exchange_from_scan_to_graph(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = tables.narrow_edges(spark, SF)
        kept = retention.retain(edges, 0.2, 3)
        text = plan(kept)
        assert text.count("Exchange hashpartitioning") == 1
        scan = [line for line in plan(tables.records(spark, SF).select("session_id", "pos")).split("\n") if "FileScan" in line]
        assert "text" not in scan[0].split("ReadSchema:")[1]
        top = plan(kept.select("edge_id", "source_rank") if "source_rank" in kept.columns else
                   edges.select("edge_id"))
        assert "BatchEvalPython" not in top and "ArrowEvalPython" not in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_text_is_shuffled_where_none_is_read(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def exchanged(df):
            """The output columns of all exchanges."""
            found, stack = [], [df._jdf.queryExecution().executedPlan()]
            while stack:
                node = stack.pop()
                if "ShuffleExchange" in node.getClass().getSimpleName():
                    found.append(node.output().mkString(","))
                stack += [node.children().apply(i) for i in range(node.children().size())]
            return found

        for name in ("candidate_distance_hist", "candidate_edges_w3", "interaction_channels", "cue_flags"):
            assert all("text" not in columns for columns in exchanged(queries.REGISTRY[name](spark, SF)))
        narrow = exchanged(tables.narrow_edges(spark, SF))
        assert len(narrow) == 1 and "_text" not in narrow[0] and "_own_terms" in narrow[0]
        whole = exchanged(tables.edges(spark, SF))
        assert len(whole) == 1 and whole[0].count("_text") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rank_filter_prunes_before_the_shuffle(spark):
    from turnweave.operators.metrics import with_source_rank

    ranked = with_source_rank(scored(spark).repartition(4), "stage1_prob").where("source_rank <= 2")
    assert "WindowGroupLimit" in plan(ranked)


def test_held_out_split_is_guarded(spark):
    held = run.HeldOut(scored(spark))
    with pytest.raises(RuntimeError):
        held.read()
    held.freeze()
    assert held.read().count() > 0


def test_staged_run_is_exact_and_repeatable(spark):
    edges = scored(spark)
    first = run.staged_run(edges, target_recall=0.8, guard_boundary=False)
    second = run.staged_run(edges.repartition(5), target_recall=0.8, guard_boundary=False)
    assert first.params == second.params
    picked = lambda r: {x["edge_id"] for x in r.final.where("final_graph_pred_edge = 1").collect()}
    assert picked(first) == picked(second)
    assert all(r["passed"] for r in first.audit.collect())
    validation = first.final.where("split = 'validation'")
    recall = validation.where("edge_label = 1").agg(F.avg("stage1_pred_edge")).first()[0]
    assert recall >= 0.8
    contracts.check_partition(validation, "validation")


def test_calibration_matches_a_newton_fit(spark):
    """Scaler and balanced, fully penalised logistic regression, C = 1."""
    import numpy as np

    edges = retention.retain(scored(spark), 0.0, 5).where("split = 'train'")
    model = evidence.fit_calibration(edges)
    data = edges.where("stage1_pred_edge = 1").select("stage1_prob", "edge_label").toPandas()
    x, y = data["stage1_prob"].to_numpy(), data["edge_label"].to_numpy()
    z = np.column_stack([(x - x.mean()) / x.std(), np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (w * (p - y)) + beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + np.eye(2)
        beta -= np.linalg.solve(hess, grad)
    want = 1 / (1 + np.exp(-z @ beta))
    kept = edges.where("stage1_pred_edge = 1")
    got = kept.select(model.probability(F.col("stage1_prob")).alias("q")).toPandas()["q"]
    assert np.max(np.abs(np.sort(got) - np.sort(want))) < 1e-9
    out = evidence.calibrated_evidence(kept, model).agg(F.min("stage2a_local_prob"), F.max("stage2a_local_prob")).first()
    assert abs(out[0] - want.min()) < 1e-9 and abs(out[1] - want.max()) < 1e-9


def test_logistic_scorer_matches_a_newton_fit(spark):
    """Free intercept, population scaling, balanced weights, C = 1."""
    import numpy as np

    edges = scored(spark).withColumn("d", F.col("distance").cast("double"))
    model = scorers.fit_logistic(edges, ["stage1_prob", "d"])
    data = edges.select("edge_id", "stage1_prob", "d", "edge_label").toPandas()
    x, y = data[["stage1_prob", "d"]].to_numpy(), data["edge_label"].to_numpy()
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    want = dict(zip(data["edge_id"], 1 / (1 + np.exp(-z @ beta))))
    got = scorers.predict(edges, model, ["stage1_prob", "d"], "q").select("edge_id", "q").collect()
    assert max(abs(r["q"] - want[r["edge_id"]]) for r in got) < 1e-6
    assert {c[0] for c in scorers.coefficients(model, ["stage1_prob", "d"])} == {"stage1_prob", "d"}


def test_salted_lookup_equals_broadcast(spark):
    left = spark.range(500).withColumn("k", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7))
    right = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a = lookup_join(left, right, ["k"], F.col("id"))
    b = lookup_join(left, right, ["k"], F.col("id"), salts=8)
    assert a.select("id", "v").exceptAll(b.select("id", "v")).isEmpty() and b.count() == 500


def test_alignment_checks(spark):
    ref = spark.createDataFrame([("a",), ("b",)], "edge_id string")
    good = spark.createDataFrame([("b", 1), ("a", 0), ("c", 1)], "edge_id string, final_graph_pred_edge int")
    assert {tuple(r) for r in splits.align(ref, good).collect()} == {("a", 0), ("b", 1)}
    for bad in (good.where("edge_id <> 'a'"), good.unionByName(good)):
        with pytest.raises(Exception):
            splits.align(ref, bad).collect()


def test_contract_reports_every_violation(spark):
    edges = retention.retain(scored(spark), 0.1, 2)
    contracts.check_partition(edges, "ok")
    broken = edges.withColumn("stage1_prob", F.lit(1.5)).withColumn("edge_label", F.lit(2)).unionByName(
        edges.withColumn("edge_label", F.lit(2)).limit(1)
    )
    with pytest.raises(RuntimeError) as error:
        contracts.check_partition(broken, "x", {"rows": 1})
    for word in ("repeated_edge_ids", "bad_labels", "bad_probabilities", "expected 1"):
        assert word in str(error.value)
    contracts.check_retention(edges, "x", 0.1, 2)
    with pytest.raises(RuntimeError):
        contracts.check_retention(edges, "x", 0.5, 1)
    with pytest.raises(RuntimeError):
        contracts.check_disjoint({"a": edges, "b": edges})


def test_graph_aggregation(spark):
    edges = spark.createDataFrame([("s", 0, 1), ("s", 0, 2), ("s", 1, 2)], "session_id string, Q1_row int, Q2_row int")
    nodes = spark.createDataFrame(
        [("s", 0, "source", [1.0, 0.0]), ("s", 1, "source", [3.0, 2.0]), ("s", 1, "target", [0.0, 4.0]), ("s", 2, "target", [2.0, 2.0])],
        "session_id string, row int, role string, x array<double>",
    )
    both = {(r["row"], r["role"]): r["neigh"] for r in graph.mean_aggregation(nodes, edges).collect()}
    assert both[(0, "source")] == [1.0, 2.0] and both[(2, "target")] == [2.0, 4 / 3]
    split = {(r["row"], r["role"]): (r["incoming"], r["outgoing"]) for r in graph.in_out_aggregation(nodes, edges).collect()}
    assert split[(2, "target")] == ([2.0, 1.0], [0.0, 0.0]) and split[(0, "source")] == ([0.0, 0.0], [1.0, 3.0])


def test_tables_and_caches(spark, tmp_path):
    edges = scored(spark, 3)
    path = writers.write_table(edges, str(tmp_path / "edges"), ["split"])
    assert readers.read_edges(spark, path, ["edge_id", "stage1_prob"]).count() == edges.count()
    assert (tmp_path / "edges" / "split=train").is_dir()
    writers.export_csv(edges, str(tmp_path / "x.csv"), single=True)
    assert readers.read_edges(spark, str(tmp_path / "x.csv")).count() == edges.count()
    files = [f.read_bytes() for f in (tmp_path / "x.csv").glob("*.csv")]
    assert len(files) == 1 and files[0].startswith(b"\xef\xbb\xbf" + edges.columns[0].encode() + b",")
    back = readers.read_edges(spark, str(tmp_path / "x.csv"), ["edge_id"]).collect()
    assert {r.edge_id for r in back} == {r.edge_id for r in edges.collect()}
    meta = {"model": "m", "k": 3}
    cache = writers.cache_path(str(tmp_path), "Score Fusion", meta)
    assert readers.read_score_cache(spark, cache, meta) is None
    writers.write_score_cache(edges.select("edge_id", "stage1_prob"), cache, meta)
    assert readers.read_score_cache(spark, cache, meta).count() == edges.count()
    assert readers.read_score_cache(spark, cache, {"model": "m", "k": 4}) is None
    record = writers.write_json_record({"a": 1}, str(tmp_path / "r" / "p.json"))
    assert readers.read_json_record(record) == {"a": 1}
    assert writers.freeze_manifest({"all": edges})["all"]["sessions"] == 3
    assert readers.resume_edges(spark, str(tmp_path / "none")) is None


def test_case_guard(spark):
    edges = retention.retain(scored(spark, 3), 0.0, 5)
    graph_ = recovery.recover(
        edges.withColumn("stage2_graph_input_pred", F.col("stage1_pred_edge")).withColumn("stage2a_local_evidence", F.lit(1.0)), 0.0, 0.0
    )
    case = contracts.check_case(graph_, "s0", 3, (3, 3, 3))
    assert [r["Q1_row"] for r in case.collect()] == [0, 1, 2]
    with pytest.raises(RuntimeError):
        contracts.check_case(graph_, "s0", 3, (5, 3, 1))
    assert math.isclose(graph_.agg(F.max("final_graph_score")).first()[0], 1 / (1 + math.exp(-1.0)))
