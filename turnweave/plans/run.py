"""The staged run: score, retain, calibrate, recover, evaluate once on test.

Between steps everything stays lazy or is materialised as a table; the driver
sees a number only where a decision is made (threshold and cap, fitted model,
penalties) and the final metric rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts, evidence, metrics, recovery, retention, splits
from ..session import materialize


class HeldOut:
    """Keeps the test split out of reach until all parameters are frozen."""

    def __init__(self, frame: DataFrame):
        self._frame = frame
        self._frozen = False

    def freeze(self) -> None:
        self._frozen = True

    def read(self) -> DataFrame:
        if not self._frozen:
            raise RuntimeError("the test split was read before the parameters were frozen")
        return self._frame


@dataclass
class RunResult:
    final: DataFrame
    retention_search: DataFrame
    penalty_search: DataFrame
    audit: DataFrame
    params: dict


def split_frames(edges: DataFrame) -> tuple[DataFrame, DataFrame, HeldOut]:
    part = lambda name: edges.where(F.col("split") == name)
    return part("train"), part("validation"), HeldOut(part("test"))


def staged_run(
    edges: DataFrame,
    target_recall: float = retention.TARGET_RECALL,
    max_top_k: int = retention.MAX_TOP_K,
    lambda0_grid: Sequence[float] = recovery.LAMBDA0_GRID,
    lambdat_grid: Sequence[float] = recovery.LAMBDAT_GRID,
    calibrated: bool = True,
    guard_boundary: bool = True,
) -> RunResult:
    """``edges``: keys, ``stage1_prob``, ``edge_label``, ``split``."""
    base = materialize(edges)
    train, validation, held_out = split_frames(base)

    threshold, cap, search = retention.tune_retention(
        validation, target_recall=target_recall, max_top_k=max_top_k
    )
    keep = lambda df: retention.retain(df, threshold, cap)
    train, validation = keep(train), keep(validation)
    contracts.check_disjoint({"train": train, "validation": validation})

    if calibrated:
        model = evidence.fit_calibration(train)
        attach = lambda df: evidence.calibrated_evidence(df, model)
    else:
        attach = evidence.raw_evidence
    train, validation = attach(train), materialize(attach(validation))

    grid = materialize(recovery.penalty_grid(validation, lambda0_grid, lambdat_grid, limit=max_top_k))
    best = recovery.best_penalties(grid).first()
    lambda_0, lambda_t = float(best["lambda_0"]), float(best["lambda_t"])
    if guard_boundary:
        recovery.reject_upper_boundary("lambda_0", lambda_0, lambda0_grid)
        recovery.reject_upper_boundary("lambda_t", lambda_t, lambdat_grid)

    held_out.freeze()
    test = attach(keep(held_out.read()))
    every = train.unionByName(validation).unionByName(test)
    final = materialize(recovery.recover(every, lambda_0, lambda_t))
    audits = recovery.exactness_audit(final, lambda_0, lambda_t, limit=max_top_k)
    contracts.check_audit(audits)
    contracts.check_selected_only_candidates(final)
    params = {
        "selected_threshold": threshold,
        "selected_top_k": cap,
        "selected_lambda_0": lambda_0,
        "selected_lambda_t": lambda_t,
        "test_labels_used_for_fitting_or_selection": False,
    }
    return RunResult(final, search, grid, audits, params)


def split_summary(final: DataFrame) -> DataFrame:
    """Metric record per split."""
    return metrics.evaluate(final, "edge_label", "final_graph_pred_edge", "final_graph_score", ["split"])


PENALTY_CONDITIONS: Mapping[str, tuple[bool, bool]] = {
    "M0": (False, False),
    "M1": (True, False),
    "M2": (True, True),
}


def penalty_ablation(
    edges: DataFrame,
    lambda0_grid: Sequence[float] = recovery.LAMBDA0_GRID,
    lambdat_grid: Sequence[float] = recovery.LAMBDAT_GRID,
    limit: int = recovery.MAX_CANDIDATES_PER_TARGET,
) -> DataFrame:
    """No penalty, edge penalty only, both: selected on validation, all splits scored.

    The three conditions are parts of one grid, so one pass over all splits
    holds both the validation search and the results of the chosen settings.
    """
    grids = recovery.penalty_grid(
        edges, (0.0, *lambda0_grid), (0.0, *lambdat_grid), limit=limit, ranking=False, by=["split"]
    )
    search = grids.where(F.col("split") == "validation")
    order = F.struct("F1", "Precision", (-F.col("PredEdges")).alias("a"),
                     (-F.col("lambda_0")).alias("b"), (-F.col("lambda_t")).alias("c"))
    picks = None
    for name, (edge_on, target_on) in PENALTY_CONDITIONS.items():
        allowed = search
        if not edge_on:
            allowed = allowed.where(F.col("lambda_0") == 0.0)
        if not target_on:
            allowed = allowed.where(F.col("lambda_t") == 0.0)
        row = allowed.agg(F.max_by(F.struct("lambda_0", "lambda_t"), order).alias("s"))
        row = row.select(F.lit(name).alias("condition"), "s.lambda_0", "s.lambda_t")
        picks = row if picks is None else picks.unionByName(row)
    return grids.join(F.broadcast(picks), ["lambda_0", "lambda_t"]).select(
        "condition", "split", "lambda_0", "lambda_t", "Precision", "Recall", "F1", "PredEdges", "TP", "FP", "FN",
        "ObjectiveTotal",
    )


def evidence_ablation(edges: DataFrame, **options) -> DataFrame:
    """Raw score against recalibrated evidence, each with its own penalties."""
    out = None
    for name, calibrated in (("raw_stage1_prob", False), ("calibrated_lr", True)):
        result = staged_run(edges, calibrated=calibrated, guard_boundary=False, **options)
        rows = split_summary(result.final).select(
            F.lit(name).alias("condition"),
            "*",
            F.lit(result.params["selected_lambda_0"]).alias("selected_lambda_0"),
            F.lit(result.params["selected_lambda_t"]).alias("selected_lambda_t"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def compare_models(edges: DataFrame, models: Mapping[str, str], **options) -> DataFrame:
    """Thresholds from validation, metrics on validation and test, per model.

    ``models`` maps model names to score columns.  All models share one long
    table, so the number of jobs does not grow with their number.  Scores are
    written once (the threshold is a decision point) and then read twice.
    """
    pairs = F.array(
        *[F.struct(F.lit(n).alias("Model"), F.col(c).cast("double").alias("score")) for n, c in models.items()]
    )
    keys = ["edge_id", "session_id", "split", "edge_label"]
    long = materialize(edges.where(F.col("split") != "train").select(*keys, F.inline(pairs)))
    cuts = metrics.best_f1_threshold(
        long.where(F.col("split") == "validation"), "edge_label", "score", by=["Model"], **options
    ).select("Model", F.col("threshold").alias("Threshold"))
    decided = long.join(F.broadcast(cuts), "Model").withColumn(
        "pred", (F.col("score") >= F.col("Threshold")).cast("int")
    )
    table = metrics.evaluate(decided, "edge_label", "pred", "score", ["Model", "split"])
    return table.join(F.broadcast(cuts), "Model")


def decided_models(
    edges: DataFrame,
    models: Mapping[str, str],
    graph: tuple[str, str],
    k_values: Sequence[int] = (1, 2, 3, 5),
) -> DataFrame:
    """Predictions of every model with the parameters that validation selects for it.

    ``models`` maps names to score columns.  Each gives two models: a score cut,
    and ``<name> Top-K`` with a cut and a cap per source.  ``graph`` names score
    and prediction of the final graph, which has neither.  Rows of validation
    and test: keys, Model, score, pred, Threshold, TopK.
    """
    base = materialize(edges.where(F.col("split") != "train"))
    validation = base.where(F.col("split") == "validation")
    keys = ["edge_id", "session_id", "Q1_row", "Q2_row", "split", "edge_label"]
    none = F.lit(None)
    score, pred = graph
    out = base.select(
        *keys, F.lit("Final Graph").alias("Model"), F.col(score).cast("double").alias("score"), F.col(pred).cast("int").alias("pred"),
        none.cast("double").alias("Threshold"), none.cast("int").alias("TopK"),
    )
    for name, column in models.items():
        plain = metrics.best_f1_threshold(validation, "edge_label", column)
        plain = plain.select(F.lit(name).alias("Model"), F.col("threshold").alias("Threshold"), none.cast("int").alias("TopK"))
        capped = metrics.best_topk(metrics.topk_threshold_search(validation, k_values, score=column))
        capped = capped.select(F.lit(f"{name} Top-K"), "threshold", "top_k")
        ranked = metrics.with_source_rank(base, column, "_rank").crossJoin(F.broadcast(plain.union(capped)))  # two rows
        admitted = (F.col(column) >= F.col("Threshold")) & (F.col("TopK").isNull() | (F.col("_rank") <= F.col("TopK")))
        out = out.unionByName(
            ranked.select(
                *keys, "Model", F.col(column).cast("double").alias("score"), admitted.cast("int").alias("pred"), "Threshold", "TopK"
            )
        )
    return out


def full_comparison(decided: DataFrame, order: Sequence[str]) -> DataFrame:
    """Metrics with selected parameters per model and split, models in a fixed order."""
    params = ["Model", "split", "Threshold", "TopK"]
    table = metrics.evaluate(decided, "edge_label", "pred", "score", params)
    return splits.order_models(table, order)
