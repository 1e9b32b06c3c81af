"""Stage-by-stage records of a run, and their one-row-per-split summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .metrics import confusion, ranking_metrics

# Column order of a stage record.
STAGE_COLUMNS = (
    "total_edges true_edges pred_edges candidate_retention_ratio candidate_compression_ratio "
    "stage1_gold_edge_recall stage1_precision stage1_recall stage1_f1 stage1_tp stage1_fp stage1_fn "
    "stage1_tn stage1_auc stage1_ap stage2a_auc stage2a_ap stage2b_input_pred_edges "
    "stage2b_final_pred_edges stage2b_deleted_edges stage2b_deleted_tp stage2b_deleted_fp "
    "stage2b_deleted_fn stage2b_precision stage2b_recall stage2b_f1 stage2b_auc stage2b_ap"
).split()

RETENTION, CALIBRATION, RECOVERY = (
    "stage1_candidate_retention",
    "stage2a_local_calibration",
    "stage2b_structured_recovery",
)


def _record(df: DataFrame, stage: str, note: str, filled: dict[str, Column]) -> DataFrame:
    columns = [filled.get(c, F.lit(None)).cast("double").alias(c) for c in STAGE_COLUMNS]
    return df.select("split", F.lit(stage).alias("stage"), *columns, F.lit(note).alias("notes"))


def _ranks(df: DataFrame, score: str) -> DataFrame:
    return ranking_metrics(df, "edge_label", score, ["split"]).select("split", "auc", "ap")


def retention_record(df: DataFrame) -> DataFrame:
    base = confusion(df, "edge_label", "stage1_pred_edge", ["split"]).join(_ranks(df, "stage1_prob"), "split")
    kept = ratio(F.col("pred_edges"), F.col("total"), None)
    filled = {
        "total_edges": F.col("total"),
        "true_edges": F.col("true_edges"),
        "pred_edges": F.col("pred_edges"),
        "candidate_retention_ratio": kept,
        "candidate_compression_ratio": 1.0 - kept,
        "stage1_gold_edge_recall": F.col("recall"),
        **{f"stage1_{c}": F.col(c) for c in ("precision", "recall", "f1", "tp", "fp", "fn", "tn", "auc", "ap")},
    }
    return _record(base, RETENTION, "Stage 1 source-conditioned candidate retention.", filled)


def calibration_record(df: DataFrame) -> DataFrame:
    base = ranking_metrics(df, "edge_label", "stage2a_local_prob", ["split"])
    filled = {
        "total_edges": F.col("total"),
        "true_edges": F.col("true_edges"),
        "stage2a_auc": F.col("auc"),
        "stage2a_ap": F.col("ap"),
    }
    return _record(base, CALIBRATION, "Stage 2A candidate-set ranking and calibration.", filled)


def recovery_record(df: DataFrame) -> DataFrame:
    y = F.col("edge_label").cast("int") == 1
    given = F.col("stage2_graph_input_pred").cast("int") == 1
    final = F.col("final_graph_pred_edge").cast("int") == 1
    deleted = given & ~final
    extra = df.groupBy("split").agg(
        F.count_if(given).alias("_given"),
        F.count_if(deleted).alias("_del"),
        F.count_if(deleted & y).alias("_del_tp"),
        F.count_if(deleted & ~y).alias("_del_fp"),
        F.count_if(y & ~given).alias("_del_fn"),
    )
    base = (
        confusion(df, "edge_label", "final_graph_pred_edge", ["split"])
        .join(extra, "split")
        .join(_ranks(df, "final_graph_score"), "split")
    )
    filled = {
        "total_edges": F.col("total"),
        "true_edges": F.col("true_edges"),
        "stage2b_input_pred_edges": F.col("_given"),
        "stage2b_final_pred_edges": F.col("pred_edges"),
        "stage2b_deleted_edges": F.col("_del"),
        "stage2b_deleted_tp": F.col("_del_tp"),
        "stage2b_deleted_fp": F.col("_del_fp"),
        "stage2b_deleted_fn": F.col("_del_fn"),
        **{f"stage2b_{c}": F.col(c) for c in ("precision", "recall", "f1", "auc", "ap")},
    }
    return _record(base, RECOVERY, "Stage 2B exact target-wise graph recovery.", filled)


def stage_records(final: DataFrame) -> DataFrame:
    """All three records of a final graph that carries a ``split`` column."""
    return reduce(
        DataFrame.unionByName,
        [retention_record(final), calibration_record(final), recovery_record(final)],
    )


def transition_summary(records: DataFrame, lambda_0: float | None, lambda_t: float | None) -> DataFrame:
    """One row per split, picking each figure from the stage that owns it."""
    def pick(stage: str, column: str, name: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(column))).alias(name)

    own = [
        (RETENTION, "total_edges", "raw_candidates"),
        (RETENTION, "true_edges", "raw_true_edges"),
        (RETENTION, "pred_edges", "stage1_retained_edges"),
        (RETENTION, "stage1_gold_edge_recall", "stage1_gold_edge_recall"),
        (RETENTION, "candidate_compression_ratio", "stage1_compression_ratio"),
        (CALIBRATION, "stage2a_auc", "stage2a_auc"),
        (CALIBRATION, "stage2a_ap", "stage2a_ap"),
    ] + [
        (RECOVERY, f"stage2b_{c}", f"stage2b_{c}")
        for c in (
            "input_pred_edges", "final_pred_edges", "deleted_edges", "deleted_tp", "deleted_fp",
            "precision", "recall", "f1", "auc", "ap",
        )
    ]
    summary = records.groupBy("split").agg(*[pick(*item) for item in own])
    number = lambda v: F.lit(None if v is None else float(v)).cast("double")
    return summary.withColumn("selected_lambda_0", number(lambda_0)).withColumn(
        "selected_lambda_t", number(lambda_t)
    )
