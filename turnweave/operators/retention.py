"""Source-conditioned candidate retention and its recall-constrained tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import f1_score, ratio
from .metrics import apply_threshold, running_counts, score_histogram, with_source_rank

TARGET_RECALL = 0.98
MAX_TOP_K = 5


def retain(
    edges: DataFrame,
    threshold: float,
    top_k: int,
    score: str = "stage1_prob",
    name: str = "stage1_pred_edge",
) -> DataFrame:
    """Keep an edge when its score reaches the cut and it ranks within the cap.

    The rank counts every candidate of the source, not only those over the cut.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    return apply_threshold(edges, score, threshold, top_k, name)


def retention_search(
    edges: DataFrame,
    score: str = "stage1_prob",
    label: str = "edge_label",
    target_recall: float = TARGET_RECALL,
    max_top_k: int = MAX_TOP_K,
    **options,
) -> DataFrame:
    """For each cap, the largest cut that still reaches the target recall.

    The cut is an order statistic of the positives within the cap, read off the
    running counts.  Infeasible caps stay in the table, with a null threshold
    and the counts of the cap alone.
    """
    if not 0.0 < target_recall <= 1.0:
        raise ValueError("target_recall must be in (0, 1]")
    if max_top_k < 1:
        raise ValueError("max_top_k must be at least 1")
    narrow = edges.select("session_id", "Q1_row", "Q2_row", score, label)
    ranked = with_source_rank(narrow, score, "_rank")
    admitted = ranked.where(F.col("_rank") <= max_top_k).withColumn(
        "TopK", F.explode(F.sequence(F.col("_rank"), F.lit(max_top_k)))
    )
    curve = running_counts(score_histogram(admitted, label, score, ["TopK"]), ["TopK"], **options)
    positive = F.col(label).cast("int") == 1
    totals = edges.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(positive).alias("_pos"))
    totals = totals.withColumn(
        "_need", F.ceil(F.lit(float(target_recall)) * F.col("_pos") - 1e-12).cast("long")
    )
    reached = F.col("cum_pos") >= F.col("_need")
    point = F.struct("score", "cum_pos", "cum_neg")
    caps = (
        curve.crossJoin(F.broadcast(totals))
        .groupBy("TopK", "_rows", "_pos", "_need")
        .agg(
            F.sum("pos").alias("_cap_pos"),
            F.sum("neg").alias("_cap_neg"),
            F.max(F.when(reached, point)).alias("_cut"),
        )
    )
    feasible = F.col("_cap_pos") >= F.col("_need")
    tp = F.when(feasible, F.col("_cut.cum_pos")).otherwise(F.col("_cap_pos"))
    fp = F.when(feasible, F.col("_cut.cum_neg")).otherwise(F.col("_cap_neg"))
    fn = F.col("_pos") - tp
    return caps.select(
        "TopK",
        F.when(feasible, F.col("_cut.score")).alias("Threshold"),
        feasible.alias("Feasible"),
        F.lit(float(target_recall)).alias("TargetRecall"),
        F.col("_need").alias("RequiredPositiveEdges"),
        F.col("_pos").alias("ValidationPositiveEdges"),
        ratio(F.col("_cap_pos"), F.col("_pos")).alias("MaxRecallAtK"),
        ratio(tp, F.col("_pos")).alias("Recall"),
        ratio(tp, tp + fp).alias("Precision"),
        f1_score(tp, fp, fn).alias("F1"),
        (tp + fp).alias("RetainedEdges"),
        ratio(tp + fp, F.col("_rows")).alias("RetentionRatio"),
        tp.alias("TruePositives"),
        fp.alias("FalsePositives"),
        fn.alias("FalseNegatives"),
    )


def best_retention(search: DataFrame) -> DataFrame:
    """Fewest retained edges, then smaller cap, then larger threshold."""
    return (
        search.where("Feasible")
        .orderBy(F.asc("RetainedEdges"), F.asc("TopK"), F.desc("Threshold"))
        .limit(1)
    )


def tune_retention(edges: DataFrame, **options) -> tuple[float, int, DataFrame]:
    """Decision point: (threshold, cap, search table of at most K rows)."""
    search = retention_search(edges, **options).cache()
    row = best_retention(search).first()
    if row is None:
        raise RuntimeError("no cap reaches the requested recall on these edges")
    return float(row["Threshold"]), int(row["TopK"]), search


def retention_mismatches(
    edges: DataFrame,
    threshold: float,
    top_k: int,
    score: str = "stage1_prob",
    observed: str = "stage1_pred_edge",
) -> DataFrame:
    """Recompute the frozen policy and count rows that disagree."""
    again = retain(edges, threshold, top_k, score, "_again")
    return again.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_again") != F.col(observed).cast("int")).alias("mismatches"),
    )


def max_candidates_per_target(edges: DataFrame, pred: str = "stage1_pred_edge") -> DataFrame:
    sizes = edges.where(F.col(pred).cast("int") == 1).groupBy("session_id", "Q2_row").count()
    return sizes.agg(
        F.coalesce(F.max("count"), F.lit(0)).alias("max_candidates"),
        F.count(F.lit(1)).alias("targets"),
    )


