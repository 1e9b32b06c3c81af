"""Enrichment of the two search tables (at most K rows and grid-size rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.numeric import close_to
from .recovery import grid_order, is_selected


def _whole() -> WindowSpec:
    """Both tables are bounded by the search grid, so whole-table windows are small."""
    return Window.partitionBy()


def _from_selected(column: str, fallback: Column) -> Column:
    chosen = F.max(F.when(F.col("selected_row"), F.col(column).cast("double"))).over(_whole())
    return F.col(column).cast("double") - F.coalesce(chosen, fallback)


def flag_retention(search: DataFrame, top_k: int, threshold: float) -> DataFrame:
    """Selected row and differences to it (else to max/max/min of the table)."""
    out = search.withColumn(
        "selected_row", (F.col("TopK") == int(top_k)) & close_to(F.col("Threshold"), threshold)
    )
    return out.withColumns(
        {
            "delta_f1_from_selected": _from_selected("F1", F.max("F1").over(_whole())),
            "delta_precision_from_selected": _from_selected("Precision", F.max("Precision").over(_whole())),
            "delta_retained_edges_from_selected": _from_selected(
                "RetainedEdges", F.min("RetainedEdges").over(_whole()).cast("double")
            ),
        }
    )


def retention_summary(flagged: DataFrame) -> DataFrame:
    """Cap-by-cap table; without a selected row the best-F1 rows are the base."""
    at_best = F.col("F1") == F.max("F1").over(_whole())
    work = flagged.withColumn("_top", at_best)
    best = lambda c, f: f(F.when(F.col("_top"), F.col(c).cast("double"))).over(_whole())
    return work.withColumns(
        {
            "is_selected": F.col("selected_row"),
            "delta_f1_from_selected": _from_selected("F1", F.max("F1").over(_whole())),
            "delta_precision_from_selected": _from_selected("Precision", best("Precision", F.max)),
            "delta_retained_edges_from_selected": _from_selected(
                "RetainedEdges", best("RetainedEdges", F.min)
            ),
        }
    ).select(
        "TopK", "Threshold", "Feasible", "Recall", "Precision", "F1",
        *[F.col(c).cast("double").alias(c) for c in
          ("RetainedEdges", "TruePositives", "FalsePositives", "FalseNegatives")],
        "is_selected", "delta_f1_from_selected", "delta_precision_from_selected",
        "delta_retained_edges_from_selected",
    ).orderBy("TopK")


def retention_neighbourhood(flagged: DataFrame, top_k: int, max_top_k: int = 5) -> DataFrame:
    low, high = max(1, top_k - 1), min(max_top_k, top_k + 1)
    return flagged.where(F.col("TopK").between(low, high)).orderBy("TopK", F.desc("F1"), F.desc("Precision"))


def compression_table(search: DataFrame, total_edges: int) -> DataFrame:
    """Recall against the share of candidates removed, cap by cap."""
    return search.select(
        "TopK", "Feasible", "Recall", (1.0 - F.col("RetainedEdges") / F.lit(float(total_edges))).alias("Compression")
    ).orderBy("TopK")


def best_feasible(flagged: DataFrame) -> DataFrame:
    return flagged.where("Feasible").orderBy(
        F.desc("F1"), F.desc("Precision"), F.asc("RetainedEdges"), F.asc("TopK")
    ).limit(1)


def flag_penalties(search: DataFrame, lambda_0: float, lambda_t: float) -> DataFrame:
    """Selected row, differences to it and distances in the grid."""
    order = Window.orderBy(*grid_order())
    out = search.withColumn("selected_row", is_selected(lambda_0, lambda_t))

    def delta(column: str) -> Column:
        return _from_selected(column, F.first(F.col(column).cast("double")).over(order))

    return out.withColumns(
        {
            "delta_f1_from_selected": delta("F1"),
            "delta_precision_from_selected": delta("Precision"),
            "delta_pred_edges_from_selected": delta("PredEdges"),
            "abs_lambda_0_distance": F.abs(F.col("lambda_0") - float(lambda_0)),
            "abs_lambda_t_distance": F.abs(F.col("lambda_t") - float(lambda_t)),
        }
    )


def grid_step(search: DataFrame, column: str) -> DataFrame:
    """Smallest positive gap between distinct values (null below two values)."""
    values = search.select(column).where(F.col(column).isNotNull()).distinct()
    gap = F.col(column) - F.lag(column).over(Window.orderBy(column))
    return values.select(gap.alias("_gap")).agg(F.min("_gap").alias("step"))


def penalty_neighbourhood(flagged: DataFrame) -> DataFrame:
    """Settings at most one grid step away in both directions.

    A grid without a step (one value in a direction) leaves the selected row.
    """
    steps = grid_step(flagged, "lambda_0").select(F.col("step").alias("_s0")).crossJoin(
        grid_step(flagged, "lambda_t").select(F.col("step").alias("_st"))
    )
    near = (F.col("abs_lambda_0_distance") <= F.col("_s0") + 1e-12) & (
        F.col("abs_lambda_t_distance") <= F.col("_st") + 1e-12
    )
    no_step = F.col("_s0").isNull() | F.col("_st").isNull()
    return (
        flagged.crossJoin(F.broadcast(steps))
        .where(F.when(no_step, F.col("selected_row")).otherwise(near))
        .drop("_s0", "_st")
        .orderBy("abs_lambda_0_distance", "abs_lambda_t_distance", F.desc("F1"))
    )


def penalty_slice(flagged: DataFrame, fixed: str, value: float) -> DataFrame:
    moving = "lambda_0" if fixed == "lambda_t" else "lambda_t"
    return flagged.where(close_to(F.col(fixed), value)).orderBy(moving)


def heatmap(search: DataFrame, value: str, columns: Sequence[float] | None = None) -> DataFrame:
    """λ0 rows by λt columns; known columns spare the extra pass of a pivot."""
    named = search.withColumn("_c", F.format_string("%.2f", F.col("lambda_t")))
    pivot = named.groupBy("lambda_0").pivot("_c", [f"{c:.2f}" for c in columns] if columns else None)
    return pivot.agg(F.first(value)).orderBy("lambda_0")
