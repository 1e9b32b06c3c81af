"""Local evidence: probabilities turned into additive log-odds."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, logit, sigmoid, to_number
from ..session import materialize
from .metrics import ranking_metrics


def with_evidence(edges: DataFrame, probability: Column, eps: float = 1e-6) -> DataFrame:
    """Attach evidence columns; nothing is pruned here."""
    kept = to_number(F.col("stage1_pred_edge"), 0.0).cast("int") == 1
    out = edges.withColumn("stage2a_local_prob", clip(probability, eps, 1.0 - eps))
    prob = F.col("stage2a_local_prob")
    return out.withColumns(
        {
            "stage2_graph_input_pred": kept.cast("int"),
            "stage2a_local_evidence": logit(prob),
            "stage2_selection_score": prob,
            "stage2_pred_edge": kept.cast("int"),
            "stage2_score": F.when(kept, prob).otherwise(F.lit(0.0)),
        }
    )


def raw_evidence(edges: DataFrame, score: str = "stage1_prob") -> DataFrame:
    """Evidence without recalibration: the retention score itself."""
    return with_evidence(edges, to_number(F.col(score), 0.0), sys.float_info.epsilon)


def evidence_ranking(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AUC and AP of the evidence over retained candidates."""
    kept = edges.where(F.col("stage2_graph_input_pred") == 1)
    ranks = ranking_metrics(kept, "edge_label", "stage2a_local_prob", by or [])
    return ranks.withColumnsRenamed(
        {"total": "candidate_edges", "true_edges": "candidate_true_edges"}
    )


@dataclass(frozen=True)
class Calibration:
    """One-dimensional recalibration; applying it is a plain column expression."""

    mean: float
    deviation: float
    weight: float
    bias: float

    def probability(self, score: Column) -> Column:
        unit = (to_number(score, 0.0) - self.mean) / self.deviation
        return sigmoid(unit * self.weight + self.bias)

    def coefficients(self, name: str = "stage1_prob") -> list[tuple[str, float, float]]:
        return [(name, self.weight, abs(self.weight))]


def fit_calibration(
    train: DataFrame,
    score: str = "stage1_prob",
    label: str = "edge_label",
    c_value: float = 1.0,
    max_iter: int = 50,
) -> Calibration:
    """Class-balanced L2 logistic regression on retained train candidates.

    The penalty also covers the intercept.  Candidates are reduced to counts per
    (score, label); each Newton step is one aggregate of five sums over them.
    """
    kept = train.where(to_number(F.col("stage1_pred_edge")).cast("int") == 1)
    x, y = to_number(F.col(score), 0.0), to_number(F.col(label)).cast("int")
    cells = materialize(kept.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n")))
    row = cells.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("y")).alias("p"),
        F.sum(F.col("n") * F.col("x")).alias("sx"),
    ).first()
    if not row["n"] or row["p"] in (0, row["n"]):
        raise RuntimeError("retained train candidates must hold both classes")
    n, p, mean = row["n"], row["p"], row["sx"] / row["n"]
    spread = cells.agg(F.sum(F.col("n") * (F.col("x") - mean) ** 2)).first()[0] / n
    deviation = math.sqrt(spread) or 1.0
    unit = (F.col("x") - mean) / deviation
    weight = F.col("n") * F.when(F.col("y") == 1, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
    table = cells.select(unit.alias("u"), "y", (weight * float(c_value)).alias("w"))
    a = b = 0.0
    for _ in range(max_iter):
        prob = sigmoid(F.col("u") * a + b)
        table_q = table.withColumn("q", prob)
        miss = F.col("w") * (F.col("q") - F.col("y"))
        curve = F.col("w") * F.col("q") * (1.0 - F.col("q"))
        g = table_q.agg(
            F.sum(miss * F.col("u")), F.sum(miss),
            F.sum(curve * F.col("u") * F.col("u")), F.sum(curve * F.col("u")), F.sum(curve),
        ).first()
        ga, gb, haa, hab, hbb = g[0] + a, g[1] + b, g[2] + 1.0, g[3], g[4] + 1.0
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if max(abs(da), abs(db)) < 1e-10:
            break
    return Calibration(mean, deviation, a, b)


def calibrated_evidence(edges: DataFrame, model: Calibration, score: str = "stage1_prob") -> DataFrame:
    return with_evidence(edges, model.probability(F.col(score)))
