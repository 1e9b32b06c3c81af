"""Session bootstrap: confidence intervals and paired F1 differences.

Rates need only per-session counts, so edges are reduced to one row per session
before any draw is made.  AUC and AP need score histograms; these are reduced
per (session, score) first and weighted by how often a draw picked the session.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import f1_score, ratio
from ..session import lookup_join
from .metrics import ranking_from_counts, running_counts, score_histogram
from .prefix import integer_slice, sliced_index

DRAWS = 2000
SEED = 42
DRIVER_PICKS = 20_000_000
MODULUS = 2147483647


def index_sessions(edges: DataFrame, order: str | None = None, slices: int = 4096) -> DataFrame:
    """``session_id, session_idx``: dense numbers, in ``order`` or hash order.

    ``order`` is an integer column (its minimum per session counts), used where
    the draw order must be fixed from outside.
    """
    if order is not None:
        sessions = edges.groupBy("session_id").agg(F.min(order).alias("_o"))
        placed = sliced_index(
            sessions, [], integer_slice(F.col("_o"), 65_536), [F.col("_o"), F.col("session_id")], "session_idx"
        )
        return placed.select("session_id", "session_idx")
    sessions = edges.select("session_id").distinct()
    hashed = F.pmod(F.xxhash64("session_id"), F.lit(slices))
    return sliced_index(sessions, [], hashed, [F.col("session_id")], "session_idx")


def seeded_draws(
    spark: SparkSession, n_sessions: int, n_draws: int = DRAWS, seed: int = SEED
) -> DataFrame:
    """``draw, session_idx, weight`` from numpy's seeded generator.

    The stream is sequential and therefore made on the driver; its size is
    checked, and ``hashed_draws`` is the distributed way beyond the limit.
    """
    if n_sessions * n_draws > DRIVER_PICKS:
        raise ValueError("too many picks for seeded draws; use hashed_draws")
    rng = np.random.default_rng(seed)
    parts = []
    for draw in range(n_draws):
        picks = rng.integers(0, n_sessions, size=n_sessions)
        idx, weight = np.unique(picks, return_counts=True)
        parts.append(np.column_stack([np.full(len(idx), draw), idx, weight]))
    table = np.vstack(parts) if parts else np.zeros((0, 3), dtype="int64")
    import pandas as pd

    return spark.createDataFrame(
        pd.DataFrame(table.astype("int64"), columns=["draw", "session_idx", "weight"])
    )


def hashed_draws(
    sessions: DataFrame, n_draws: int = DRAWS, seed: int = SEED
) -> DataFrame:
    """The same shape from integer arithmetic, generated where it is used.

    Pick k of draw d is a mixed function of (d, k, seed) modulo the session
    count, so any task can make its share and any engine can replay it.  Each
    pick is a row of weight 1: sums over rows need no session counted up first,
    so sessions times draws are not shuffled by session and draw.
    """
    count = sessions.agg(F.count(F.lit(1)).alias("n"))
    # sessions carry 0..n-1, which serve as the pick numbers of every draw
    picks = sessions.select(
        F.col("session_idx").alias("k"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_draws - 1).cast("long"))).alias("draw"),
    ).crossJoin(F.broadcast(count))  # one row: the session count
    m = F.lit(MODULUS).cast("long")
    mixed = (F.col("draw") * 7919 + F.col("k") * 104729 + F.lit(int(seed) * 31)) % m
    mixed = (mixed * 48271) % m
    mixed = (mixed * mixed + F.col("draw")) % m
    mixed = (mixed * 16807 + F.col("k")) % m
    return picks.select("draw", (mixed % F.col("n")).alias("session_idx"), F.lit(1).cast("long").alias("weight"))


def session_counts(
    edges: DataFrame, sessions: DataFrame, label: str, preds: Sequence[str]
) -> DataFrame:
    """Per-session tp/fp/fn for each prediction column (combined map-side)."""
    y = F.col(label).cast("int")
    sums = []
    for p in preds:
        z = F.col(p).cast("int")
        sums += [
            F.count_if((y == 1) & (z == 1)).alias(f"{p}_tp"),
            F.count_if((y == 0) & (z == 1)).alias(f"{p}_fp"),
            F.count_if((y == 1) & (z == 0)).alias(f"{p}_fn"),
        ]
    return edges.groupBy("session_id").agg(*sums).join(sessions, "session_id")


def draw_rates(counts: DataFrame, draws: DataFrame, preds: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 of each draw; shuffles one row per draw."""
    names = [f"{p}_{c}" for p in preds for c in ("tp", "fp", "fn")]
    summed = (
        draws.join(counts, "session_idx")
        .groupBy("draw")
        .agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names])
    )
    out = ["draw"]
    for p in preds:
        tp, fp, fn = (F.col(f"{p}_{c}") for c in ("tp", "fp", "fn"))
        out += [
            ratio(tp, tp + fp).alias(f"{p}_Precision"),
            ratio(tp, tp + fn).alias(f"{p}_Recall"),
            f1_score(tp, fp, fn).alias(f"{p}_F1"),
        ]
    return summed.select(*out)


def draw_ranking(
    edges: DataFrame,
    sessions: DataFrame,
    draws: DataFrame,
    label: str,
    score: str,
) -> DataFrame:
    """AUC and AP of each draw, from weighted score histograms.

    Draw weights are packed per session (one row each), so the join is
    many-to-one; a session with most of the scores is dealt over salts.
    """
    packed = draws.groupBy("session_idx").agg(F.collect_list(F.struct("draw", "weight")).alias("w"))
    packed = packed.join(sessions, "session_idx").select("session_id", "w")
    hist = score_histogram(edges, label, score, ["session_id"])
    weighted = lookup_join(hist, packed, ["session_id"], F.col("score"), "inner")
    per_draw = (
        weighted.select("score", "pos", "neg", F.inline("w"))
        .groupBy("draw", "score")
        .agg(
            F.sum(F.col("pos") * F.col("weight")).alias("pos"),
            F.sum(F.col("neg") * F.col("weight")).alias("neg"),
        )
    )
    ranks = ranking_from_counts(running_counts(per_draw, ["draw"]), ["draw"])
    return ranks.select("draw", F.col("auc").alias("AUC"), F.col("ap").alias("AP"))


def intervals(draw_table: DataFrame, columns: dict[str, str], n_draws: int) -> DataFrame:
    """Mean and 2.5/97.5 % quantiles per metric; null draws are left out.

    ``columns`` maps output metric names to columns of ``draw_table``, which has
    one row per draw.
    """
    stats = draw_table.agg(
        *[
            F.struct(
                F.lit(metric).alias("Metric"),
                F.avg(c).alias("BootstrapMean"),
                F.percentile(c, F.lit(0.025)).alias("CI_Lower"),
                F.percentile(c, F.lit(0.975)).alias("CI_Upper"),
                F.lit(int(n_draws)).alias("BootstrapSamples"),
            ).alias(c)
            for metric, c in columns.items()
        ]
    )
    return stats.select(F.inline(F.array(*columns.values())))


def bootstrap_ci(
    edges: DataFrame,
    sessions: DataFrame,
    draws: DataFrame,
    n_draws: int,
    label: str = "edge_label",
    pred: str = "pred",
    score: str | None = "score",
) -> DataFrame:
    """Intervals of AUC, AP, precision, recall and F1 (the last three if no score)."""
    rates = draw_rates(session_counts(edges, sessions, label, [pred]), draws, [pred])
    columns = {"Precision": f"{pred}_Precision", "Recall": f"{pred}_Recall", "F1": f"{pred}_F1"}
    if score is not None:
        rates = rates.join(draw_ranking(edges, sessions, draws, label, score), "draw")
        columns = {"AUC": "AUC", "AP": "AP", **columns}
    return intervals(rates, columns, n_draws)


def paired_f1(
    edges: DataFrame,
    sessions: DataFrame,
    draws: DataFrame,
    n_draws: int,
    label: str = "edge_label",
    model: str = "model_pred",
    baseline: str = "baseline_pred",
) -> DataFrame:
    """Distribution of F1(model) - F1(baseline) over shared draws, one row."""
    rates = draw_rates(
        session_counts(edges, sessions, label, [model, baseline]), draws, [model, baseline]
    )
    return difference(rates.select((F.col(f"{model}_F1") - F.col(f"{baseline}_F1")).alias("d")), n_draws)


def difference(diff: DataFrame, n_draws: int) -> DataFrame:
    """Mean, quantiles and share not above 0 of ``d``, one row."""
    return diff.agg(
        F.avg("d").alias("F1_Difference_Mean"),
        F.percentile("d", F.lit(0.025)).alias("CI_Lower"),
        F.percentile("d", F.lit(0.975)).alias("CI_Upper"),
        F.avg((F.col("d") <= 0).cast("double")).alias("P_Diff_LE_0"),
    ).withColumn("BootstrapSamples", F.lit(int(n_draws)))
