"""Confusion counts, ranking metrics and exact threshold search.

Ranking metrics start from a score histogram (one row per distinct score,
combined map-side) and need running counts along it.  ``running_counts`` cuts
that walk into score slices, so no task sees the whole histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import f1_score, finite_score, ratio
from .prefix import boundary_slice, group_join, sliced_running_sum, unit_slice


def confusion(
    df: DataFrame, label: str = "edge_label", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """One pass: counts, precision, recall, F1 and accuracy per group."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(y == 1).alias("true_edges"),
        F.count_if(p == 1).alias("pred_edges"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": f1_score(tp, fp, fn),
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        }
    )


def score_histogram(
    df: DataFrame,
    label: str = "edge_label",
    score: str = "score",
    by: Sequence[str] = (),
    weight: Column | None = None,
) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label).cast("int")
    one = F.lit(1).cast("long") if weight is None else weight.cast("long")
    return (
        df.withColumn("_s", finite_score(F.col(score)))
        .groupBy(*by, F.col("_s").alias("score"))
        .agg(
            F.sum(F.when(y == 1, one).otherwise(F.lit(0).cast("long"))).alias("pos"),
            F.sum(F.when(y == 1, F.lit(0).cast("long")).otherwise(one)).alias("neg"),
        )
    )


def running_counts(
    histogram: DataFrame,
    by: Sequence[str] = (),
    slices: int = 1024,
    boundaries: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``cum_pos``/``cum_neg``: rows scoring at least this score.

    Slices default to equal widths up to 1 and equal ratios beyond; pass
    ``boundaries`` (see ``score_boundaries``) when scores crowd together.  The
    result is the same.
    """
    cut = unit_slice(F.col("score"), slices) if boundaries is None else boundary_slice(F.col("score"), boundaries)
    return sliced_running_sum(
        histogram,
        by,
        cut,
        [F.col("score").desc()],
        {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
        descending=True,
    )


def ranking_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware AUC and step-wise AP; null where a class is missing.

    Both are sums over distinct scores of terms that need only the running
    counts, so groups reduce in one combined aggregate.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    at_least = F.col("cum_pos") + F.col("cum_neg")
    sums = counts.groupBy(*by).agg(
        F.sum("pos").alias("true_edges"),
        F.sum("neg").alias("_n"),
        # positives above or level with each block of negatives
        F.sum(neg * (F.col("cum_pos") - pos / 2.0)).alias("_wins"),
        F.sum(ratio(pos * F.col("cum_pos"), at_least)).alias("_steps"),
    )
    both = (F.col("true_edges") > 0) & (F.col("_n") > 0)
    return sums.select(
        *by,
        (F.col("true_edges") + F.col("_n")).alias("total"),
        "true_edges",
        F.when(both, F.col("_wins") / (F.col("true_edges").cast("double") * F.col("_n"))).alias("auc"),
        F.when(both, F.col("_steps") / F.col("true_edges")).alias("ap"),
    )


def ranking_metrics(
    df: DataFrame,
    label: str = "edge_label",
    score: str = "score",
    by: Sequence[str] = (),
    **options,
) -> DataFrame:
    """``total, true_edges, auc, ap`` per group."""
    return ranking_from_counts(running_counts(score_histogram(df, label, score, by), by, **options), by)


def evaluate(
    df: DataFrame,
    label: str = "edge_label",
    pred: str = "pred",
    score: str = "score",
    by: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Confusion record with ``auc`` and ``ap`` attached.

    Rows are reduced once, to counts per (score, prediction); both parts of the
    record are sums over that table.
    """
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    cells = df.groupBy(*by, finite_score(F.col(score)).alias("score"), p.alias("_p")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    on = F.col("_p") == 1
    part = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0)))
    counts = with_rates(
        cells.groupBy(*by).agg(
            F.sum(F.col("pos") + F.col("neg")).alias("total"),
            F.sum("pos").alias("true_edges"),
            F.sum(F.when(on, F.col("pos") + F.col("neg")).otherwise(F.lit(0))).alias("pred_edges"),
            part("pos", on).alias("tp"),
            part("neg", on).alias("fp"),
            part("pos", ~on).alias("fn"),
            part("neg", ~on).alias("tn"),
        )
    )
    histogram = cells.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranks = ranking_from_counts(running_counts(histogram, by, **options), by).drop("total", "true_edges")
    return group_join(counts, ranks, by)


def threshold_sweep(
    df: DataFrame,
    label: str = "edge_label",
    score: str = "score",
    eligible: Column | None = None,
    by: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Counts and rates at every distinct eligible score.

    Misses count every positive of the group, eligible or not.
    """
    rows = df if eligible is None else df.where(eligible)
    totals = df.groupBy(*by).agg(F.count_if(F.col(label).cast("int") == 1).alias("_all_pos"))
    curve = running_counts(score_histogram(rows, label, score, by), by, **options)
    curve = group_join(curve, totals, by)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    fn = F.col("_all_pos") - tp
    return curve.select(
        *by,
        F.col("score").alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        (tp + fp).alias("pred_edges"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("_all_pos")).alias("recall"),
        f1_score(tp, fp, fn).alias("f1"),
    )


def best_f1_threshold(
    df: DataFrame,
    label: str = "edge_label",
    score: str = "score",
    eligible: Column | None = None,
    by: Sequence[str] = (),
    **options,
) -> DataFrame:
    """The exact F1-optimal threshold per group.

    Ties go to higher precision, then fewer predictions, then the larger
    threshold.  A group with no eligible row gets an infinite threshold.
    """
    sweep = threshold_sweep(df, label, score, eligible, by, **options)
    key = F.struct(
        F.col("f1"), F.col("precision"), (-F.col("pred_edges")).alias("fewer"), F.col("threshold")
    )
    row = F.struct("threshold", "tp", "fp", "fn", "pred_edges", "precision", "recall", "f1")
    best = sweep.groupBy(*by).agg(F.max_by(row, key).alias("_best"))
    best = best.select(*by, "_best.*")
    groups = df.groupBy(*by).agg(F.count_if(F.col(label).cast("int") == 1).alias("_all_pos"))
    joined = group_join(groups, best, by, "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        *by,
        F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"),
        F.coalesce("tp", zero).alias("tp"),
        F.coalesce("fp", zero).alias("fp"),
        F.coalesce("fn", "_all_pos").alias("fn"),
        F.coalesce("pred_edges", zero).alias("pred_edges"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
    )


def with_source_rank(
    df: DataFrame,
    score: str,
    name: str = "source_rank",
    source: Sequence[str] = ("session_id", "Q1_row"),
    tie: Sequence[str] = ("Q2_row",),
) -> DataFrame:
    """Rank within a source, best score first, table order on ties."""
    order = [finite_score(F.col(score)).desc(), *[F.col(c) for c in tie]]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*source).orderBy(*order)))


def topk_threshold_search(
    df: DataFrame,
    k_values: Sequence[int],
    label: str = "edge_label",
    score: str = "score",
    **options,
) -> DataFrame:
    """Best threshold for each Top-K cap; all caps share one ranking pass.

    Only rows within the largest cap are multiplied by the caps they satisfy.
    """
    caps = F.array(*[F.lit(int(k)) for k in k_values])
    ranked = with_source_rank(df, score, "_rank").select("_rank", score, label)
    admitted = ranked.where(F.col("_rank") <= max(k_values)).withColumn(
        "top_k", F.explode(F.filter(caps, lambda k: k >= F.col("_rank")))
    )
    histogram = score_histogram(admitted, label, score, ["top_k"])
    curve = running_counts(histogram, ["top_k"], **options)
    totals = df.agg(F.count_if(F.col(label).cast("int") == 1).alias("_all_pos"))
    curve = curve.crossJoin(F.broadcast(totals))
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    fn = F.col("_all_pos") - tp
    row = F.struct(
        F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        (tp + fp).alias("pred_edges"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, F.col("_all_pos")).alias("recall"), f1_score(tp, fp, fn).alias("f1"),
    )
    keyed = curve.select("top_k", row.alias("_row"))
    key = F.struct("_row.f1", "_row.precision", (-F.col("_row.pred_edges")).alias("fewer"), "_row.threshold")
    return keyed.groupBy("top_k").agg(F.max_by("_row", key).alias("_best")).select("top_k", "_best.*")


def best_topk(search: DataFrame) -> DataFrame:
    """One row: F1, precision, fewer edges, smaller cap, larger threshold."""
    return search.orderBy(
        F.desc("f1"), F.desc("precision"), F.asc("pred_edges"), F.asc("top_k"), F.desc("threshold")
    ).limit(1)


def apply_threshold(
    df: DataFrame, score: str, threshold: float, top_k: int | None = None, name: str = "pred"
) -> DataFrame:
    """Frozen decision rule: score cut, and a cap per source when given."""
    keep = finite_score(F.col(score)) >= float(threshold)
    if top_k is None:
        return df.withColumn(name, keep.cast("int"))
    ranked = with_source_rank(df, score, "_rank")
    return ranked.withColumn(name, (keep & (F.col("_rank") <= int(top_k))).cast("int")).drop("_rank")
