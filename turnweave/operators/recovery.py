"""Exact sparse graph recovery, target by target.

For one target with evidence r sorted downwards, keeping the k best edges is
worth ``prefix(k) - λ0·k - λt·k(k-1)/2``; the smallest k with the largest value
(k = 0 is worth 0) is optimal over all subsets.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import close_to, f1_score, finite_score, ratio, sigmoid, to_number
from ..session import materialize
from .metrics import ranking_from_counts
from .prefix import group_join, sliced_running_sum, unit_slice

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TARGET = ("session_id", "Q2_row")
MAX_CANDIDATES_PER_TARGET = 5
# Default penalty grids and audit tolerance.
LAMBDA0_GRID = tuple(round(0.05 * i, 10) for i in range(17))
LAMBDAT_GRID = tuple(round(0.05 * i, 10) for i in range(11))
AUDIT_TOLERANCE = 1e-10
#: gains equal to so many places are ties, whatever the order of subtractions
GAIN_PLACES = 9
#: up to this gain the final score, a double, tells such gains apart
GAIN_BOUND = 15.0
#: evidence nearer than half of it to a threshold of the grid, or beyond the bound, is decided target by target
NEAR = 1e-8
NEAR_BOUND = 1e5
#: subset values computed at once inside a task
SUBSETS_AT_ONCE = 1_000_000


def _value(prefix: Column, k: Column, lambda_0: Column, lambda_t: Column) -> Column:
    return prefix - lambda_0 * k - lambda_t * k * (k - 1) / F.lit(2.0)


def _ranked(edges: DataFrame, evidence: str, tie: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rank and prefix sum per target; one exchange and one sort for both."""
    keys = [*TARGET, "stage2_graph_input_pred"]
    order = Window.partitionBy(*keys).orderBy(F.col(evidence).desc(), *[F.col(t) for t in tie])
    out = edges.withColumns(
        {
            "_rank": F.row_number().over(order),
            "_prefix": F.sum(evidence).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    return out, keys


def recover(
    edges: DataFrame,
    lambda_0: float,
    lambda_t: float,
    evidence: str = "stage2a_local_evidence",
    tie: Sequence[str] = ("Q1_row",),
) -> DataFrame:
    """Select the optimal edge set of every target.

    ``edges`` carries ``stage2_graph_input_pred``; other rows pass through
    unselected.  A target holds at most as many candidates as the candidate
    window is long, so the per-target windows are bounded.
    """
    if lambda_0 < 0 or lambda_t < 0:
        raise ValueError("penalties must be non-negative")
    clean = edges.withColumn(evidence, to_number(F.col(evidence), 0.0))
    ranked, keys = _ranked(clean, evidence, tie)
    group = Window.partitionBy(*keys)
    l0, lt = F.lit(float(lambda_0)), F.lit(float(lambda_t))
    out = ranked.withColumn("_value", _value(F.col("_prefix"), F.col("_rank"), l0, lt))
    out = out.withColumn("_best", F.greatest(F.lit(0.0), F.max("_value").over(group)))
    hit = (F.col("_value") == F.col("_best")) & (F.col("_best") > 0)
    out = out.withColumn(
        "_k", F.coalesce(F.min(F.when(hit, F.col("_rank"))).over(group), F.lit(0))
    )
    candidate = F.col("stage2_graph_input_pred") == 1
    chosen = candidate & (F.col("_rank") <= F.col("_k"))
    gain = F.round(F.col(evidence) - l0 - lt * (F.col("_rank") - 1).cast("double"), GAIN_PLACES)
    return out.withColumns(
        {
            "stage2b_target_rank": F.when(candidate, F.col("_rank").cast("double")),
            "stage2b_incremental_gain": F.when(candidate, gain),
            "stage2b_target_objective": F.when(candidate, F.col("_best")).otherwise(F.lit(0.0)),
            "stage2_graph_target_degree": F.when(candidate, F.col("_k")).otherwise(F.lit(0)),
            "stage2_pruned_by_graph": (candidate & ~chosen).cast("int"),
            "final_graph_pred_edge": chosen.cast("int"),
            "final_graph_score": F.when(candidate, sigmoid(gain)).otherwise(F.lit(0.0)),
        }
    ).drop("_rank", "_prefix", "_value", "_best", "_k")


def recovery_totals(recovered: DataFrame, lambda_0: float, lambda_t: float) -> DataFrame:
    """Objective, target groups and selected edges, one row."""
    candidate = F.col("stage2_graph_input_pred") == 1
    first = candidate & (F.col("stage2b_target_rank") == 1.0)
    return recovered.agg(
        F.coalesce(F.sum(F.when(first, F.col("stage2b_target_objective"))), F.lit(0.0)).alias("objective_total"),
        F.count_if(first).alias("target_groups"),
        F.coalesce(F.sum("final_graph_pred_edge"), F.lit(0)).alias("pred_edges"),
    ).select(
        F.lit(float(lambda_0)).alias("lambda_0"),
        F.lit(float(lambda_t)).alias("lambda_t"),
        "objective_total",
        "target_groups",
        "pred_edges",
    )


# --------------------------------------------------------------------------
# Bounded per-target arrays, shared by the audit and the grid
# --------------------------------------------------------------------------

def _candidates(edges: DataFrame, evidence: str, tie: Sequence[str], extra: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Candidates with evidence ``r`` and rank ``k`` within their target."""
    clean = edges.where(F.col("stage2_graph_input_pred") == 1).withColumn(
        evidence, to_number(F.col(evidence), 0.0)
    )
    order = Window.partitionBy(*TARGET).orderBy(F.col(evidence).desc(), *[F.col(t) for t in tie])
    return clean.select(
        *by, *TARGET, F.col(evidence).alias("r"), *extra, F.row_number().over(order).alias("k")
    )


def _target_arrays(
    edges: DataFrame,
    evidence: str,
    tie: Sequence[str],
    extra: Sequence[str],
    limit: int,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per target: its candidates in rank order.

    At most ``limit + 1`` candidates are collected (the rank filter prunes
    before the shuffle); a target that has more raises instead of losing rows.
    """
    ranked = _candidates(edges, evidence, tie, extra, by)
    grouped = (
        ranked.where(F.col("k") <= limit + 1)
        .groupBy(*TARGET, *by)
        .agg(F.sort_array(F.collect_list(F.struct("k", "r", *extra))).alias("c"))
    )
    checked = F.when(F.size("c") <= limit, F.col("c")).otherwise(
        F.raise_error(F.lit(f"a target has more than {limit} candidates"))
    )
    return grouped.withColumn("c", checked)


def exactness_audit(
    recovered: DataFrame,
    lambda_0: float,
    lambda_t: float,
    evidence: str = "stage2a_local_evidence",
    tie: Sequence[str] = ("Q1_row",),
    limit: int = MAX_CANDIDATES_PER_TARGET,
    tolerance: float = AUDIT_TOLERANCE,
) -> DataFrame:
    """Compare the solver with all 2^m subsets of every target (m <= limit).

    One row per ``split`` value; a graph without that column is one split.
    """
    if "split" not in recovered.columns:
        recovered = recovered.withColumn("split", F.lit("all"))
    picked = recovered.withColumn("z", F.col("final_graph_pred_edge").cast("int"))
    groups = _target_arrays(picked, evidence, tie, ["z"], limit, ["split"])

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size, best value of all subsets and value of the solver's subset of every target."""
        for batch in batches:
            lists = batch.column("c")
            offset, flat = lists.offsets.to_numpy(), lists.flatten()
            offset = offset - offset[0]
            evidences = flat.field("r").to_numpy(zero_copy_only=False)
            kept = flat.field("z").to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
            size = np.diff(offset)
            top, got = np.zeros(len(size)), np.full(len(size), np.nan)
            known = np.zeros(len(size), bool)
            for m in np.unique(size).tolist():
                bit = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
                n = bit.sum(axis=1)
                of_size = np.flatnonzero(size == m)
                step = max(1, SUBSETS_AT_ONCE >> m)
                for start in range(0, len(of_size), step):
                    at = of_size[start : start + step]
                    cell = offset[at][:, None] + np.arange(m)
                    r, z = evidences[cell], kept[cell]
                    total = np.zeros((len(at), 1 << m))
                    for p in range(m):  # the value of a subset, from its members alone
                        total += np.where(bit[:, p] == 1, r[:, p : p + 1], 0.0)
                    value = total - lambda_0 * n - lambda_t * n * (n - 1) / 2.0
                    top[at] = value.max(axis=1)
                    mask = (z * (1 << np.arange(m))).sum(axis=1)
                    some = (mask >= 0) & (mask < 1 << m)
                    known[at] = some
                    got[at[some]] = value[some, mask[some].astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("split"), pa.array(size, pa.int32()), pa.array(top), pa.array(got, mask=~known)],
                names=["split", "m", "_top", "_got"],
            )

    lambda_0, lambda_t = float(lambda_0), float(lambda_t)
    kind = recovered.schema["split"].dataType.simpleString()
    per_target = groups.select("split", "c").mapInArrow(subsets, f"split {kind}, m int, _top double, _got double")
    gap = F.greatest(F.lit(0.0), F.col("_top") - F.col("_got"))
    found = per_target.groupBy("split").agg(
        F.count(F.lit(1)).alias("candidate_target_groups"),
        F.coalesce(F.max("m"), F.lit(0)).alias("max_candidates_per_target"),
        F.coalesce(F.sum(F.expr("shiftleft(1L, m)")), F.lit(0)).alias("enumerated_subsets"),
        F.count_if(gap > tolerance).alias("objective_mismatches"),
        F.count_if(F.abs(F.col("_top") - F.col("_got")) > tolerance).alias("subset_mismatches"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_objective_gap"),
    )
    every = recovered.select("split", *TARGET).distinct().groupBy("split").agg(
        F.count(F.lit(1)).alias("all_target_groups")
    )
    clean = (F.col("objective_mismatches") == 0) & (F.col("subset_mismatches") == 0)
    counts = [
        "candidate_target_groups", "max_candidates_per_target", "enumerated_subsets",
        "objective_mismatches", "subset_mismatches",
    ]
    zero = F.lit(0).cast("long")
    filled = every.join(found, "split", "left").withColumns(
        {**{c: F.coalesce(F.col(c), zero) for c in counts},
         "max_objective_gap": F.coalesce("max_objective_gap", F.lit(0.0))}
    )
    return filled.select(
        "split",
        "all_target_groups",
        *counts,
        "max_objective_gap",
        F.lit(float(tolerance)).alias("tolerance"),
        clean.alias("passed"),
    )


def penalty_grid(
    edges: DataFrame,
    lambda0_grid: Sequence[float] = LAMBDA0_GRID,
    lambdat_grid: Sequence[float] = LAMBDAT_GRID,
    label: str = "edge_label",
    evidence: str = "stage2a_local_evidence",
    tie: Sequence[str] = ("Q1_row",),
    limit: int = MAX_CANDIDATES_PER_TARGET,
    ranking: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Every (λ0, λt) in one job instead of one job per setting.

    ``by`` (columns fixed within a session, such as the split) gives one grid
    per group.

    Evidence falls with the rank and the penalty of one more edge does not, so a
    setting keeps the candidate of rank k exactly if ``r > λ0 + λt·(k-1)``.
    Candidates are ranked once and reduced to counts per (rank, evidence); the
    settings are tried on these.  Targets with evidence at a threshold, where the
    rounding of their sums decides, are solved target by target, equal ones once.
    ``ranking`` adds AUC and AP of the final score.
    """
    settings = [(float(a), float(b)) for a, b in product(sorted(set(lambda0_grid)), sorted(set(lambdat_grid)))]
    grid = F.array(*[F.struct(F.lit(a).alias("l0"), F.lit(b).alias("lt")) for a, b in settings])
    labelled = edges.withColumn("y", F.col(label).cast("int"))
    ranked = _candidates(labelled, evidence, tie, ["y"], by)
    alone = F.max(_undecided(settings, limit)).over(Window.partitionBy(*TARGET)).alias("alone")
    checked = F.when(F.col("k") <= limit, F.col("k")).otherwise(
        F.raise_error(F.lit(f"a target has more than {limit} candidates"))
    )
    ranked = ranked.select(*by, *TARGET, checked.alias("k"), "r", "y", alone)
    positive, free = F.coalesce(F.col("y") == 1, F.lit(False)), ~F.col("alone")
    cells = materialize(
        ranked.groupBy(*by, "k", "r").agg(
            F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"),
            F.count_if(free & positive).alias("free_pos"), F.count_if(free).alias("free"),
        )
    )
    keys = [*by, "lambda_0", "lambda_t"]
    tried = cells.withColumn("g", F.explode(grid)).select(
        *by, F.col("g.l0").alias("lambda_0"), F.col("g.lt").alias("lambda_t"), "free", "free_pos",
        (F.col("r") - F.col("g.l0") - F.col("g.lt") * (F.col("k") - 1)).alias("gain"),
    )
    part = lambda value: F.sum(F.when(F.col("gain") > 0, value).otherwise(F.lit(0)))
    sums = tried.groupBy(*keys).agg(
        part(F.col("free_pos")).alias("tp"), part(F.col("free")).alias("pred"),
        F.sum(F.when((F.col("gain") > 0) & (F.col("free") > 0), F.col("gain") * F.col("free")).otherwise(F.lit(0.0))).alias("objective"),
    )
    if cells.where(F.col("pos") + F.col("neg") > F.col("free")).limit(1).count():
        one_by_one = _solved(ranked.where("alone"), grid, by)
        sums = sums.unionByName(one_by_one).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "pred", "objective")])
    totals = edges.groupBy(*by).agg(F.count_if(F.col(label).cast("int") == 1).alias("_pos"))
    out = group_join(sums, totals, by)
    tp, pred = F.col("tp"), F.col("pred")
    fp, fn = pred - tp, F.col("_pos") - tp
    columns = [
        *keys,
        ratio(tp, pred).alias("Precision"),
        ratio(tp, F.col("_pos")).alias("Recall"),
        f1_score(tp, fp, fn).alias("F1"),
        pred.alias("PredEdges"),
        tp.alias("TP"),
        fp.alias("FP"),
        fn.alias("FN"),
        F.col("objective").alias("ObjectiveTotal"),
    ]
    result = out.select(*columns)
    if not ranking:
        return result
    ranks = _grid_ranking(edges, cells, [a for a, _ in settings], [b for _, b in settings], label, limit, by)
    return group_join(result, ranks, [*by, "lambda_t"])


def _undecided(settings: Sequence[tuple[float, float]], limit: int) -> Column:
    """Whether a candidate is too near to a threshold of the settings, or too odd, to be counted apart from its target."""
    if min(b for _, b in settings) < 0:
        return F.lit(True)
    cuts = {a + b * k for a, b in settings for k in range(limit)}
    # two numbers less than half a bin apart share a bin of one of two staggered rows of bins
    bins = [sorted({math.floor(c / NEAR + shift) for c in cuts}) for shift in (0.0, 0.5)]
    near = [F.floor(F.col("r") / NEAR + shift).isin(*b) for shift, b in zip((0.0, 0.5), bins)]
    odd = F.coalesce(~F.col("y").isin(0, 1), F.lit(True))
    return odd | (F.abs("r") > NEAR_BOUND) | near[0] | near[1]


def _solved(ranked: DataFrame, grid: Column, by: Sequence[str]) -> DataFrame:
    """Sums per setting over targets solved one by one; targets alike in evidence and labels are solved once."""
    groups = ranked.groupBy(*TARGET, *by).agg(F.sort_array(F.collect_list(F.struct("k", "r", "y"))).alias("c"))
    groups = groups.groupBy(*by, "c").agg(F.count(F.lit(1)).alias("n"))
    # prefix sums in rank order, independent of the penalties
    groups = groups.withColumn(
        "p",
        F.expr(
            "aggregate(c, array(0D), (acc, e) -> concat(acc, array(element_at(acc, -1) + e.r)))"
        ),
    )
    tried = groups.withColumn("g", F.explode(grid)).select(
        *by,
        "c",
        "n",
        F.col("g.l0").alias("lambda_0"),
        F.col("g.lt").alias("lambda_t"),
        F.expr("transform(p, (v, k) -> v - g.l0 * k - g.lt * k * (k - 1) / 2D)").alias("v"),
    )
    # array_position finds the first, i.e. smallest, optimal k
    tried = tried.withColumn("_best", F.array_max("v")).withColumn(
        "k", (F.array_position("v", F.col("_best")) - 1).cast("int")
    )
    picked = F.expr("aggregate(slice(c, 1, k), 0, (acc, e) -> acc + e.y)")
    return tried.groupBy(*by, "lambda_0", "lambda_t").agg(
        F.sum(picked * F.col("n")).alias("tp"), F.sum(F.col("k") * F.col("n")).alias("pred"), F.sum(F.col("_best") * F.col("n")).alias("objective")
    )


def _grid_ranking(
    edges: DataFrame,
    cells: DataFrame,
    lambda0: Sequence[float],
    lambdat: Sequence[float],
    label: str,
    limit: int,
    by: Sequence[str],
) -> DataFrame:
    """AUC and AP per λt; rows outside the graph score below all others.

    λ0 lowers every gain alike, so the order of the final scores, and with it
    AUC and AP, depends on λt alone.  That holds while final scores tell gains
    apart (``GAIN_BOUND``; logits of probabilities stay below 14); evidence
    beyond it raises.
    """
    keys = [*by, "lambda_t"]
    each = F.array(*[F.lit(b) for b in sorted(set(lambdat))])
    low = -30.0 + max(lambda0) + max(lambdat) * limit
    bounded = F.when(F.col("r").between(low, GAIN_BOUND), F.col("r")).otherwise(
        F.raise_error(F.lit(f"final scores cannot rank evidence outside [{low:g}, {GAIN_BOUND:g}]"))
    )
    flat = cells.select(*by, "k", bounded.alias("r"), "pos", "neg")
    gain = F.col("r") - F.col("lambda_t") * (F.col("k") - 1).cast("double")
    scored = flat.withColumn("lambda_t", F.explode(each)).select(*keys, finite_score(F.round(gain, GAIN_PLACES)).alias("score"), "pos", "neg")
    inside = scored.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    outside = (
        edges.where(F.col("stage2_graph_input_pred") != 1)
        .groupBy(*by)
        .agg(
            F.count_if(F.col(label).cast("int") == 1).alias("pos"),
            F.count_if(F.col(label).cast("int") != 1).alias("neg"),
        )
        .withColumn("lambda_t", F.explode(each))
        .select(*keys, F.lit(-1e30).alias("score"), "pos", "neg")
    )
    curve = sliced_running_sum(
        inside.unionByName(outside),
        keys,
        unit_slice(sigmoid(F.col("score"))),
        [F.col("score").desc()],
        {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
        descending=True,
    )
    ranks = ranking_from_counts(curve, keys)
    return ranks.select(*keys, F.col("auc").alias("AUC"), F.col("ap").alias("AP"))


def grid_order() -> list[Column]:
    return [F.desc("F1"), F.desc("Precision"), F.asc("PredEdges"), F.asc("lambda_0"), F.asc("lambda_t")]


def best_penalties(search: DataFrame) -> DataFrame:
    """One row: F1, precision, fewer edges, smaller λ0, smaller λt."""
    return search.orderBy(*grid_order()).limit(1)


def reject_upper_boundary(name: str, selected: float, grid: Sequence[float]) -> None:
    """Stop when validation picked the largest value of a real grid."""
    values = sorted({float(v) for v in grid})
    if len(values) > 1 and abs(float(selected) - values[-1]) <= 1e-12:
        raise RuntimeError(
            f"validation selected {name}={selected:g}, the upper end of "
            f"[{values[0]:g}, {values[-1]:g}]; widen the grid before reading the test split"
        )


def tied_best(search: DataFrame) -> DataFrame:
    """All settings that share the largest F1, in selection order."""
    top = F.max("F1").over(Window.partitionBy())  # grid-size table
    return search.withColumn("_top", top).where(close_to(F.col("F1"), F.col("_top"))).drop("_top").orderBy(*grid_order())


def is_selected(lambda_0: float, lambda_t: float) -> Column:
    return close_to(F.col("lambda_0"), lambda_0) & close_to(F.col("lambda_t"), lambda_t)
