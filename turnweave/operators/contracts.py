"""Table contracts: every check is an aggregate, all violations in one report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_finite, to_number
from .recovery import MAX_CANDIDATES_PER_TARGET
from .retention import retention_mismatches

KEYS = ("session_id", "Q1_row", "Q2_row", "edge_id")
REQUIRED = (*KEYS, "edge_label", "stage1_prob", "stage1_pred_edge")


def require_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise RuntimeError(f"{what} is missing columns: {missing}")


def nonfinite_count(column: str) -> Column:
    return F.count_if(~is_finite(F.col(column)))


def partition_report(edges: DataFrame) -> DataFrame:
    """One row of sizes and violation counts of a scored split.

    Repeated ids and crowded targets are counted on pre-aggregated keys, so no
    group is collected anywhere.
    """
    require_columns(edges, REQUIRED)
    empty = [F.count_if(F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "").alias(f"empty_{k}") for k in KEYS]
    label, pred = to_number(F.col("edge_label"), None), to_number(F.col("stage1_pred_edge"), None)
    prob = to_number(F.col("stage1_prob"), None)
    main = edges.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(label == 1.0).alias("true_edges"),
        *empty,
        *[nonfinite_count(c).alias(f"nonfinite_{c}") for c in ("edge_label", "stage1_pred_edge", "stage1_prob")],
        F.count_if(~F.coalesce(label.isin(0.0, 1.0), F.lit(True))).alias("bad_labels"),
        F.count_if(~F.coalesce(pred.isin(0.0, 1.0), F.lit(True))).alias("bad_predictions"),
        F.count_if((prob < 0) | (prob > 1)).alias("bad_probabilities"),
    )
    sessions = edges.groupBy("session_id").agg(F.lit(1).alias("_")).agg(F.count(F.lit(1)).alias("sessions"))
    ids = edges.groupBy("edge_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_edge_ids"))
    crowd = (
        edges.where(pred == 1.0)
        .groupBy("session_id", "Q2_row")
        .count()
        .agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_target_candidates"))
    )
    return main.crossJoin(sessions).crossJoin(ids).crossJoin(crowd)


def check_partition(
    edges: DataFrame,
    name: str,
    expected: Mapping[str, int] | None = None,
    max_candidates: int = MAX_CANDIDATES_PER_TARGET,
) -> dict[str, int]:
    """Collect the one-row report and raise with every violation at once."""
    row = partition_report(edges).first().asDict()
    sizes = ("rows", "sessions", "true_edges", "max_target_candidates")
    problems = [f"{k}={v}" for k, v in row.items() if k not in sizes and v]
    problems += [f"{k}={row[k]}, expected {v}" for k, v in (expected or {}).items() if row[k] != v]
    if row["max_target_candidates"] > max_candidates:
        problems.append(f"{row['max_target_candidates']} retained candidates for one target, at most {max_candidates}")
    if problems:
        raise RuntimeError(f"{name}: " + "; ".join(problems))
    return row


def check_retention(edges: DataFrame, name: str, threshold: float, top_k: int) -> None:
    bad = retention_mismatches(edges, threshold, top_k).first()["mismatches"]
    if bad:
        raise RuntimeError(f"{name}: retention differs from its frozen policy on {bad} rows")


def check_disjoint(frames: Mapping[str, DataFrame]) -> None:
    """No session in two splits; semi joins on distinct ids."""
    names = list(frames)
    ids = {n: frames[n].select("session_id").distinct() for n in names}
    for i, left in enumerate(names):
        for right in names[i + 1:]:
            if not ids[left].join(ids[right], "session_id", "left_semi").isEmpty():
                raise RuntimeError(f"{left} and {right} share sessions")


def check_selected_only_candidates(graph: DataFrame) -> None:
    outside = graph.where(
        (F.col("stage2_graph_input_pred") != 1) & (F.col("final_graph_pred_edge") == 1)
    )
    if not outside.isEmpty():
        raise RuntimeError("the graph selects an edge that retention excluded")


def check_audit(audit: DataFrame, tolerance: float = 1e-10) -> None:
    """An audit table has one row per split."""
    bad = audit.where(~F.col("passed") | (F.col("max_objective_gap") > tolerance))
    names = [r["split"] for r in bad.select("split").collect()]
    if names:
        raise RuntimeError("exactness audit failed for: " + ", ".join(names))


def check_values(observed: Mapping[str, object], required: Mapping[str, object], what: str) -> None:
    """Compare manifest entries with required values, all mismatches at once."""
    wrong = {k: (observed.get(k), v) for k, v in required.items() if observed.get(k) != v}
    if wrong:
        raise RuntimeError(f"{what}: " + "; ".join(f"{k} is {o!r}, must be {r!r}" for k, (o, r) in wrong.items()))


# What a retention manifest and an encoder record must certify.
RETENTION_PROTOCOL = {
    "retention_orientation": "source_conditioned",
    "retention_group_keys": ["session_id", "Q1_row"],
    "encoder_train_only": True,
    "encoder_training_objective": "positive_pair_mnrl_only",
    "rationale_derived_supervision": False,
    "scorer_refit_after_validation": False,
    "test_labels_used_for_fitting_or_selection": False,
}
ENCODER_PROTOCOL = {
    "training_objective": "positive_pair_mnrl_only",
    "input_format": "raw_q1_a1__q2_v1",
    "rationale_derived_supervision": False,
    "targeted_supervision": False,
    "hard_negative_supervision": False,
    "direction_auxiliary_supervision": False,
    "train_only": True,
}


def check_encoder_record(
    record: Mapping[str, object],
    data_hash: str,
    manifest_hash: str,
    session_counts: Mapping[str, int],
    protocol: Mapping[str, object] = ENCODER_PROTOCOL,
) -> None:
    """Accept an encoder only if it was trained on these very files."""
    required = {
        **protocol,
        "train_file_sha256": data_hash,
        "session_manifest_sha256": manifest_hash,
        "session_counts": dict(session_counts),
    }
    check_values(record, required, "encoder record")


def check_run_record(params: Mapping[str, object], splits: Mapping[str, Mapping[str, int]]) -> None:
    """A finished run must report the sizes of its splits and no test leakage."""
    check_values(params, {"test_labels_used_for_fitting_or_selection": False}, "run record")
    for split, sizes in splits.items():
        metrics = params.get(f"{split}_metrics") or {}
        check_values(metrics, sizes, f"run record, {split}")


def check_retention_manifest(params: Mapping[str, object], max_top_k: int = 5) -> None:
    check_values(params, RETENTION_PROTOCOL, "retention manifest")
    threshold, cap = params.get("selected_threshold"), params.get("selected_top_k")
    if not isinstance(threshold, (int, float)) or not 0.0 <= float(threshold) <= 1.0:
        raise RuntimeError("retention manifest: selected_threshold must lie in [0, 1]")
    if not isinstance(cap, int) or not 1 <= cap <= max_top_k:
        raise RuntimeError(f"retention manifest: selected_top_k must lie in [1, {max_top_k}]")


def check_case(
    graph: DataFrame, session_id: str, target_row: int, expected: tuple[int, int, int]
) -> DataFrame:
    """One target's candidates in source order; counts must match.

    ``expected``: candidates, retained, selected.
    """
    case = graph.where((F.col("session_id") == session_id) & (F.col("Q2_row") == target_row))
    row = case.agg(
        F.count(F.lit(1)), F.count_if(F.col("stage1_pred_edge") == 1), F.count_if(F.col("final_graph_pred_edge") == 1)
    ).first()
    if tuple(row) != tuple(expected):
        raise RuntimeError(f"case {session_id}/{target_row}: found {tuple(row)}, expected {tuple(expected)}")
    return case.orderBy("Q1_row")
