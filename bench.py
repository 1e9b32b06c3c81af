"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnweave.plans.queries import REGISTRY  # noqa: E402
from turnweave.session import local_session  # noqa: E402

HEADLINE = (
    "candidate_edges_w5",
    "topic_shift_score",
    "interaction_channels",
    "retention_search",
    "recovery_graph",
    "exactness_audit",
    "penalty_grid",
    "split_metrics",
    "best_f1_threshold",
    "topk_threshold_search",
    "bm25_scores",
    "model_comparison",
    "cosine_pairs",
    "node_mean_agg",
    "error_columns",
    "stage_transitions",
    "bootstrap_ci",
    "unique_anchor_batches",
    "long_recovery_graph",
    "long_penalty_grid",
    "bootstrap_models",
    "event_sessions",
    "graph_forward",
    "score_fusion",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("turnweave-bench", cores=cpus, spark__sql__shuffle__partitions=cpus)
    # one untimed query so that session start is not charged to the first
    REGISTRY["candidate_distance_hist"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
