"""Label columns, pending rows, response parsing and label normalisation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_number
from ..functions.text import zero_fill

Labeler = Callable[[str], str]
# Label columns with defaults, response fields.
LABEL_DEFAULTS = {
    "dependent": "",
    "dependency_type": "",
    "relation_type": "",
    "dep_reason": "",
    "done": 0,
    "topic_shift_score": "",
    "topic_shift_flags": "",
    "topic_shift_bucket": "",
}
RESPONSE_SCHEMA = "dependent string, dependency_type string, relation_type string, reason string"


def initialize_labels(edges: DataFrame) -> DataFrame:
    """Add missing label columns; ``done`` becomes an integer."""
    new = {c: F.lit(v) for c, v in LABEL_DEFAULTS.items() if c not in edges.columns}
    out = edges.withColumns(new) if new else edges
    fixed = {"done": to_number(F.col("done")).cast("int")}
    if "Scode" in out.columns:
        fixed["Scode"] = zero_fill(F.col("Scode"))
    return out.withColumns(fixed)


def is_pending(retry_errors: bool = False) -> Column:
    todo = F.coalesce(F.col("done"), F.lit(0)) != 1
    if retry_errors:
        todo = todo | (F.trim(F.coalesce(F.col("dependent"), F.lit(""))) == "Error")
    return todo


def pending(edges: DataFrame, retry_errors: bool = False, limit: int = 0) -> DataFrame:
    rows = edges.where(is_pending(retry_errors))
    if limit > 0:
        return rows.orderBy("session_id", "Q1_row", "Q2_row").limit(limit)
    return rows


def prompt_text() -> Column:
    return F.concat(
        F.lit("Q1: "), "Q1", F.lit("\nA1: "), "A1", F.lit("\nQ2: "), "Q2",
        F.lit("\ndistance: "), F.col("distance").cast("string"),
    )


def json_object(response: Column) -> Column:
    """The whole response when it is an object, else its outermost braces.

    Null when neither parses (also for an empty response).
    """
    text = F.trim(response)
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    valid = lambda c: F.get_json_object(c, "$").isNotNull() & c.startswith("{")
    return F.when(valid(text), text).when(valid(inner), inner)


def parse_response(response: Column) -> Column:
    """Struct of the four response fields (null struct when unparsable)."""
    return F.from_json(json_object(response), RESPONSE_SCHEMA)


def normalize_labels(parsed: Column, raw: Column) -> dict[str, Column]:
    """Rules that turn a parsed answer into label columns."""
    missing = parsed.isNull()
    answer = F.coalesce(parsed["dependent"], F.lit("Error"))
    dependent = F.when(missing | ~answer.isin("Yes", "No"), "Error").otherwise(answer)
    kind = F.coalesce(parsed["dependency_type"], F.lit("Error"))
    relation = F.coalesce(parsed["relation_type"], F.lit("Error"))
    relation = F.when(relation == "Interaction-Complaint", "Complaint").otherwise(relation)
    no = dependent == "No"
    return {
        "dependent": dependent,
        "dependency_type": F.when(no, "No-Dependency").otherwise(kind),
        "relation_type": F.when(no, "Topic Shift").otherwise(relation),
        "dep_reason": F.when(missing, "API failed").otherwise(F.coalesce(parsed["reason"], raw)),
    }


def _caller(labeler: Labeler, retries: int, pause: float, stop_after: int):
    """Per-task loop around the injected labeler.

    A failed call is retried with growing pauses.  After ``stop_after`` failures
    in a row the task stops calling and leaves its other rows pending.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed_in_row, stopped = 0, False
        for batch in batches:
            answers: list[str | None] = []
            called: list[int] = []
            for prompt in batch["prompt"]:
                answer = None
                if not stopped:
                    for attempt in range(retries):
                        try:
                            answer = labeler(prompt)
                            break
                        except Exception:  # noqa: BLE001 - any failure of the service counts
                            time.sleep(pause * (attempt + 1))
                called.append(0 if stopped else 1)
                answers.append(answer)
                if not stopped:
                    failed_in_row = 0 if answer and answer.strip() else failed_in_row + 1
                    stopped = stop_after > 0 and failed_in_row >= stop_after
            yield pd.DataFrame(
                {"edge_id": batch["edge_id"], "response": answers, "called": called}
            )

    return run


def label_edges(
    edges: DataFrame,
    labeler: Labeler,
    retry_errors: bool = False,
    limit: int = 0,
    retries: int = 3,
    pause: float = 5.0,
    stop_after: int = 5,
) -> DataFrame:
    """Label pending rows with an injected ``prompt -> response text`` callable.

    Only key and prompt travel to Python; parsing and rules stay in the JVM.
    Rows that are not pending, or were not reached, come back unchanged.
    """
    todo = pending(edges, retry_errors, limit).select("edge_id", prompt_text().alias("prompt"))
    answers = todo.mapInPandas(
        _caller(labeler, retries, pause, stop_after),
        "edge_id string, response string, called int",
    ).where(F.col("called") == 1)
    labels = normalize_labels(F.col("_p"), F.col("response"))
    fresh = answers.withColumn("_p", parse_response(F.col("response"))).select(
        "edge_id", *[v.alias(f"_{k}") for k, v in labels.items()]
    )
    merged = edges.join(fresh, "edge_id", "left")
    hit = F.col("_dependent").isNotNull()
    out = merged.withColumns(
        {k: F.when(hit, F.col(f"_{k}")).otherwise(F.col(k)) for k in labels}
    ).withColumn("done", F.when(hit, F.lit(1)).otherwise(F.col("done")))
    return out.select(*edges.columns)


def value_counts(edges: DataFrame, columns: list[str]) -> DataFrame:
    """Distribution of several label columns in one pass (nulls included)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return edges.select(F.inline(pairs)).groupBy("column", "value").count()
