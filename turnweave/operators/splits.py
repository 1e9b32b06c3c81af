"""Session splits: manifests, assignment, leakage checks, column normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import to_number
from ..functions.text import anchor_text, candidate_text, clean_text
from ..session import lookup_join

SPLITS = ("train", "validation", "test")
# Accepted spellings and the label remap.
SPLIT_ALIASES = {"val": "validation", "valid": "validation", "dev": "validation"}
RELATION_ALIASES = {"Clarification": "Elaboration"}


def _aliased(value: Column, aliases: Mapping[str, str]) -> Column:
    out = value
    for old, new in aliases.items():
        out = F.when(value == old, new).otherwise(out)
    return out


def normalize_split(value: Column) -> Column:
    return _aliased(F.lower(clean_text(value)), SPLIT_ALIASES)


def normalize_manifest(manifest: DataFrame, aliases: bool = True) -> DataFrame:
    missing = {"session_id", "split"} - set(manifest.columns)
    if missing:
        raise ValueError(f"the manifest needs the columns {sorted(missing)}")
    if aliases:
        return manifest.select(
            clean_text(F.col("session_id")).alias("session_id"), normalize_split(F.col("split")).alias("split")
        )
    return manifest.select(
        F.col("session_id").cast("string").alias("session_id"),
        F.lower(F.trim(F.col("split").cast("string"))).alias("split"),
    )


def manifest_report(manifest: DataFrame) -> DataFrame:
    """One row: sessions per split, empties, repeats and unknown splits."""
    per_session = manifest.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("split").alias("_split")
    )
    return per_session.agg(
        *[F.count_if(F.col("_split") == s).alias(s) for s in SPLITS],
        F.count_if(F.coalesce(F.col("session_id"), F.lit("")) == "").alias("empty_sessions"),
        F.count_if(F.col("_n") > 1).alias("repeated_sessions"),
        F.count_if(~F.coalesce(F.col("_split"), F.lit("")).isin(*SPLITS)).alias("unknown_splits"),
    )


def check_manifest(manifest: DataFrame, expected: Mapping[str, int] | None = None, complete: bool = True) -> None:
    """Raise with every violation of the manifest contract at once."""
    row = manifest_report(manifest).first().asDict()
    problems = [f"{k}={row[k]}" for k in ("empty_sessions", "repeated_sessions", "unknown_splits") if row[k]]
    if complete:
        problems += [f"split {s} is empty" for s in SPLITS if not row[s]]
    problems += [f"{s}: {row[s]} sessions, expected {n}" for s, n in (expected or {}).items() if row[s] != n]
    if problems:
        raise ValueError("manifest: " + "; ".join(problems))


def split_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(F.count_distinct("session_id").alias("sessions"))


def assign_split(edges: DataFrame, manifest: DataFrame, salts: int = 0) -> DataFrame:
    """Attach ``split``; a session with very many rows is dealt over salts."""
    return lookup_join(edges, manifest, ["session_id"], F.col("edge_id"), "left", salts)


def coverage_gaps(edges: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sessions in only one of the two tables (anti joins both ways)."""
    seen = edges.select("session_id").distinct()
    known = manifest.select("session_id")
    unknown = seen.join(known, "session_id", "left_anti").withColumn("problem", F.lit("not_in_manifest"))
    absent = known.join(seen, "session_id", "left_anti").withColumn("problem", F.lit("not_in_data"))
    return unknown.unionByName(absent)


def overlapping_sessions(edges: DataFrame) -> DataFrame:
    """Sessions that occur in more than one split."""
    return (
        edges.select("session_id", "split")
        .distinct()
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("splits"))
        .where(F.col("splits") > 1)
    )


def split_manifest(edges: DataFrame) -> DataFrame:
    return edges.select("session_id", "split").distinct()


def add_labels(edges: DataFrame) -> DataFrame:
    return edges.withColumns(
        {
            "edge_label": F.coalesce(F.col("dependent") == "Yes", F.lit(False)).cast("int"),
            "relation_type_train": _aliased(F.col("relation_type"), RELATION_ALIASES),
        }
    )


def positive_mask(edges: DataFrame) -> Column:
    """Yes-like text in ``dependent``, else ``edge_label`` of strictly 0 or 1."""
    if "dependent" in edges.columns:
        return F.lower(F.trim(F.col("dependent").cast("string"))).isin("yes", "1", "true")
    if "edge_label" not in edges.columns:
        raise ValueError("training rows need dependent or edge_label")
    value = to_number(F.col("edge_label"), None)
    return F.when(value.isin(0.0, 1.0), value == 1.0).otherwise(
        F.raise_error(F.lit("edge_label must be 0 or 1")).cast("boolean")
    )


def add_text_features(edges: DataFrame, sizes: Mapping[str, str] | None = None) -> DataFrame:
    """Text lengths and a numeric distance; ``sizes`` names carried lengths where edges have no texts."""
    lengths = {f"{c.lower()}_len": F.length(clean_text(F.col(c))) for c in ("Q1", "A1", "Q2")}
    if sizes is not None:
        lengths = {name: F.col(c) for name, c in sizes.items()}
    return edges.withColumns({**lengths, "distance_num": to_number(F.col("distance"), 0.0)})


def normalize_columns(edges: DataFrame) -> DataFrame:
    """Derive label and distance from whichever columns a table has."""
    names = set(edges.columns)
    if "edge_label" in names:
        label = to_number(F.col("edge_label")).cast("int")
    elif "dependent" in names:
        label = F.coalesce(F.lower(F.col("dependent").cast("string")) == "yes", F.lit(False)).cast("int")
    elif "label" in names:
        label = to_number(F.col("label")).cast("int")
    else:
        raise ValueError("no column to derive edge_label from")
    if "distance_num" in names:
        distance = to_number(F.col("distance_num"))
    elif "distance" in names:
        distance = to_number(F.col("distance"))
    else:
        distance = F.coalesce(
            to_number(F.col("Q2_row"), None) - to_number(F.col("Q1_row"), None), F.lit(0.0)
        )
    return edges.withColumns({"edge_label": label, "distance_num": distance})


def add_pair_texts(edges: DataFrame) -> DataFrame:
    """``anchor_text`` and ``candidate_text``; a missing text column is empty."""
    have = {c: (F.col(c) if c in edges.columns else F.lit("")) for c in ("Q1", "A1", "Q2")}
    clean = {c: clean_text(v, nan_is_missing=True) for c, v in have.items()}
    return edges.withColumns(
        {
            "anchor_text": anchor_text(clean["Q1"], clean["A1"]),
            "candidate_text": candidate_text(clean["Q2"]),
        }
    )


def align(reference: DataFrame, graph: DataFrame, required: str = "final_graph_pred_edge") -> DataFrame:
    """Left-align a graph to reference rows, one to one.

    Unmatched reference rows and repeated keys on either side raise inside the
    job, so no aligned row can be read without the check having run.
    """
    if required not in graph.columns:
        raise RuntimeError(f"the graph has no column {required}")
    keys = ["edge_id"] if {"edge_id"} <= set(reference.columns) & set(graph.columns) else [
        "session_id", "Q1_row", "Q2_row"
    ]
    text = [F.col(k).cast("string").alias(k) for k in keys]
    left = reference.select(*text).groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    payload = [c for c in graph.columns if c not in keys]
    right = graph.select(*text, F.struct(*payload).alias("_g")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_nr"), F.any_value("_g").alias("_g")
    )
    joined = left.join(right, keys, "left")
    problem = (
        F.when(F.col("_nl") > 1, "repeated reference row")
        .when(F.col("_nr") > 1, "repeated graph row")
        .when(F.col(f"_g.{required}").isNull(), "unmatched reference row")
    )
    checked = joined.withColumn(
        "_g", F.when(problem.isNull(), F.col("_g")).otherwise(F.raise_error(problem))
    )
    return checked.select(*keys, *[F.col(f"_g.{c}").alias(c) for c in payload])


def order_models(table: DataFrame, order: Sequence[str], column: str = "Model") -> DataFrame:
    """Fixed model order; unknown models come last."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(column))
    return table.orderBy(F.when(place == 0, F.lit(len(order) + 1)).otherwise(place), column)
