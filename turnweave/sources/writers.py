"""Writers: tables, small JSON records, status files, score caches."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Parquet, the format between steps."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def export_csv(df: DataFrame, path: str, single: bool = False, bom: bool = True) -> str:
    """Text export for people; ``single`` is meant for small result tables.

    Each file begins with a byte order mark, by which spreadsheets know UTF-8.
    """
    out = df.coalesce(1) if single else df
    if bom and out.columns:
        out = out.toDF(f"\ufeff{out.columns[0]}", *out.columns[1:])
    out.write.mode("overwrite").csv(path, header=True, escape='"')
    return path


def write_json_record(record: Mapping[str, object], path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        json.dump(record, handle, ensure_ascii=False, indent=2, sort_keys=True)
    return path


def write_status(path: str, completed: bool, test_loaded: bool, message: str) -> str:
    """Run status, rewritten at each phase change."""
    return write_json_record(
        {"completed": completed, "formal_test_loaded": test_loaded, "message": message}, path
    )


def record_hash(record: Mapping[str, object]) -> str:
    text = json.dumps(record, ensure_ascii=False, sort_keys=True)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def file_hash(path: str, block: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as handle:
        while chunk := handle.read(block):
            digest.update(chunk)
    return digest.hexdigest()


def directory_hash(root: str) -> str:
    """Hash of relative paths and contents of all files below a folder."""
    digest = hashlib.sha256()
    found = (os.path.join(base, f) for base, _, files in os.walk(root) for f in files)
    for path in sorted(found, key=lambda p: os.path.relpath(p, root).replace(os.sep, "/")):
        name = os.path.relpath(path, root).replace(os.sep, "/")
        digest.update(f"{name}\n{file_hash(path)}\n".encode("utf-8"))
    return digest.hexdigest()


def cache_path(root: str, name: str, meta: Mapping[str, object]) -> str:
    """Folder of a score cache, keyed by model name and parameters."""
    return os.path.join(root, "cache", f"{_slug(name)}_{record_hash({'name': name, **meta})[:24]}")


def write_score_cache(scores: DataFrame, path: str, meta: Mapping[str, object]) -> str:
    """Scores first, metadata last: a cache without metadata is never read."""
    scores.write.mode("overwrite").parquet(f"{path}/scores")
    spark = scores.sparkSession
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/meta")
    return path


def _slug(name: str) -> str:
    return re.sub("[^0-9a-z]+", "_", name.lower()).strip("_") or "baseline"


def prediction_audit(long: DataFrame, models: Sequence[str]) -> DataFrame:
    """Wide audit table from ``edge_id, Model, score, pred`` rows: one pivot.

    The model list is known, so the pivot needs no extra pass to find it.
    """
    keyed = long.withColumn("_slug", slugify(F.col("Model")))
    names = [_slug(m) for m in models]
    keys = [c for c in ("edge_id", "session_id", "Q1_row", "Q2_row", "edge_label") if c in long.columns]
    wide = keyed.groupBy(*keys).pivot("_slug", names).agg(
        F.first("score").alias("score"), F.first("pred").alias("pred")
    )
    return wide


def freeze_manifest(rows: Mapping[str, DataFrame]) -> dict[str, dict[str, int]]:
    """Rows, sessions and true edges per split, one small record."""
    def measure(item: tuple[str, DataFrame]) -> DataFrame:
        name, df = item
        sizes = df.groupBy("session_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("edge_label").cast("long")).alias("t")
        )
        return sizes.agg(
            F.lit(name).alias("split"), F.sum("n").alias("rows"),
            F.count(F.lit(1)).alias("sessions"), F.sum("t").alias("true_edges"),
        )

    table = reduce(DataFrame.unionByName, map(measure, rows.items()))
    return {
        r["split"]: {k: int(r[k] or 0) for k in ("rows", "sessions", "true_edges")}
        for r in table.collect()
    }
