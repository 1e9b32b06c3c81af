"""Readers for raw records, edge tables, manifests and cached scores."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.candidates import choose_block, number_records, prepare_raw_records, raw_order
from ..operators.labeling import initialize_labels
from ..operators.splits import add_pair_texts, check_manifest, normalize_columns, normalize_manifest

REPLACEMENT = "�"
LEGACY_CHARSETS = "spark.sql.legacy.javaCharsets"


def _csv(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    return spark.read.csv(
        path, header=True, inferSchema=False, multiLine=True, escape='"', encoding=encoding
    )


def detect_encoding(spark: SparkSession, path: str, first: str = "GBK", second: str = "UTF-8") -> str:
    """``first`` unless the files hold bytes it cannot decode.

    Spark replaces undecodable bytes instead of failing, so the whole text is
    searched for the replacement character, as a distributed job.
    """
    spark.conf.set(LEGACY_CHARSETS, "true")
    df = _csv(spark, path, first)
    if any(REPLACEMENT in c for c in df.columns):
        return second
    # column names come from decoded headers and may need quoting
    damaged = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.contains(df[f"`{c}`"], F.lit(REPLACEMENT)), F.lit(False)) for c in df.columns],
    )
    return first if df.where(damaged).isEmpty() else second


def read_raw_records(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Raw Q&A rows with padded codes, session ids and positions.

    Yields the raw columns plus ``session_id, pos`` and the cleaned ``Q, A``.
    """
    from ..functions.text import clean_text

    chosen = encoding or detect_encoding(spark, path)
    if chosen.upper() not in ("UTF-8", "UTF8"):
        spark.conf.set(LEGACY_CHARSETS, "true")
    raw = prepare_raw_records(_csv(spark, path, chosen))
    order = raw_order(raw.columns)
    if order == ("Qnumbr",):
        raw = raw.withColumn("Qnumbr", F.coalesce(F.col("Qnumbr").try_cast("long").cast("string"), "Qnumbr"))
        raw = raw.withColumn("_n", F.col("Qnumbr").try_cast("long"))
        order = ("_n", "Qnumbr")
    # file order is not kept by a distributed read; the texts break ties
    texts = [c for c in ("Qcntet", "Acntet") if c in raw.columns]
    block = choose_block(raw, "session_id") if order else None
    numbered = number_records(raw, "session_id", (*order, *texts), "pos", block)
    return numbered.drop("_n").withColumns(
        {"Q": clean_text(F.col("Qcntet")), "A": clean_text(F.col("Acntet"))}
    )


def read_edges(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Candidate edges: Parquet as stored, CSV as text with empty for missing."""
    if path.rstrip("/").lower().endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue=None)
        df = df.na.fill("")
    else:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def nothing_there(error: AnalysisException) -> bool:
    """A missing path or a file without content; any other fault must not pass as a first run."""
    return (error.getCondition() or "").startswith(("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))


def resume_edges(spark: SparkSession, path: str) -> DataFrame | None:
    """An earlier labelled snapshot, or None when there is none to resume."""
    try:
        df = read_edges(spark, path)
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        return None
    return initialize_labels(df) if df.columns else None


def read_scored_split(spark: SparkSession, path: str) -> DataFrame:
    """A scored split with normalised columns and pair texts."""
    df = add_pair_texts(normalize_columns(read_edges(spark, path)))
    missing = {"session_id", "Q1_row", "Q2_row", "edge_label"} - set(df.columns)
    if missing:
        raise RuntimeError(f"{path} is missing columns: {sorted(missing)}")
    return df


def read_manifest(
    spark: SparkSession, path: str, strict: bool = True, expected: dict[str, int] | None = None
) -> DataFrame:
    """Session manifest; strict reading checks the full contract."""
    if path.lower().endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.csv(path, header=True, inferSchema=False)
    manifest = normalize_manifest(raw, aliases=strict)
    check_manifest(manifest, expected, complete=strict)
    return manifest


def read_json_record(path: str) -> dict:
    """A small JSON parameter record (driver side)."""
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)


def read_score_cache(spark: SparkSession, path: str, meta: dict) -> DataFrame | None:
    """Cached scores when their stored metadata equals ``meta``."""
    try:
        stored = spark.read.parquet(f"{path}/meta").first()
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        return None
    if stored is None or json.loads(stored["meta"]) != json.loads(json.dumps(meta)):
        return None
    return spark.read.parquet(f"{path}/scores")


# Declared layout of a candidate-edge table.
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("edge_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("Q1_row", T.IntegerType()),
        T.StructField("Q2_row", T.IntegerType()),
        T.StructField("distance", T.IntegerType()),
        T.StructField("Q1", T.StringType()),
        T.StructField("A1", T.StringType()),
        T.StructField("Q2", T.StringType()),
    ]
)
