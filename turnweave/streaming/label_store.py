"""A table of labels that batches are merged into by key.

The store is partitioned by a hash of the edge's key.  A batch rewrites only the
partitions that it touches, by dynamic partition overwrite, and takes only edges
that are still pending, so a batch that is replayed changes nothing.  When the
labelling service fails for several edges in a row, the rest of the batch stays
pending; "in a row" goes by the order of the edges' keys over the whole batch, so
the outcome does not depend on how the batch is partitioned.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.labeling import Labeler, _caller, initialize_labels, is_pending, normalize_labels, parse_response, prompt_text
from ..operators.prefix import sliced_index
from ..session import materialize

BUCKETS = 64
ORDER = ("session_id", "Q1_row", "Q2_row", "edge_id")


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("edge_id"), F.lit(buckets)).cast("int"))


def create_store(edges: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write edges with their label columns as a new store; ``edge_id`` is unique, the table may be empty."""
    rows = _bucketed(initialize_labels(edges), buckets)
    rows.write.partitionBy("bucket").parquet(path)
    # a store without rows has no file to read the columns from
    told = rows.sparkSession.createDataFrame([(rows.schema.json(),)], "value string")
    told.coalesce(1).write.text(f"{path}/_schema")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_schema").first()["value"]))
    return spark.read.schema(schema).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop("bucket")


def upsert(spark: SparkSession, path: str, rows: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace stored rows by ``rows`` of the same key, add those that are new; rows of one key must agree."""
    old = _stored(spark, path)
    columns = [c for c in old.columns if c != "bucket"]
    fresh = materialize(_bucketed(rows.select(*columns), buckets).dropDuplicates(["edge_id"]))
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most the number of buckets
    if not touched:
        return
    kept = old.where(F.col("bucket").isin(touched)).join(fresh.select("edge_id"), "edge_id", "left_anti")
    # written aside first: a partition cannot be read and replaced at once
    merged = materialize(kept.select(*columns, "bucket").unionByName(fresh))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def label_batch(
    rows: DataFrame, labeler: Labeler, retries: int = 3, pause: float = 5.0, stop_after: int = 5, order: Sequence[str] = ORDER
) -> DataFrame:
    """The rows of a batch that get a label: all, or those up to ``stop_after`` failures in a row.

    A failure is an answer that is missing or blank after all retries; it is
    labelled ``Error``.  Rows after the failures that stop the batch are left out.
    All rows of a batch are asked for, since which come first is known only then.
    """
    prompts = rows.select("edge_id", prompt_text().alias("prompt"))
    answers = prompts.mapInPandas(_caller(labeler, retries, pause, 0), "edge_id string, response string, called int").select("edge_id", "response")
    answered = materialize(rows.join(answers, "edge_id"))
    if stop_after > 0:
        failed = (F.trim(F.coalesce("response", F.lit(""))) == "").cast("long")
        numbered = answered.select(*order, failed.alias("failed"))
        numbered = materialize(sliced_index(numbered, [], F.col(order[0]), [F.col(c) for c in order], "number").select("edge_id", "number", "failed"))
        # so many failures behind one another, counted from every row
        spans = numbered.where("failed = 1").select(F.explode(F.sequence(F.col("number"), F.col("number") + stop_after - 1)).alias("number"))
        full = spans.groupBy("number").count().where(F.col("count") == stop_after).agg(F.min("number").alias("last"))
        last = full.first()["last"]  # one number
        if last is not None:
            answered = answered.join(numbered.where(F.col("number") <= last).select("edge_id"), "edge_id", "left_semi")
    labels = normalize_labels(F.col("_p"), F.col("response"))
    told = answered.withColumn("_p", parse_response(F.col("response")))
    return told.withColumns({**labels, "done": F.lit(1)}).select(*rows.columns)


def merge_batch(spark: SparkSession, path: str, batch: DataFrame, labeler: Labeler, buckets: int = BUCKETS, **options) -> None:
    """Add the edges of a batch that the store lacks and label those that are pending there."""
    known = read_store(spark, path)
    rows = initialize_labels(batch).select(*known.columns).dropDuplicates(["edge_id"])
    stored = known.join(rows.select("edge_id"), "edge_id", "left_semi")
    new = rows.join(known.select("edge_id"), "edge_id", "left_anti")
    current = materialize(stored.unionByName(new))
    labelled = label_batch(current.where(is_pending()), labeler, **options)
    waiting = new.join(labelled.select("edge_id"), "edge_id", "left_anti")
    upsert(spark, path, labelled.unionByName(waiting), buckets)


def merge_stream(
    spark: SparkSession, edges_path: str, schema: T.StructType, labeler: Labeler, path: str, checkpoint: str, files_per_batch: int = 1, **options
):
    """Merge all files of edges into the store, a batch at a time; returns the streaming query."""
    edges = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(edges_path)
    save = lambda batch, number: merge_batch(batch.sparkSession, path, batch, labeler, **options)
    return edges.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
