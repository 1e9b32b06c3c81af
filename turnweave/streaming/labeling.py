"""Resumable labelling: each micro-batch of pending edges is saved once.

Candidate edges arrive as files.  A batch is labelled and written under its
batch number, so a batch replayed after a failure overwrites its own output, and
the checkpoint resumes where the last finished batch ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.labeling import initialize_labels, label_edges
from ..operators.topicshift import auto_label_easy, with_topic_shift


def label_stream(
    spark: SparkSession,
    edges_path: str,
    schema: T.StructType,
    labeler: Callable[[str], str],
    output_path: str,
    checkpoint_path: str,
    files_per_batch: int = 1,
    denoise: bool = True,
    **options,
):
    """Start a run over all files present; returns the streaming query."""
    edges = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(edges_path)
    )

    def save(batch: DataFrame, number: int) -> None:
        rows = initialize_labels(batch)
        if denoise:
            rows = auto_label_easy(with_topic_shift(rows))
        labelled = label_edges(rows, labeler, **options)
        labelled.write.mode("overwrite").parquet(f"{output_path}/batch={number}")

    return (
        edges.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def labelled_so_far(spark: SparkSession, output_path: str) -> DataFrame:
    return spark.read.parquet(output_path)
