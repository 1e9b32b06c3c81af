"""Embedding tables from an injected encoder, keyed by content hash.

The encoder is any callable from texts (or text pairs) to a matrix.  Each
distinct text is encoded once; an earlier table spares the texts it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup_join

Encoder = Callable[[Sequence[str]], np.ndarray]
PairEncoder = Callable[[Sequence[str], Sequence[str]], np.ndarray]
SCHEMA = "text_sha string, embedding array<float>"


def text_key(*texts: Column) -> Column:
    """Content hash of one text or of several, kept apart by a separator."""
    return F.sha2(F.concat_ws("\x1f", *texts), 256)


def _batches(encode: Callable[[pd.DataFrame], np.ndarray], batch_size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start:start + batch_size]
                matrix = np.asarray(encode(part), dtype=np.float32)
                yield pd.DataFrame({"text_sha": part["text_sha"].to_numpy(), "embedding": list(matrix)})

    return run


def encode_texts(
    texts: DataFrame,
    encoder: Encoder,
    column: str = "text",
    known: DataFrame | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """``text_sha, embedding`` for every distinct text; ``known`` rows are reused."""
    keyed = texts.select(text_key(F.col(column)).alias("text_sha"), F.col(column).alias("text"))
    wanted = keyed.dropDuplicates(["text_sha"])
    missing = wanted if known is None else wanted.join(known.select("text_sha"), "text_sha", "left_anti")
    fresh = missing.mapInPandas(_batches(lambda p: encoder(p["text"].tolist()), batch_size), SCHEMA)
    if known is None:
        return fresh
    return fresh.unionByName(known.join(wanted.select("text_sha"), "text_sha", "left_semi"))


def encode_pairs(
    edges: DataFrame,
    encoder: PairEncoder,
    first: str = "anchor_text",
    second: str = "candidate_text",
    batch_size: int = 32,
) -> DataFrame:
    """Joint encodings of distinct text pairs, keyed by the hash of both."""
    keyed = edges.select(
        text_key(F.col(first), F.col(second)).alias("text_sha"), F.col(first).alias("a"), F.col(second).alias("b")
    ).dropDuplicates(["text_sha"])
    return keyed.mapInPandas(
        _batches(lambda p: encoder(p["a"].tolist(), p["b"].tolist()), batch_size), SCHEMA
    )


def attach(
    df: DataFrame, table: DataFrame, *columns: str,
    name: str = "embedding", spread: str = "edge_id", salts: int = 0,
) -> DataFrame:
    """Add the embedding of the text (or text pair) in ``columns``.

    A text may stand for a large share of all rows, so its rows are dealt by
    ``spread`` over copies of the table once that is too large to broadcast.
    """
    renamed = table.select("text_sha", F.col("embedding").alias(name))
    keyed = df.withColumn("text_sha", text_key(*[F.col(c) for c in columns]))
    return lookup_join(keyed, renamed, ["text_sha"], F.col(spread), "left", salts).drop("text_sha")
