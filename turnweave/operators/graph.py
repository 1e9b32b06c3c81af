"""Candidate graph tables: role nodes and one round of neighbour averaging."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text

NODE = ("session_id", "row", "role")


def node_texts(edges: DataFrame) -> DataFrame:
    """One row per (session, row, role): source = question + answer, target = question.

    Every edge of a node repeats the same record, so any one of them serves.
    """
    source = edges.select(
        "session_id",
        F.col("Q1_row").alias("row"),
        F.lit("source").alias("role"),
        F.concat_ws(" ", clean_text(F.col("Q1")), clean_text(F.col("A1"))).alias("text"),
    )
    target = edges.select(
        "session_id",
        F.col("Q2_row").alias("row"),
        F.lit("target").alias("role"),
        clean_text(F.col("Q2")).alias("text"),
    )
    return source.unionByName(target).groupBy(*NODE).agg(F.max("text").alias("text"))


def directed_edges(edges: DataFrame) -> DataFrame:
    """Arcs between role nodes, each pair once."""
    return edges.select("session_id", "Q1_row", "Q2_row").distinct()


def _arcs(edges: DataFrame, direction: str) -> DataFrame:
    """(node, neighbour) pairs: ``in`` looks at sources, ``out`` at targets."""
    pairs = directed_edges(edges)
    if direction == "in":
        mine, other, role, other_role = "Q2_row", "Q1_row", "target", "source"
    else:
        mine, other, role, other_role = "Q1_row", "Q2_row", "source", "target"
    return pairs.select(
        "session_id",
        F.col(mine).alias("row"),
        F.lit(role).alias("role"),
        F.col(other).alias("nb_row"),
        F.lit(other_role).alias("nb_role"),
    )


def _mean(nodes: DataFrame, arcs: DataFrame, name: str) -> DataFrame:
    """Mean neighbour vector; vectors are combined map-side by the summarizer.

    A node has at most as many neighbours as the candidate window is long.
    """
    neighbours = nodes.select(
        "session_id",
        F.col("row").alias("nb_row"),
        F.col("role").alias("nb_role"),
        array_to_vector(F.col("x")).alias("_v"),
    )
    return (
        arcs.join(neighbours, ["session_id", "nb_row", "nb_role"])
        .groupBy(*NODE)
        .agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(name))
    )


def mean_aggregation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected mean over neighbours and the node itself (``neigh``)."""
    self_loop = nodes.select(
        *NODE, F.col("row").alias("nb_row"), F.col("role").alias("nb_role")
    )
    arcs = _arcs(edges, "in").unionByName(_arcs(edges, "out")).unionByName(self_loop)
    return _mean(nodes, arcs, "neigh")


def in_out_aggregation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Separate means over incoming and outgoing neighbours; none gives zeros."""
    incoming = _mean(nodes, _arcs(edges, "in"), "incoming")
    outgoing = _mean(nodes, _arcs(edges, "out"), "outgoing")
    zeros = F.transform(F.col("x"), lambda _: F.lit(0.0))
    return (
        nodes.join(incoming, list(NODE), "left")
        .join(outgoing, list(NODE), "left")
        .select(
            *NODE,
            F.coalesce("incoming", zeros).alias("incoming"),
            F.coalesce("outgoing", zeros).alias("outgoing"),
        )
    )


def edge_states(edges: DataFrame, nodes: DataFrame, column: str = "x") -> DataFrame:
    """Edge head input [h_s, h_t, |h_s-h_t|, h_s*h_t] from node states."""
    side = lambda role, key, name: nodes.where(F.col("role") == role).select(
        "session_id", F.col("row").alias(key), F.col(column).alias(name)
    )
    both = edges.join(side("source", "Q1_row", "_hs"), ["session_id", "Q1_row"]).join(
        side("target", "Q2_row", "_ht"), ["session_id", "Q2_row"]
    )
    features = F.concat(
        "_hs",
        "_ht",
        F.zip_with("_hs", "_ht", lambda a, b: F.abs(a - b)),
        F.zip_with("_hs", "_ht", lambda a, b: a * b),
    )
    return both.withColumn("edge_state", features).drop("_hs", "_ht")
