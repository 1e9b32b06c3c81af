"""Vector work on runs of records: a vector reaches a task once, never an edge.

Records are dealt to groups that hold whole sessions, or blocks of long ones, and
the first and last records of a block are shown to its neighbours as far as a
result reaches.  Inside a group all pairs at one distance are two slices of the
same matrix, so scores, neighbour means and layers of a graph network are matrix
operations.  The only exchange is the one that builds the groups.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 4_096
ROWS_A_GROUP = 50_000
#: edges whose features live at once inside a task
EDGES_AT_ONCE = 4_096


@dataclass
class Run:
    """Records of one group in the order of session and position."""

    session: pa.ChunkedArray
    code: np.ndarray
    pos: np.ndarray
    home: np.ndarray
    opens: np.ndarray
    asks: np.ndarray
    vectors: dict[str, np.ndarray]
    window: int
    raw: dict[str, pa.ChunkedArray]

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(sources, targets) for each distance from 1 to the window."""
        out = []
        for k in range(1, self.window + 1):
            if k >= len(self.pos):
                break
            same = (self.code[k:] == self.code[:-k]) & (self.pos[k:] - self.pos[:-k] == k) & self.opens[:-k] & self.asks[k:]
            i = np.flatnonzero(same)
            out.append((i, i + k))
        return out

    def own_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs whose source is at home here."""
        some = [(i[self.home[i]], j[self.home[i]]) for i, j in self.pairs()]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(s[n] for s in some)]) for n in (0, 1))

    def edges(self, i: np.ndarray, j: np.ndarray, **columns: np.ndarray) -> pa.Table:
        """Edge rows (session_id, Q1_row, Q2_row) and further columns."""
        named = {"session_id": self.session.take(pa.array(i)), "Q1_row": pa.array(self.pos[i], pa.int32()), "Q2_row": pa.array(self.pos[j], pa.int32())}
        return pa.table(named | {c: pa.array(v) for c, v in columns.items()})

    def roles(self) -> tuple[np.ndarray, np.ndarray]:
        """Which records are nodes as sources and as targets: those of some pair."""
        source, target = np.zeros(len(self.pos), bool), np.zeros(len(self.pos), bool)
        for i, j in self.pairs():
            source[i] = True
            target[j] = True
        return source, target


def on_runs(
    records: DataFrame,
    vectors: Sequence[str],
    compute: Callable[[Run], pa.Table],
    schema: str,
    window: int = 5,
    reach: int | None = None,
    block: int = BLOCK,
    raw: Sequence[str] = (),
    rows_a_group: int = ROWS_A_GROUP,
) -> DataFrame:
    """``compute`` for every group of ``records`` (session_id, pos, opens, asks, vector and ``raw`` columns).

    ``pos`` counts the records of a session from 0; ``reach`` is how many records
    to either side of a home record a result may depend on (the window, if not
    given).  Vectors of one column have one length.
    """
    reach = window if reach is None else reach
    if window < 1 or reach < window or block < reach:
        raise ValueError("need 1 <= window <= reach <= block")
    count = records.count()
    groups = max(1, math.ceil(count / rows_a_group))
    pos = F.col("pos").cast("bigint")
    home = F.floor(pos / block)
    shown = F.sequence(F.greatest(F.floor((pos - reach) / block), F.lit(0)), F.floor((pos + reach) / block))
    rows = records.select(
        "session_id", pos.alias("pos"), F.coalesce("opens", F.lit(False)).alias("opens"), F.coalesce("asks", F.lit(False)).alias("asks"), *vectors, *raw,
        F.pmod(F.xxhash64("session_id"), F.lit(groups)).alias("_group"), home.alias("_home"), F.explode(shown).alias("_block"),
    )

    def task(table: pa.Table) -> pa.Table:
        codes = table.column("session_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((table.column("pos").to_numpy(), codes))
        table = table.take(pa.array(order))
        matrix = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1).astype(np.float64)
        flag = lambda c: table.column(c).to_numpy(zero_copy_only=False).astype(bool)
        at_home = (table.column("_home").to_numpy() == table.column("_block").to_numpy()).astype(bool)
        return compute(Run(
            table.column("session_id"), codes[order], table.column("pos").to_numpy(), at_home, flag("opens"), flag("asks"),
            {c: matrix(c) for c in vectors}, window, {c: table.column(c) for c in raw},
        ))

    return rows.groupBy("_group", "_block").applyInArrow(task, schema)


def _edge_schema(records: DataFrame, more: str) -> str:
    return f"session_id {records.schema['session_id'].dataType.simpleString()}, Q1_row int, Q2_row int, {more}"


def edge_id() -> Column:
    return F.concat_ws("_", "session_id", "Q1_row", "Q2_row").alias("edge_id")


def _in_parts(run: Run, reduce: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], edges_at_once: int) -> pa.Table:
    """Edge rows with the columns that ``reduce`` makes of (sources, targets), some thousand edges at once."""
    i, j = run.own_pairs()
    found = [reduce(i[at : at + edges_at_once], j[at : at + edges_at_once]) for at in range(0, max(len(i), 1), edges_at_once)]
    return run.edges(i, j, **{c: np.concatenate([f[c] for f in found]) for c in found[0]})


def cosine_edges(records: DataFrame, source: str, target: str, window: int = 5, **options) -> DataFrame:
    """``session_id, Q1_row, Q2_row, cosine`` of all candidate edges."""

    def compute(run: Run) -> pa.Table:
        a, b = run.vectors[source], run.vectors[target]
        size = np.maximum
        na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        cosine = lambda i, j: {"cosine": (a[i] * b[j]).sum(axis=1) / size(na[i] * nb[j], 1e-12)}
        return _in_parts(run, cosine, EDGES_AT_ONCE)

    return on_runs(records, list(dict.fromkeys([source, target])), compute, _edge_schema(records, "cosine double"), window, **options)


def feature_edges(
    records: DataFrame,
    source: str,
    target: str,
    numeric: tuple[Sequence[str], Sequence[str]],
    reduce: Callable[[np.ndarray], dict[str, np.ndarray]],
    schema: str,
    window: int = 5,
    rows_at_once: int = EDGES_AT_ONCE,
    **options,
) -> DataFrame:
    """What ``reduce`` makes of the feature rows [dot, distance, numerics, |a - b|, a * b] of all candidate edges.

    ``numeric`` names one-number vector columns of the source and of the target
    record.  Features live inside a task, some thousand rows at once; a scorer or a
    digest leaves it, by the columns of ``schema``.
    """
    ours, theirs = numeric

    def compute(run: Run) -> pa.Table:
        a, b = run.vectors[source].astype(np.float32), run.vectors[target].astype(np.float32)

        def features(p: np.ndarray, q: np.ndarray) -> dict[str, np.ndarray]:
            x, y = a[p], b[q]
            dot = (x.astype(np.float64) * y).sum(axis=1, keepdims=True).astype(np.float32)
            numbers = [(run.pos[q] - run.pos[p])[:, None], *(run.vectors[c][p] for c in ours), *(run.vectors[c][q] for c in theirs)]
            return reduce(np.hstack([dot, *(n.astype(np.float32) for n in numbers), np.abs(x - y), x * y]))

        return _in_parts(run, features, rows_at_once)

    return on_runs(records, list(dict.fromkeys([source, target, *ours, *theirs])), compute, _edge_schema(records, schema), window, **options)


def state_edges(records: DataFrame, source: str, target: str, reduce: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, window: int = 5, **options) -> DataFrame:
    """What ``reduce`` makes of the edge states [s, t, |s - t|, s * t] of all candidate edges, some thousand at once."""

    def compute(run: Run) -> pa.Table:
        def states(i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
            s, t = run.vectors[source][i], run.vectors[target][j]
            return reduce(np.hstack([s, t, np.abs(s - t), s * t]))

        return _in_parts(run, states, EDGES_AT_ONCE)

    return on_runs(records, list(dict.fromkeys([source, target])), compute, _edge_schema(records, schema), window, **options)


def neighbour_means(run: Run, s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums and numbers of neighbours: of every source over its targets, of every target over its sources."""
    out, into = np.zeros_like(t), np.zeros_like(s)
    n_out, n_in = np.zeros(len(s)), np.zeros(len(s))
    for i, j in run.pairs():
        out[i] += t[j]
        n_out[i] += 1
        into[j] += s[i]
        n_in[j] += 1
    return out, n_out[:, None], into, n_in[:, None]


def _node_table(run: Run, keep: tuple[np.ndarray, np.ndarray], columns: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    at = [np.flatnonzero(k & run.home) for k in keep]
    both = np.concatenate(at)
    role = ["source"] * len(at[0]) + ["target"] * len(at[1])
    named = {"session_id": run.session.take(pa.array(both)), "row": pa.array(run.pos[both], pa.int32()), "role": pa.array(role)}
    values = {c: pa.array(list(np.vstack([s[at[0]], t[at[1]]])), pa.list_(pa.float64())) for c, (s, t) in columns.items()}
    return pa.table(named | values)


def _node_schema(records: DataFrame, more: str) -> str:
    return f"session_id {records.schema['session_id'].dataType.simpleString()}, row int, role string, {more}"


def mean_nodes(records: DataFrame, source: str, target: str, window: int = 5, **options) -> DataFrame:
    """``neigh``: mean of every role node over itself and its neighbours."""

    def compute(run: Run) -> pa.Table:
        s, t = run.vectors[source], run.vectors[target]
        out, n_out, into, n_in = neighbour_means(run, s, t)
        return _node_table(run, run.roles(), {"neigh": ((s + out) / (1 + n_out), (t + into) / (1 + n_in))})

    return on_runs(records, list(dict.fromkeys([source, target])), compute, _node_schema(records, "neigh array<double>"), window, **options)


def in_out_nodes(records: DataFrame, source: str, target: str, window: int = 5, **options) -> DataFrame:
    """``incoming, outgoing``: means over sources and over targets; none gives zeros."""

    def compute(run: Run) -> pa.Table:
        s, t = run.vectors[source], run.vectors[target]
        out, n_out, into, n_in = neighbour_means(run, s, t)
        one = lambda n: np.maximum(n, 1)
        none = np.zeros_like
        return _node_table(run, run.roles(), {"incoming": (none(s), into / one(n_in)), "outgoing": (out / one(n_out), none(t))})

    return on_runs(records, list(dict.fromkeys([source, target])), compute, _node_schema(records, "incoming array<double>, outgoing array<double>"), window, **options)


def sparse_product_edges(records: DataFrame, document: str, query: str, name: str, window: int = 5, **options) -> DataFrame:
    """``session_id, Q1_row, Q2_row`` and ``name``: for all candidate edges the product of two sparse vectors.

    ``document`` of the source and ``query`` of the target are arrays of
    (term, number); a term occurs once in an array.  A task holds the terms of one
    source and its targets as dictionaries; ``rows_a_group`` and ``block`` bound
    the arrays it is given.
    """

    def compute(run: Run) -> pa.Table:
        i, j = run.own_pairs()
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        terms = lambda column, k: {t["term"]: t["x"] for t in run.raw[column][k].as_py() or ()}
        score = np.zeros(len(i))
        at, weights, queries = -1, {}, {}
        for n, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
            if p != at:  # the next source: earlier records are no targets any more
                at, weights, queries = p, terms(document, p), {k: v for k, v in queries.items() if k > p}
            if q not in queries:
                queries[q] = terms(query, q)
            score[n] = sum(x * weights[t] for t, x in queries[q].items() if t in weights)
        return run.edges(i, j, **{name: score})

    return on_runs(records, [], compute, _edge_schema(records, f"{name} double"), window, raw=[document, query], **options)


# --------------------------------------------------------------------------
# Layers of a graph network
# --------------------------------------------------------------------------

def gelu(x: np.ndarray) -> np.ndarray:
    error = np.frompyfunc(math.erf, 1, 1)
    return 0.5 * x * (1.0 + error(x / math.sqrt(2.0)).astype(np.float64))


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    mean = x.mean(axis=1, keepdims=True)
    spread = ((x - mean) ** 2).mean(axis=1, keepdims=True)
    return (x - mean) / np.sqrt(spread + eps) * scale + shift


@dataclass(frozen=True)
class Layer:
    """Weights (out, in), bias, and scale and shift of the layer norm."""

    weight: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    shift: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return gelu(layer_norm(x @ self.weight.T + self.bias, self.scale, self.shift))


@dataclass(frozen=True)
class EdgeHead:
    """A hidden layer over [h_s, h_t, |h_s - h_t|, h_s * h_t] and one output."""

    hidden: Layer
    weight: np.ndarray
    bias: float

    def __call__(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        return self.hidden(np.hstack([s, t, np.abs(s - t), s * t])) @ self.weight + self.bias


def layers_from_table(rows: DataFrame) -> dict[str, np.ndarray]:
    """Named weight matrices from a table (name, i, j, value); its size is that of the model."""
    found: dict[str, dict] = {}
    for r in rows.collect():
        found.setdefault(r["name"], {})[(r["i"], r["j"])] = r["value"]
    out = {}
    for name, cells in found.items():
        shape = tuple(1 + max(c[d] for c in cells) for d in (0, 1))
        if len(cells) != shape[0] * shape[1]:
            raise ValueError(f"matrix {name!r} has {len(cells)} of {shape[0] * shape[1]} entries")
        out[name] = np.zeros(shape)
        for at, value in cells.items():
            out[name][at] = value
    return out


def graph_scores(
    records: DataFrame, source: str, target: str, layers: Sequence[Layer], head: EdgeHead, directed: bool = False, window: int = 5, **options
) -> DataFrame:
    """``session_id, Q1_row, Q2_row, margin``: the forward pass of a trained network over every session's candidate graph.

    Undirected, a layer sees a node and the mean over itself and its neighbours;
    directed, the node and the means over its sources and over its targets, zeros
    where there are none.  No graph crosses a session, hence none crosses a split.
    A node depends on records as many windows away as there are layers, which is
    how far blocks overlap.
    """
    if not layers:
        raise ValueError("a graph network needs a layer")

    def compute(run: Run) -> pa.Table:
        s, t = run.vectors[source], run.vectors[target]
        for layer in layers:
            out, n_out, into, n_in = neighbour_means(run, s, t)
            if directed:
                none_s, none_t = np.zeros_like(s), np.zeros_like(t)
                s, t = np.hstack([s, none_s, out / np.maximum(n_out, 1)]), np.hstack([t, into / np.maximum(n_in, 1), none_t])
            else:
                s, t = np.hstack([s, (s + out) / (1 + n_out)]), np.hstack([t, (t + into) / (1 + n_in)])
            s, t = layer(s), layer(t)
        return _in_parts(run, lambda i, j: {"margin": head(s[i], t[j]) if len(i) else np.zeros(0)}, EDGES_AT_ONCE)

    reach = window * (len(layers) + 1)
    return on_runs(records, list(dict.fromkeys([source, target])), compute, _edge_schema(records, "margin double"), window, reach, **options)
