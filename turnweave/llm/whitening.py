"""Whitening by spectral divide and conquer with QDWH polar decompositions.

The covariance is summed over executors from centred vectors; what reaches the
driver is a matrix of the dimension, whatever the number of rows.  There the polar
factor of the shifted covariance, found by the dynamically weighted Halley
iteration, gives the projector on all eigenvectors above the shift; an orthonormal
basis of its range and of the rest splits the matrix in two, which are split in
turn until each part is one component or a multiple of the identity.  The
components and the mean then go to all executors, which whiten row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import Workspace, ship

#: what one unit of an entry becomes before it is cut to a whole number
GRID = 256
COMPONENTS = 4
#: a component counts as one of rounding only below this part of the trace
FLOOR = 1e-13
MAX_DIMENSION = 4096
_EPS = np.finfo(np.float64).eps


# --------------------------------------------------------------------------
# The decomposition, of a matrix of the dimension
# --------------------------------------------------------------------------

def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH iterations."""
    scale = np.linalg.norm(a, 2)
    x = a / scale
    # a lower bound of the smallest singular value; too small a bound costs a step or two
    low = max(1.0 / (np.sqrt(len(a)) * np.linalg.cond(x, 1)), _EPS) if len(a) > 1 else 1.0
    identity = np.eye(len(a))
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        # the inverse-free form: QR of the stacked matrix is stable at any condition
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, identity]))
        q1, q2 = q[: len(a)], q[len(a) :]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q1 @ q2.T)
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if moved <= np.cbrt(_EPS) and abs(1 - low) <= 10 * _EPS:
            break
    return x


def _basis(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthogonal matrix whose first ``rank`` columns span the projector's range."""
    # pivoting by column norm: the range is spanned well by its longest columns
    left = projector.copy()
    chosen = np.zeros((len(projector), rank))
    for i in range(rank):
        column = left[:, np.argmax((left * left).sum(axis=0))]
        for _ in range(2):
            column = column - chosen[:, :i] @ (chosen[:, :i].T @ column)
        chosen[:, i] = column / np.linalg.norm(column)
        left -= np.outer(chosen[:, i], chosen[:, i] @ left)
    # one step of subspace iteration removes what pivoting left of the other space
    q, _ = np.linalg.qr(np.hstack([projector @ chosen, np.eye(len(projector))]))
    return q


def spectral(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, falling."""
    n = len(a)
    scale = np.linalg.norm(a, 2) if scale is None else scale
    centre = np.trace(a) / n
    rest = a - centre * np.eye(n)
    if n == 1 or np.linalg.norm(rest, 2) <= 4 * _EPS * scale:
        return np.full(n, centre), np.eye(n)
    if n == 2:  # one rotation
        angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
        c, s = np.cos(angle), np.sin(angle)
        v = np.array([[c, -s], [s, c]])
        return _falling(np.diag(v.T @ a @ v), v)
    # the mean of the eigenvalues always has some on either side
    shift = float(np.median(np.diag(a)))
    for shift in (shift, centre, *(centre + np.linalg.norm(rest, 2) * f for f in (0.1, -0.1, 0.01, -0.01, 1e-3, -1e-3, 1e-5, -1e-5))):
        moved = a - shift * np.eye(n)
        if np.linalg.norm(moved, 2) == 0:
            continue
        projector = (polar(moved) + np.eye(n)) / 2
        above = np.trace(projector)
        rank = int(round(above))
        # a shift on an eigenvalue leaves the trace between two whole numbers
        if 0 < rank < n and abs(above - rank) < 1e-6:
            q = _basis(projector, rank)
            split = q.T @ a @ q
            if np.linalg.norm(split[rank:, :rank], 2) <= 1e-12 * scale * n:
                break
    else:
        raise ArithmeticError("no shift splits the spectrum")
    high, high_v = spectral((split[:rank, :rank] + split[:rank, :rank].T) / 2, scale)
    low, low_v = spectral((split[rank:, rank:] + split[rank:, rank:].T) / 2, scale)
    return np.concatenate([high, low]), np.hstack([q[:, :rank] @ high_v, q[:, rank:] @ low_v])


def _falling(values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and eigenvectors of a covariance, the largest entry of each vector positive."""
    values, vectors = _falling(*spectral((v + v.T) / 2))
    largest = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(vectors))]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


# --------------------------------------------------------------------------
# Passes over the rows
# --------------------------------------------------------------------------

def _on_grid(vector: str) -> Column:
    """Null for a vector that is missing or holds null or non-finite entries."""
    entry = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    sound = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(sound, F.transform(entry, lambda c: F.floor(F.lit(float(GRID)) * c).cast("bigint")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _products(of, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, values): row i of the sum of outer products of ``of(x)``, and row ``width`` their sum."""
    total, sums = np.zeros((width, width)), np.zeros(width)
    for batch in batches:
        y = of(batch.column(0))
        total += y.T @ y
        sums += y.sum(axis=0)
    rows = np.vstack([total, sums])
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(width + 1), pa.int32()), pa.array(list(rows), pa.list_(pa.float64()))], names=["i", "values"]
    )


def _summed(fit: DataFrame, of, width: int) -> tuple[np.ndarray, np.ndarray]:
    partial_rows = fit.select("x").mapInArrow(partial(_products, of, width), "i int, values array<double>")
    each = partial_rows.select("i", F.posexplode("values").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((width + 1, width))
    for r in each.groupBy("i").agg(F.collect_list(F.struct("j", "value")).alias("row")).collect():  # width + 1 rows
        for j, value in r["row"]:
            out[r["i"], j] = value
    return out[:width], out[width]


class Whitening:
    """Mean (as whole sums), components and their part of the variance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n = n
        self.sums = sums
        self.values = values
        self.vectors = vectors
        self.trace = trace
        self.identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        # whole numbers divide exactly rounded, however large
        return np.array([s / self.n for s in self.sums])

    def whiten(self, column: pa.Array) -> np.ndarray:
        x = _matrix(column, len(self.sums)).astype(np.float64)
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def _centred(mean: np.ndarray, column: pa.Array) -> np.ndarray:
    return _matrix(column, len(mean)).astype(np.float64) - mean


def fit_whitening(grid: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on every distinct vector ``x`` (whole numbers, one length) of ``grid``; None without rows."""
    spark = grid.sparkSession
    ship(spark)
    fit = Workspace(spark).save("fit", grid.select("x").distinct())
    rows = fit.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()
    if not rows:
        return None
    if len(rows) > MAX_DIMENSION:
        raise ValueError(f"vectors have more than {MAX_DIMENSION} entries")
    rows.sort(key=lambda r: r["j"])  # one row per dimension
    n, sums = rows[0]["n"], [r["s"] for r in rows]
    mean = np.array([s / n for s in sums])
    total, _ = _summed(fit, partial(_centred, mean), len(sums))
    covariance = total / n
    trace = float(np.trace(covariance))
    values, vectors = eigen(covariance) if trace > 0 else (np.zeros(len(sums)), np.eye(len(sums)))
    some = min(components, int((values > FLOOR * trace).sum()) if trace > 0 else 0)
    found = Whitening(n, sums, values[:some], vectors[:, :some], trace)
    if some:
        squares, lines = _summed(fit, found.whiten, some)
        again = squares / n - np.outer(lines / n, lines / n)
        found.identity_error = float(np.abs(again - np.eye(some)).max())
    return found


def _apply(found: Whitening, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("x")
        y = found.whiten(batch.column(at))
        others = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in others], pa.array(list(y), pa.list_(pa.float64()))],
            names=[*[batch.schema.names[i] for i in others], "whitened"],
        )


def whitened_components(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per sound row of ``rows`` and component: its columns without the vector, plus
    component, n, deviation, whitened, explained, identity_error.

    Entries become whole numbers, ``floor(256 * entry)``.  ``n`` counts the distinct
    whole vectors, on which mean and covariance are fitted; ``deviation`` is the
    squared distance from their mean times ``n`` squared, a whole number (an error,
    not a wrong number, beyond 64 bits).  ``identity_error`` is the largest entry by
    which the covariance of the whitened distinct vectors differs from the identity.

    Rows without a vector, with an empty one, or with null or non-finite entries
    are left out; where lengths differ, so are rows of another length than most
    sound rows have (the greater among equals).  Repeated rows all stay.  Components
    without variance are not given: a single distinct vector, like an empty table,
    gives no rows.  Other columns are kept; one named like a result is replaced.
    """
    spark = rows.sparkSession
    results = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    carried = {c: f"k{i}" for i, c in enumerate(c for c in rows.columns if c not in (*results, vector))}
    schema = rows.schema
    grid = rows.select(*[F.col(f"`{c}`").alias(k) for c, k in carried.items()], _on_grid(vector).alias("x")).where("size(x) > 0")
    grid = Workspace(spark).save("grid", grid)
    lengths = grid.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    fields = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in carried)
    head = f"{fields}, " if fields else ""
    tail = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], head + tail)
    grid = grid.where(F.size("x") == lengths["length"])
    found = fit_whitening(grid, components)
    if not len(found.values):
        return spark.createDataFrame([], head + tail)
    gaps = F.zip_with("x", F.array(*[F.lit(s).cast("bigint") for s in found.sums]), lambda x, s: (F.lit(found.n).cast("bigint") * x - s))
    # integral sums fail beyond 64 bits instead of going round
    deviation = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g * g)
    told = grid.select(*carried.values(), deviation.alias("deviation"), "x")
    inner = ", ".join([*(f"{k} {schema[c].dataType.simpleString()}" for c, k in carried.items()), "deviation bigint, whitened array<double>"])
    shown = told.mapInArrow(partial(_apply, found), inner)
    explained = F.array(*[F.lit(float(e / found.trace)) for e in found.values])
    shown = shown.select(*carried.values(), "deviation", F.posexplode("whitened").alias("at", "value"))
    return shown.select(
        *[F.col(k).alias(c) for c, k in carried.items()], (F.col("at") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"),
        "deviation", F.col("value").alias("whitened"), F.get(explained, F.col("at")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
