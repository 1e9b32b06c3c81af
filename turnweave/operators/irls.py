"""Logistic fits by Newton steps whose sums are distributed aggregates.

A step needs the weighted Gram matrix of the features and the gradient.  Every task
sums its own rows in blocks, the sums are combined by entry, and only a matrix of
the number of features reaches the driver.  The problem is convex and Newton's
steps converge in about ten passes, so a fit can be repeated step by step by any
engine that can sum.  The objective is that of a standard scaler with a
class-balanced L2 logistic regression: ``C * sum(w * loss) + |beta|^2 / 2``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid, to_number
from ..session import materialize

STEPS = 30
TOLERANCE = 1e-10
#: rows turned into one matrix inside a task
BLOCK = 8_192


@dataclass
class Logistic:
    """Scaling and coefficients; ``gradient`` is the norm left at the last step."""

    mean: list[float]
    deviation: list[float]
    weights: list[float]
    bias: float
    steps: int = 0
    gradient: float = 0.0
    names: list[str] = field(default_factory=list)

    def margin(self, features: str | Sequence[str]) -> Column:
        scale = [w / d for w, d in zip(self.weights, self.deviation)]
        shift = self.bias - float(np.dot(scale, self.mean))
        if isinstance(features, str):
            products = F.zip_with(features, F.array(*map(F.lit, scale)), lambda x, s: x.cast("double") * s)
            return F.aggregate(products, F.lit(shift), lambda a, x: a + x)
        total = F.lit(shift)
        for name, s in zip(features, scale):
            total = total + to_number(F.col(name), 0.0) * s
        return total

    def probability(self, features: str | Sequence[str]) -> Column:
        return sigmoid(self.margin(features))

    def coefficients(self) -> list[tuple[str, float, float]]:
        """(feature, coefficient, |coefficient|), largest first."""
        names = self.names or [f"x{i}" for i in range(len(self.weights))]
        return sorted(((n, w, abs(w)) for n, w in zip(names, self.weights)), key=lambda r: -r[2])


def _entries(rows: DataFrame, sums, size: int) -> np.ndarray:
    """Sum over tasks of the (size, size) matrix that ``sums`` gives for a block of rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                block = batch.slice(start, BLOCK)
                x = block.column("x").flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
                total += sums(x, block.column("y").to_numpy(zero_copy_only=False), block.column("n").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"]
        )

    parts = rows.select("x", "y", "n").mapInArrow(task, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # one row per entry
        out[r["i"], r["j"]] = r["v"]
    return out


def fit_irls(
    train: DataFrame,
    features: str | Sequence[str],
    label: str = "edge_label",
    c_value: float = 1.0,
    steps: int = STEPS,
    penalise_intercept: bool = False,
) -> Logistic:
    """Fit on all rows; ``features`` is one array column or a list of numeric columns.

    Rows equal in features and label are summed up first.  Missing features count
    as 0, a constant feature gets the deviation 1.  One class only, or arrays of
    different lengths, are an error.
    """
    x = (
        F.transform(F.col(features), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
        if isinstance(features, str)
        else F.array(*[to_number(F.col(c), 0.0) for c in features])
    )
    rows = materialize(train.select(x.alias("x"), F.col(label).cast("double").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")))
    shape = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("p")).first()
    if not shape["n"] or shape["p"] in (0, shape["n"]):
        raise RuntimeError("the training rows hold only one class")
    if shape["least"] != shape["most"]:
        raise ValueError("feature arrays differ in length")
    d, n, p = shape["most"], shape["n"], shape["p"]

    def first(x, y, m):
        return np.vstack([(m @ x)[None, :], np.zeros((d - 1, d))])

    mean = _entries(rows, first, d)[0] / n

    def second(x, y, m):
        z = x - mean
        return np.vstack([(m @ (z * z))[None, :], np.zeros((d - 1, d))])

    deviation = np.sqrt(_entries(rows, second, d)[0] / n)
    deviation[deviation == 0] = 1.0
    weight = {1.0: c_value * n / (2.0 * p), 0.0: c_value * n / (2.0 * (n - p))}
    ridge = np.ones(d + 1)
    ridge[d] = 1.0 if penalise_intercept else 0.0
    beta = np.zeros(d + 1)
    for step in range(1, steps + 1):

        def gram(x, y, m, beta=beta):
            u = np.hstack([(x - mean) / deviation, np.ones((len(x), 1))])
            q = 1 / (1 + np.exp(-np.clip(u @ beta, -30, 30)))
            w = m * np.where(y == 1, weight[1.0], weight[0.0])
            out = np.zeros((d + 2, d + 2))
            out[: d + 1, : d + 1] = (u * (w * q * (1 - q))[:, None]).T @ u
            out[d + 1, : d + 1] = u.T @ (w * (q - y))
            return out

        total = _entries(rows, gram, d + 2)
        gradient = total[d + 1, : d + 1] + ridge * beta
        move = np.linalg.solve(total[: d + 1, : d + 1] + np.diag(ridge), gradient)
        beta = beta - move
        if np.abs(move).max() < TOLERANCE:
            break
    names = [] if isinstance(features, str) else list(features)
    return Logistic(mean.tolist(), deviation.tolist(), beta[:d].tolist(), float(beta[d]), step, float(np.abs(gradient).max()), names)
