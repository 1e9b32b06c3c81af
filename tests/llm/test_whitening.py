"""Whitening against numpy's own eigenvectors."""

import math

import numpy as np
import pytest

from turnweave.llm import whitening


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33, 64])
def test_spectral_equals_eigh(n):
    rng = np.random.default_rng(n)
    for a in (
        rng.normal(size=(n, n)),
        np.diag(np.arange(n, 0.0, -1)),
        np.eye(n),
        np.zeros((n, n)),
        np.diag([1.0] * (n // 2) + [2.0] * (n - n // 2)),
        np.ones((n, n)),
        np.diag(10.0 ** -np.arange(n)) if n < 12 else np.diag(1 + 1e-9 * np.arange(n)),
        np.outer(rng.normal(size=n), np.ones(n)),
    ):
        a = (a + a.T) / 2
        values, vectors = whitening.eigen(a)
        scale = max(np.linalg.norm(a, 2), 1e-300)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * scale * max(n, 4)
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 * max(n, 4)
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale * max(n, 4)


def test_polar_factor():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(20, 20))
    a = a + a.T
    u = whitening.polar(a)
    assert np.abs(u @ u - np.eye(20)).max() < 1e-13
    assert np.linalg.eigvalsh(u @ a).min() > 0


def by_hand(vectors, components):
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1], u[:, ::-1]
    y = (x - sums / n) @ u[:, :components] / np.sqrt(values[:components])
    return n, [int(sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist()))) for row in x.tolist()], y, values / values.sum()


def test_rows_equal_numpy(spark):
    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(7, 7)) * np.arange(1, 8)
    sound = (rng.normal(size=(300, 7)) @ mixing / 10).astype(np.float32)
    sound = np.vstack([sound, np.repeat(sound[:1], 200, axis=0)])  # one vector holds much of the table
    rows = [(i, v.tolist(), f"n{i}") for i, v in enumerate(sound)]
    rows += [
        (900, None, ""), (901, [], ""), (902, [1.0] * 6 + [None], ""), (903, [1.0] * 6 + [float("nan")], ""),
        (904, [float("inf")] + [0.0] * 6, ""), (905, [1.0, 2.0], ""), (None, sound[5].tolist(), None),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    found = whitening.whitened_components(table)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = found.collect()
    n, deviation, y, part = by_hand(np.vstack([sound, sound[5:6]]), 4)
    assert len(out) == 4 * 501
    signs = {}
    for r in out:
        i, c = 500 if r.vec_id is None else r.vec_id, r.component - 1
        assert (r.n, r.deviation) == (n, deviation[i])
        assert abs(r.explained - part[c]) < 1e-12 and r.identity_error < 1e-9
        sign = signs.setdefault(c, 1 if abs(r.whitened - y[i, c]) < 1e-6 else -1)
        assert abs(sign * r.whitened - y[i, c]) < 1e-8


def test_odd_tables(spark):
    shape = "vec_id long, embedding array<double>, whitened string"
    assert whitening.whitened_components(spark.createDataFrame([], shape)).collect() == []
    same = spark.createDataFrame([(i, [0.5, 0.25], "x") for i in range(5)], shape)
    assert whitening.whitened_components(same).collect() == []
    line = spark.createDataFrame([(i, [i / 8, i / 8, 0.0], "x") for i in range(5)], shape)
    out = whitening.whitened_components(line).collect()
    assert {r.component for r in out} == {1} and len(out) == 5
    assert abs(out[0].explained - 1) < 1e-12 and out[0].identity_error < 1e-12
    only = whitening.whitened_components(spark.createDataFrame([([0.1],), ([0.9],)], "embedding array<double>"))
    assert only.columns[0] == "component" and only.count() == 2
