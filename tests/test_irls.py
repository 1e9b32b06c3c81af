"""Newton fits against a plain loop, Spark's own optimiser and the condition of a minimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.operators import evidence, irls, scorers
from turnweave.sources.models import load_model, save_model


def sample(n=400, d=3, seed=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)) * [1, 5, 0.1][:d] + [0, 2, -1][:d], 2)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    return x, y


def by_hand(x, y, c=1.0, bias_ridge=0.0):
    n, p = len(y), y.sum()
    mean, dev = x.mean(axis=0), x.std(axis=0)
    u = np.hstack([(x - mean) / np.where(dev == 0, 1, dev), np.ones((n, 1))])
    w = c * np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    ridge = np.array([1.0] * x.shape[1] + [bias_ridge])
    beta = np.zeros(u.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-u @ beta))
        beta = beta - np.linalg.solve((u.T * (w * q * (1 - q))) @ u + np.diag(ridge), u.T @ (w * (q - y)) + ridge * beta)
    return beta, u


@pytest.mark.parametrize("bias_ridge", [False, True])
def test_fit_equals_newton_by_hand(spark, bias_ridge):
    x, y = sample()
    rows = [(*map(float, a), int(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, edge_label int").repartition(5)
    beta, u = by_hand(x, y, 0.7, float(bias_ridge))
    for features, table in ((["a", "b", "c"], df), ("x", df.select(F.array("a", "b", "c").alias("x"), "edge_label"))):
        model = irls.fit_irls(table, features, c_value=0.7, penalise_intercept=bias_ridge)
        assert np.abs(np.array([*model.weights, model.bias]) - beta).max() < 1e-9
        assert model.gradient < 1e-6 and model.steps < 15
        found = sorted(r[0] for r in table.select(model.probability(features)).collect())
        assert np.abs(np.array(found) - np.sort(1 / (1 + np.exp(-u @ beta)))).max() < 1e-9


def test_fit_equals_the_optimiser_of_spark(spark):
    x, y = sample(300, 2, 5)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, edge_label int")
    mine = irls.fit_irls(df, ["a", "b"])
    theirs = scorers.fit_logistic(df, ["a", "b"])
    both = scorers.predict(df, theirs, ["a", "b"], "p").select("p", mine.probability(["a", "b"]).alias("q")).collect()
    assert max(abs(r.p - r.q) for r in both) < 1e-5
    sizes = [size for _, _, size in mine.coefficients()]
    assert sizes == sorted(sizes, reverse=True) and {n for n, _, _ in mine.coefficients()} == {"a", "b"}


def test_odd_rows_and_errors(spark):
    shape = "x array<float>, edge_label int"
    df = spark.createDataFrame([([1.0, 5.0], 1), ([None, 5.0], 0), ([2.0, 5.0], 1), ([0.5, 5.0], 0), ([1.5, 5.0], 0)], shape)
    model = irls.fit_irls(df, "x")  # a null counts as 0, the constant feature has no weight
    assert model.weights[0] > 0 and abs(model.weights[1]) < 1e-12 and model.deviation[1] == 1.0
    with pytest.raises(RuntimeError):
        irls.fit_irls(df.where("edge_label = 1"), "x")
    with pytest.raises(RuntimeError):
        irls.fit_irls(df.limit(0), "x")
    with pytest.raises(ValueError):
        irls.fit_irls(df.union(spark.createDataFrame([([1.0], 1)], shape)), "x")


def test_saved_models_come_back_whole(spark, tmp_path):
    x, y = sample(100, 2, 7)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, edge_label int")
    model = irls.fit_irls(df, ["a", "b"])
    save_model(spark, model, f"{tmp_path}/m")
    assert load_model(spark, f"{tmp_path}/m", irls.Logistic) == model
    line = evidence.Calibration(0.1, 1 / 3, -2.0, 1e-17)
    save_model(spark, line, f"{tmp_path}/c")
    assert load_model(spark, f"{tmp_path}/c", evidence.Calibration) == line
    with pytest.raises(ValueError):
        load_model(spark, f"{tmp_path}/c", irls.Logistic)
    with pytest.raises(Exception, match="already exists"):
        save_model(spark, model, f"{tmp_path}/m")
