"""Learned scorers on Spark ML and the lexical/temporal baselines.

Scaling and weighting follow the usual pipeline of a standard scaler and a
class-balanced L2 logistic regression with C = 1 / (lambda * n).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import inverse_distance, to_number

SEED = 42


def class_counts(df: DataFrame, label: str = "edge_label") -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    return int(row[0]), int(row[1])


def balanced_weight(label: str, negatives: int, positives: int) -> Column:
    """n / (2 · class size); the weights sum to n."""
    n = negatives + positives
    return F.when(F.col(label) == 1, F.lit(n / (2.0 * positives))).otherwise(F.lit(n / (2.0 * negatives)))


def fit_logistic(
    train: DataFrame,
    features: str | Sequence[str],
    label: str = "edge_label",
    c_value: float = 1.0,
    max_iter: int = 2000,
) -> PipelineModel:
    """Scaler + balanced logistic regression, fitted once on the given rows.

    ``features`` is one array column or a list of numeric columns.
    """
    negatives, positives = class_counts(train, label)
    if not negatives or not positives:
        raise RuntimeError("the training rows hold only one class")
    rows = negatives + positives
    vectors = as_vector(train, features).withColumn("_w", balanced_weight(label, negatives, positives))
    scaler = StandardScaler(inputCol="_raw", outputCol="_unit", withMean=True, withStd=True).fit(vectors)
    # The scaler divides by the sample deviation; this turns it into the population one.
    factor = math.sqrt(rows / (rows - 1.0))
    rescale = ElementwiseProduct(
        scalingVec=Vectors.dense([factor] * scaler.std.size), inputCol="_unit", outputCol="_scaled"
    )
    scaled = rescale.transform(scaler.transform(vectors))
    model = LogisticRegression(
        featuresCol="_scaled",
        labelCol=label,
        weightCol="_w",
        regParam=1.0 / (c_value * rows),
        elasticNetParam=0.0,
        maxIter=max_iter,
        tol=1e-10,
        standardization=False,
        fitIntercept=True,
        probabilityCol="_prob",
        predictionCol="_pred",
        rawPredictionCol="_margin",
    ).fit(scaled)
    return PipelineModel(stages=[scaler, rescale, model])


def as_vector(df: DataFrame, features: str | Sequence[str]) -> DataFrame:
    array = (
        F.transform(F.col(features), lambda x: x.cast("double"))
        if isinstance(features, str)
        else F.array(*[to_number(F.col(c), 0.0) for c in features])
    )
    return df.withColumn("_raw", array_to_vector(array))


def predict(
    df: DataFrame, model: PipelineModel, features: str | Sequence[str], name: str = "stage1_semantic_prob"
) -> DataFrame:
    scored = model.transform(as_vector(df, features))
    drop = [c for c in ("_raw", "_unit", "_scaled", "_margin", "_pred", "_prob") if c in scored.columns]
    return scored.withColumn(name, vector_to_array("_prob")[1]).drop(*drop)


def coefficients(model: PipelineModel, names: Sequence[str]) -> list[tuple[str, float, float]]:
    """(feature, coefficient, |coefficient|), largest first."""
    fitted = model.stages[-1]
    assert isinstance(fitted, LogisticRegressionModel)
    rows = [(n, float(w), abs(float(w))) for n, w in zip(names, fitted.coefficients.toArray())]
    return sorted(rows, key=lambda r: -r[2])


def distance_prior(df: DataFrame, distance: str = "distance_num", name: str = "distance_prior") -> DataFrame:
    return df.withColumn(name, inverse_distance(F.col(distance)))


FUSION_FEATURES = ("bm25_score", "semantic_score", "pairwise_score", "distance_prior")


def fit_fusion(train: DataFrame, features: Sequence[str] = FUSION_FEATURES, label: str = "edge_label") -> PipelineModel:
    return fit_logistic(train, list(features), label, max_iter=3000)
