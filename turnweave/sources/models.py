"""Frozen models: the numbers of a fit, written once and read back to the last bit."""

from __future__ import annotations

import dataclasses
import json
from typing import TypeVar

from pyspark.sql import SparkSession

Model = TypeVar("Model")


def save_model(spark: SparkSession, model, path: str) -> None:
    """One JSON record with the model's kind and numbers; a path that exists is an error."""
    record = {"kind": type(model).__name__, "values": dataclasses.asdict(model)}
    spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.text(path)


def load_model(spark: SparkSession, path: str, kind: type[Model]) -> Model:
    """The model as it was saved; another kind of model is an error."""
    record = json.loads(spark.read.text(path).first()["value"])
    if record["kind"] != kind.__name__:
        raise ValueError(f"{path} holds a {record['kind']}, not a {kind.__name__}")
    return kind(**record["values"])
