"""Numeric coercion, link functions and metric arithmetic."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(value: Column, default: float | None = 0.0) -> Column:
    """Double, with unparsable, null and NaN values replaced by ``default``.

    A Java cast also takes type suffixes ('1d', '2f'); those are no numbers here.
    """
    suffixed = F.coalesce(value.cast("string").rlike(r"(?i)[0-9.][df]\s*$"), F.lit(False))
    number = F.when(~suffixed, value.try_cast("double"))
    number = F.when(F.isnan(number), F.lit(None).cast("double")).otherwise(number)
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def is_finite(value: Column) -> Column:
    number = to_number(value, None)
    return number.isNotNull() & (F.abs(number) != F.lit(math.inf))


def finite_score(value: Column) -> Column:
    """NaN and null to 0, infinities to ±1e30."""
    number = to_number(value, 0.0)
    return F.greatest(F.least(number, F.lit(1e30)), F.lit(-1e30))


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(value, F.lit(30.0)), F.lit(-30.0))))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def logit(value: Column, eps: float = 1e-6) -> Column:
    p = clip(value, eps, 1.0 - eps)
    return F.ln(p / (1.0 - p))


def inverse_distance(value: Column) -> Column:
    """1 / max(d, 1); a missing distance counts as 1."""
    return 1.0 / F.greatest(to_number(value, 1.0), F.lit(1.0))


def ratio(top: Column, bottom: Column, default: float | None = 0.0) -> Column:
    """Division that yields ``default`` on a zero denominator."""
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def close_to(left: Column, right: Column | float, atol: float = 1e-12) -> Column:
    other = right if isinstance(right, Column) else F.lit(float(right))
    return F.coalesce(F.abs(left - other) <= atol, F.lit(False))


def parse_grid(text: str) -> tuple[float, ...]:
    """Sorted, distinct, non-negative values of a comma-separated list."""
    values = {float(part) for part in str(text).split(",") if part.strip()}
    if not values:
        raise ValueError("a grid needs at least one value")
    if min(values) < 0:
        raise ValueError("grid values must be non-negative")
    return tuple(sorted(values))


def format_grid(values: Iterable[float]) -> str:
    return ",".join(f"{float(v):g}" for v in values)


def parse_topk(text: str) -> tuple[int, ...]:
    values = {int(part) for part in str(text).split(",") if part.strip()}
    if not values or min(values) < 1:
        raise ValueError("top-k values must be positive integers")
    return tuple(sorted(values))
