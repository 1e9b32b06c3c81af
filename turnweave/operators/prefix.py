"""Running totals and row numbers over groups too large for one task.

A plain running window sends a whole group to one task.  Here the group is cut
into slices that follow the order, slice totals are summed first (map-side
combined, one row per slice), and each slice starts from the total of the
slices before it.  The result equals the single-window form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliced_running_sum(
    df: DataFrame,
    by: Sequence[str],
    slice_by: Column,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running totals ``sums[name]`` in ``order`` within ``by``.

    ``slice_by`` must be monotone in the order: non-decreasing along it, or
    non-increasing when ``descending``.  Rows, offsets and the in-slice window
    share one hash partitioning, by a struct: null groups and null slices equal
    themselves there, so no row is lost.
    """
    names = list(sums)
    work = df.withColumn("_key", F.struct(F.struct(F.lit(0), *by).alias("by"), slice_by.alias("slice")))
    for name in names:
        work = work.withColumn(f"_in_{name}", sums[name])
    totals = work.groupBy("_key").agg(
        *[F.sum(f"_in_{n}").alias(f"_tot_{n}") for n in names]
    )
    slice_order = F.col("_key.slice").desc() if descending else F.col("_key.slice").asc()
    before = Window.partitionBy("_key.by").orderBy(slice_order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    offsets = totals.select(
        "_key",
        *[
            (F.sum(f"_tot_{n}").over(before) - F.col(f"_tot_{n}")).alias(f"_off_{n}")
            for n in names
        ],
    )
    joined = work.join(offsets, "_key")
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    for name in names:
        joined = joined.withColumn(
            name, F.col(f"_off_{name}") + F.sum(f"_in_{name}").over(inside)
        )
    helpers = [c for n in names for c in (f"_in_{n}", f"_off_{n}")]
    return joined.drop("_key", *helpers)


def group_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two tables with one row per group (or none to name): null groups match."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    other = right.select(*[F.col(c).alias(f"_by_{c}") if c in by else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return left.join(other, on, how).drop(*[f"_by_{c}" for c in by])


def sliced_index(
    df: DataFrame,
    by: Sequence[str],
    slice_by: Column,
    order: Sequence[Column],
    name: str = "idx",
) -> DataFrame:
    """Zero-based dense position within ``by`` in a total ``order``."""
    numbered = sliced_running_sum(
        df, by, slice_by, order, {name: F.lit(1).cast("long")}
    )
    return numbered.withColumn(name, F.col(name) - 1)


def integer_slice(key: Column, width: int) -> Column:
    """Slices of ``width`` consecutive integer key values."""
    return F.floor(key / F.lit(int(width))).cast("long")


def unit_slice(score: Column, slices: int = 1024) -> Column:
    """Order-preserving slices of a score: equal width on [-1, 1], equal ratio beyond.

    A doubling of the score gets ``slices`` slices too, so unbounded scores
    (BM25, logits) spread like probabilities do.
    """
    size = F.least(F.abs(score), F.lit(1e300))
    steps = F.when(size <= 1.0, size).otherwise(F.log2(size) + 1.0) * F.lit(float(slices))
    return F.floor(F.when(score < 0, -steps).otherwise(steps)).cast("long")


def boundary_slice(score: Column, boundaries: Sequence[float]) -> Column:
    """Slices between given ascending boundaries (driver-side quantiles)."""
    cuts = F.array(*[F.lit(float(b)) for b in boundaries]) if boundaries else None
    if cuts is None:
        return F.lit(0).cast("long")
    return F.size(F.filter(cuts, lambda b: b <= score)).cast("long")


def score_boundaries(df: DataFrame, column: str, slices: int = 1024) -> list[float]:
    """At most ``slices`` quantile boundaries of a numeric column.

    A bounded driver-side list; any boundaries give exact running totals, these
    only balance the slices when scores crowd together.
    """
    points = [i / slices for i in range(1, slices)]
    values = df.approxQuantile(column, points, 1.0 / (4 * slices))
    return sorted(set(values))
