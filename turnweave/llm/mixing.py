"""A mix of sources whose weights change over training time.

Each source has a demand, the words it is to give, and a ramp, the way its weight
moves over the time 0 .. 1.  The integral of the ramp tells how many words the
source has given by a time; its inverse tells at what time a document (or a
repetition of it) is due.  Documents are then sorted by training position, the
words that all sources have given by that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import SPACE_WORD, Workspace

WEIGHTS = (5, 2, 1)
#: a source gives at most this many times its words
REPEATS = 3
#: change of a source's weight from the middle of training to its end, as a share: rising and falling in turn
RAMP = 0.5
#: rows of one source that one task orders
SLICE_ROWS = 20_000


def word_count(text: str = "text") -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_WORD)).cast("bigint")


def source_demands(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target, slope: one row per source.

    Sources in code-point order (null last) take the weights in turn and share
    the size of all rows; no source exceeds ``repeats`` times its size, and what
    it leaves is shared again by weight until none is above.  That is one level
    that all uncapped sources reach per weight: sources are sorted by the level
    at which they are full.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = "row_number() over (order by source is null, source) - 1"
    listed = ",".join(map(str, weights))
    ranked = sums.withColumn("rank", F.expr(turn)).withColumn(
        "weight", F.expr(f"cast(get(array({listed}), cast(rank % {len(weights)} as int)) as bigint)")
    )
    ranked = ranked.withColumn("full", F.lit(repeats) * F.col("source_size"))
    level = "cast(full as double) / weight"
    order = f"order by {level}, rank rows between"
    filled = (
        ranked.withColumn("total", F.expr("sum(source_size) over ()"))
        .withColumn("below", F.expr(f"coalesce(sum(full) over ({order} unbounded preceding and 1 preceding), 0)"))
        .withColumn("open", F.expr(f"sum(weight) over ({order} current row and unbounded following)"))
    )
    # the first source, from the least full level on, that the shared level does not fill
    fits = filled.withColumn("fits", F.expr(f"(total - below) / cast(open as double) <= {level}"))
    fits = fits.withColumn("settled", F.expr(f"max(fits) over ({order} unbounded preceding and current row)"))
    fits = fits.withColumn("lead", F.expr("min(if(settled, struct(full / cast(weight as double) as l, rank, below, open), null)) over ()"))
    target = F.expr("if(settled, cast(weight * (total - lead.below) as double) / lead.open, cast(full as double))")
    slope = F.expr(f"if(rank % 2 = 0, {RAMP}D, -{RAMP}D)")
    return fits.select("source", "source_size", target.alias("target"), slope.alias("slope"))


def given(time: Column, slope: Column) -> Column:
    """Share of its demand that a source has given by a time: the integral of 1 + slope * (2t - 1)."""
    return time * (1 - slope) + slope * time * time


def due(share: Column, slope: Column) -> Column:
    """The time by which a source has given a share of its demand: the inverse of ``given``."""
    rest = 1 - slope
    return 2 * share / (rest + F.sqrt(rest * rest + 4 * slope * share))


def training_schedule(
    docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """``docs`` plus size, source_size, target, copies, taken and positions.

    ``docs`` needs doc_id and source.  Inside a source, documents follow each
    other by md5 of doc_id; a document's repetition r (from 0) is taken when its
    middle word, ``r * source_size`` words further on, still lies within the
    source's target.  ``positions`` holds the training position of every taken
    repetition, in words.

    Nulls: a null source is a source of its own, rows without doc_id come first
    in their source, a null size is 0.  Rows of size 0 take nothing, though they
    may have positions.  Equal rows are kept apart and get consecutive places.
    Other columns are kept; those named like a result are replaced.
    """
    space = Workspace(docs.sparkSession)
    added = ("size", "source_size", "target", "copies", "taken", "positions")
    kept = [c for c in docs.columns if c not in added]
    names = {c: f"c{i}" for i, c in enumerate(kept)}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        F.col("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order"), F.col("doc_id"),
    )
    # slices keep a source of any size from being ordered by one task
    count = docs.count()
    slices = max(1, -(-count // slice_rows))
    slice_of = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint") * slices / (1 << 32)).cast("int")
    measured = space.save(
        "slices",
        rows.select("source", slice_of.alias("slice"), "size").groupBy("source", "slice").agg(F.sum("size").alias("size")),
    )
    demands = space.save("demands", source_demands(measured, weights, repeats))
    ahead = measured.select(
        "source", "slice",
        F.expr("coalesce(sum(size) over (partition by source order by slice rows between unbounded preceding and 1 preceding), 0)").alias("ahead"),
    )
    both = space.save(
        "places",
        ahead.join(demands, ahead["source"].eqNullSafe(demands["source"])).select(
            demands["source"].alias("of"), F.col("slice").alias("slice_of"), "ahead", "source_size", "target", "slope"
        ),
    )
    speed = demands.agg(F.sum("target").alias("all"), F.sum(F.expr("target * slope")).alias("bend")).first()
    inside = "sum(size) over (partition by source, slice order by order, doc_id, size rows between unbounded preceding and 1 preceding)"
    placed = rows.withColumn("slice", slice_of).withColumn("inside", F.coalesce(F.expr(inside), F.lit(0)))
    # as many places as sources and slices; a source's rows are spread over its slices
    placed = placed.join(both, placed["source"].eqNullSafe(both["of"]) & (placed["slice"] == both["slice_of"]))
    middle = F.expr("ahead + inside + size / 2D")
    repeats_taken = F.expr(f"filter(sequence(0, {repeats - 1}), r -> 2 * (r * source_size + ahead + inside) + size <= 2 * target)")
    total, bend = float(speed["all"] or 0), float(speed["bend"] or 0)

    def position(r: Column) -> Column:
        share = (r * F.col("source_size") + middle) / F.col("target")
        time = due(F.least(share, F.lit(1.0)), F.col("slope"))
        return F.lit(total) * time + F.lit(bend) * (time * time - time)

    taken = placed.withColumn("turns", F.when(F.col("target") > 0, repeats_taken).otherwise(F.expr("cast(array() as array<int>)")))
    return taken.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        "size", "source_size", "target",
        F.size("turns").alias("copies"),
        (F.size("turns") * F.col("size")).cast("bigint").alias("taken"),
        F.transform("turns", position).alias("positions"),
    )


def in_training_order(scheduled: DataFrame, ties: list[str]) -> DataFrame:
    """One row per taken repetition, sorted by training position over all partitions."""
    return scheduled.withColumn("position", F.explode("positions")).orderBy("position", *ties)
