"""Size-balanced shards by sampled splitters, in DataFrame operations only.

Records are ordered by (key, tie).  A size-weighted sample of keys gives quantile
boundaries, which cut the order into many ranges of about equal bytes.  Ranges
are measured over all records; those that came out too large are sampled again
and cut further, between keys where possible and inside one key only when that
key alone is too much.  Shards are runs of consecutive ranges.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import Workspace

#: ranges per shard, sampled keys per range
RANGES = 64
SAMPLES = 16
#: a range above this many times the mean is cut again
OVERFULL = 1.5
#: one key is cut only if it holds more than this share of a shard
WHOLE_KEY = 0.25
ROUNDS = 3
LOWEST = -(1 << 63)


def _rank(bounds: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or below (key, tie): a binary search in two literal arrays."""
    if not bounds:
        return F.lit(0)
    keys = F.split(F.lit(",".join(str(k) for k, _ in bounds)), ",").cast("array<bigint>")
    ties = F.split(F.lit(",".join(str(t) for _, t in bounds)), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halve(span: Column, _: Column) -> Column:
        low, high = span["low"], span["high"]
        middle = F.shiftright(low + high, 1)
        k, t = F.get(keys, middle), F.get(ties, middle)
        below = (k < F.col("key")) | ((k == F.col("key")) & (t <= F.col("tie")))
        return F.when(low >= high, span).when(
            below, F.struct((middle + 1).alias("low"), high.alias("high"))
        ).otherwise(F.struct(low.alias("low"), middle.alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(steps, start, halve)["low"]


def _sample(rows: DataFrame, rate: Column, turn: int) -> list[tuple[int, int]]:
    """(key, tie), each repeated as often as it was drawn; at most the asked number but for chance."""
    chance = F.pmod(F.xxhash64("key", "tie", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.floor(F.col("size") * rate + chance).cast("int")
    found = rows.select("key", "tie", drawn.alias("n")).where("n > 0").collect()
    return sorted((r["key"], r["tie"]) for r in found for _ in range(r["n"]))


def _measure(rows: DataFrame, bounds: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """range -> (bytes, rows), over all rows; as many entries as ranges."""
    found = rows.groupBy(_rank(bounds).alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    return {r["range"]: (r["size"], r["n"]) for r in found}


def _refine(rows: DataFrame, bounds: list, measured: dict, aim: float, whole: float, turn: int) -> list:
    """Further boundaries inside overfull ranges."""
    large = {i: size for i, (size, _) in measured.items() if size > OVERFULL * aim}
    if not large:
        return bounds
    # one rate for all: a range of x times the aim gets x * SAMPLES draws
    rate = F.lit(SAMPLES / aim)
    placed = rows.withColumn("range", _rank(bounds)).where(F.col("range").isin(list(large)))
    chosen = defaultdict(list)
    for point in _sample(placed, rate, turn):
        at = bisect_left(bounds, point)
        chosen[at + (at < len(bounds) and bounds[at] == point)].append(point)
    extra = set()
    for at, points in chosen.items():
        drawn = defaultdict(list)
        for key, tie in points:
            drawn[key].append(tie)
        for i in range(SAMPLES, len(points), SAMPLES):
            extra.add((points[i][0], LOWEST))
        for key, ties in drawn.items():
            if len(ties) >= SAMPLES // 2:  # a heavy key: it begins and ends a range
                extra.add((key, LOWEST))
                if key < -LOWEST - 1:
                    extra.add((key + 1, LOWEST))
            weight = large.get(at, 0) * len(ties) / len(points)
            if weight > whole:
                extra.update((key, ties[i]) for i in range(SAMPLES, len(ties), SAMPLES))
    return sorted({*bounds, *extra})


def plan_shards(rows: DataFrame, shards: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Boundaries, and for each range its shard and the slots before it.

    ``rows`` has key, tie and size (longs, not null).  What reaches the driver is
    bounded by ``shards * RANGES``: sampled keys and one measure per range.
    """
    total = rows.agg(F.sum("size").alias("t"), F.count("*").alias("n")).first()
    if not total["n"]:
        return [], [0], [0]
    aim = max(1.0, total["t"] / (shards * RANGES))
    points = _sample(rows, F.lit(SAMPLES / aim), 0)
    bounds = sorted({(points[i][0], LOWEST) for i in range(SAMPLES, len(points), SAMPLES)})
    measured = _measure(rows, bounds)
    for turn in range(1, ROUNDS + 1):
        finer = _refine(rows, bounds, measured, aim, WHOLE_KEY * total["t"] / shards, turn)
        if finer == bounds:
            break
        bounds = finer
        measured = _measure(rows, bounds)
    shard_of, before, done, slots = [], [], 0, defaultdict(int)
    for i in range(len(bounds) + 1):
        size, n = measured.get(i, (0, 0))
        middle = done + size / 2
        shard = min(shards - 1, math.floor(shards * middle / total["t"])) if total["t"] else 0
        shard_of.append(shard)
        before.append(slots[shard])
        slots[shard] += n
        done += size
    return bounds, shard_of, before


def shard_by_size(df: DataFrame, shards: int, key: Column, tie: Column, size: Column, save: bool = True) -> DataFrame:
    """``df`` plus shard (0 .. shards - 1) and slot (gapless from 0 within a shard).

    Bytes per shard are near equal.  Rows of one key stay together unless the key
    holds more than ``WHOLE_KEY`` of a shard; then it is cut by ``tie``.  Rows with
    equal key and tie cannot be parted.  Nulls in key or tie count as one value,
    a null size as 0.  An empty table gives an empty result, and columns of
    ``df`` named shard or slot are replaced.

    The plan is made on (key, tie, size) alone, written once if ``save``; the
    rows themselves move once, to the range that numbers them.
    """
    narrow = df.select(
        F.coalesce(key, F.lit(0)).cast("bigint").alias("key"),
        F.coalesce(tie, F.lit(0)).cast("bigint").alias("tie"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
    )
    if save:
        narrow = Workspace(df.sparkSession).save("sizes", narrow)
    bounds, shard_of, before = plan_shards(narrow, shards)
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    names = {c: f"c{i}" for i, c in enumerate(kept)}
    rows = df.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        F.coalesce(key, F.lit(0)).cast("bigint").alias("key"),
        F.coalesce(tie, F.lit(0)).cast("bigint").alias("tie"),
    )
    # ranges, not shards, are the unit of work: each is a small part of a shard
    placed = rows.withColumn("range", _rank(bounds))
    number = F.expr("row_number() over (partition by range order by key, tie)")
    start = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    home = F.split(F.lit(",".join(map(str, shard_of))), ",").cast("array<int>")
    numbered = placed.withColumn("number", number.cast("bigint"))
    return numbered.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        F.get(home, F.col("range")).alias("shard"),
        (F.get(start, F.col("range")) + F.col("number") - 1).alias("slot"),
    )
