"""Positive text pairs for contrastive encoder training, and their batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import anchor_text, candidate_text, clean_text
from ..session import lookup_join, materialize
from .prefix import sliced_running_sum
from .splits import positive_mask

SEED = 42


def positive_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (anchor, candidate) texts of the positive train rows.

    ``edges`` carries ``split``; a pair needs all three texts.  ``copies`` tells
    how many rows a pair stands for.
    """
    rows = edges.where((F.col("split") == "train") & positive_mask(edges))
    full = [F.length(clean_text(F.col(c))) > 0 for c in ("Q1", "A1", "Q2")]
    return (
        rows.where(full[0] & full[1] & full[2])
        .select(
            anchor_text(F.col("Q1"), F.col("A1")).alias("anchor"),
            candidate_text(F.col("Q2")).alias("candidate"),
        )
        .groupBy("anchor", "candidate")
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def pair_stats(edges: DataFrame) -> DataFrame:
    """Row counts of the pair construction, one row."""
    train = F.col("split") == "train"
    base = edges.agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(train).alias("train_rows"),
        F.count_if(train & positive_mask(edges)).alias("train_positive_rows"),
    )
    pairs = positive_pairs(edges).agg(
        F.count(F.lit(1)).alias("unique_train_positive_pairs"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_positive_pairs_removed"),
    )
    return base.crossJoin(pairs)


def unique_anchor_batches(
    pairs: DataFrame, batch_size: int, seed: int = SEED, slices: int = 1024
) -> DataFrame:
    """Give every pair a batch so that no batch repeats an anchor.

    Pairs are numbered with equal anchors side by side (anchors in hash order)
    and dealt round-robin over M batches, M = max(pairs / batch_size, copies of
    the most frequent anchor).  Neighbours then never meet, and no batch is
    larger than ``batch_size``.  Batches of one pair are dropped: without a
    second anchor they hold no contrast.

    Numbering runs over hash slices, and inside an anchor over slices of its
    own, so that one very frequent anchor does not end in one task.
    """
    if batch_size < 2:
        raise ValueError("batch_size must be at least 2")
    salt = F.lit(f"{seed}:")
    keyed = pairs.withColumns(
        {
            "_a": F.md5(F.concat(salt, F.col("anchor"))),
            "_c": F.md5(F.concat(salt, F.col("candidate"))),
        }
    )
    # the first three hex digits follow the order of the whole digest
    cut = lambda c: F.conv(F.substring(c, 1, 3), 16, 10).cast("long")
    anchors = keyed.groupBy("anchor", "_a").agg(F.count(F.lit(1)).alias("n"))
    placed = sliced_running_sum(
        anchors, [], cut(F.col("_a")), [F.col("_a"), F.col("anchor")], {"upto": F.col("n")}
    ).select("anchor", (F.col("upto") - F.col("n")).alias("start"))
    inside = sliced_running_sum(
        keyed, ["anchor"], cut(F.col("_c")), [F.col("_c"), F.col("candidate")],
        {"nth": F.lit(1).cast("long")},
    )
    totals = anchors.agg(
        F.greatest(
            F.ceil(F.sum("n") / F.lit(float(batch_size))).cast("long"), F.max("n")
        ).alias("batches")
    )
    sized = _join_spread(inside, placed).crossJoin(F.broadcast(totals))
    numbered = sized.select(
        "anchor", "candidate", F.pmod(F.col("start") + F.col("nth") - 1, F.col("batches")).alias("batch")
    )
    kept = numbered.groupBy("batch").count().where(F.col("count") > 1).select("batch")
    return numbered.join(kept, "batch", "left_semi")


def _join_spread(inside: DataFrame, placed: DataFrame) -> DataFrame:
    return lookup_join(inside, placed, ["anchor"], F.col("candidate"), "inner")


def peel(counts: list[int], total: int, batch_size: int) -> tuple[int, int, int]:
    """How many of the commonest anchors go ahead of all others, and the pairs and places that are then left.

    ``counts`` falls and has the ``batch_size`` greatest.  An anchor with more
    pairs than there are full batches cannot be dealt in turn: it takes one place
    of its own in as many batches as it has pairs.
    """
    taken = 0
    while batch_size > 1 and taken < len(counts) and counts[taken] > total // batch_size:
        total -= counts[taken]
        batch_size -= 1
        taken += 1
    return taken, total, batch_size


def filled_anchor_batches(pairs: DataFrame, batch_size: int, seed: int = SEED) -> DataFrame:
    """``anchor, candidate, batch``: batches without a repeated anchor, filled one after the other.

    Every batch is as full as the anchors allow: ``batch_size`` pairs, but for
    those at the end that only a very common anchor, or the remainder, is left for.
    Anchors too common to be dealt in turn (at most ``batch_size`` of them) lie in
    the first batches, one pair in each; all other pairs are numbered with equal
    anchors side by side and dealt over the full batches, so that equal anchors
    never meet.  Batches of one pair are dropped: they hold no contrast.

    Anchors are told apart by a 64-bit hash (two that share one are never put
    together); texts are not grouped or sorted.
    """
    if batch_size < 2:
        raise ValueError("batch_size must be at least 2")
    keyed = materialize(pairs.select("anchor", "candidate", F.xxhash64(F.lit(seed), "anchor").alias("_a"), F.xxhash64(F.lit(seed), "candidate").alias("_c")))
    anchors = keyed.groupBy("_a").agg(F.count(F.lit(1)).alias("n"))
    top = anchors.orderBy(F.desc("n"), "_a").limit(batch_size).collect()
    total = anchors.agg(F.sum("n")).first()[0] or 0
    taken, left, places = peel([r["n"] for r in top], total, batch_size)
    ahead = [r["_a"] for r in top[:taken]]
    cut = lambda c: F.shiftright(c, 54)  # noqa: E731 - the first ten bits follow the order of the hash
    inside = sliced_running_sum(keyed, ["_a"], cut(F.col("_c")), [F.col("_c"), F.col("candidate")], {"nth": F.lit(1).cast("long")})
    starts = sliced_running_sum(anchors.where(~F.col("_a").isin(ahead)) if ahead else anchors, [], cut(F.col("_a")), [F.col("_a")], {"upto": F.col("n")})
    starts = starts.select("_a", (F.col("upto") - F.col("n")).alias("start"))
    full, rest = divmod(left, places)
    at = F.col("start") + F.col("nth") - 1
    wide = rest * (full + 1)  # places in rows that reach into the last, smaller batch
    dealt = F.when(at < wide, F.pmod(at, F.lit(full + 1))).otherwise(F.pmod(at - wide, F.lit(max(full, 1))))
    numbered = lookup_join(inside, starts, ["_a"], F.col("_c"), "left").select(
        "anchor", "candidate", F.coalesce(dealt, F.col("nth") - 1).alias("batch")
    )
    alone = numbered.groupBy("batch").count().where(F.col("count") > 1).select("batch")
    return numbered.join(alone, "batch", "left_semi")
