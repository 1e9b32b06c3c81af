"""Session bootstrap by weight vectors, for any number of models at once.

How often each draw picked a session is one packed vector per session.  All that a
metric needs is counts: true and false positives and misses of each model, and
positives and negatives per distinct score.  Each count of a session, times the
session's vector, adds up to one vector per count over all sessions, so rows follow
distinct scores and not draws, and precision, recall, F1, AUC and AP of all draws
are arithmetic on a few vectors.

Picks are routed by slices of sessions: a task makes the picks of its pick numbers
for all draws and sends each slice the packed picks that fall into it.  There they
meet the counts of the slice's sessions, so weight vectors are never rows of a join.
Vectors of counts travel in the narrowest integers that hold them.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite_score
from ..session import materialize
from .bootstrap import DRAWS, MODULUS, SEED
from .prefix import sliced_index, unit_slice

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SESSIONS_A_SLICE = 512
SCORES_A_SLICE = 256
#: picks held by a task before they are sent off
PICKS_AT_ONCE = 1_000_000
#: cells multiplied at once
CELLS_AT_ONCE = 1_024
#: vectors that a task makes of one slice of sessions; a slice with more is dealt out by code
VECTORS_AT_ONCE = 8_192
#: slices of sessions whose vectors are added up at once
SLICES_AT_ONCE = 16
SALTS = 16

_COUNTS = ("tp", "fp", "fn")


def picks(k: np.ndarray, n_draws: int, n_sessions: int, seed: int = SEED) -> np.ndarray:
    """(len(k), n_draws): the session that pick k of each draw takes; the rule of ``bootstrap.hashed_draws``."""
    k = k.astype(np.int64)[:, None]
    draw = np.arange(n_draws, dtype=np.int64)[None, :]
    mixed = (draw * 7919 + k * 104729 + seed * 31) % MODULUS
    mixed = (mixed * 48271) % MODULUS
    mixed = (mixed * mixed + draw) % MODULUS
    mixed = (mixed * 16807 + k) % MODULUS
    return mixed % n_sessions


def _sent(sessions: DataFrame, n: int, n_draws: int, seed: int) -> DataFrame:
    """``slice, codes``: packed picks (session in its slice, draw) that fall into each slice of sessions."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PICKS_AT_ONCE // n_draws)
        for batch in batches:
            ks = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(ks), step):
                taken = picks(ks[start : start + step], n_draws, n, seed)
                code = (taken % SESSIONS_A_SLICE) * n_draws + np.arange(n_draws)
                home = (taken // SESSIONS_A_SLICE).ravel()
                order = np.argsort(home, kind="stable")
                home, code = home[order], code.ravel()[order].astype(np.int32)
                first = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))
                packed = [c.tobytes() for c in np.split(code, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(home[first], pa.int64()), pa.array(packed, pa.binary())], names=["slice", "codes"])

    return sessions.select("session_idx").mapInArrow(send, "slice bigint, codes binary")


def _dense(codes: pa.ChunkedArray, n_draws: int) -> np.ndarray:
    """(sessions of a slice, n_draws): how often each draw picked each session."""
    weight = np.zeros(SESSIONS_A_SLICE * n_draws, np.int32)
    for chunk in codes.to_pylist():
        np.add.at(weight, np.frombuffer(chunk, np.int32), 1)
    return weight.reshape(SESSIONS_A_SLICE, n_draws)


def weight_vectors(sessions: DataFrame, n_draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """``session_idx, weights``: packed 32-bit counts, one a draw, of how often it picked the session."""
    n = sessions.count()

    def dense(key: tuple, rows: pa.Table) -> pa.Table:
        weight = _dense(rows.column("codes"), n_draws)
        idx = key[0].as_py() * SESSIONS_A_SLICE + np.arange(SESSIONS_A_SLICE)
        inside = idx < n
        return pa.table({"session_idx": pa.array(idx[inside], pa.int64()), "weights": pa.array([w.tobytes() for w in weight[inside]], pa.binary())})

    return _sent(sessions, n, n_draws, seed).groupBy("slice").applyInArrow(dense, "session_idx bigint, weights binary")


def _pack(v: np.ndarray) -> bytes | None:
    """Counts in the narrowest type that holds them; none of them is null."""
    top = v.max()
    if not top:
        return None
    width = next((t for t in (np.uint8, np.uint16, np.uint32) if top <= np.iinfo(t).max), np.float64)
    return v.astype(width).tobytes()


def _unpack(column: pa.ChunkedArray, n_draws: int) -> np.ndarray:
    """(rows, n_draws): packed counts or doubles as doubles; the width tells the type."""
    types = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.float64}
    out = np.zeros((len(column), n_draws))
    for row, v in zip(out, column):
        if v.is_valid:
            packed = v.as_buffer()
            row[:] = np.frombuffer(packed, types[packed.size // n_draws])
    return out


def _sum_vectors(rows: DataFrame, key: str = "code") -> DataFrame:
    """One row a key: ``a`` and ``b``, packed doubles, added up; rows of a key meet in two levels."""

    def add(group: tuple, table: pa.Table) -> pa.Table:
        total = [sum(np.frombuffer(v, np.float64) for v in table.column(c).to_pylist()).tobytes() for c in ("a", "b")]
        return pa.table({key: pa.array([group[0].as_py()], pa.int64()), "a": pa.array(total[:1], pa.binary()), "b": pa.array(total[1:], pa.binary())})

    schema = f"{key} bigint, a binary, b binary"
    once = rows.groupBy(key, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")).applyInArrow(add, schema)
    return once.groupBy(key).applyInArrow(add, schema)


def _weighted(cells: DataFrame, sessions: DataFrame, n_draws: int, seed: int) -> DataFrame:
    """``code, a, b``: the vectors of each code, from cells (session_idx, code, pos, neg), one a session and code."""
    n = sessions.count()
    cells = materialize(cells.withColumn("slice", F.expr(f"session_idx div {SESSIONS_A_SLICE}")))
    # a slice of sessions with very many scores is several tasks, each with the picks of the slice
    parts = F.ceil(F.count(F.lit(1)) / VECTORS_AT_ONCE).alias("parts")
    dealt = cells.groupBy("slice", "code").agg(F.lit(1).alias("_")).groupBy("slice").agg(parts)
    sent = _sent(sessions, n, n_draws, seed).join(dealt, "slice")
    sent = sent.select("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "codes")
    mine = cells.join(dealt, "slice").withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")))

    def multiply(key: tuple, picked: pa.Table, rows: pa.Table) -> pa.Table:
        code = rows.column("code").to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        at, pos, neg = (rows.column(c).to_numpy()[order] for c in ("session_idx", "pos", "neg"))
        weight, at = _dense(picked.column("codes"), n_draws), at % SESSIONS_A_SLICE
        bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])), [len(code)]]) if len(code) else np.zeros(1, np.int64)
        packed: tuple[list, list] = ([], [])
        low = 0
        while low < len(bounds) - 1:
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CELLS_AT_ONCE, "right")) - 1)
            these = slice(bounds[low], bounds[high])
            w = weight[at[these]].astype(np.int64)
            for out, x in zip(packed, (pos, neg)):
                out += [_pack(v) for v in np.add.reduceat(w * x[these, None], bounds[low:high] - bounds[low], axis=0)]
            low = high
        return pa.table({
            "code": pa.array(code[bounds[:-1]], pa.int64()), "slice": pa.array(np.full(len(bounds) - 1, key[0].as_py()), pa.int64()),
            "a": pa.array(packed[0], pa.binary()), "b": pa.array(packed[1], pa.binary()),
        })

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        code, at = np.unique(rows.column("code").to_numpy(), return_inverse=True)
        packed = []
        for c in ("a", "b"):
            total = np.zeros((len(code), n_draws))
            for i in range(0, len(at), CELLS_AT_ONCE):
                np.add.at(total, at[i : i + CELLS_AT_ONCE], _unpack(rows.column(c).slice(i, CELLS_AT_ONCE), n_draws))
            packed.append(pa.array([_pack(v) for v in total], pa.binary()))
        return pa.table({"code": pa.array(code, pa.int64()), "slice": pa.array(np.full(len(code), key[1].as_py()), pa.int64()), "a": packed[0], "b": packed[1]})

    schema = "code bigint, slice bigint, a binary, b binary"
    by_slice = mine.select("slice", "part", "session_idx", "code", "pos", "neg").groupBy("slice", "part")
    vectors = sent.groupBy("slice", "part").cogroup(by_slice).applyInArrow(multiply, schema)
    slices = math.ceil(n / SESSIONS_A_SLICE)
    while True:  # a group has the codes of a run of scores in some slices of sessions
        run, some = F.expr(f"code div {SCORES_A_SLICE}").alias("run"), F.expr(f"slice div {SLICES_AT_ONCE}")
        vectors = vectors.select(run, some.alias("slice"), "code", "a", "b").groupBy("run", "slice").applyInArrow(add, schema)
        slices = math.ceil(slices / SLICES_AT_ONCE)
        if slices <= 1:
            return vectors.select("code", "a", "b")


def draw_metrics(
    long: DataFrame, sessions: DataFrame, n_draws: int = DRAWS, seed: int = SEED, label: str = "edge_label", ranking: bool = True
) -> DataFrame:
    """``Model, draw, Precision, Recall, F1, AUC, AP`` of every model and draw; no AUC and AP without ``ranking``.

    ``long`` has session_id, Model, score, pred and the label, one row per edge and
    model; ``sessions`` has session_id and session_idx from 0.  AUC and AP are null
    in draws without both classes.  Missing labels and predictions count as 0,
    missing scores as ``finite_score`` has it.
    """
    y, p = F.coalesce(F.col(label).cast("int"), F.lit(0)), F.coalesce(F.col("pred").cast("int"), F.lit(0))
    score = finite_score(F.col("score")) if ranking else F.lit(0.0)
    base = long.select("session_id", "Model", score.alias("score"), y.alias("y"), p.alias("p"))
    base = base.join(sessions, "session_id")
    summed = base.groupBy("session_idx", "Model", "score").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"),
        F.count_if(F.expr("y = 1 and p = 1")).alias("tp"), F.count_if(F.expr("y = 0 and p = 1")).alias("fp"), F.count_if(F.expr("y = 1 and p = 0")).alias("fn"),
    )
    summed = materialize(summed)
    models = summed.select("Model").distinct()
    models = materialize(sliced_index(models, [], F.pmod(F.xxhash64("Model"), F.lit(64)), [F.col("Model")], "m"))
    # code: model in the high bits, place of the score (or of the count) in the low ones
    code = F.shiftleft(F.col("m"), 40)
    cells = summed.join(F.broadcast(models), "Model").select(
        "session_idx", F.inline(F.array(*[F.struct((code + i).alias("code"), F.col(c).alias("pos"), F.lit(0).cast("bigint").alias("neg")) for i, c in enumerate(_COUNTS)]))
    ).groupBy("session_idx", "code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    if ranking:
        # scores from the greatest down, numbered within their model; counts of predictions come before them
        scores = summed.select("Model", "score").distinct()
        scores = sliced_index(scores, ["Model"], -unit_slice(F.col("score")), [F.col("score").desc()], "place")
        codes = scores.join(F.broadcast(models), "Model")  # a row a model
        scored = summed.join(codes, ["Model", "score"]).select("session_idx", (code + F.col("place") + len(_COUNTS)).alias("code"), "pos", "neg")
        cells = cells.unionByName(scored)
    vectors = materialize(_weighted(cells, sessions, n_draws, seed))
    vectors = vectors.withColumns({"m": F.shiftright("code", 40), "place": F.col("code").bitwiseAND((1 << 40) - 1) - len(_COUNTS)})

    draws = np.arange(n_draws)
    rate_schema = "m bigint, draw int, Precision double, Recall double, F1 double"

    def rates(key: tuple, rows: pa.Table) -> pa.Table:
        by = dict(zip(rows.column("place").to_pylist(), _unpack(rows.column("a"), n_draws)))
        tp, fp, fn = (by[i - len(_COUNTS)] for i in range(3))
        over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
        return pa.table({
            "m": pa.array(np.full(n_draws, key[0].as_py()), pa.int64()), "draw": pa.array(draws, pa.int32()),
            "Precision": over(tp, tp + fp), "Recall": over(tp, tp + fn), "F1": over(2 * tp, 2 * tp + fp + fn),
        })

    found = vectors.where("place < 0").groupBy("m").applyInArrow(rates, rate_schema)
    if not ranking:
        return found.join(F.broadcast(models), "m").select("Model", "draw", "Precision", "Recall", "F1")
    ranked = vectors.where("place >= 0").withColumn("slice", F.floor(F.col("place") / SCORES_A_SLICE))

    def totals(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = (_unpack(rows.column(c), n_draws).sum(axis=0) for c in ("a", "b"))
        return pa.table({"m": pa.array([key[0].as_py()], pa.int64()), "slice": pa.array([key[1].as_py()], pa.int64()), "a": pa.array([a.tobytes()], pa.binary()), "b": pa.array([b.tobytes()], pa.binary())})

    def before(key: tuple, rows: pa.Table) -> pa.Table:
        """Positives and negatives of all slices of higher scores."""
        order = np.argsort(rows.column("slice").to_numpy())
        out = []
        for c in ("a", "b"):
            v = _unpack(rows.column(c), n_draws)[order]
            out.append([x.tobytes() for x in np.cumsum(v, axis=0) - v])
        return pa.table({"m": pa.array(np.full(len(order), key[0].as_py()), pa.int64()), "slice": pa.array(rows.column("slice").to_numpy()[order], pa.int64()), "a": pa.array(out[0], pa.binary()), "b": pa.array(out[1], pa.binary())})

    def terms(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
        """Won pairs and precision steps of one slice."""
        order = np.argsort(rows.column("place").to_numpy())
        pos, neg = (_unpack(rows.column(c), n_draws)[order] for c in ("a", "b"))
        cp = np.cumsum(pos, axis=0) + _unpack(above.column("a"), n_draws)[0]
        cn = np.cumsum(neg, axis=0) + _unpack(above.column("b"), n_draws)[0]
        wins = (neg * (cp - pos / 2)).sum(axis=0)
        some = cp + cn
        steps = np.divide(pos * cp, some, out=np.zeros_like(some), where=some > 0).sum(axis=0)
        return pa.table({"m": pa.array([key[0].as_py()], pa.int64()), "a": pa.array([wins.tobytes()], pa.binary()), "b": pa.array([steps.tobytes()], pa.binary())})

    sliced = ranked.groupBy("m", "slice").applyInArrow(totals, "m bigint, slice bigint, a binary, b binary")
    above = sliced.groupBy("m").applyInArrow(before, "m bigint, slice bigint, a binary, b binary")
    parts = ranked.select("m", "slice", "place", "a", "b").groupBy("m", "slice").cogroup(above.groupBy("m", "slice")).applyInArrow(terms, "m bigint, a binary, b binary")
    areas = _sum_vectors(parts, "m").select("m", F.col("a").alias("wins"), F.col("b").alias("steps"))
    classes = _sum_vectors(sliced.select("m", "a", "b"), "m").join(areas, "m")

    def area(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, a, b, wins, steps in zip(*(batch.column(i).to_pylist() for i in range(5))):
                pos, neg, wins, steps = (np.frombuffer(v, np.float64) for v in (a, b, wins, steps))
                both = (pos > 0) & (neg > 0)
                auc = np.divide(wins, pos * neg, out=np.zeros(n_draws), where=both)
                ap = np.divide(steps, pos, out=np.zeros(n_draws), where=both)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n_draws, m), pa.int64()), pa.array(draws, pa.int32()), pa.array(auc, mask=~both), pa.array(ap, mask=~both)],
                    names=["m", "draw", "AUC", "AP"],
                )

    ranks = classes.select("m", "a", "b", "wins", "steps").mapInArrow(area, "m bigint, draw int, AUC double, AP double")
    return found.join(ranks, ["m", "draw"]).join(F.broadcast(models), "m").select("Model", "draw", "Precision", "Recall", "F1", "AUC", "AP")


def model_intervals(table: DataFrame, n_draws: int) -> DataFrame:
    """``Model, Metric``, mean and 2.5/97.5 % quantiles of a ``draw_metrics`` table; null draws are left out."""
    names = ("AUC", "AP", "Precision", "Recall", "F1")
    stats = table.groupBy("Model").agg(*[
        F.struct(
            F.lit(n).alias("Metric"), F.avg(n).alias("BootstrapMean"), F.percentile(n, F.lit(0.025)).alias("CI_Lower"),
            F.percentile(n, F.lit(0.975)).alias("CI_Upper"), F.lit(int(n_draws)).alias("BootstrapSamples"),
        ).alias(n)
        for n in names
    ])
    return stats.select("Model", F.inline(F.array(*names)))


def paired_differences(table: DataFrame, model: str, n_draws: int) -> DataFrame:
    """F1 of ``model`` less that of every other model over shared draws, one row each."""
    own = table.where(F.col("Model") == model).select("draw", F.col("F1").alias("own"))
    others = table.where(F.col("Model") != model).join(own, "draw").withColumn("d", F.col("own") - F.col("F1"))
    return others.groupBy(F.col("Model").alias("Baseline")).agg(
        F.avg("d").alias("F1_Difference_Mean"), F.percentile("d", F.lit(0.025)).alias("CI_Lower"), F.percentile("d", F.lit(0.975)).alias("CI_Upper"),
        F.avg((F.col("d") <= 0).cast("double")).alias("P_Diff_LE_0"), F.lit(int(n_draws)).alias("BootstrapSamples"),
    )


def long_table(edges: DataFrame, models: Mapping[str, tuple[str, str]], label: str = "edge_label") -> DataFrame:
    """One row per edge and model: ``models`` maps names to (score column, prediction column)."""
    each = F.array(*[F.struct(F.lit(n).alias("Model"), F.col(s).cast("double").alias("score"), F.col(p).cast("int").alias("pred")) for n, (s, p) in models.items()])
    return edges.select("session_id", label, F.inline(each))
