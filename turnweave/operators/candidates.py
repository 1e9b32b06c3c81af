"""From ordered session rows to windowed candidate edges.

Two layouts give the same rows.  The *session* layout shuffles once by session
and lets every later per-source and per-target window reuse that partitioning.
The *block* layout cuts sessions into blocks of bounded size, so that a session
holding a large share of all rows is still spread over the cluster.
``choose_block`` measures which one is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_LEXICON, Lexicon
from ..functions.numeric import to_number
from ..functions.text import (
    char_jaccard,
    clean_text,
    contains_any,
    set_jaccard,
    word_chars,
    zero_fill,
)
from .prefix import integer_slice, sliced_running_sum

DEFAULT_WINDOW = 5
#: functions of a turn's cleaned text, by name
Features = Mapping[str, Callable[[Column], Column]]
SESSION_ROW_LIMIT = 200_000
BLOCK_ROWS = 16_384


def choose_block(
    rows: DataFrame,
    session: str,
    limit: int = SESSION_ROW_LIMIT,
    block: int = BLOCK_ROWS,
) -> int | None:
    """None when every session fits a task, else the block size to use.

    Reads only the session column, combined map-side; one number comes back.
    """
    largest = rows.groupBy(session).count().agg(F.max("count")).first()[0]
    return None if (largest or 0) <= limit else block


# --------------------------------------------------------------------------
# Records
# --------------------------------------------------------------------------

def records_from_turns(
    turns: DataFrame,
    session: str = "conv_id",
    order: str = "turn",
    role: str = "role",
    text: str = "text",
    asker: str = "user",
    answerer: str = "assistant",
    block: int | None = None,
    features: Features | None = None,
    texts: bool = True,
) -> DataFrame:
    """Pair each asker turn with the answer directly after it.

    Returns ``session_id, pos, turn, Q, A``: ``pos`` numbers the asker turns of
    a session from 0, ``A`` is empty unless the very next turn is an answer.
    ``(session, order)`` is unique and ``order`` an integer.

    ``features`` are computed per turn, before the rows are shuffled by session:
    feature ``f`` arrives as ``q_f`` and ``a_f``.  Without ``texts`` the result
    has text sizes (``q_size, a_size``) in place of ``Q, A``, and the shuffle
    carries only the features that are used.
    """
    wanted = dict(features or {})
    if not texts:
        wanted["size"] = F.length
    base = turns.select(
        F.col(session).alias("session_id"),
        F.col(order).alias("turn"),
        F.col(role).alias("_role"),
        clean_text(F.col(text)).alias("_text"),
    )
    base = base.select(
        "session_id", "turn", "_role", *(["_text"] if texts else []),
        *[use(F.col("_text")).alias(f"_own_{name}") for name, use in wanted.items()],
    )
    own = {f"_own_{name}": (f"q_{name}", f"a_{name}", use(F.lit(""))) for name, use in wanted.items()}
    if texts:
        own["_text"] = ("Q", "A", F.lit(""))
    paired = _paired(base, asker, ["_role", *own], block)
    answered = F.col("_next_role") == answerer
    return paired.where(F.col("_role") == asker).select(
        "session_id",
        "pos",
        "turn",
        *[F.col(c).alias(q) for c, (q, _, _) in own.items()],
        *[F.when(answered, F.col(f"_next{c}")).otherwise(empty).alias(a) for c, (_, a, empty) in own.items()],
    ).select("session_id", "pos", "turn", *(["Q", "A"] if texts else []), *[f"{s}_{n}" for n in wanted for s in "qa"])


def _paired(base: DataFrame, asker: str, carried: Sequence[str], block: int | None) -> DataFrame:
    """Add ``pos`` and, for each carried column ``c``, ``_next{c}`` of the next turn."""
    asks = (F.col("_role") == asker).cast("long")
    if block is None:
        in_order = Window.partitionBy("session_id").orderBy("turn")
        return base.select(
            "*",
            *[F.lead(c).over(in_order).alias(f"_next{c}") for c in carried],
            (F.sum(asks).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("pos"),
        )
    # a struct key: null sessions and null turns equal themselves, as in the other layout
    slot = F.struct(F.col("session_id").alias("s"), integer_slice(F.col("turn"), block).alias("slice"))
    sliced = base.withColumn("_slot", slot)
    # One row per slice: how many asker turns it has and how it begins.
    heads = sliced.groupBy("_slot").agg(
        F.sum(asks).alias("_asks"),
        F.min_by(F.struct(*carried), F.col("turn")).alias("_head"),
    )
    along = Window.partitionBy("_slot.s").orderBy("_slot.slice")
    heads = heads.select(
        "_slot",
        (F.sum("_asks").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_asks")).alias("_before"),
        F.lead("_head").over(along).alias("_after"),
    )
    inside = Window.partitionBy("_slot").orderBy("turn")
    last = F.lead(F.lit(1)).over(inside).isNull()
    return sliced.join(heads, "_slot").select(
        "*",
        *[F.when(last, F.col("_after")[c]).otherwise(F.lead(c).over(inside)).alias(f"_next{c}") for c in carried],
        (F.col("_before") + F.sum(asks).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("pos"),
    )


def number_records(
    records: DataFrame,
    session: str = "session_id",
    order: Sequence[str] = ("Qnumbr",),
    name: str = "pos",
    block: int | None = None,
) -> DataFrame:
    """Zero-based position inside each session.

    The block form slices by the first order column: ranges of an integer key,
    else its values (dates, say), none of which may hold a whole large session.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    if block is None:
        return records.withColumn(
            name, F.row_number().over(Window.partitionBy(session).orderBy(*keys)) - 1
        )
    first = F.col(order[0])
    if dict(records.dtypes)[order[0]] in ("tinyint", "smallint", "int", "bigint"):
        cut = integer_slice(F.coalesce(first, F.lit(2**62)), block)
    else:
        cut = F.coalesce(first.cast("string"), F.lit("\U0010ffff"))
    numbered = sliced_running_sum(
        records,
        [session],
        cut,
        keys,
        {name: F.lit(1).cast("long")},
    )
    return numbered.withColumn(name, (F.col(name) - 1).cast("int"))


def prepare_raw_records(raw: DataFrame) -> DataFrame:
    """Header trim, empty-row removal, padded codes and the session key."""
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    missing = {"Scode", "Year"} - set(trimmed.columns)
    if missing:
        raise ValueError(f"raw records need the columns {sorted(missing)}")
    return (
        trimmed.na.drop("all")
        .withColumn("Scode", zero_fill(F.coalesce(F.col("Scode"), F.lit("nan"))))
        .withColumn("Year", F.trim(F.coalesce(F.col("Year").cast("string"), F.lit("nan"))))
        .withColumn("session_id", F.concat_ws("_", "Scode", "Year"))
    )


def raw_order(columns: Sequence[str]) -> tuple[str, ...]:
    """Record number when present, else the date text."""
    for name in ("Qnumbr", "Date"):
        if name in columns:
            return (name,)
    return ()


# --------------------------------------------------------------------------
# Edges
# --------------------------------------------------------------------------

def candidate_edges(
    records: DataFrame,
    window: int = DEFAULT_WINDOW,
    block: int | None = None,
    source: Sequence[str] = (),
    target: Sequence[str] = (),
    texts: bool = True,
) -> DataFrame:
    """All (source, later target) pairs at most ``window`` positions apart.

    ``records`` has ``session_id, pos, Q, A``, or ``q_size, a_size`` in place of
    the texts if these are not asked for.  A source needs a question and an
    answer, a target a question; rows that fail still take up a position.
    ``source`` and ``target`` name further record columns to carry along, so
    per-record work (tokens, term sets) is done once and not once per edge; a
    target column ``c`` arrives as ``Q2_c``.

    The pairs come from one bounded look-ahead per row, not from a self join.
    Without ``texts`` the result has no ``Q1, A1, Q2``, and texts are dropped
    before the look-ahead copies them.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    follower = F.struct(
        F.col("pos").alias("row"),
        F.col("_asks"),
        *([F.col("Q")] if texts else []),
        *[F.col(c).alias(c) for c in target],
    )
    q_size, a_size = (F.col(c) if c in records.columns else F.length(c[0].upper()) for c in ("q_size", "a_size"))
    asks = q_size > 0
    records = records.select(
        "session_id",
        "pos",
        asks.alias("_asks"),
        (asks & (a_size > 0)).alias("_opens"),
        *(["Q", "A"] if texts else []),
        *dict.fromkeys([*source, *target]),
    )
    if block is None:
        ahead = Window.partitionBy("session_id").orderBy("pos").rowsBetween(1, window)
        staged = records.withColumn("_next", F.collect_list(follower).over(ahead))
    else:
        if block < window:
            raise ValueError("a block must be at least as long as the window")
        home = integer_slice(F.col("pos"), block)
        # The first rows of a block are also shown to the block before it.
        shown = F.when(
            (F.pmod(F.col("pos"), F.lit(block)) < window) & (F.col("pos") >= block),
            F.array(home, home - 1),
        ).otherwise(F.array(home))
        ahead = Window.partitionBy("session_id", "_block").orderBy("pos").rowsBetween(1, window)
        staged = (
            records.withColumn("_home", home)
            .withColumn("_block", F.explode(shown))
            .withColumn("_next", F.collect_list(follower).over(ahead))
            .where(F.col("_home") == F.col("_block"))
        )
    edges = staged.where("_opens").select(
        "session_id",
        F.col("pos").cast("int").alias("Q1_row"),
        F.explode("_next").alias("_t"),
        *([F.col("Q").alias("Q1"), F.col("A").alias("A1")] if texts else []),
        *source,
    ).where(F.col("_t._asks"))
    q2_row = F.col("_t.row").cast("int")
    return edges.select(
        F.concat_ws("_", F.col("session_id"), F.col("Q1_row"), q2_row).alias("edge_id"),
        "session_id",
        "Q1_row",
        q2_row.alias("Q2_row"),
        (q2_row - F.col("Q1_row")).alias("distance"),
        *(["Q1", "A1", F.col("_t.Q").alias("Q2")] if texts else []),
        *source,
        *[F.col(f"_t.{c}").alias(f"Q2_{c}") for c in target],
    )


def with_followed(records: DataFrame, window: int = DEFAULT_WINDOW, block: int | None = None) -> DataFrame:
    """Add ``followed``: whether a record that asks comes within the window (``pos``, ``asks``)."""
    follows = F.coalesce(F.max(F.col("asks").cast("int")).over(Window.partitionBy("session_id").orderBy("pos").rowsBetween(1, window)), F.lit(0)) > 0
    if block is None:
        return records.withColumn("followed", follows)
    home = integer_slice(F.col("pos"), block)
    shown = F.when((F.pmod(F.col("pos"), F.lit(block)) < window) & (F.col("pos") >= block), F.array(home, home - 1)).otherwise(F.array(home))
    ahead = Window.partitionBy("session_id", "_block").orderBy("pos").rowsBetween(1, window)
    staged = records.withColumn("_home", home).withColumn("_block", F.explode(shown))
    staged = staged.withColumn("followed", F.coalesce(F.max(F.col("asks").cast("int")).over(ahead), F.lit(0)) > 0)
    return staged.where(F.col("_home") == F.col("_block")).drop("_home", "_block")


def min_target_length(edges: DataFrame, length: int, size: Column | None = None) -> DataFrame:
    """Edges whose target question has ``length`` characters; ``size`` where edges carry it in place of texts."""
    size = F.length("Q2") if size is None else size
    return edges.where(size >= length) if length > 0 else edges


def heuristic_score(
    q1: Column,
    a1: Column,
    q2: Column,
    distance: Column,
    lexicon: Lexicon = DEFAULT_LEXICON,
    overlap: Column | None = None,
) -> Column:
    """Cheap follow-up likelihood used to pick rows for a prompt test.

    ``overlap`` (see ``carried_overlap``) spares the character sets per edge.
    """
    q1, a1, q2 = clean_text(q1), clean_text(a1), clean_text(q2)
    gap = to_number(distance, 1.0)
    gap = F.when(gap == 0, F.lit(1.0)).otherwise(gap)
    flag = lambda condition: condition.cast("double")
    complaint = contains_any(q2, lexicon.complaint)
    short = (F.length(q2) <= 12) & (complaint | contains_any(q2, lexicon.short_complaint))
    if overlap is None:
        overlap = F.greatest(char_jaccard(q1, q2), char_jaccard(a1, q2))
    near = 1.0 / (1.0 + F.greatest(gap, F.lit(1.0)))
    total = (
        0.26 * flag(contains_any(q2, lexicon.followup))
        + 0.30 * flag(complaint)
        + 0.16 * flag(contains_any(a1, lexicon.vague))
        + 0.16 * overlap
        + 0.08 * near
        + 0.20 * flag(short)
    )
    return F.least(F.lit(1.0), total)


CHARS: Features = {"chars": word_chars}
CHAR_SOURCE, CHAR_TARGET = ("q_chars", "a_chars"), ("q_chars",)


def record_chars(records: DataFrame) -> DataFrame:
    """Character sets once per record; carry them through ``candidate_edges``."""
    return records.withColumns({"q_chars": word_chars(F.col("Q")), "a_chars": word_chars(F.col("A"))})


def carried_overlap() -> Column:
    """The larger character overlap of question and answer with the target."""
    target = F.col("Q2_q_chars")
    return F.greatest(set_jaccard(F.col("q_chars"), target), set_jaccard(F.col("a_chars"), target))


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle order (md5 text of seed and key)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_candidates(
    edges: DataFrame,
    max_candidates: int,
    seed: int = 42,
    lexicon: Lexicon = DEFAULT_LEXICON,
) -> DataFrame:
    """Half by heuristic score, half by hash order, in hash order.

    Both halves are distributed top-n selections of the requested sample size;
    a table no larger than the sample passes through with a null
    ``prompt_test_score``, so the columns are the same at every size.
    """
    carried = {"q_chars", "a_chars", "Q2_q_chars"} <= set(edges.columns)
    overlap = carried_overlap() if carried else None
    scored = edges.withColumn(
        "prompt_test_score",
        heuristic_score(F.col("Q1"), F.col("A1"), F.col("Q2"), F.col("distance"), lexicon, overlap),
    )
    if max_candidates <= 0 or edges.limit(max_candidates + 1).count() <= max_candidates:
        return edges.withColumn("prompt_test_score", F.lit(None).cast(scored.schema["prompt_test_score"].dataType))
    high_n = max_candidates // 2
    best = [F.col("prompt_test_score").desc(), F.col("session_id"), F.col("Q1_row"), F.col("Q2_row")]
    high = scored.orderBy(*best).limit(high_n)
    rest = scored.join(high.select("edge_id"), "edge_id", "left_anti")
    rest = rest.orderBy(hash_order(F.col("edge_id"), seed), "edge_id").limit(max_candidates - high_n)
    return high.unionByName(rest).orderBy(hash_order(F.col("edge_id"), seed + 1), "edge_id")
