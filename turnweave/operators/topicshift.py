"""Rule score for topic shifts, and the automatic labelling of clear cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_LEXICON, Lexicon
from ..functions.text import clean_text, contains_any, extract_terms, term_overlap
from .candidates import Features

EASY_THRESHOLD = 0.80
BOUNDARY_THRESHOLD = 0.45
AUTO_REASON = "Automatic topic shift denoise."


def term_features(lexicon: Lexicon = DEFAULT_LEXICON) -> Features:
    """Term sets of a turn, for ``records_from_turns``."""
    return {"terms": lambda text: extract_terms(text, lexicon.term_stopwords)}


def record_terms(records: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Term sets once per record; no term crosses the question/answer border."""
    if not {"q_terms", "a_terms"} <= set(records.columns):
        stop = lexicon.term_stopwords
        records = records.withColumns(
            {"q_terms": extract_terms(F.col("Q"), stop), "a_terms": extract_terms(F.col("A"), stop)}
        )
    return records.withColumn("anchor_terms", F.array_union("q_terms", "a_terms")).drop("a_terms")


def topic_shift(
    q1: Column,
    a1: Column,
    q2: Column,
    lexicon: Lexicon = DEFAULT_LEXICON,
    anchor_terms: Column | None = None,
    q2_terms: Column | None = None,
) -> tuple[Column, Column]:
    """(score in [0, 1], pipe-joined flags).

    Amounts are added in a fixed order so that the cut-offs fall alike in every
    engine.  Term sets may be passed in when they are already at hand.
    """
    q1, a1, q2 = clean_text(q1), clean_text(a1), clean_text(q2)
    if anchor_terms is None:
        anchor_terms = extract_terms(F.concat_ws(" ", q1, a1), lexicon.term_stopwords)
    if q2_terms is None:
        q2_terms = extract_terms(q2, lexicon.term_stopwords)
    overlap = term_overlap(anchor_terms, q2_terms)
    size = F.length(q2)
    short = size <= 20
    strong = contains_any(q2, lexicon.strong_shift)
    soft = ~strong & contains_any(q2, lexicon.soft_shift)
    goes_on = contains_any(q2, lexicon.continuation)
    unseen = (size > 0) & ~F.contains(q1, q2) & ~F.contains(a1, q2)

    steps: list[tuple[Column, float, str | None]] = [
        (strong, 0.85, "strong_pattern"),
        (soft, 0.35, "soft_pattern"),
        ((overlap < 0.05) & short, 0.35, "low_overlap_short_q2"),
        (overlap == 0.0, 0.22, "no_overlap"),
        ((overlap > 0.0) & (overlap < 0.08), 0.12, "tiny_overlap"),
        (
            short & (overlap < 0.12) & ~goes_on & contains_any(q2, lexicon.new_topic),
            0.18,
            "new_topic_short_q2",
        ),
        (goes_on, -0.15, "continuation_marker"),
        (contains_any(q2, lexicon.question), 0.03, "question_form"),
        (size <= 10, 0.05, "short_q2"),
        ((size > 10) & (size <= 16), 0.04, "short_q2"),
        ((size > 16) & short, 0.03, "short_q2"),
        (unseen, 0.03, None),
    ]
    score = F.lit(0.0)
    for condition, amount, _ in steps:
        score = score + F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))
    flags = F.concat_ws("|", *[F.when(c, F.lit(name)) for c, _, name in steps if name])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), flags


def bucket(score: Column, easy: float = EASY_THRESHOLD, boundary: float = BOUNDARY_THRESHOLD) -> Column:
    return (
        F.when(score >= easy, "easy").when(score >= boundary, "boundary").otherwise("keep")
    )


def with_topic_shift(
    edges: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    easy: float = EASY_THRESHOLD,
    boundary: float = BOUNDARY_THRESHOLD,
) -> DataFrame:
    """Add ``topic_shift_score/flags/bucket``; uses carried term sets if present."""
    carried = {"anchor_terms", "Q2_q_terms"} <= set(edges.columns)
    score, flags = topic_shift(
        F.col("Q1"),
        F.col("A1"),
        F.col("Q2"),
        lexicon,
        F.col("anchor_terms") if carried else None,
        F.col("Q2_q_terms") if carried else None,
    )
    out = edges.withColumn("topic_shift_score", score).withColumn("topic_shift_flags", flags)
    out = out.withColumn("topic_shift_bucket", bucket(F.col("topic_shift_score"), easy, boundary))
    return out.drop("anchor_terms", "Q2_q_terms") if carried else out


def auto_label_easy(edges: DataFrame, label_columns: Sequence[str] = ()) -> DataFrame:
    """Finish ``easy`` rows as independent; other rows keep their labels."""
    easy = F.col("topic_shift_bucket") == "easy"
    fixed = {
        "done": F.lit(1),
        "dependent": F.lit("No"),
        "dependency_type": F.lit("No-Dependency"),
        "relation_type": F.lit("Topic Shift"),
        "dep_reason": F.lit(AUTO_REASON),
    }
    return edges.withColumns(
        {name: F.when(easy, value).otherwise(F.col(name)) for name, value in fixed.items()}
    )
