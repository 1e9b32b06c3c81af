"""Edge-local interaction channels: complaint, challenge and business bridge.

The channels are exported next to the learned probability; retention itself
uses the learned probability alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_LEXICON, Lexicon
from ..functions.numeric import clip, to_number
from ..functions.text import (
    clean_text,
    count_found,
    find_terms,
    found_score,
    object_terms,
    question_mark_score,
    shared_objects,
)
from .candidates import Features

NEAR_DISTANCE = 5


def _levels(*steps: tuple[Column, float]) -> Column:
    """Highest level whose condition holds, else 0."""
    return F.greatest(
        F.lit(0.0), *[F.when(cond, F.lit(level)).otherwise(F.lit(0.0)) for cond, level in steps]
    )


# Columns the channels read; texts are scanned for terms once, not per list.
RECORD_COLUMNS = ("q_found", "a_found", "q_objects", "a_objects", "q_marks", "a_digits", "a_size")
_SOURCE = ("q_found", "a_found", "q_objects", "a_objects", "a_digits", "a_size")
_TARGET = ("Q2_q_found", "Q2_q_objects", "Q2_q_marks")


def turn_features(lexicon: Lexicon = DEFAULT_LEXICON) -> Features:
    """What the channels read of a turn, for ``records_from_turns``."""
    vocabulary = lexicon.channel_vocabulary()
    return {
        "found": lambda text: find_terms(text, vocabulary),
        "objects": lambda text: object_terms(text, lexicon),
        "marks": question_mark_score,
        "digits": lambda text: text.rlike(r"(?U)\d").cast("double"),
        "size": F.length,
    }


def _text_columns(q: Column, a: Column, lexicon: Lexicon) -> dict[str, Column]:
    features = turn_features(lexicon)
    return {name: features[name[2:]](q if name.startswith("q_") else a) for name in RECORD_COLUMNS}


def record_features(records: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Scan each record's texts once, before it fans out into edges.

    Carry ``SOURCE_FEATURES`` and ``TARGET_FEATURES`` through
    ``candidate_edges``; the channels then touch no text at all.
    """
    return records.withColumns(_text_columns(F.col("Q"), F.col("A"), lexicon))


SOURCE_FEATURES = _SOURCE
TARGET_FEATURES = ("q_found", "q_objects", "q_marks")


def edge_features(edges: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """The same columns computed from edge texts (when no record table is at hand)."""
    if {*_SOURCE, *_TARGET} <= set(edges.columns):
        return edges
    cleaned = edges.withColumns({f"_{c}": clean_text(F.col(c)) for c in ("Q1", "A1", "Q2")})
    out = cleaned.withColumns(_text_columns(F.col("_Q1"), F.col("_A1"), lexicon))
    target = _text_columns(F.col("_Q2"), F.lit(""), lexicon)
    out = out.withColumns({f"Q2_{c}": target[c] for c in TARGET_FEATURES})
    return out.drop("_Q1", "_A1", "_Q2", "q_marks")


def with_interaction_scores(edges: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Dissatisfaction, pressure, claim, challenge, explanation and evidence."""
    out = edge_features(edges, lexicon)
    a1, q2 = F.col("a_found"), F.col("Q2_q_found")
    marks, size = F.col("Q2_q_marks"), F.col("a_size")
    out = out.withColumns(
        {
            "_unsat": found_score(a1, lexicon.unsatisfied, 2.0),
            "_size": size,
            "q2_pressure_score": F.greatest(found_score(q2, lexicon.pressure, 2.0), marks * 0.25),
            "a1_claim_score": found_score(a1, lexicon.claim, 2.0),
            "q2_challenge_score": F.greatest(found_score(q2, lexicon.challenge, 2.0), marks * 0.35),
            "q2_explain_only_score": found_score(q2, lexicon.explain_only, 2.0),
            "evidence_score": F.greatest(
                found_score(q2, lexicon.evidence, 2.0), found_score(a1, lexicon.evidence, 3.0)
            ),
        }
    )
    raw = F.col("_unsat")
    lifted = (
        F.when(raw <= 0, raw)
        .when(F.col("_size") <= 18, F.greatest(raw, F.lit(0.75)))
        .when(F.col("_size") <= 35, F.greatest(raw, F.lit(0.60)))
        .otherwise(raw)
    )
    return out.withColumn("answer_unsatisfied_score", lifted).drop("_unsat", "_size")


def complaint_level(semantic: Column, distance: Column) -> Column:
    near = distance <= NEAR_DISTANCE
    unsat, pressure = F.col("answer_unsatisfied_score"), F.col("q2_pressure_score")
    explain = F.col("q2_explain_only_score")
    bare = clip(pressure - 0.70 * explain, 0.0, 1.0)
    return _levels(
        ((unsat >= 0.45) & (pressure >= 0.75) & near, 0.58),
        ((unsat >= 0.58) & (pressure >= 0.55) & near, 0.80),
        ((bare >= 0.92) & (semantic >= 0.01) & near, 0.56),
        ((bare >= 0.95) & (distance <= 2), 0.55),
        ((explain >= 0.65) & (unsat >= 0.45) & near, 0.53),
    )


def challenge_level(semantic: Column, distance: Column) -> Column:
    near = distance <= NEAR_DISTANCE
    challenge, claim = F.col("q2_challenge_score"), F.col("a1_claim_score")
    evidence = F.col("evidence_score")
    return _levels(
        ((challenge >= 0.45) & (semantic >= 0.06) & near, 0.58),
        ((evidence >= 0.55) & (challenge >= 0.35) & (semantic >= 0.02) & near, 0.70),
        (
            (challenge >= 0.55)
            & ((claim >= 0.35) | (evidence >= 0.35))
            & (semantic >= 0.02)
            & near,
            0.78,
        ),
    )


def with_bridge_scores(
    edges: DataFrame,
    semantic: str,
    lexicon: Lexicon = DEFAULT_LEXICON,
    scale: float = 1.0,
    min_semantic: float = 0.0,
) -> DataFrame:
    """Structured bridge between an answered business event and a later intent."""
    # No term holds white space, so the anchor's terms are those of its two texts.
    out = edge_features(edges, lexicon).withColumns(
        {
            "_anchor": F.array_union("q_found", "a_found"),
            "_anchor_objects": F.array_union("q_objects", "a_objects"),
        }
    )
    anchor, a1, q2 = F.col("_anchor"), F.col("a_found"), F.col("Q2_q_found")
    out = out.withColumns(
        {f"a1_event_{g}": found_score(anchor, t, 2.0) for g, t in lexicon.events.items()}
    ).withColumns({f"q2_intent_{g}": found_score(q2, t, 2.0) for g, t in lexicon.intents.items()})

    shared, shared_names = shared_objects(F.col("_anchor_objects"), F.col("Q2_q_objects"))
    a1_shared, a1_names = shared_objects(F.col("a_objects"), F.col("Q2_q_objects"))
    grows = (count_found(anchor, lexicon.capacity_anchor) > 0) & (
        count_found(q2, lexicon.capacity_query) > 0
    )
    out = out.withColumns(
        {
            "structured_followup_action_score": found_score(q2, lexicon.action, 2.0),
            "structured_reference_score": found_score(q2, lexicon.reference, 1.0),
            "structured_shared_object_score": shared,
            "structured_a1_shared_object_score": a1_shared,
            "structured_capacity_growth_signal": grows.cast("double"),
            "structured_answer_state_score": found_score(a1, lexicon.answer_state, 2.0),
            "structured_answer_commitment_score": found_score(a1, lexicon.commitment, 2.0),
            "structured_answer_numeric_score": F.col("a_digits"),
            "structured_q2_continuation_need_score": found_score(q2, lexicon.continuation_need, 2.0),
            "structured_shared_terms": shared_names,
            "structured_a1_shared_terms": a1_names,
        }
    ).drop("_anchor", "_anchor_objects")

    distance = to_number(F.col("distance"), 99.0)
    sem = F.col(semantic)
    open_rule = (distance <= NEAR_DISTANCE) & (sem >= min_semantic)
    rule = _levels(
        *[
            ((F.col(f"a1_event_{e}") >= 0.5) & (F.col(f"q2_intent_{i}") >= 0.5) & open_rule, w)
            for e, i, w in lexicon.bridges
        ]
    )
    out = out.withColumn("structured_bridge_rule_score", rule)

    rule = F.col("structured_bridge_rule_score")
    action, ref = F.col("structured_followup_action_score"), F.col("structured_reference_score")
    shared = F.col("structured_shared_object_score")
    a1_shared = F.col("structured_a1_shared_object_score")
    asks_on = (action >= 0.45) | (ref >= 0.50)
    concrete = [
        # same object with a matching business rule
        (shared >= 0.50) & (rule > 0) & ((a1_shared >= 0.24) | (ref >= 0.50) | (sem >= 0.03)),
        # strong rule, weak object, close by
        (rule >= 0.30) & ((shared >= 0.12) | (a1_shared >= 0.12)) & asks_on & (distance <= 3),
        # medium rule, object named in the answer, closer still
        (rule >= 0.24) & (a1_shared >= 0.12) & asks_on & (distance <= 2),
        # explicit reference to a shared object
        (ref >= 0.50) & ((shared >= 0.24) | (a1_shared >= 0.12)),
        # capacity build-up followed by a growth question in the next turn
        (F.col(f"a1_event_{lexicon.growth_event}") >= 0.5)
        & (F.col(f"q2_intent_{lexicon.growth_intent}") >= 0.5)
        & (F.col("structured_capacity_growth_signal") >= 1.0)
        & (action >= 0.45)
        & (distance <= 1),
    ]
    eligible = (rule > 0) & reduce(lambda x, y: x | y, concrete) & asks_on
    strength = F.greatest(rule + 0.05 * shared + 0.03 * action + 0.02 * ref, sem)
    return out.withColumn("structured_bridge_eligible", eligible.cast("double")).withColumn(
        "stage1_structured_prob",
        clip(
            F.when(F.col("structured_bridge_eligible") == 1.0, strength).otherwise(F.lit(0.0))
            * float(scale),
            0.0,
            0.45,
        ),
    )


def interaction_channels(
    edges: DataFrame,
    semantic: str = "stage1_semantic_prob",
    lexicon: Lexicon = DEFAULT_LEXICON,
    bridge_scale: float = 1.0,
    min_semantic: float = 0.0,
) -> DataFrame:
    """All channels plus ``stage1_prob``, the clipped learned probability."""
    out = with_interaction_scores(edges, lexicon)
    distance = to_number(F.col("distance"), 99.0)
    sem = F.col(semantic)
    out = out.withColumns(
        {
            "stage1_complaint_prob": complaint_level(sem, distance),
            "stage1_challenge_prob": challenge_level(sem, distance),
        }
    )
    out = with_bridge_scores(out, semantic, lexicon, bridge_scale, min_semantic)

    state = F.greatest("structured_answer_state_score", "structured_answer_commitment_score")
    answered = (
        (F.col("structured_bridge_rule_score") > 0)
        & (F.col("structured_q2_continuation_need_score") >= 0.35)
        & (state >= 0.35)
        & (
            (F.col("structured_a1_shared_object_score") >= 0.12)
            | (F.col("structured_shared_object_score") >= 0.24)
            | (F.col("structured_reference_score") >= 0.50)
        )
        & (distance <= NEAR_DISTANCE)
    )
    growth = (
        (F.col("structured_capacity_growth_signal") >= 1.0)
        & (F.col(f"q2_intent_{lexicon.growth_intent}") >= 0.50)
        & (state >= 0.35)
        & (distance <= 1)
    )
    backed = (
        (sem >= 0.005)
        | (F.col("stage1_complaint_prob") >= 0.12)
        | (F.col("stage1_challenge_prob") >= 0.12)
    )
    alone = (F.col("stage1_structured_prob") >= 0.12) & ~backed
    out = out.withColumns(
        {
            "structured_answer_state_guard": answered.cast("double"),
            "structured_capacity_growth_guard": growth.cast("double"),
            "structured_standalone_guard": (answered | growth).cast("double"),
            "structured_standalone_blocked": (alone & ~(answered | growth)).cast("double"),
        }
    )
    return out.drop(*_SOURCE, *_TARGET).withColumns(
        {
            "stage1_structured_prob": F.when(
                F.col("structured_standalone_blocked") == 1.0, F.lit(0.0)
            ).otherwise(F.col("stage1_structured_prob")),
            "stage1_semantic_prob": sem,
            "stage1_prob": clip(to_number(sem, 0.0), 0.0, 1.0),
        }
    )
