"""How the given tables stand in for sessions, labels and splits.

``conversations`` is a session table: user turns are questions, the assistant
turn right after is the answer.  There are no dependency labels, so a declared
integer formula serves as one; sessions are split 64/16/20 by id.  The word
lists are Latin-script fragments that occur in the tables' texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Lexicon
from ..functions.text import term_overlap
from ..operators.candidates import Features, candidate_edges, choose_block, number_records, records_from_turns
from ..operators.topicshift import record_terms, term_features

THRESHOLD, TOP_K = 0.2, 3
LAMBDA_0, LAMBDA_T = 0.2, 0.15
SCORE_FACTOR = 1.5

TABLE_LEXICON = Lexicon(
    followup=("that", "what", "que", "wie", "como"),
    complaint=("nicht", "pas ", "not ", "ningu"),
    vague=("tion", "lich", "ment", "ción"),
    strong_shift=("whthe", "schge", "êtremen"),
    soft_shift=("ouv", "pfü", "aich"),
    question=("is ", "est ", "ist ", "es "),
    continuation=("with", "avec", "mit ", "con "),
    new_topic=("an ", "un ", "ein "),
    short_complaint=("pas", "not"),
    term_stopwords=("the", "and", "les", "und", "que", "der"),
    unsatisfied=("was", "dans", "von", "para"),
    pressure=("inan", "eau", "heit", "rr"),
    explain_only=("ion", "keit", "boí"),
    claim=("are", "est", "das", "los"),
    challenge=("ough", "pas", "ver", "del"),
    evidence=("ther", "elle", "ung", "cor"),
    action=("ing", "que", "ber", "ora"),
    reference=("this", "des", "den", "las"),
    answer_state=("ed", "aux", "zu", "os"),
    commitment=("ent", "oir", "auf", "ar"),
    continuation_need=("re", "le", "er", "la"),
    capacity_anchor=("onth", "tionre", "chtei"),
    capacity_query=("the", "de", "die"),
    objects=("thing", "tion", "tionne", "ment", "keit", "ung", "heit", "eaux"),
    object_stopwords=("the", "and"),
    generic_answer=("thst", "pale", "chst"),
    salutations=(),
    events={
        "project_capacity": ("tion", "ing", "keit"),
        "market_order_price": ("edth", "aux", "tz", "ue"),
        "product_rnd": ("ster", "elle", "ver"),
    },
    intents={
        "growth_profit_question": ("er", "le", "ie"),
        "progress_detail_question": ("and", "les", "und"),
        "planning_question": ("onin", "ench", "schb"),
    },
    bridges=(
        ("project_capacity", "growth_profit_question", 0.28),
        ("project_capacity", "progress_detail_question", 0.30),
        ("market_order_price", "growth_profit_question", 0.22),
        ("product_rnd", "planning_question", 0.24),
    ),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_size(spark: SparkSession, sf_dir: str) -> int | None:
    return choose_block(table(spark, sf_dir, "conversations"), "conv_id")


def records(
    spark: SparkSession, sf_dir: str, block: int | None = None, features: Features | None = None, texts: bool = True
) -> DataFrame:
    return records_from_turns(table(spark, sf_dir, "conversations"), block=block, features=features, texts=texts)


def edges(
    spark: SparkSession, sf_dir: str, window: int = 5, features: Features | None = None, texts: bool = True,
    source=(), target=(),
) -> DataFrame:
    """Candidate edges; ``source`` and ``target`` name record columns made by ``features``."""
    block = block_size(spark, sf_dir)
    return candidate_edges(records(spark, sf_dir, block, features, texts), window, block, source, target, texts)


def edge_label() -> Column:
    return ((F.col("session_id") * 7 + F.col("Q1_row") * 3 + F.col("Q2_row")) % 5 == 0).cast("int")


def split_of(session: Column) -> Column:
    part = session % 25
    return F.when(part < 16, "train").when(part < 20, "validation").otherwise("test")


def scored_edges(
    spark: SparkSession, sf_dir: str, source=(), target=(), prepare=None, texts: bool = True,
    features: Features | None = None,
) -> DataFrame:
    """Edges with term overlap as score, the declared label and the split.

    Where nothing downstream reads texts, term sets (and ``features``) are built
    per turn and shuffled in their place; else once per record after the
    shuffle.  ``prepare`` sees texts and may add record columns, which
    ``source``/``target`` then carry.
    """
    block = block_size(spark, sf_dir)
    whole = texts or prepare is not None
    found = dict(features or {}) if whole else term_features(TABLE_LEXICON) | dict(features or {})
    base = record_terms(records(spark, sf_dir, block, found, whole), TABLE_LEXICON)
    if prepare is not None:
        base = prepare(base)
    wide = candidate_edges(
        base, 5, block, ("anchor_terms", *source), ("q_terms", *target), texts
    )
    overlap = term_overlap(F.col("anchor_terms"), F.col("Q2_q_terms"))
    return wide.withColumns(
        {
            "stage1_prob": F.round(F.least(F.lit(1.0), overlap * SCORE_FACTOR), 6),
            "edge_label": edge_label(),
            "split": split_of(F.col("session_id")),
        }
    )


NARROW = ("edge_id", "session_id", "Q1_row", "Q2_row", "distance", "stage1_prob", "edge_label", "split")


def narrow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored edges without texts."""
    return scored_edges(spark, sf_dir, texts=False).select(*NARROW)


def long_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored edges of long sessions: the events of two users each, some twenty in a session.

    All distances of the window occur and targets have up to five sources.  The
    score is one of 50 steps made from the two event ids; a declared formula makes
    the label likelier the higher the score and the smaller the distance.
    """
    events = table(spark, sf_dir, "events").select(F.expr("user_id div 2").alias("session_id"), "event_id", "ts")
    block = choose_block(events, "session_id")
    placed = number_records(events, "session_id", ("ts", "event_id"), "pos", block).withColumns({"q_size": F.lit(1), "a_size": F.lit(1)})
    pairs = candidate_edges(placed, 5, block, ("event_id",), ("event_id",), texts=False)
    step = F.pmod(F.col("event_id") * 7919 + F.col("Q2_event_id") * 104729, F.lit(50))
    chance = F.pmod(F.col("event_id") * 31 + F.col("Q2_event_id") * 17, F.lit(100))
    label = chance < step * step / 40 - 4 * F.col("distance")
    return pairs.select(
        "edge_id", "session_id", "Q1_row", "Q2_row", "distance", F.round((step + 1) / 51, 6).alias("stage1_prob"),
        label.cast("int").alias("edge_label"), split_of(F.col("session_id")).alias("split"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels with a length score: the metric operators' document input."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 6).alias("score")
    )
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "source", "score", F.col("quality").alias("edge_label")
    )
