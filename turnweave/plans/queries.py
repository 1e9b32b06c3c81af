"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from ..functions.numeric import inverse_distance
from ..operators import (
    blocks,
    bm25,
    bootstrap,
    bootstrap_vectors,
    candidates,
    channels,
    contracts,
    diagnostics,
    errors,
    evidence,
    graph,
    irls,
    labeling,
    metrics,
    pairs,
    recovery,
    retention,
    rules,
    scorers,
    sensitivity,
    sessionize,
    splits,
    topicshift,
)
from ..session import materialize, shared_folder
from ..sources.models import load_model, save_model
from ..sources.writers import prediction_audit
from ..streaming import candidates as stream_candidates
from ..streaming import label_store
from ..streaming import sessionize as stream_sessions
from ..streaming.replay import replay
from . import run
from .tables import (
    LAMBDA_0,
    LAMBDA_T,
    NARROW,
    TABLE_LEXICON as LEX,
    THRESHOLD,
    TOP_K,
    block_size,
    edges,
    labelled_documents,
    long_edges,
    narrow_edges,
    records,
    scored_edges,
    split_of,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
GRID_0 = recovery.LAMBDA0_GRID
GRID_T = recovery.LAMBDAT_GRID
DRAWS = bootstrap.DRAWS


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def both_sources(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register a query on the dialogues' edges, and as ``long_..`` on those of long sessions."""
    REGISTRY[fn.__name__] = fn
    long = lambda spark, d: fn(spark, d, long_edges)
    long.__doc__ = fn.__doc__
    REGISTRY[f"long_{fn.__name__}"] = long
    return fn


def r6(value: Column | str, name: str) -> Column:
    """Rounded output column: sums run in different orders in two engines."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, 6).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c, c) if c in names else F.col(c) for c in df.columns])


# -- records and candidates -------------------------------------------------

@query
def records_qa(spark, d):
    out = records(spark, d, block_size(spark, d))
    return out.select("session_id", "pos", "turn", "Q", "A")


@query
def candidate_edges_w5(spark, d):
    return edges(spark, d, 5)


@query
def candidate_edges_w3(spark, d):
    return edges(spark, d, 3, texts=False).select("edge_id", "session_id", "Q1_row", "Q2_row", "distance")


@query
def candidate_edges_w1(spark, d):
    return edges(spark, d, 1, texts=False).select("edge_id", "session_id", "Q1_row", "Q2_row", "distance")


@query
def candidate_edges_blocks(spark, d):
    """The block layout (for sessions too large for a task), with tiny blocks."""
    small = records(spark, d, 3)
    return candidates.candidate_edges(small, 2, 2).select("edge_id", "Q1_row", "Q2_row", "Q1", "A1", "Q2")


@query
def candidate_distance_hist(spark, d):
    return edges(spark, d, texts=False).groupBy("distance").agg(F.count(F.lit(1)).alias("edges"))


@query
def min_q2_length_filter(spark, d):
    sized = edges(spark, d, texts=False, target=["q_size"])
    return candidates.min_target_length(sized, 120, F.col("Q2_q_size")).select("edge_id", F.col("Q2_q_size").alias("q2_len"))


@query
def text_features(spark, d):
    sized = edges(spark, d, texts=False, source=["q_size", "a_size"], target=["q_size"])
    lengths = {"q1_len": "q_size", "a1_len": "a_size", "q2_len": "Q2_q_size"}
    return splits.add_text_features(sized, lengths).select("edge_id", *lengths, "distance_num")


@query
def clean_documents(spark, d):
    clean = tx.clean_text(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.length(clean).alias("clean_chars"), F.md5(clean).alias("clean_md5")
    )


# -- lexical scalars --------------------------------------------------------

@query
def cue_flags(spark, d):
    cues = {
        name: lambda text, terms=terms: tx.contains_any(text, terms).cast("int")
        for name, terms in (
            ("followup", LEX.followup), ("complaint", LEX.complaint), ("vague", LEX.vague), ("question", LEX.question)
        )
    }
    asked = ["q_followup", "q_complaint", "q_question"]
    wide = edges(spark, d, features=cues, texts=False, source=["a_vague"], target=asked)
    return wide.select(
        "edge_id", F.col("a_vague").alias("vague"), *[F.col(f"Q2_{c}").alias(c[2:]) for c in asked]
    )


@query
def char_jaccard(spark, d):
    sets = candidates.CHARS | errors.SEEN
    wide = edges(spark, d, features=sets, texts=False, source=["q_chars", "a_seen"], target=["q_chars", "q_seen"])
    return wide.select(
        "edge_id",
        r6(tx.set_jaccard(F.col("q_chars"), F.col("Q2_q_chars")), "word_chars"),
        r6(tx.set_jaccard(F.col("a_seen"), F.col("Q2_q_seen")), "visible_chars"),
    )


@query
def term_overlap(spark, d):
    return scored_edges(spark, d, texts=False).select(
        "edge_id",
        F.size("anchor_terms").alias("anchor_terms"),
        F.size("Q2_q_terms").alias("q2_terms"),
        r6(tx.term_overlap(F.col("anchor_terms"), F.col("Q2_q_terms")), "overlap"),
    )


def _char_edges(spark, d):
    block = block_size(spark, d)
    base = candidates.record_chars(records(spark, d, block))
    return candidates.candidate_edges(base, 5, block, candidates.CHAR_SOURCE, candidates.CHAR_TARGET)


def _heuristic(spark, d):
    score = candidates.heuristic_score(
        F.col("Q1"), F.col("A1"), F.col("Q2"), F.col("distance"), LEX, candidates.carried_overlap()
    )
    return _char_edges(spark, d).withColumn("prompt_test_score", F.round(score, 6))


@query
def heuristic_score(spark, d):
    return _heuristic(spark, d).select("edge_id", "prompt_test_score")


@query
def heuristic_topn(spark, d):
    """The top-n report that seeds a prompt test (n is the feature)."""
    best = [F.desc("prompt_test_score"), "session_id", "Q1_row", "Q2_row"]
    return _heuristic(spark, d).orderBy(*best).limit(50).select("edge_id", "prompt_test_score")


@query
def sample_candidates(spark, d):
    """Mixed sample of 60: half by score, half by hash order."""
    return candidates.sample_candidates(_char_edges(spark, d), 60, 42, LEX).select("edge_id")


@query
def question_marks(spark, d):
    docs = table(spark, d, "documents").withColumn("t", tx.clean_text(F.col("text")))
    return docs.select("doc_id", r6(tx.question_mark_score(F.col("t")), "marks"))


@query
def term_scores(spark, d):
    docs = table(spark, d, "documents").withColumn("t", tx.clean_text(F.col("text")))
    return docs.select(
        "doc_id",
        r6(tx.term_score(F.col("t"), LEX.pressure, 3.0), "pressure"),
        r6(tx.group_score(F.col("t"), LEX.objects), "objects"),
    )


@query
def bm25_tokens(spark, d):
    docs = table(spark, d, "documents").withColumn("t", tx.clean_text(F.col("text")))
    docs = docs.withColumn("k", tx.bm25_tokens(F.col("t")))
    return docs.select("doc_id", F.size("k").alias("tokens"), F.size(F.array_distinct("k")).alias("vocabulary"))


@query
def run_tokens(spark, d):
    docs = table(spark, d, "documents").withColumn("t", tx.clean_text(F.col("text")))
    docs = docs.withColumn("k", tx.run_tokens(F.col("t")))
    return docs.select("doc_id", F.size("k").alias("tokens"), F.md5(F.array_join("k", " ")).alias("joined"))


@query
def slugs(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy(tx.slugify(F.concat_ws(" / ", "source", "lang")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query
def text_hashes(spark, d):
    """Content hash per text: the key of encoder caches."""
    texts = edges(spark, d)
    anchor = tx.anchor_text(F.col("Q1"), F.col("A1"))
    return texts.select("edge_id", F.sha2(anchor, 256).alias("anchor_sha"), F.sha2(tx.candidate_text(F.col("Q2")), 256).alias("candidate_sha"))


# -- topic shift ------------------------------------------------------------

def _shifted(spark, d):
    block = block_size(spark, d)
    base = topicshift.record_terms(records(spark, d, block), LEX)
    wide = candidates.candidate_edges(base, 5, block, source=["anchor_terms"], target=["q_terms"])
    return topicshift.with_topic_shift(wide, LEX)


@query
def topic_shift_score(spark, d):
    return _shifted(spark, d).select(
        "edge_id", r6("topic_shift_score", "topic_shift_score"), "topic_shift_flags", "topic_shift_bucket"
    )


@query
def topic_shift_buckets(spark, d):
    return _shifted(spark, d).groupBy("topic_shift_bucket").agg(F.count(F.lit(1)).alias("edges"))


@query
def topic_shift_autolabel(spark, d):
    out = topicshift.auto_label_easy(labeling.initialize_labels(_shifted(spark, d)))
    return out.select("edge_id", "done", "dependent", "dependency_type", "relation_type", "dep_reason")


# -- interaction channels ---------------------------------------------------

def _featured(spark, d):
    return scored_edges(
        spark, d,
        source=channels.SOURCE_FEATURES,
        target=channels.TARGET_FEATURES,
        texts=False,
        features=channels.turn_features(LEX),
    ).withColumn("stage1_semantic_prob", F.col("stage1_prob"))


INTERACTION = (
    "answer_unsatisfied_score", "q2_pressure_score", "a1_claim_score", "q2_challenge_score",
    "q2_explain_only_score", "evidence_score",
)


@query
def interaction_scores(spark, d):
    out = channels.with_interaction_scores(_featured(spark, d), LEX)
    return out.select("edge_id", *[r6(c, c) for c in INTERACTION])


@query
def complaint_challenge_levels(spark, d):
    out = channels.with_interaction_scores(_featured(spark, d), LEX)
    sem, dist = F.col("stage1_semantic_prob"), F.col("distance").cast("double")
    return out.select(
        "edge_id",
        r6(channels.complaint_level(sem, dist), "complaint"),
        r6(channels.challenge_level(sem, dist), "challenge"),
    )


@query
def event_intent_groups(spark, d):
    out = channels.with_bridge_scores(_featured(spark, d), "stage1_semantic_prob", LEX)
    names = [f"a1_event_{g}" for g in LEX.events] + [f"q2_intent_{g}" for g in LEX.intents]
    return out.select("edge_id", *[r6(c, c) for c in names])


@query
def shared_objects(spark, d):
    out = channels.with_bridge_scores(_featured(spark, d), "stage1_semantic_prob", LEX)
    return out.select(
        "edge_id",
        r6("structured_shared_object_score", "shared"),
        r6("structured_a1_shared_object_score", "a1_shared"),
        "structured_shared_terms",
        "structured_a1_shared_terms",
    )


@query
def bridge_rules(spark, d):
    out = channels.with_bridge_scores(_featured(spark, d), "stage1_semantic_prob", LEX)
    return out.select(
        "edge_id",
        r6("structured_bridge_rule_score", "rule"),
        r6("structured_followup_action_score", "action"),
        r6("structured_reference_score", "reference"),
        r6("structured_capacity_growth_signal", "capacity"),
        "structured_bridge_eligible",
        r6("stage1_structured_prob", "bridge"),
    )


@query
def interaction_channels(spark, d):
    out = channels.interaction_channels(_featured(spark, d), "stage1_semantic_prob", LEX, bridge_scale=1.0)
    return out.select(
        "edge_id",
        *[r6(f"stage1_{c}_prob", c) for c in ("complaint", "challenge", "structured")],
        "structured_answer_state_guard",
        "structured_capacity_growth_guard",
        "structured_standalone_blocked",
        "stage1_prob",
    )


# -- retention --------------------------------------------------------------

@query
def source_rank(spark, d):
    return metrics.with_source_rank(narrow_edges(spark, d), "stage1_prob").select("edge_id", "source_rank")


@query
def source_topk_mask(spark, d):
    ranked = metrics.with_source_rank(narrow_edges(spark, d), "stage1_prob")
    return ranked.where(F.col("source_rank") <= 2).select("edge_id", "source_rank")


def _retained(spark, d, source=narrow_edges):
    return retention.retain(source(spark, d), THRESHOLD, TOP_K)


@query
def retain_policy(spark, d):
    return _retained(spark, d).select("edge_id", "stage1_pred_edge")


@both_sources
def retention_recheck(spark, d, source=narrow_edges):
    return retention.retention_mismatches(_retained(spark, d, source), THRESHOLD, TOP_K)


@both_sources
def target_candidate_max(spark, d, source=narrow_edges):
    return retention.max_candidates_per_target(_retained(spark, d, source))


def _validation(spark, d, source=narrow_edges):
    """The validation split as a written table: searches read it several times."""
    return materialize(source(spark, d).where(F.col("split") == "validation"))


def _search(spark, d, source=narrow_edges):
    return retention.retention_search(_validation(spark, d, source))


RETENTION_RATES = ("Threshold", "TargetRecall", "MaxRecallAtK", "Recall", "Precision", "F1", "RetentionRatio")


@both_sources
def retention_search(spark, d, source=narrow_edges):
    return rounded(_search(spark, d, source), *RETENTION_RATES)


@both_sources
def retention_best(spark, d, source=narrow_edges):
    return rounded(retention.best_retention(_search(spark, d, source)), *RETENTION_RATES)


# -- evidence and recovery --------------------------------------------------

def _evidenced(spark, d, source=narrow_edges):
    """Raw evidence, rounded so that ties are ties in every engine."""
    out = evidence.raw_evidence(_retained(spark, d, source))
    return out.withColumn("stage2a_local_evidence", F.round("stage2a_local_evidence", 6))


@query
def evidence_columns(spark, d):
    return _evidenced(spark, d).select(
        "edge_id", "stage2_graph_input_pred", r6("stage2a_local_prob", "local_prob"),
        "stage2a_local_evidence", r6("stage2_score", "stage2_score"),
    )


@both_sources
def evidence_ranking(spark, d, source=narrow_edges):
    return rounded(evidence.evidence_ranking(_evidenced(spark, d, source), ["split"]), "auc", "ap")


def _recovered(spark, d, source=narrow_edges):
    return recovery.recover(_evidenced(spark, d, source), LAMBDA_0, LAMBDA_T)


@both_sources
def recovery_graph(spark, d, source=narrow_edges):
    out = _recovered(spark, d, source)
    return out.select(
        "edge_id",
        "stage2b_target_rank",
        r6("stage2b_incremental_gain", "gain"),
        r6("stage2b_target_objective", "objective"),
        "stage2_graph_target_degree",
        "stage2_pruned_by_graph",
        "final_graph_pred_edge",
        r6("final_graph_score", "final_graph_score"),
    )


@query
def recovery_totals(spark, d):
    return rounded(recovery.recovery_totals(_recovered(spark, d), LAMBDA_0, LAMBDA_T), "objective_total")


@both_sources
def exactness_audit(spark, d, source=narrow_edges):
    final = materialize(_recovered(spark, d, source))
    return rounded(recovery.exactness_audit(final, LAMBDA_0, LAMBDA_T), "max_objective_gap")


GRID_RATES = ("lambda_0", "lambda_t", "AUC", "AP", "Precision", "Recall", "F1", "ObjectiveTotal")


def _grid(spark, d, source=narrow_edges, ranking=False):
    validation = materialize(_evidenced(spark, d, source).where(F.col("split") == "validation"))
    return recovery.penalty_grid(validation, GRID_0, GRID_T, ranking=ranking)


@both_sources
def penalty_grid(spark, d, source=narrow_edges):
    return rounded(_grid(spark, d, source, ranking=True), *GRID_RATES)


@query
def penalty_grid_ranking(spark, d):
    """AUC and AP of the final score for every setting of a coarse grid."""
    validation = materialize(_evidenced(spark, d).where(F.col("split") == "validation"))
    out = recovery.penalty_grid(validation, (0.0, 0.2, 0.4), (0.0, 0.15))
    return rounded(out, *GRID_RATES)


@both_sources
def penalty_best(spark, d, source=narrow_edges):
    return rounded(recovery.best_penalties(_grid(spark, d, source)), *GRID_RATES)


@both_sources
def penalty_ties(spark, d, source=narrow_edges):
    return rounded(recovery.tied_best(materialize(_grid(spark, d, source))), *GRID_RATES)


@both_sources
def penalty_ablation(spark, d, source=narrow_edges):
    return rounded(run.penalty_ablation(materialize(_evidenced(spark, d, source))), *GRID_RATES)


# -- metrics ----------------------------------------------------------------

@query
def confusion_by_split(spark, d):
    out = metrics.confusion(_recovered(spark, d), "edge_label", "final_graph_pred_edge", ["split"])
    return rounded(out, "precision", "recall", "f1", "accuracy")


@both_sources
def split_metrics(spark, d, source=narrow_edges):
    return rounded(run.split_summary(_recovered(spark, d, source)), "precision", "recall", "f1", "accuracy", "auc", "ap")


@query
def ranking_documents(spark, d):
    return rounded(metrics.ranking_metrics(labelled_documents(spark, d)), "auc", "ap")


@query
def ranking_by_source(spark, d):
    return rounded(metrics.ranking_metrics(labelled_documents(spark, d), by=["source"]), "auc", "ap")


@query
def threshold_sweep(spark, d):
    return rounded(metrics.threshold_sweep(labelled_documents(spark, d)), "precision", "recall", "f1")


@query
def best_f1_threshold(spark, d):
    return rounded(metrics.best_f1_threshold(labelled_documents(spark, d)), "precision", "recall", "f1")


@both_sources
def topk_threshold_search(spark, d, source=narrow_edges):
    validation = _validation(spark, d, source)
    out = metrics.topk_threshold_search(validation, (1, 2, 3, 5), score="stage1_prob")
    return rounded(out, "precision", "recall", "f1")


@both_sources
def topk_best(spark, d, source=narrow_edges):
    validation = _validation(spark, d, source)
    out = metrics.best_topk(metrics.topk_threshold_search(validation, (1, 2, 3, 5), score="stage1_prob"))
    return rounded(out, "precision", "recall", "f1")


# -- baselines --------------------------------------------------------------

def _token_edges(spark, d):
    def tokens(r: DataFrame) -> DataFrame:
        anchor = tx.clean_text(tx.anchor_text(F.col("Q"), F.col("A")))
        return r.withColumns(
            {
                "anchor_text": anchor,
                "doc_tokens": tx.bm25_tokens(anchor),
                "query_tokens": tx.bm25_tokens(tx.clean_text(tx.candidate_text(F.col("Q")))),
            }
        )

    out = scored_edges(spark, d, ("anchor_text", "doc_tokens"), ("query_tokens",), tokens, texts=False)
    return out.withColumnRenamed("Q2_query_tokens", "query_tokens")


def _train_anchors(token_edges: DataFrame) -> DataFrame:
    """One row per train source: its edges repeat the same text."""
    train = token_edges.where(F.col("split") == "train")
    return train.select("session_id", "Q1_row", "anchor_text").dropDuplicates(["session_id", "Q1_row"])


@query
def bm25_corpus(spark, d):
    terms = bm25.corpus_terms(_train_anchors(_token_edges(spark, d)))
    return terms.select("token", "df", "n_docs", r6("avgdl", "avgdl"), r6("idf", "idf"))


def _bag_records(spark, d):
    """Records with token bags, written once: corpus statistics and scores both read them."""
    block = block_size(spark, d)
    base = records(spark, d, block)
    anchor = tx.clean_text(tx.anchor_text(F.col("Q"), F.col("A")))
    asks = F.length("Q") > 0
    return materialize(candidates.with_followed(base.select(
        "session_id", "pos", asks.alias("asks"), (asks & (F.length("A") > 0)).alias("opens"), split_of(F.col("session_id")).alias("split"),
        anchor.alias("anchor_text"), tx.bm25_tokens(anchor).alias("doc_tokens"),
        tx.bm25_tokens(tx.clean_text(tx.candidate_text(F.col("Q")))).alias("query_tokens"),
    ), 5, block))


def _bm25_edges(spark, d):
    bags = _bag_records(spark, d)
    corpus = bm25.fit(bags.where("split = 'train' and opens and followed"))
    return rounded(bm25.score_records(bags, corpus), "bm25_score")


@query
def bm25_scores(spark, d):
    wide = _token_edges(spark, d)
    corpus = bm25.fit(_train_anchors(wide))
    return rounded(bm25.score_edges(wide, corpus), "bm25_score")


@query
def bm25_sparse(spark, d):
    """The same scores as products of sparse vectors of records."""
    return _bm25_edges(spark, d).select(blocks.edge_id(), "bm25_score")


@query
def distance_prior(spark, d):
    return narrow_edges(spark, d).select("edge_id", r6(inverse_distance(F.col("distance")), "distance_prior"))


def _model_scores(spark, d):
    wide = _token_edges(spark, d)
    scores = rounded(bm25.score_edges(wide, bm25.fit(_train_anchors(wide))), "bm25_score")
    base = wide.select(*NARROW).withColumn("distance_prior", F.round(inverse_distance(F.col("distance")), 6))
    return base.join(scores, "edge_id")


MODELS = {"BM25": "bm25_score", "Temporal-distance Prior": "distance_prior", "Term Overlap": "stage1_prob"}


@query
def model_comparison(spark, d):
    out = run.compare_models(_model_scores(spark, d), MODELS)
    return rounded(out, "precision", "recall", "f1", "accuracy", "auc", "ap", "Threshold")


@query
def prediction_audit_table(spark, d):
    scored = _model_scores(spark, d).where(F.col("split") == "test")
    long = scored.select(
        "edge_id", "edge_label",
        F.inline(F.array(*[F.struct(F.lit(n).alias("Model"), F.col(c).alias("score")) for n, c in MODELS.items()])),
    ).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return prediction_audit(long, list(MODELS))


# -- vectors and graph ------------------------------------------------------

def _vector_edges(spark, d):
    """Embeddings as positions of their label's session, paired with window 5."""
    vectors = table(spark, d, "embeddings").select(
        F.col("label").cast("long").alias("session_id"), "vec_id", "embedding"
    )
    block = candidates.choose_block(vectors, "session_id")
    placed = candidates.number_records(vectors, "session_id", ("vec_id",), "pos", block)
    ready = placed.withColumns({"Q": F.col("vec_id").cast("string"), "A": F.col("vec_id").cast("string")})
    return candidates.candidate_edges(ready, 5, block, source=["embedding"], target=["embedding"])


def _vector_records(spark, d):
    """The same records with their vector, for work on runs of records."""
    vectors = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("session_id"), "vec_id", "embedding")
    block = candidates.choose_block(vectors, "session_id")
    placed = candidates.number_records(vectors, "session_id", ("vec_id",), "pos", block)
    size = F.array(F.length(F.col("vec_id").cast("string")).cast("double"))
    return placed.withColumns({"opens": F.lit(True), "asks": F.lit(True), "size": size})


@query
def cosine_pairs(spark, d):
    return blocks.cosine_edges(_vector_records(spark, d), "embedding", "embedding").select(blocks.edge_id(), r6("cosine", "cosine"))


@query
def edge_vector_features(spark, d):
    def digest(x):
        return {"width": np.full(len(x), x.shape[1], np.int32), "total": x.sum(axis=1, dtype=np.float64), "cosine": x[:, 0].astype(np.float64)}

    out = blocks.feature_edges(
        _vector_records(spark, d), "embedding", "embedding", (["size", "size"], ["size"]), digest, "width int, total double, cosine double"
    )
    return out.select(blocks.edge_id(), "width", F.round("total", 3).alias("total"), F.round("cosine", 4).alias("cosine"))


def _sum(column: str) -> Column:
    return F.round(F.aggregate(column, F.lit(0.0), lambda acc, v: acc + v), 4)


@query
def node_mean_agg(spark, d):
    out = blocks.mean_nodes(_vector_records(spark, d), "embedding", "embedding")
    return out.select(*graph.NODE, _sum("neigh").alias("neigh_sum"), F.round(F.element_at("neigh", 1), 5).alias("neigh_1"))


@query
def node_in_out_agg(spark, d):
    out = blocks.in_out_nodes(_vector_records(spark, d), "embedding", "embedding")
    return out.select(*graph.NODE, _sum("incoming").alias("in_sum"), _sum("outgoing").alias("out_sum"))


@query
def node_texts(spark, d):
    return graph.node_texts(edges(spark, d)).select(*graph.NODE, F.md5("text").alias("text_md5"))


@query
def edge_states(spark, d):
    def digest(x):
        return {"width": np.full(len(x), x.shape[1], np.int32), "total": x.sum(axis=1)}

    out = blocks.state_edges(_vector_records(spark, d), "embedding", "embedding", digest, "width int, total double")
    return out.select(blocks.edge_id(), "width", F.round("total", 4).alias("total"))


#: dimensions of the network that the graph queries run; its weights follow from a declared formula
GRAPH_IN, GRAPH_HIDDEN, GRAPH_LAYERS = 6, 4, 2


def graph_weight(layer: int, i: int, j: int) -> float:
    return ((i * 7 + j * 13 + layer * 5) % 11 - 5) / 8.0


def _graph_model(directed: bool):
    """Layers and edge head; the head's hidden layer counts as the layer after the last."""

    def layer(number: int, width: int) -> blocks.Layer:
        weight = np.array([[graph_weight(number, i, j) for j in range(width)] for i in range(GRAPH_HIDDEN)])
        each = np.arange(GRAPH_HIDDEN)
        return blocks.Layer(weight, np.array([graph_weight(number, i, 99) for i in each]), 1 + each % 3 / 4, (each % 5 - 2) / 8)

    widths = [GRAPH_IN, *[GRAPH_HIDDEN] * (GRAPH_LAYERS - 1)]
    layers = [layer(n, w * (3 if directed else 2)) for n, w in enumerate(widths)]
    hidden = layer(GRAPH_LAYERS, 4 * GRAPH_HIDDEN)
    return layers, blocks.EdgeHead(hidden, np.array([graph_weight(9, i, 0) for i in range(GRAPH_HIDDEN)]), 0.25)


def _graph_scores(spark, d, directed):
    rows = _vector_records(spark, d).withColumn("x", F.slice("embedding", 1, GRAPH_IN))
    out = blocks.graph_scores(rows, "x", "x", *_graph_model(directed), directed=directed)
    return out.select(blocks.edge_id(), r6("margin", "margin"))


@query
def graph_forward(spark, d):
    """Two undirected layers and the edge head over every session's candidate graph."""
    return _graph_scores(spark, d, False)


@query
def graph_forward_directed(spark, d):
    return _graph_scores(spark, d, True)


# -- splits and contracts ---------------------------------------------------

def _manifest(spark, d):
    sessions = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    return sessions.withColumn("split", split_of(F.col("session_id")))


@query
def split_manifest(spark, d):
    assigned = splits.assign_split(edges(spark, d, texts=False).select("edge_id", "session_id"), _manifest(spark, d))
    return splits.split_manifest(assigned)


@query
def split_counts(spark, d):
    return splits.split_counts(_manifest(spark, d))


@query
def manifest_report(spark, d):
    return splits.manifest_report(_manifest(spark, d).withColumn("session_id", F.col("session_id").cast("string")))


@query
def manifest_gaps(spark, d):
    """Sessions without any candidate edge, and the other way round."""
    return splits.coverage_gaps(edges(spark, d, texts=False).select("session_id"), _manifest(spark, d).select("session_id"))


@query
def split_overlap(spark, d):
    """Sessions in two splits, with an edge-wise split that leaks on purpose."""
    leaky = edges(spark, d, texts=False).select("session_id", split_of(F.col("session_id") + F.col("Q2_row")).alias("split"))
    return splits.overlapping_sessions(leaky)


@query
def partition_report(spark, d):
    return contracts.partition_report(_retained(spark, d))


@query
def contract_report(spark, d):
    """Rules as data on a copy of the long sessions that is broken on purpose, against its manifest and its parts."""
    kept = _retained(spark, d, long_edges)
    at = lambda sql, broken, column: F.when(F.expr(sql), broken).otherwise(F.col(column))
    broken = kept.withColumns({
        "edge_label": at("(Q1_row * 7 + Q2_row) % 97 = 0", F.lit(2), "edge_label"),
        "stage1_prob": at("session_id % 31 = 7", F.col("stage1_prob") + 1, "stage1_prob"),
        "edge_id": F.when(F.expr("session_id % 29 = 3 and Q1_row = 0"), F.lit(None)).otherwise(at("session_id % 37 = 5 and Q1_row = 1", F.lit("same"), "edge_id")),
        "split": at("session_id % 41 = 2 and Q2_row = 3", F.lit("test"), "split"),
    })
    broken = materialize(broken)
    manifest = table(spark, d, "events").select(F.expr("user_id div 2").alias("session_id")).distinct().where("session_id % 13 <> 1")
    part = lambda name: broken.where(F.col("split") == name)
    artifacts = {"edges": broken, "manifest": manifest, "train": part("train"), "test": part("test")}
    listed = [
        *rules.scored_split_rules("edges", 4),
        rules.Rule("in_manifest", "edges", "contained", ("session_id",), ("manifest",)),
        rules.Rule("same_sessions", "manifest", "same_keys", ("session_id",), ("edges",)),
        rules.Rule("no_leak", "train", "disjoint", ("session_id",), ("test",)),
        rules.Rule("rows_expected", "test", "rows", (), (1000,)),
        rules.Rule("sessions_expected", "manifest", "distinct", ("session_id",), (275,)),
        rules.Rule("selected_only_if_near", "edges", "implies", ("distance", "stage1_pred_edge"), (5, 0)),
        rules.Rule("graph_written", "graph", "unique", ("edge_id",)),
    ]
    return rules.report(artifacts, listed)


@query
def graph_align(spark, d):
    final = _recovered(spark, d).select("edge_id", "final_graph_pred_edge", r6("final_graph_score", "final_graph_score"))
    return splits.align(narrow_edges(spark, d).select("edge_id"), final)


@query
def label_columns(spark, d):
    source = edges(spark, d, texts=False).withColumns(
        {
            "dependent": F.when(F.col("distance") == 1, "Yes").otherwise("No"),
            "relation_type": F.when(F.col("Q2_row") % 2 == 0, "Clarification").otherwise("Complaint"),
        }
    )
    out = splits.add_labels(source)
    return out.select("edge_id", "edge_label", "relation_type_train", splits.positive_mask(source).cast("int").alias("positive"))


# -- errors and diagnostics -------------------------------------------------

def _analysed(spark, d):
    base = scored_edges(spark, d, errors.SEEN_SOURCE, errors.SEEN_TARGET, errors.record_seen)
    base = topicshift.with_topic_shift(base, LEX)
    base = splits.add_text_features(base)
    kept = evidence.raw_evidence(retention.retain(base, THRESHOLD, TOP_K))
    kept = kept.withColumn("stage2a_local_evidence", F.round("stage2a_local_evidence", 6))
    return errors.with_error_columns(recovery.recover(kept, LAMBDA_0, LAMBDA_T), LEX)


@query
def error_columns(spark, d):
    return _analysed(spark, d).select(
        "edge_id", "pred_indegree", "distance_bucket", "q2_bucket",
        r6("q1_q2_jaccard", "q1_q2_jaccard"), r6("a1_q2_jaccard", "a1_q2_jaccard"),
        "fp_taxonomy", "fn_taxonomy",
    )


@query
def fp_taxonomy(spark, d):
    rows = errors.error_rows(_analysed(spark, d), "FP")
    return rounded(errors.taxonomy_table(rows, "FP", "fp_taxonomy"), "share")


@query
def fn_taxonomy(spark, d):
    rows = errors.error_rows(_analysed(spark, d), "FN")
    return rounded(errors.taxonomy_table(rows, "FN", "fn_taxonomy"), "share")


@query
def secondary_breakdown(spark, d):
    rows = errors.error_rows(_analysed(spark, d), "FP")
    out = errors.secondary_breakdown(rows, "fp_taxonomy", "distance_bucket", "FP")
    return rounded(out, "share_within_error", "share_within_primary")


def _cases(spark, d):
    """Analysed edges, scores rounded so that ties are ties in every engine; written, as several tables read them."""
    rows = _analysed(spark, d).drop("Q1", "A1", "Q2")
    return materialize(rounded(rows, "final_graph_score", "stage2a_local_prob", "a1_q2_jaccard", "q1_q2_jaccard"))


@query
def fp_cases(spark, d):
    return errors.case_table(_cases(spark, d), "FP")


@query
def fn_cases(spark, d):
    return errors.case_table(_cases(spark, d), "FN")


@query
def case_examples(spark, d):
    """Five examples of each error class (the number is the feature)."""
    return errors.case_examples(_cases(spark, d), 5)


@query
def bucket_distribution(spark, d):
    rows = errors.error_rows(_analysed(spark, d), "FN")
    return rounded(errors.bucket_table(rows, "FN", "distance_num", errors.distance_bucket), "share")


@both_sources
def score_buckets(spark, d, source=narrow_edges):
    return rounded(errors.bucket_table(source(spark, d), "all", "stage1_prob", errors.score_bucket), "share")


@both_sources
def indegree_summary(spark, d, source=narrow_edges):
    return rounded(errors.indegree_summary(_recovered(spark, d, source)), "share")


@both_sources
def miss_attribution(spark, d, source=narrow_edges):
    return errors.miss_attribution(_recovered(spark, d, source))


@query
def error_boundaries(spark, d):
    final = materialize(_analysed(spark, d).drop("Q1", "A1", "Q2"))
    false = errors.taxonomy_table(errors.error_rows(final, "FP"), "FP", "fp_taxonomy")
    return rounded(errors.boundary_table(errors.miss_attribution(final), false), "share")


@query
def consistency_check(spark, d):
    """The graph against a threshold rule on its own local probability."""
    left = _recovered(spark, d)
    right = left.select(
        "edge_id",
        (F.col("stage2_score") >= 0.55).cast("int").alias("model_pred"),
        F.col("final_graph_score").alias("model_score"),
    )
    return rounded(errors.consistency(left, right), "value")


@query
def error_summary(spark, d):
    final = _recovered(spark, d)
    record = metrics.evaluate(final, "edge_label", "final_graph_pred_edge", "final_graph_score")
    return rounded(errors.error_summary(record), "value")


@query
def stage_records(spark, d):
    final = materialize(_recovered(spark, d))
    return rounded(diagnostics.stage_records(final), *diagnostics.STAGE_COLUMNS)


@both_sources
def stage_transitions(spark, d, source=narrow_edges):
    records_ = diagnostics.stage_records(materialize(_recovered(spark, d, source)))
    out = diagnostics.transition_summary(records_, LAMBDA_0, LAMBDA_T)
    return rounded(out, *[c for c in out.columns if c != "split"])


# -- sensitivity ------------------------------------------------------------

@both_sources
def retention_flags(spark, d, source=narrow_edges):
    flagged = sensitivity.flag_retention(_search(spark, d, source), 3, 0.0)
    return rounded(sensitivity.retention_summary(flagged), "Threshold", "Recall", "Precision", "F1",
                   "delta_f1_from_selected", "delta_precision_from_selected", "delta_retained_edges_from_selected")


@both_sources
def retention_compression(spark, d, source=narrow_edges):
    total = _validation(spark, d, source).count()
    return rounded(sensitivity.compression_table(_search(spark, d, source), total), "Recall", "Compression")


FLAG_RATES = (*GRID_RATES, "delta_f1_from_selected", "delta_precision_from_selected",
              "delta_pred_edges_from_selected", "abs_lambda_0_distance", "abs_lambda_t_distance")


@both_sources
def penalty_flags(spark, d, source=narrow_edges):
    return rounded(sensitivity.flag_penalties(materialize(_grid(spark, d, source)), LAMBDA_0, LAMBDA_T), *FLAG_RATES)


@both_sources
def penalty_neighbourhood(spark, d, source=narrow_edges):
    flagged = sensitivity.flag_penalties(materialize(_grid(spark, d, source)), LAMBDA_0, LAMBDA_T)
    return rounded(sensitivity.penalty_neighbourhood(flagged), *FLAG_RATES)


@both_sources
def penalty_slice(spark, d, source=narrow_edges):
    flagged = sensitivity.flag_penalties(_grid(spark, d, source), LAMBDA_0, LAMBDA_T)
    return rounded(sensitivity.penalty_slice(flagged, "lambda_t", LAMBDA_T), *FLAG_RATES)


@both_sources
def penalty_heatmap(spark, d, source=narrow_edges):
    out = sensitivity.heatmap(_grid(spark, d, source), "F1", GRID_T)
    named = [r6(f"`{t:.2f}`", f"t_{round(t * 100):03d}") for t in GRID_T]
    return out.select(r6("lambda_0", "lambda_0"), *named)


# -- bootstrap --------------------------------------------------------------

def _boot(spark, d, models, ranking):
    """Metrics of every draw; ``models`` as ``bootstrap_vectors.long_table`` takes them."""
    test = _recovered(spark, d).where(F.col("split") == "test").select(
        "session_id", "edge_label", "final_graph_pred_edge",
        F.round("final_graph_score", 6).alias("final_graph_score"),
        F.col("stage1_pred_edge").alias("baseline_pred"),
    )
    test = materialize(test)  # narrow; read for counts and sessions
    sessions = materialize(bootstrap.index_sessions(test, "session_id"))
    return bootstrap_vectors.draw_metrics(bootstrap_vectors.long_table(test, models), sessions, DRAWS, ranking=ranking)


@query
def bootstrap_ci(spark, d):
    table = _boot(spark, d, {"Final Graph": ("final_graph_score", "final_graph_pred_edge")}, True)
    out = bootstrap.intervals(table, {m: m for m in ("AUC", "AP", "Precision", "Recall", "F1")}, DRAWS)
    return rounded(out, "BootstrapMean", "CI_Lower", "CI_Upper")


@query
def bootstrap_paired_f1(spark, d):
    both = {"model": ("final_graph_score", "final_graph_pred_edge"), "baseline": ("final_graph_score", "baseline_pred")}
    table = materialize(_boot(spark, d, both, False))  # one row a model and draw
    f1 = lambda name: table.where(F.col("Model") == name).select("draw", F.col("F1").alias(name))
    diff = f1("model").join(f1("baseline"), "draw").select((F.col("model") - F.col("baseline")).alias("d"))
    return rounded(bootstrap.difference(diff, DRAWS), "F1_Difference_Mean", "CI_Lower", "CI_Upper", "P_Diff_LE_0")


#: score and prediction of every model that the bootstrap holds against the final graph
BOOT_MODELS = {
    "Final Graph": ("final_graph_score", "final_graph_pred_edge"),
    "Stage 1": ("stage1_prob", "stage1_pred_edge"),
    "Temporal-distance Prior": ("distance_prior", "prior_pred"),
}


def _boot_models(spark, d, source=narrow_edges, ranking=True):
    prior = F.round(inverse_distance(F.col("distance")), 6)
    test = _recovered(spark, d, source).where(F.col("split") == "test").select(
        "session_id", "edge_label", "final_graph_pred_edge", F.round("final_graph_score", 6).alias("final_graph_score"),
        "stage1_prob", "stage1_pred_edge", prior.alias("distance_prior"), (prior >= 0.5).cast("int").alias("prior_pred"),
    )
    test = materialize(test)
    sessions = materialize(bootstrap.index_sessions(test, "session_id"))
    return bootstrap_vectors.draw_metrics(bootstrap_vectors.long_table(test, BOOT_MODELS), sessions, DRAWS, ranking=ranking)


@both_sources
def bootstrap_models(spark, d, source=narrow_edges):
    """Intervals of all metrics of all models, from shared draws."""
    out = bootstrap_vectors.model_intervals(_boot_models(spark, d, source), DRAWS)
    return rounded(out, "BootstrapMean", "CI_Lower", "CI_Upper")


@both_sources
def bootstrap_paired_models(spark, d, source=narrow_edges):
    """F1 of the final graph less that of every other model."""
    out = bootstrap_vectors.paired_differences(_boot_models(spark, d, source, ranking=False), "Final Graph", DRAWS)
    return rounded(out, "F1_Difference_Mean", "CI_Lower", "CI_Upper", "P_Diff_LE_0")


# -- comparison with the final graph -----------------------------------------

COMPARED = {"Stage 1": "stage1_prob", "Temporal-distance Prior": "distance_prior"}
MODEL_ORDER = ("Temporal-distance Prior", "Temporal-distance Prior Top-K", "Stage 1", "Stage 1 Top-K", "Final Graph")


def _decided(spark, d, source=narrow_edges):
    scored = _recovered(spark, d, source).select(
        "edge_id", "session_id", "Q1_row", "Q2_row", "split", "edge_label", "stage1_prob", "final_graph_pred_edge",
        F.round("final_graph_score", 6).alias("final_graph_score"),
        F.round(inverse_distance(F.col("distance")), 6).alias("distance_prior"),
    )
    return run.decided_models(scored, COMPARED, ("final_graph_score", "final_graph_pred_edge"))


@both_sources
def full_comparison(spark, d, source=narrow_edges):
    """Score cuts, Top-K models and the final graph, with the parameters that validation selected."""
    out = run.full_comparison(_decided(spark, d, source), MODEL_ORDER)
    return rounded(out, "precision", "recall", "f1", "accuracy", "auc", "ap", "Threshold")


@both_sources
def prediction_audit_selected(spark, d, source=narrow_edges):
    """Scores and predictions of every compared model on each test edge, cut as validation selected."""
    test = _decided(spark, d, source).where(F.col("split") == "test")
    return prediction_audit(test, MODEL_ORDER)


# -- labelling and pairs ----------------------------------------------------

def _pair_edges(spark, d):
    return scored_edges(spark, d).select("session_id", "Q1_row", "Q2_row", "Q1", "A1", "Q2", "split", "edge_label")


@query
def positive_pairs(spark, d):
    out = pairs.positive_pairs(_pair_edges(spark, d))
    return out.select(F.md5("anchor").alias("anchor"), F.md5("candidate").alias("candidate"), "copies")


@query
def pair_stats(spark, d):
    return pairs.pair_stats(_pair_edges(spark, d))


@query
def unique_anchor_batches(spark, d):
    """Batch sizes and distinct anchors: they agree in every batch."""
    batches = pairs.unique_anchor_batches(pairs.positive_pairs(_pair_edges(spark, d)), 16)
    return batches.groupBy("batch").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("anchor").alias("anchors")
    )


@query
def filled_anchor_batches(spark, d):
    """Batches of documents that never hold a source twice: sources are few and some very common."""
    docs = table(spark, d, "documents").where("source is not null")
    found = pairs.filled_anchor_batches(docs.select(F.col("source").alias("anchor"), F.col("doc_id").cast("string").alias("candidate")), 16)
    return found.groupBy("batch").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("anchor").alias("anchors"))


@query
def pending_rows(spark, d):
    shifted = topicshift.auto_label_easy(labeling.initialize_labels(_shifted(spark, d)))
    return labeling.pending(shifted).select("edge_id")


@query
def label_value_counts(spark, d):
    shifted = topicshift.auto_label_easy(labeling.initialize_labels(_shifted(spark, d)))
    return labeling.value_counts(shifted, ["dependent", "dependency_type", "relation_type"])


def _stub_labeler():
    """Answers by the length of the prompt: every seventh fails, three more in eleven say Yes."""

    def answer(prompt: str) -> str:
        n = len(prompt)
        if n % 7 < 2:
            return ""
        return '{"dependent":"%s","dependency_type":"t","relation_type":"Elaboration","reason":"n"}' % ("Yes" if n % 11 < 3 else "No")

    return answer


@query
def label_upsert(spark, d):
    """Two overlapping batches merged into a label store; three failures in a row stop the first, none the second."""
    every = materialize(edges(spark, d))
    path = shared_folder(spark, "labels")
    label_store.create_store(every.where("Q2_row % 2 = 1"), path, 8)
    options = {"buckets": 8, "retries": 1, "pause": 0.0}
    label_store.merge_batch(spark, path, every.where("Q1_row = 0"), _stub_labeler(), stop_after=3, **options)
    label_store.merge_batch(spark, path, every.where("session_id % 2 = 0"), _stub_labeler(), stop_after=0, **options)
    return label_store.read_store(spark, path).select("edge_id", "done", "dependent", "relation_type")


@query
def json_rescue(spark, d):
    """Objects embedded in surrounding text, dug out of event properties."""
    noisy = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("answer: "), "props", F.lit(" end"))).otherwise(F.col("props"))
    found = labeling.json_object(noisy)
    return table(spark, d, "events").select(
        "event_id", F.get_json_object(found, "$.k").try_cast("long").alias("k")
    )


@query
def label_responses(spark, d):
    """Response parsing and label rules on responses built from the edges."""
    kind = F.col("Q1_row") + F.col("Q2_row") * 2 + F.col("session_id")
    response = (
        F.when(kind % 5 == 0, F.lit(""))
        .when(kind % 5 == 1, F.lit('{"dependent":"Yes","dependency_type":"Content-Dependent","relation_type":"Interaction-Complaint","reason":"r"}'))
        .when(kind % 5 == 2, F.lit('ok {"dependent":"No","dependency_type":"x","relation_type":"y","reason":"n"} done'))
        .when(kind % 5 == 3, F.lit('{"dependent":"Maybe","dependency_type":"a","relation_type":"b","reason":"m"}'))
        .otherwise(F.lit("no object here"))
    )
    work = edges(spark, d, texts=False).select("edge_id", response.alias("response"))
    work = work.withColumn("_p", labeling.parse_response(F.col("response")))
    rules = labeling.normalize_labels(F.col("_p"), F.col("response"))
    return work.select("edge_id", *[v.alias(k) for k, v in rules.items()])


# -- streams ----------------------------------------------------------------

WAVES = 3
GAP = 24 * 3600


@query
def streamed_candidate_edges(spark, d):
    """``candidate_edges_w5`` from a stream: turns come in waves, neighbours in time in either order."""
    turns = table(spark, d, "conversations")
    least, most = turns.agg(F.min("turn"), F.max("turn")).first()
    width = (most - least) // WAVES + 1
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60)
    # half of the turns at the end of a wave come with the next one
    shifted = F.col("turn") - least + F.pmod(F.xxhash64("conv_id", "turn"), F.lit(2)) * F.lit((width + 1) // 2)
    fed = turns.select(
        F.col("conv_id").alias("session_id"), "turn", "role", "text", time.alias("event_time"),
        F.least(F.floor(shifted / width), F.lit(WAVES - 1)).alias("wave"),
    )
    closing = fed.limit(0).drop("wave").union(
        spark.sql(f"select cast(null as bigint), cast(null as bigint), cast(null as string), cast(null as string), "
                  f"timestamp_seconds(1704067200 + ({most} + 2 * {width} + 2) * 60)")
    )
    start = lambda s, out, cp: stream_candidates.run_candidates(s, out, cp, window=5, delay=f"{width + 1} minutes")
    done = replay(fed, "wave", WAVES, closing, start)
    return stream_candidates.as_edges(done.result(stream_candidates.OUTPUT.format(session="bigint")))


def _event_aggregates():
    return [F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")]


def _in_micros(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", "total"
    )


@query
def event_sessions(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _in_micros(sessionize.session_table(events, "user_id", "ts", _event_aggregates(), GAP))


@query
def event_session_numbers(spark, d):
    events = table(spark, d, "events")
    return sessionize.number_sessions(events, "user_id", "ts", GAP).select("event_id", "user_id", "session_no")


@query
def event_sessions_stream(spark, d):
    """``event_sessions`` from a stream in waves; half of a wave's last hour comes with the next one."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    least, most = events.agg(F.unix_seconds(F.min("ts").cast("timestamp")), F.unix_seconds(F.max("ts").cast("timestamp"))).first()
    width = (most - least) // WAVES + 1
    shifted = F.unix_seconds(F.col("ts").cast("timestamp")) - least + F.pmod(F.xxhash64("event_id"), F.lit(2)) * 3600
    fed = events.withColumn("wave", F.least(F.floor(shifted / width), F.lit(WAVES - 1)))
    closing = events.limit(0).union(
        spark.sql(f"select cast(null as bigint), timestamp_seconds({most} + 10 * 86400), cast(null as bigint), cast(null as double)")
    )
    fed, closing = (x.withColumn("ts", F.col("ts").cast("timestamp")) for x in (fed, closing))
    start = lambda s, out, cp: stream_sessions.run_sessions(s, out, cp, "user_id", "ts", _event_aggregates(), gap=GAP, delay="2 hours")
    done = replay(fed, "wave", WAVES, closing, start)
    return _in_micros(done.result("user_id bigint, start timestamp, end timestamp, events bigint, total double"))


# -- learned scorers and the staged run --------------------------------------

@query
def lr_scorer(spark, d):
    wide = _vector_edges(spark, d).withColumn(
        "edge_label", ((F.col("session_id") + F.col("Q1_row") * 3 + F.col("Q2_row")) % 3 == 0).cast("int")
    )
    features = vx.pair_features(F.col("embedding"), F.col("Q2_embedding"), F.col("distance"))
    ready = materialize(wide.select("edge_id", "edge_label", features.alias("x")))
    model = irls.fit_irls(ready, "x")
    return ready.select("edge_id", r6(model.probability("x"), "prob"))


def _fusion_scores(spark, d):
    return materialize(_model_scores(spark, d)).withColumnsRenamed({"stage1_prob": "semantic_score"}).withColumn(
        "pairwise_score", F.col("semantic_score") * F.col("distance_prior")
    )


def _fusion_fit(scored):
    return irls.fit_irls(scored.where(F.col("split") == "train"), list(scorers.FUSION_FEATURES))


@query
def score_fusion(spark, d):
    scored = _fusion_scores(spark, d)
    model = _fusion_fit(scored)
    return scored.select("edge_id", r6(model.probability(list(scorers.FUSION_FEATURES)), "fusion"))


@query
def frozen_fusion(spark, d):
    """``score_fusion`` with the fit saved to a file and loaded again."""
    scored = _fusion_scores(spark, d)
    path = shared_folder(spark, "models") + "/fusion"
    save_model(spark, _fusion_fit(scored), path)
    model = load_model(spark, path, irls.Logistic)
    return scored.select("edge_id", r6(model.probability(list(scorers.FUSION_FEATURES)), "fusion"))


@query
def fusion_coefficients(spark, d):
    model = _fusion_fit(_fusion_scores(spark, d))
    rows = [*((n, w) for n, w, _ in model.coefficients()), ("intercept", model.bias)]
    return spark.createDataFrame(rows, "feature string, coefficient double").select("feature", r6("coefficient", "coefficient"))


@both_sources
def calibration(spark, d, source=narrow_edges):
    """The recalibration fitted on retained train candidates: scaling, weight and bias."""
    model = evidence.fit_calibration(_retained(spark, d, source).where(F.col("split") == "train"))
    return spark.createDataFrame([(model.mean, model.deviation, model.weight, model.bias)], "mean double, deviation double, weight double, bias double").select(
        *[r6(c, c) for c in ("mean", "deviation", "weight", "bias")]
    )


@both_sources
def calibrated_columns(spark, d, source=narrow_edges):
    kept = _retained(spark, d, source)
    model = evidence.fit_calibration(kept.where(F.col("split") == "train"))
    out = evidence.calibrated_evidence(kept, model)
    return out.select("edge_id", "stage2_graph_input_pred", r6("stage2a_local_prob", "local_prob"), r6("stage2a_local_evidence", "local_evidence"))


@both_sources
def staged_run(spark, d, source=narrow_edges):
    result = run.staged_run(source(spark, d), guard_boundary=False)
    return rounded(run.split_summary(result.final), "precision", "recall", "f1", "accuracy", "auc", "ap")


@both_sources
def staged_parameters(spark, d, source=narrow_edges):
    """What the staged run froze before it read the test split."""
    found = run.staged_run(source(spark, d), guard_boundary=False).params
    names = ("selected_threshold", "selected_top_k", "selected_lambda_0", "selected_lambda_t")
    return spark.createDataFrame([(n, float(found[n])) for n in names], "parameter string, value double").select("parameter", r6("value", "value"))


@both_sources
def evidence_ablation(spark, d, source=narrow_edges):
    out = run.evidence_ablation(source(spark, d))
    return rounded(out, "precision", "recall", "f1", "accuracy", "auc", "ap", "selected_lambda_0", "selected_lambda_t")
