"""BM25 over candidate edges, with corpus statistics kept as tables.

Tokens are made once per distinct text.  The inverse document frequency is
attached in two ways that together cover every token: the few tokens that occur
in a large share of all documents (their number is bounded by average document
length / share) are broadcast, all others are joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, bm25_tokens, clean_text
from ..session import lookup_join, materialize
from .blocks import BLOCK, ROWS_A_GROUP, sparse_product_edges

K1 = 1.5
B = 0.75
HOT_SHARE = 0.005
#: tokens of the records that a task of the sparse form is given, on average
TOKENS_A_GROUP = 500_000


@dataclass(frozen=True)
class Corpus:
    """``terms``: token, df, idf.  ``docs`` and ``avgdl`` describe the corpus."""

    terms: DataFrame
    docs: int
    avgdl: float


def corpus_terms(texts: DataFrame, column: str = "anchor_text", tokens: Column | None = None) -> DataFrame:
    """Document frequency per token over the distinct texts, plus corpus totals.

    Columns ``token, df, n_docs, avgdl, idf``; everything stays distributed.
    """
    docs = texts.select(clean_text(F.col(column)).alias("text")).distinct()
    docs = docs.select((bm25_tokens(F.col("text")) if tokens is None else tokens).alias("tokens"))
    stats = docs.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens").cast("double")).alias("avgdl")
    )
    freq = (
        docs.select(F.explode(F.array_distinct("tokens")).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    n = F.greatest(F.col("n_docs"), F.lit(1))
    return freq.crossJoin(F.broadcast(stats)).withColumn(
        "idf", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    )


def fit(texts: DataFrame, column: str = "anchor_text") -> Corpus:
    """Freeze corpus statistics: two numbers on the driver, terms as a table.

    One pass over the texts: an extra empty token per document carries its
    length, so its row holds document count and total length.
    """
    docs = texts.select(clean_text(F.col(column)).alias("text")).distinct()
    docs = docs.select(bm25_tokens(F.col("text")).alias("tokens"))
    tokens = F.concat(F.array(F.lit("")), F.array_distinct("tokens"))
    freq = materialize(
        docs.select(F.size("tokens").cast("long").alias("n"), F.explode(tokens).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("token") == "", F.col("n"))).alias("len"))
    )
    row = freq.where(F.col("token") == "").first()
    n_docs, avgdl = (int(row["df"]), row["len"] / row["df"]) if row else (0, 0.0)
    n = F.lit(max(n_docs, 1))
    terms = freq.where(F.col("token") != "").select(
        "token", "df", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    return Corpus(terms, n_docs, avgdl)


def query_hits(edges: DataFrame, query_tokens: str, doc_tokens: str, keys: list[str]) -> DataFrame:
    """One row per edge and distinct query token that the document contains.

    Counting happens inside the row, so no token-by-token join of the two texts
    is needed: ``keys, token, qf, tf, dl``.
    """
    shared = F.array_intersect(F.col(query_tokens), F.col(doc_tokens))
    return edges.select(
        *keys,
        F.size(doc_tokens).alias("dl"),
        F.col(query_tokens).alias("_q"),
        F.col(doc_tokens).alias("_d"),
        F.explode(shared).alias("token"),
    ).select(
        *keys,
        "token",
        F.expr("size(filter(_q, t -> t = token))").alias("qf"),
        F.expr("size(filter(_d, t -> t = token))").alias("tf"),
        "dl",
    )


def with_idf(hits: DataFrame, corpus: Corpus, spread: Column, hot_share: float = HOT_SHARE) -> DataFrame:
    """Attach idf without ever sending a hot token's rows to one task."""
    floor = max(1.0, hot_share * corpus.docs)
    hot = corpus.terms.where(F.col("df") > floor).select("token", F.col("idf").alias("_hot"))
    cold = corpus.terms.where(F.col("df") <= floor).select(
        F.col("token").alias("_key"), F.col("idf").alias("_cold")
    )
    resolved = hits.join(F.broadcast(hot), "token", "left")
    # Rows already resolved get a key that matches nothing and is spread evenly.
    key = F.when(F.col("_hot").isNull(), F.col("token")).otherwise(
        F.concat(F.lit("\x00"), spread.cast("string"))
    )
    return (
        resolved.withColumn("_key", key)
        .join(cold, "_key", "left")
        .withColumn("idf", F.coalesce("_hot", "_cold", F.lit(0.0)))
        .drop("_hot", "_cold", "_key")
    )


def score_edges(
    edges: DataFrame,
    corpus: Corpus,
    query_tokens: str = "query_tokens",
    doc_tokens: str = "doc_tokens",
    key: str = "edge_id",
    k1: float = K1,
    b: float = B,
    name: str = "bm25_score",
) -> DataFrame:
    """``key, name`` for every edge; edges without a shared token score 0."""
    hits = with_idf(query_hits(edges, query_tokens, doc_tokens, [key]), corpus, F.col(key))
    length = F.col("dl") / F.lit(corpus.avgdl) if corpus.avgdl else F.lit(0.0)
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length)
    part = F.col("qf") * F.col("idf") * (F.col("tf") * F.lit(k1 + 1.0)) / (F.col("tf") + norm + 1e-9)
    sums = hits.groupBy(key).agg(F.sum(part).alias("_s"))
    return edges.select(key).join(sums, key, "left").select(
        key, F.coalesce("_s", F.lit(0.0)).alias(name)
    )


def term_counts(tokens: str) -> Column:
    """A bag of tokens as an array of (term, x), each term once with its number: runs of the sorted bag."""

    def runs(bag: Column) -> Column:
        begins = F.filter(
            F.when(F.size(bag) > 0, F.sequence(F.lit(0), F.size(bag) - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 0) | (F.get(bag, i) != F.get(bag, i - 1)),
        )
        return bind(begins, lambda at: F.transform(at, lambda b, j: F.struct(
            F.get(bag, b).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(bag)) - b).cast("double").alias("x"),
        )))

    return F.when(F.col(tokens).isNotNull(), bind(F.array_sort(tokens), runs))


def record_weights(
    records: DataFrame, corpus: Corpus, doc_tokens: str = "doc_tokens", query_tokens: str = "query_tokens", k1: float = K1, b: float = B
) -> DataFrame:
    """``session_id, pos, opens, asks`` and two sparse vectors per record.

    ``document`` has the BM25 weight of each term of the record's own text, with
    idf attached once per record and term; ``query`` has how often each term
    occurs in the question.  Terms outside the corpus weigh nothing and are left out.
    """
    length = F.size(doc_tokens) / F.lit(corpus.avgdl) if corpus.avgdl else F.lit(0.0)
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * length)
    terms = records.select("session_id", "pos", norm.alias("norm"), F.explode(term_counts(doc_tokens)).alias("t"))
    terms = terms.select("session_id", "pos", "norm", F.col("t.term").alias("token"), F.col("t.x").alias("tf"))
    weighed = lookup_join(terms, corpus.terms.select("token", "idf"), ["token"], F.col("pos"), "inner")
    x = F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + F.col("norm") + 1e-9)
    rest = F.struct("opens", "asks", term_counts(query_tokens).alias("query"))
    # record and terms meet in one exchange
    both = weighed.select("session_id", "pos", F.struct(F.col("token").alias("term"), x.alias("x")).alias("w"), F.lit(None).alias("rest")).unionByName(
        records.select("session_id", "pos", F.lit(None).alias("w"), rest.alias("rest"))
    )
    whole = both.groupBy("session_id", "pos").agg(F.collect_list("w").alias("document"), F.first("rest", ignorenulls=True).alias("rest"))
    return whole.select("session_id", "pos", "rest.opens", "rest.asks", "document", "rest.query")


def group_sizes(records: DataFrame, bags: Sequence[str], window: int) -> dict[str, int]:
    """``rows_a_group`` and ``block`` that give a group about TOKENS_A_GROUP tokens."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    mean = records.agg(F.avg(sum((size(c) for c in bags), F.lit(1)))).first()[0] or 1.0
    rows = max(4 * window, min(ROWS_A_GROUP, int(TOKENS_A_GROUP / mean)))
    return {"rows_a_group": rows, "block": max(window, min(BLOCK, rows // 4))}


def score_records(records: DataFrame, corpus: Corpus, window: int = 5, name: str = "bm25_score", **options) -> DataFrame:
    """``session_id, Q1_row, Q2_row, bm25_score`` of all candidate edges of records with token bags."""
    options = group_sizes(records, ("doc_tokens", "query_tokens"), window) | options
    return sparse_product_edges(record_weights(records, corpus), "document", "query", name, window, **options)
