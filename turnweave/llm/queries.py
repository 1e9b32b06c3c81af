"""The corpus operators on the given tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import (
    chat,
    decontam,
    langid,
    licenses,
    mixing,
    neardup,
    pseudolm,
    quality,
    ranked,
    sharding,
    tokens,
    warc,
    whitening,
)
from turnweave.llm.common import Workspace

SHARDS = 40
#: the near-duplicate query takes shingles of four words, the pipeline of five
QUERY_SHINGLE = 4

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("content"),
    )
    # equal texts have one key, so they stay in one shard as far as a shard holds them
    rows = Workspace(spark).save("rows", rows)
    placed = sharding.shard_by_size(rows, SHARDS, F.col("content"), F.xxhash64("doc_id"), F.col("size"), save=False)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"))
    # stored payloads are measured again; a revisit carries the size and digest of the record it refers to
    stored = F.col("payload").isNotNull()
    return back.select(
        "page_id",
        F.when(stored, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("bigint").alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("words"))
    rows = Workspace(spark).save("words", rows)
    mixed = mixing.training_schedule(rows, F.col("words"))
    # in the order in which documents are first due; those that are never due come last, in many ranges
    first = F.get("positions", F.lit(0))
    ordered = mixed.withColumn("first", first).orderBy(F.col("first").asc_nulls_last(), F.xxhash64("doc_id"), "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.quality_cascade(docs)
    failed = (F.col("n_words") < quality.MIN_WORDS) | (
        100 * F.col("n_repeat_words") > quality.MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return judged.select("doc_id", *quality.FEATURES, failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudolm.pseudo_likelihood(docs, pseudolm.train(docs))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=QUERY_SHINGLE)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated_words(docs, _table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = docs.where(~langid.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(labelled))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chat.perspectives(_table(spark, sf_dir, "conversations"))
    mask = F.concat_ws(",", F.transform("mask", lambda r: F.concat_ws("-", r["begin"].cast("string"), r["end"].cast("string"))))
    return shown.select("conv_id", "sample", "perspective", "first_message", "n_messages", "rendered", mask.alias("mask"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build_index(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ranked.ranked_search(index, _table(spark, sf_dir, "benchmark"))


REGISTRY: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_warc, op3_mixing, op4_quality, op5_lm_scoring,
        op6_near_dup, op7_decontamination, op8_token_counts, op9_language, op10_chat,
        op11_licenses, op12_whitening, op13_ranked_search,
    )
}
