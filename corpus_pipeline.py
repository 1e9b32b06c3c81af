"""A training corpus from the documents table, in five stages.

Every stage works on all rows of the one before, written as Parquet and read
again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm import decontam, mixing, neardup, quality, sharding
from turnweave.llm.common import Workspace

SHARDS = 40


#: what the operators read; all other columns travel as one struct that no operator looks into
USED = ("doc_id", "text", "source")


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, source`` and the rest of the columns as ``row``, whatever they are called."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in USED]
    return docs.select(*USED, F.struct(F.lit(0).alias("none"), *rest).alias("row"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, in their order."""
    return rows.select(*[F.col(c) if c in USED else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule lets pass.

    Null and empty texts have no words and go; long texts are judged whole;
    repeated rows are judged alike and all stay or all go; an empty table stays
    empty.  Columns of any name keep their values.
    """
    judged = quality.quality_cascade(_packed(docs), features=(), keep_text=True)
    return _unpacked(judged.where("rejected_by is null"), docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id.

    A missing doc_id comes last; documents of equal doc_id are told apart by their
    text.  Rows that repeat doc_id and text stay once.  Null and empty texts are
    near nothing.  An empty table stays empty, columns of any name keep their
    values.
    """
    rows = _packed(docs)
    found = neardup.near_duplicates(rows.select("doc_id", "text"), by_row=True)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("content").alias("gone_content")).distinct()
    same = rows["doc_id"].eqNullSafe(gone["gone_id"]) & (neardup.content() == gone["gone_content"])
    left = rows.join(gone, same, "left_anti")
    copy = F.expr("row_number() over (partition by doc_id, xxhash64(text) order by text)")
    # a missing doc_id says nothing about sameness, but an equal text does
    return _unpacked(left.withColumn("copy", copy).where("copy = 1"), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay; repeated rows all stay or all go; an
    empty table, or one of the benchmark, takes nothing away.  Columns of any name
    keep their values.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _packed(docs)
    marked = decontam.contaminated_words(rows.select("doc_id", F.xxhash64("text").alias("content"), "text"), benchmark)
    hit = marked.where("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("content").alias("hit_content")).distinct()
    same = rows["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(rows["text"]) == hit["hit_content"])
    return _unpacked(rows.join(hit, same, "left_anti"), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order.

    Documents without words add nothing to a mix but may be given; a null source
    is a source of its own; repeated rows are documents of their own.  An empty table
    stays empty, columns of any name keep their values.
    """
    scheduled = mixing.training_schedule(_packed(docs), mixing.word_count())
    return _unpacked(mixing.in_training_order(scheduled, ["doc_id"]), docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard and their slot in it.

    Null texts count as empty; repeated rows lie side by side; an empty table
    stays empty.  Own columns called ``shard`` or ``slot`` are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    return sharding.shard_by_size(docs, SHARDS, F.xxhash64(text), F.xxhash64("doc_id"), F.octet_length(text) + 16)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: the last stage orders by a hash that DuckDB does not have; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = space.save(f"{i}-{name}", stage(spark, docs, sf_dir))
        if i:
            space.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
