"""Error taxonomy of a recovered graph and its breakdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT_LEXICON, Lexicon
from ..functions.numeric import close_to, ratio, to_number
from ..functions.text import contains_any, set_jaccard, visible_chars
from .candidates import Features

OVERLAP_TRIGGER = 0.30


def distance_bucket(distance: Column) -> Column:
    whole = distance.cast("double").cast("int")
    return (
        F.when(whole <= 1, "d=1").when(whole <= 3, "d=2-3").when(whole <= 5, "d=4-5").otherwise("d>=6")
    )


def score_bucket(value: Column) -> Column:
    """Half-open bins; the first label reads "<=0" but holds values below 0."""
    number = to_number(value, None)
    return (
        F.when(number.isNull(), "nan")
        .when(number < 0.0, "<=0")
        .when(number < 0.1, "0-0.1")
        .when(number < 0.25, "0.1-0.25")
        .when(number < 0.5, "0.25-0.5")
        .when(number < 0.75, "0.5-0.75")
        .otherwise(">=0.75")
    )


def generic_answer(answer: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return contains_any(F.coalesce(answer, F.lit("")), lexicon.generic_answer)


def question_form(flags: Column, bucket: Column, q2_len: Column) -> Column:
    flags = F.coalesce(flags, F.lit(""))
    length = to_number(q2_len, None)
    return (
        F.contains(flags, F.lit("question_form"))
        | F.contains(flags, F.lit("short_q2"))
        | (F.coalesce(bucket, F.lit("")) == "boundary")
        | F.coalesce(length <= 20, F.lit(False))
    )


def _off_topic(bucket: Column) -> Column:
    return ~F.coalesce(bucket, F.lit("")).isin("", "keep", "nan")


SEEN_SOURCE, SEEN_TARGET = ("q_seen", "a_seen"), ("q_seen",)


SEEN: Features = {"seen": visible_chars}


def record_seen(records: DataFrame) -> DataFrame:
    """Visible characters once per record; carry them through ``candidate_edges``."""
    return records.withColumns({"q_seen": visible_chars(F.col("Q")), "a_seen": visible_chars(F.col("A"))})


def with_error_columns(graph: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """In-degree, buckets, overlaps and the two taxonomies.

    ``graph`` is a final graph with texts and topic-shift columns.  In-degree
    comes from a window over the (bounded) target group, not from a join back.
    """
    y, p = F.col("edge_label").cast("int"), F.col("final_graph_pred_edge").cast("int")
    target = Window.partitionBy("session_id", "Q2_row")
    carried = ("q_seen", "a_seen", "Q2_q_seen")
    if set(carried) <= set(graph.columns):
        sets = [F.col(c) for c in carried]
    else:
        sets = [visible_chars(F.col(c)) for c in ("Q1", "A1", "Q2")]
    out = graph.withColumns(
        {
            "pred_indegree": F.coalesce(F.sum(p).over(target), F.lit(0)).cast("int"),
            "distance_bucket": distance_bucket(F.col("distance_num")),
            "q2_bucket": score_bucket(F.col("q2_len")),
            "q1_q2_jaccard": set_jaccard(sets[0], sets[2]),
            "a1_q2_jaccard": set_jaccard(sets[1], sets[2]),
        }
    )
    far = F.coalesce(to_number(F.col("distance_num"), None) >= 4, F.lit(False))
    form = question_form(F.col("topic_shift_flags"), F.col("topic_shift_bucket"), F.col("q2_len"))
    overlap = (F.col("q1_q2_jaccard") >= OVERLAP_TRIGGER) | (F.col("a1_q2_jaccard") >= OVERLAP_TRIGGER)
    off = _off_topic(F.col("topic_shift_bucket"))
    false_positive = (
        F.when(far, "long_distance_carryover")
        .when(F.col("pred_indegree") >= 2, "multiple_source_over_recovery")
        .when(generic_answer(F.col("A1"), lexicon), "vague_answer_false_trigger")
        .when(form, "boundary_question_form")
        .when(overlap, "broad_lexical_overlap")
        .when(off, "topic_boundary_extension")
        .otherwise("other_manual_review")
    )
    false_negative = (
        F.when(to_number(F.col("stage1_pred_edge")).cast("int") == 0, "stage1_recall_miss")
        .when(to_number(F.col("stage2_pruned_by_graph")).cast("int") == 1, "stage2_graph_pruning_drop")
        .when(far, "long_distance_drop")
        .when(form, "boundary_question_form")
        .when(off, "topic_boundary_drop")
        .otherwise("other_manual_review")
    )
    return out.withColumns(
        {
            "fp_taxonomy": F.when((p == 1) & (y == 0), false_positive).otherwise("not_fp"),
            "fn_taxonomy": F.when((p == 0) & (y == 1), false_negative).otherwise("not_fn"),
        }
    )


def error_rows(analysed: DataFrame, kind: str) -> DataFrame:
    """FP, FN or TP rows of an analysed graph."""
    y, p = F.col("edge_label").cast("int"), F.col("final_graph_pred_edge").cast("int")
    return analysed.where(
        {"FP": (p == 1) & (y == 0), "FN": (p == 0) & (y == 1), "TP": (p == 1) & (y == 1)}[kind]
    )


def _shares(counts: DataFrame) -> DataFrame:
    # at most one row per category, so the global window is tiny
    return counts.withColumn("share", ratio(F.col("count"), F.sum("count").over(Window.partitionBy())))


def taxonomy_table(rows: DataFrame, label: str, column: str) -> DataFrame:
    category = F.coalesce(F.col(column), F.lit("other_manual_review"))
    counts = rows.groupBy(category.alias("category")).count()
    return _shares(counts).select(F.lit(label).alias("label"), "category", "count", "share")


def bucket_table(rows: DataFrame, label: str, column: str, bucket) -> DataFrame:
    """Counts per bucket; a missing column gives a single ``<missing>`` row."""
    if column not in rows.columns:
        return rows.agg(F.count(F.lit(1)).alias("count")).select(
            F.lit(label).alias("label"), F.lit("<missing>").alias("bucket"), "count", F.lit(1.0).alias("share")
        )
    counts = rows.groupBy(bucket(F.col(column)).alias("bucket")).count()
    return _shares(counts).select(F.lit(label).alias("label"), "bucket", "count", "share")


def secondary_breakdown(rows: DataFrame, primary: str, secondary: str, label: str) -> DataFrame:
    counts = rows.groupBy(
        F.coalesce(F.col(primary), F.lit("other_manual_review")).alias("primary_category"),
        F.coalesce(F.col(secondary).cast("string"), F.lit("unrecorded")).alias("secondary_attribute"),
    ).count()
    every, parent = Window.partitionBy(), Window.partitionBy("primary_category")
    return counts.select(
        F.lit(label).alias("label"),
        "primary_category",
        "secondary_attribute",
        "count",
        ratio(F.col("count"), F.sum("count").over(every)).alias("share_within_error"),
        ratio(F.col("count"), F.sum("count").over(parent)).alias("share_within_primary"),
    ).orderBy("primary_category", F.desc("count"), "secondary_attribute")


def indegree_summary(graph: DataFrame, pred: str = "final_graph_pred_edge") -> DataFrame:
    target = Window.partitionBy("session_id", "Q2_row")
    counts = (
        graph.withColumn("pred_indegree", F.sum(F.col(pred).cast("int")).over(target).cast("int"))
        .groupBy("pred_indegree")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(F.col("edge_label").cast("long")).alias("positives"),
            F.sum(F.col(pred).cast("long")).alias("predicted"),
        )
    )
    return counts.withColumn("share", ratio(F.col("rows"), F.sum("rows").over(Window.partitionBy())))


def _metric_rows(record: DataFrame, names: list[str], value: str, kind: str) -> DataFrame:
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast(kind).alias(value)) for n in names]
    return record.select(F.inline(F.array(*pairs)))


def miss_attribution(graph: DataFrame) -> DataFrame:
    """Where missed edges were lost."""
    y, p = F.col("edge_label").cast("int") == 1, F.col("final_graph_pred_edge").cast("int") == 1
    kept = to_number(F.col("stage1_pred_edge")).cast("int") == 1
    record = graph.agg(
        F.count_if(y & ~kept).alias("stage1_recall_miss"),
        F.count_if(y & kept & ~p).alias("stage2_graph_pruning_drop"),
        F.count_if(y & ~p).alias("total_fn"),
    )
    return _metric_rows(record, record.columns, "count", "long")


# Rows of the error-boundary table.
BOUNDARY_ROWS = (
    ("False negative", "stage1_recall_miss", "Not retained by Stage 1"),
    ("False negative", "stage2_graph_pruning_drop", "Not selected by Stage 2B"),
    ("False positive", "long_distance_carryover", "Carryover across distant turns"),
    ("False positive", "vague_answer_false_trigger", "False triggers from vague answers"),
    ("False positive", "multiple_source_over_recovery", "Excessive recovery of multiple sources"),
    ("False positive", "boundary_question_form", "Questions at the annotation boundary"),
    ("False positive", "other_manual_review", "Other observed patterns"),
)


def boundary_table(misses: DataFrame, false_positives: DataFrame) -> DataFrame:
    """Named error patterns with counts and shares within their outcome.

    Inputs are ``miss_attribution`` and the FP ``taxonomy_table``; shares refer
    to all misses and to all false positives, listed patterns or not.
    """
    fn = misses.select(F.lit("False negative").alias("outcome"), F.col("metric").alias("key"), "count")
    fp = false_positives.select(F.lit("False positive").alias("outcome"), F.col("category").alias("key"), "count")
    counts = fn.unionByName(fp)
    per = Window.partitionBy("outcome")
    whole = F.when(
        F.col("outcome") == "False negative", F.max(F.when(F.col("key") == "total_fn", F.col("count"))).over(per)
    ).otherwise(F.sum("count").over(per))
    named = misses.sparkSession.createDataFrame(BOUNDARY_ROWS, "outcome string, key string, pattern string")
    shared = counts.withColumn("share", ratio(F.col("count"), whole))
    return named.join(shared, ["outcome", "key"], "left").select(
        "outcome", "pattern", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("share", F.lit(0.0)).alias("share")
    )


def consistency(
    left: DataFrame,
    right: DataFrame,
    left_cols: tuple[str, str] = ("final_graph_pred_edge", "final_graph_score"),
    right_cols: tuple[str, str] = ("model_pred", "model_score"),
    atol: float = 1e-12,
) -> DataFrame:
    """Compare two prediction tables edge by edge."""
    a = left.select("edge_id", F.col(left_cols[0]).alias("_p1"), F.col(left_cols[1]).alias("_s1"))
    b = right.select("edge_id", F.col(right_cols[0]).alias("_p2"), F.col(right_cols[1]).alias("_s2"))
    record = (
        a.join(b, "edge_id")
        .agg(
            F.count(F.lit(1)).alias("matched_rows"),
            F.count_if(F.col("_p1").cast("int") != F.col("_p2").cast("int")).alias("pred_mismatches"),
            F.count_if(~close_to(F.col("_s1"), F.col("_s2"), atol)).alias("score_mismatches"),
        )
        .withColumn(
            "pred_match_rate",
            1.0 - F.col("pred_mismatches") / F.greatest(F.col("matched_rows"), F.lit(1)),
        )
    )
    return _metric_rows(record, record.columns, "value", "double")


def case_order(kind: str) -> list[Column]:
    """Review order of error cases."""
    names = {
        "FP": ("final_graph_score", "a1_q2_jaccard", "q1_q2_jaccard"),
        "FN": ("final_graph_score", "stage2a_local_prob", "stage1_prob"),
    }[kind]
    return [*[F.desc(n) for n in names], F.asc("session_id"), F.asc("Q1_row"), F.asc("Q2_row")]


CASE_KEYS = ("edge_id", "session_id", "Q1_row", "Q2_row")


def case_table(analysed: DataFrame, kind: str) -> DataFrame:
    """All false positives (``FP``) or misses (``FN``) in review order, sorted over all partitions."""
    taxonomy = f"{kind.lower()}_taxonomy"
    rows = error_rows(analysed, kind).orderBy(*case_order(kind))
    return rows.select(
        *CASE_KEYS, "final_graph_score", "stage2a_local_prob", "stage1_prob", "a1_q2_jaccard", "q1_q2_jaccard",
        "pred_indegree", "distance_bucket", "q2_bucket", F.col(taxonomy).alias("taxonomy"),
    )


def case_examples(analysed: DataFrame, n: int) -> DataFrame:
    """The first ``n`` cases of every error class in review order; Spark keeps ``n`` a class before it shuffles."""
    cases = None
    for kind in ("FP", "FN"):
        taxonomy = F.col(f"{kind.lower()}_taxonomy")
        place = F.row_number().over(Window.partitionBy("taxonomy").orderBy(*case_order(kind)))
        rows = error_rows(analysed, kind).withColumn("taxonomy", taxonomy).withColumn("place", place).where(F.col("place") <= n)
        rows = rows.select(F.lit(kind).alias("error"), "taxonomy", "place", *CASE_KEYS, "final_graph_score")
        cases = rows if cases is None else cases.unionByName(rows)
    return cases


def error_summary(evaluation: DataFrame, consistency_table: DataFrame | None = None) -> DataFrame:
    """Long ``metric, value`` form of a one-row evaluation."""
    renamed = evaluation.withColumnRenamed("total", "rows")
    names = ["rows", "true_edges", "pred_edges", "tp", "fp", "fn", "tn",
             "precision", "recall", "f1", "auc", "ap"]
    out = _metric_rows(renamed, names, "value", "double")
    if consistency_table is None:
        return out
    extra = consistency_table.where(F.col("metric").isin("pred_mismatches", "score_mismatches"))
    return out.unionByName(extra.withColumn("metric", F.concat(F.lit("consistency_"), "metric")))
