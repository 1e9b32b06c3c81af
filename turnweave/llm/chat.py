"""Chat formatting from the view of every participant, in DataFrame operations only.

A dialogue is rendered once for each of its participants, with that speaker as the
assistant and all others as named users; the mask lists the character ranges of
the speaker's own words (and end marks), which a model would be trained on.  So
that no row grows with its dialogue, a rendering is given in slices of
``max_messages`` messages: every participant has a row for every slice, silent or
not, and a slice begins with the system message in force, the last one before it.
System messages have no view of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators.prefix import sliced_running_sum

#: messages in one slice; a dialogue of any length is many bounded rows
MAX_MESSAGES = 64
SYSTEM = "system"
UNNAMED = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _head(speaker: Column, view: Column) -> Column:
    name = (
        F.when(speaker == SYSTEM, F.lit(SYSTEM))
        .when(speaker == view, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), speaker))
    )
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def numbered_messages(turns: DataFrame, max_messages: int = MAX_MESSAGES, speaker: str = "role") -> DataFrame:
    """(dialogue, number, sample, speaker, text): messages numbered from 0 in their dialogue, and their slice.

    Messages are ordered by turn (null last), speaker and text.  Numbers come from
    running counts over slices of the order, so a dialogue that holds a large part
    of all messages is numbered by many tasks.
    """
    told = turns.select(
        F.struct("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")).alias("dialogue"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit(UNNAMED)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    late = F.col("turn").isNull()
    # messages without a number may be many: they are cut by how they begin
    cut = F.struct(
        late.alias("late"), F.floor(F.col("turn") / 256).alias("part"),
        F.when(late, F.col("speaker")).alias("speaker"), F.when(late, F.substring("text", 1, 2)).alias("begin"),
    )
    order = [F.col("turn").asc_nulls_last(), F.col("speaker"), F.col("text")]
    placed = sliced_running_sum(told, ["dialogue"], cut, order, {"number": F.lit(1).cast("bigint")})
    placed = placed.withColumn("number", F.col("number") - 1)
    return placed.select("dialogue", "number", F.floor(F.col("number") / max_messages).alias("sample"), "speaker", "text")


def perspectives(turns: DataFrame, max_messages: int = MAX_MESSAGES, speaker: str = "role") -> DataFrame:
    """conv_id, sample, perspective, first_message, n_messages, rendered, mask: one row per slice and participant.

    ``turns`` has conv_id, turn, text and the speaker's column.  Messages are
    ordered by turn (null last), speaker and text; equal rows all stay.  A null
    speaker is called ``unknown``, a null text is empty.  A message without
    conv_id belongs to no dialogue and is one of its own.  Every speaker of a
    dialogue but the system has a row in each of its slices, also where it is
    silent.  ``first_message`` is the number in the dialogue, from 0, of the
    slice's first message; ``n_messages`` counts the messages of the slice with the
    system message repeated at its head.  ``mask`` holds (begin, end) in characters
    of ``rendered``, one per message of the perspective.  Dialogues without a
    participant (system messages only) give no row, an empty table gives none;
    other columns are ignored.
    """
    told = numbered_messages(turns, max_messages, speaker)
    message = F.struct("number", "speaker", "text")
    standing = F.when(F.col("speaker") == SYSTEM, message)
    grouped = told.groupBy("dialogue", "sample").agg(
        F.sort_array(F.collect_list(message)).alias("messages"), F.max(standing).alias("standing")
    )
    # the last system message of all slices before: one row a slice
    before = Window.partitionBy("dialogue").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    grouped = grouped.withColumn("head", F.last("standing", ignorenulls=True).over(before))
    opened = F.when(F.col("head").isNull(), F.col("messages")).otherwise(F.concat(F.array("head"), F.col("messages")))
    grouped = grouped.select("dialogue", "sample", F.get("messages", F.lit(0))["number"].alias("first_message"), opened.alias("messages"))
    speakers = told.where(F.col("speaker") != SYSTEM).groupBy("dialogue").agg(F.collect_set("speaker").alias("speakers"))
    # a struct key: null and alone are told apart inside it
    views = grouped.join(speakers, "dialogue").select(
        F.col("dialogue.conv_id").alias("conv_id"), "sample", "first_message", "messages", F.explode("speakers").alias("perspective")
    )
    view = F.col("perspective")
    pieces = F.transform("messages", lambda m: F.concat(_head(m["speaker"], view), m["text"], F.lit(CLOSE)))
    shown = views.withColumn("pieces", pieces)
    # where each message begins, and where its text does
    starts = F.expr(
        "aggregate(pieces, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + length(x))))"
    )
    shown = shown.withColumn("starts", starts)
    ranges = F.transform(
        "messages",
        lambda m, i: F.struct(
            (m["speaker"] == view).alias("own"),
            (F.get("starts", i) + F.length(_head(m["speaker"], view))).alias("begin"),
            (F.get("starts", i + 1) - 1).alias("end"),  # the line end after the end mark is not learned
        ),
    )
    shown = shown.withColumn("ranges", ranges)
    return shown.select(
        "conv_id", "sample", "perspective", "first_message",
        F.size("messages").cast("bigint").alias("n_messages"),
        F.concat_ws("", "pieces").alias("rendered"),
        F.expr("transform(filter(ranges, r -> r.own), r -> struct(r.begin as begin, r.end as end))").alias("mask"),
    )
