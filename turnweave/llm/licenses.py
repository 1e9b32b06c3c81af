"""Licence scan by an exact set-similarity join, in DataFrame operations only.

A text is covered by overlapping blocks of words and a template is a set of words;
a block meets a template when it holds at least ``threshold`` of the template's
words.  Words are ordered from rare to frequent over all documents.  A block that
meets a template of ``size`` words shares ``need = ceil(threshold * size)`` of
them, so the rarest word that both hold is among the first ``size - need + 1`` of
the template (prefix filter) and among the first ``length - need + 1`` of the
block, the block holds ``need`` template words at all (length filter), and behind
that word enough are left on both sides (positional filter).  Only blocks around
the templates' rare words leave the row; what passes the filters is intersected in
full.  Texts are read once; afterwards only places of template words are used.  A phrase is a template that must be held whole and whose words must then
stand consecutively.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.common import Workspace
from turnweave.llm.decontam import words

THRESHOLD = 0.8
#: a block holds twice as many words as the smallest step that takes its template whole
STEPS = (8, 16, 32, 64, 128, 256)
#: prefix words of templates up to this number are broadcast, more are joined by a shuffle
BROADCAST_ROWS = 100_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CODE_BITS = 20
_CODES_A_SLOT = 3


@dataclass(frozen=True)
class Template:
    """A labelled text; ``phrase`` asks for its words one after the other."""

    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(_WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in self.text))

    @property
    def step(self) -> int:
        fitting = [s for s in STEPS if s >= len(self.words)]
        if not fitting:
            raise ValueError(f"template {self.label!r} has more than {STEPS[-1]} words")
        return fitting[0]

    def need(self, threshold: float) -> int:
        """Words that a block must share with this template."""
        size = len(set(self.words))
        return size if self.phrase else max(1, ceil(Fraction(str(threshold)) * size))


# The phrases of the base labels and sentences of public licences.
PHRASES = (
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
)
LICENSES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template(
        "apache-2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template(
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ),
    Template("mit", "Released under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files, to deal in the Software without restriction",
    ),
)
TEMPLATES = PHRASES + LICENSES


def _numbers(values: Sequence[int], kind: str = "int") -> Column:
    """A constant array; one string that the optimizer folds, not one expression a value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _slots(hashes: Sequence[int]) -> list[int]:
    """A hash table of codes: up to three codes (plus one) packed into each slot."""
    size = 64
    while True:
        size *= 2
        chains: dict[int, list[int]] = {}
        for code, h in enumerate(hashes):
            chains.setdefault(h % size, []).append(code)
        if size >= 4 * len(hashes) and max(map(len, chains.values()), default=0) <= _CODES_A_SLOT:
            break
    return [sum(c + 1 << _CODE_BITS * i for i, c in enumerate(chains.get(s, ()))) for s in range(size)]


def _template_words(rows: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """``rows`` with ``hits`` in place of the text: (i, c), place and code of each of its words that a template has."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(w,) for w in vocabulary], "word string").select("word", F.xxhash64("word").alias("h"))
    hashes = {r["word"]: r["h"] for r in asked.collect()}  # the templates' words, a parameter
    slots = _slots([hashes[w] for w in vocabulary])
    others = [c for c in rows.columns if c != "text"]
    base = rows.select(*others, words().alias("w"))
    base = base.withColumns({"slots": _numbers(slots, "bigint"), "known": F.split(F.lit(",".join(vocabulary)), ",")})
    base = base.withColumn("v", F.expr(f"transform(w, x -> get(slots, cast(pmod(xxhash64(x), {len(slots)}) as int)))"))
    tried = " ".join(f"when get(known, {c}) = get(w, i) then struct(i as i, {c} as c)" for c in map(_packed, range(_CODES_A_SLOT)))
    hits = F.expr(f"filter(transform(v, (v, i) -> case when v = 0 then null {tried} end), x -> x is not null)")
    return base.select(*others, F.size("w").cast("bigint").alias("n_words"), hits.alias("hits"))


def _packed(i: int) -> str:
    return f"(cast(shiftright(v, {_CODE_BITS * i}) & {(1 << _CODE_BITS) - 1} as int) - 1)"


def _index(spark: SparkSession, templates: Sequence[Template], rank: dict[str, int], threshold: float) -> DataFrame:
    """One row per template and word of its prefix: what a block's word meets."""
    rows = []
    for t in templates:
        tokens, need = sorted({rank[w] for w in t.words}), t.need(threshold)
        for place, token in enumerate(tokens[: len(tokens) - need + 1]):
            rows.append((t.step, token, place, t.label, t.phrase, [rank[w] for w in t.words], tokens, need))
    schema = "t_step int, token int, place int, label string, phrase boolean, in_order array<int>, tokens array<int>, need int"
    index = spark.createDataFrame(rows, schema)
    return F.broadcast(index) if len(rows) <= BROADCAST_ROWS else index


def _met(docs: DataFrame, templates: Sequence[Template], threshold: float, carried: dict[str, str]) -> DataFrame:
    """Rows (uid, carried.., n_words, label, phrase, step, block, width, share, places), at least one a document.

    ``share`` is null in rows where no template is met.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    templates = [t for t in templates if t.words]
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), *[F.col(f"`{c}`").alias(k) for c, k in carried.items()], "text")
    space = Workspace(spark)
    rows = space.save("hits", _template_words(rows, vocabulary))

    # the global order: words that are rare over all documents come first; as many rows as words of templates
    found = rows.select(F.explode("hits.c").alias("c")).groupBy("c").count().collect()
    times = {vocabulary[r["c"]]: r["count"] for r in found}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (times.get(w, 0), w)))}
    steps = sorted({t.step for t in templates})
    least = {s: min(t.need(threshold) for t in templates if t.step == s) for s in steps}
    marks = [0] * len(vocabulary)  # of the steps with a template that has the word in its prefix
    for t in templates:
        mine = sorted(set(t.words), key=rank.get)
        for word in mine[: len(mine) - t.need(threshold) + 1]:
            marks[vocabulary.index(word)] |= 1 << steps.index(t.step)

    base = rows.withColumns({"marks": _numbers(marks), "ranks": _numbers([rank[w] for w in vocabulary])})
    # j is the number of the hit: the hits of a block are a slice around it
    seeds = "filter(transform(hits, (x, j) -> struct(x.i as i, j as j, get(marks, x.c) as m)), s -> s.m > 0)"
    base = base.withColumn("seeds", F.expr(seeds))
    base = base.withColumn("hits", F.expr("transform(hits, x -> struct(x.i as i, get(ranks, x.c) as r))"))
    blocks = []
    for bit, step in enumerate(steps):
        own = f"s{step}"
        base = base.withColumn(own, F.expr(f"transform(filter(seeds, s -> (s.m & {1 << bit}) <> 0), s -> struct(s.i div {step} as h, s.j as j))"))
        # a seed lies in two blocks; each block is shown by its first seed
        before = f"get({own}, n - 1).h"
        homes = (
            f"flatten(transform({own}, (s, n) -> array(if(s.h > 0 and (n = 0 or {before} < s.h - 1), struct(s.h - 1 as b, s.j as j), null), "
            f"if(n = 0 or {before} < s.h, struct(s.h as b, s.j as j), null))))"
        )
        around = f"slice(hits, greatest(x.j - {2 * step} + 1, 1), {4 * step})"
        blocks.append(
            f"transform(filter({homes}, x -> x is not null), x -> struct({step} as step, x.b as block, {least[step]} as least, "
            f"filter({around}, y -> y.i >= x.b * {step} and y.i < (x.b + 2) * {step}) as hits))"
        )
    nothing = "cast(array() as array<struct<step:int,block:bigint,least:int,hits:array<struct<i:int,r:int>>>>)"
    kept = ["uid", *carried.values(), "n_words"]
    shown = base.select(*kept, F.explode_outer(F.expr(f"concat({', '.join(blocks)})" if blocks else nothing)).alias("b"))
    shown = shown.select(*kept, "b", F.array_sort(F.array_distinct("b.hits.r")).alias("held"))
    # the block's own prefix, each word with its place; too short a block has none (length filter)
    prefix = F.expr("transform(slice(held, 1, greatest(size(held) - b.least + 1, 0)), (r, i) -> struct(r as token, i as i))")
    shown = shown.select(*kept, "b", "held", F.explode_outer(prefix).alias("p"))
    filters = (
        (F.col("b.step") == F.col("t_step"))
        & (F.col("p.token") == F.col("token"))
        & (F.size("held") >= F.col("need"))
        & (F.least(F.size("held") - F.col("p.i"), F.size("tokens") - F.col("place")) >= F.col("need"))
    )
    met = shown.join(_index(spark, templates, rank, threshold), filters, "left")
    # each pair once: at the rarest word that both hold
    shared = F.array_sort(F.array_intersect("held", "tokens"))
    met = met.withColumn("shared", shared)
    pair = (F.size("shared") >= F.col("need")) & (F.get("shared", F.lit(0)) == F.col("token"))
    # places of a phrase that begin in the first half; those in the second half are the next block's
    length = "size(in_order)"
    stands = (
        f"x.i < (b.block + 1) * b.step and get(b.hits, k + {length} - 1).i = x.i + {length} - 1 "
        f"and slice(b.hits.r, k + 1, {length}) = in_order"
    )
    places = F.expr(f"filter(transform(b.hits, (x, k) -> if({stands}, x.i, null)), x -> x is not null)")
    return met.select(
        *kept, "label", "phrase", F.col("b.step").alias("step"), F.col("b.block").alias("block"),
        F.size("in_order").alias("width"), F.when(pair, F.size("shared") / F.size("tokens")).alias("share"), F.when(pair & F.col("phrase"), places).alias("places"),
    )


def license_blocks(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every text block that meets a template: ``docs`` without its text, plus label, first_word, end_word, share.

    ``share`` is the part of the template's distinct words that the block, words
    ``first_word`` up to before ``end_word`` of the text, holds.  Blocks of a
    template overlap by half, so neighbouring blocks may both meet it.  A phrase
    gives the span of each of its places instead.  Nulls, repeated rows and
    clashing names as in ``license_labels``; texts without a match give no row.
    """
    results = ("label", "first_word", "end_word", "share")
    carried = {c: f"k{i}" for i, c in enumerate(c for c in docs.columns if c not in (*results, "text"))}
    met = _met(docs, templates, threshold, carried).where("share is not null")
    first = F.col("block") * F.col("step")
    span = F.when(
        F.col("phrase"), F.transform("places", lambda p: F.struct(p.cast("bigint").alias("first"), (p + F.col("width")).cast("bigint").alias("end")))
    ).otherwise(F.array(F.struct(first.alias("first"), F.least(first + 2 * F.col("step"), F.col("n_words")).alias("end"))))
    return met.select(*carried.values(), "label", "share", F.explode(span).alias("s")).select(
        *[F.col(k).alias(c) for c, k in carried.items()], "label", F.col("s.first").alias("first_word"), F.col("s.end").alias("end_word"), "share"
    )


def license_labels(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without its text, plus n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word``
    are their smallest and largest start (words from 0, null without a place).
    ``base_labels`` are those of phrases found, ``labels`` also those of templates
    met by a block, each distinct, sorted and joined by commas.  ``score`` is the
    largest share of a template found in a block, 1 where a phrase stands, 0 where
    nothing was found.

    Null and empty texts have no words and no labels; texts of any length are read
    whole, in blocks.  Every row of ``docs`` gives one row, repeated rows and rows
    of one doc_id too; an empty table gives none.  Other columns are kept; an own
    column named like one of the results is replaced.
    """
    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    carried = {c: f"k{i}" for i, c in enumerate(c for c in docs.columns if c not in (*results, "text"))}
    met = _met(docs, templates, threshold, carried)
    stands = F.coalesce(F.size("places"), F.lit(0)) > 0
    found = F.col("share").isNotNull() & (~F.col("phrase") | stands)
    gathered = met.groupBy("uid", *carried.values(), "n_words").agg(
        F.sum(F.when(stands, F.size("places")).otherwise(0)).cast("bigint").alias("n_base"),
        F.min(F.when(stands, F.array_min("places"))).cast("bigint").alias("first_word"),
        F.max(F.when(stands, F.array_max("places"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(stands, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(found, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return gathered.select(*[F.col(k).alias(c) for c, k in carried.items()], *results)
