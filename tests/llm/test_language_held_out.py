"""op9 on rows it did not learn from: accuracy, odd rows, clashing names, no look at lang, source or doc_id."""

from __future__ import annotations

import os
import zlib

import pytest
from pyspark.sql import functions as F

from turnweave.llm import langid, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in queries.op9_language(spark, SF).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(found) == len(rows)
    assert all(found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    learned = {r.lang for r in rows if r.lang is not None and not found[r.doc_id].held_out}
    assert {f.lang_pred for f in found.values()} <= learned | {"und"}
    judged = [found[r.doc_id].lang_pred == r.lang for r in rows if found[r.doc_id].held_out and r.lang is not None and r.text]
    assert len(judged) > 50 and sum(judged) / len(judged) >= 0.95


def test_odd_rows_and_clashing_names(spark):
    train = spark.createDataFrame([("aa", "thing other " * 40), ("bb", "schupfen ungich " * 40)], "lang string, text string")
    model = langid.learn(train)
    long = "schupfen ungich " * 200_000
    rows = [(1, "aa", 0.5, long), (1, "aa", 0.5, long), (2, None, None, "thing other"), (None, "bb", 1.0, None), (3, "zz", 0.0, "")]
    docs = spark.createDataFrame(rows, "doc_id int, lang string, score double, text string").withColumn("spans", F.lit("mine"))
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "lang", "lang_pred", "score", "spans"]
    found = sorted((str(r.doc_id), r.lang_pred, r.score) for r in got.collect())
    assert found == [("1", "bb", 1.0), ("1", "bb", 1.0), ("2", "aa", 1.0), ("3", "und", 0.0), ("None", "und", 0.0)]
    assert langid.identify(docs.limit(0), model).count() == 0
    # the label of a row changes nothing in its prediction
    again = langid.identify(docs.withColumn("lang", F.lit("aa")), model)
    assert sorted((str(r.doc_id), r.lang_pred, r.score) for r in again.collect()) == found
