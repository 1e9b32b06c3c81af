"""Licence scan against counting in plain Python."""

import random
import re
from collections import Counter
from math import ceil

import pytest

from turnweave.llm import licenses
from turnweave.llm.licenses import Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(text, templates, threshold):
    """(n_words, n_base, first, last, base labels, labels, score), block by block and word by word."""
    words = WORD.findall((text or "").translate(LOWER))
    places, base, labels, score = [], set(), set(), 0.0
    for t in templates:
        size = len(t.words)
        if t.phrase:
            here = [i for i in range(len(words)) if words[i : i + size] == t.words]
            places += here
            if here:
                base.add(t.label)
                score = 1.0
            continue
        need = max(1, ceil(round(threshold * 100) * len(set(t.words)) / 100))
        for start in range(0, max(len(words), 1), t.step):
            share = len(set(words[start : start + 2 * t.step]) & set(t.words))
            if share >= need:
                labels.add(t.label)
                score = max(score, share / len(set(t.words)))
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
    )


def texts():
    rng = random.Random(11)
    pool = [w for t in licenses.TEMPLATES for w in t.words] + ["zeta", "omega", "ouvrir"] * 40
    out = [None, "", " \n ", "CC BY", "cc\nby cc-by", "CC by" * 3, "Ünï cc_by ÇC BY", "all rights", "x " * 50_000 + "all rights reserved"]
    out += ["cc by " * 3_000]
    for t in licenses.TEMPLATES:
        out += [t.text, t.text.upper(), " ".join(random.Random(1).sample(t.words, len(t.words)))]
        for offset in (0, 5, 7, 8, 9, 31, 33, 64):
            out.append("word " * offset + t.text + " tail" * 9)
        for _ in range(6):  # words lost, at and around the threshold
            left = [w for w in t.words if rng.random() > 0.2]
            out.append("lead " * rng.randint(0, 40) + " ".join(left) + " rest" * rng.randint(0, 40))
    out += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_labels_equal_counting(spark, threshold):
    rows = [(i, t, f"own {i}") for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, "cc by", None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    found = licenses.license_labels(docs, threshold=threshold)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = Counter((r[0], *by_hand(r[1], licenses.TEMPLATES, threshold)) for r in rows)
    assert Counter(map(tuple, found.collect())) == want


def test_other_columns_empty_table_no_templates(spark):
    docs = spark.createDataFrame([(1, "see the MIT License, released under", "a", 2)], "doc_id long, text string, step string, block int")
    row = licenses.license_labels(docs).first()
    assert (row.step, row.block, row.labels, row.score) == ("a", 2, "mit", 1.0)
    assert licenses.license_labels(docs.limit(0)).collect() == []
    bare = licenses.license_labels(docs, templates=[]).first()
    assert (bare.n_words, bare.n_base, bare.labels, bare.score) == (6, 0, "", 0.0)
    with pytest.raises(ValueError):
        licenses.license_labels(docs, threshold=0)
    with pytest.raises(ValueError):
        licenses.license_labels(docs, templates=[Template("long", "w " * 300)])


def test_blocks_give_spans(spark):
    docs = spark.createDataFrame([(1, "a b c all rights reserved d"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in licenses.license_blocks(docs).collect()] == [(1, "reserved", 3, 6, 1.0)]
    many = [Template(f"t{i}", f"alpha{i} beta{i} gamma{i} delta{i} shared") for i in range(400)]
    docs = spark.createDataFrame([(1, "alpha7 beta7 gamma7 shared x delta399 gamma399 beta399 alpha399")], "doc_id long, text string")
    assert {r.label: r.share for r in licenses.license_blocks(docs, many).collect()} == {"t7": 0.8, "t399": 1.0}


def test_index_of_many_templates_is_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "cc by and all rights reserved")], "doc_id long, text string")
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 0)
    assert licenses.license_labels(docs).first().base_labels == "cc-by,reserved"
