"""op8: all scripts through the transducer, state maps of chunks, long texts over several tasks."""

from __future__ import annotations

import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, "/opt/tokenizers")
import public_tokenizers

from turnweave.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SCRIPTS = "Привет мир Ελλάδα ΣΟΦΟΣ 漢字かなカナ。、「」한국어 العربية हिन्दी ไทย 😀👍🏽‍️ 　é́̈ İ ﬁ ½ a's 12"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in found.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture
def counts(monkeypatch):
    """Counts that may not ask the library."""
    found = tokens.WordCounts(PATH)

    def refuse(text):
        raise AssertionError(text)

    monkeypatch.setattr(found, "by_library", refuse)
    return found


def test_every_steady_character_counts_like_the_library(counts, library):
    private = lambda i: 0xD800 <= i < 0xF900 or i >= 0xF0000
    texts = [f"a{chr(i)}e1{chr(i)}" for i in range(0x80, 0x110000) if not private(i) and tokens.steady(chr(i))]
    assert len(texts) > 90_000
    own = [sum(counts.transducer.count(p) for p in counts.pieces(t)) for t in texts]
    assert own == library(texts)


def test_scripts_in_chunks_of_any_size(counts, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice([*SCRIPTS, "<|endoftext|>"]) for _ in range(rng.randint(0, 60))) for _ in range(1000)]
    for text, n in zip(texts, library(texts), strict=True):
        for size in (3, 9, 1 << 16):
            assert tokens.compose(tokens.chunk_map(c, counts) for c in tokens.cut(text.encode(), counts, size)) == n, (text, size)


@pytest.mark.parametrize("text", ["a" * 50_000, "漢" * 20_000, "哈哈" * 9_000 + "好", "_" * 50_000, "abcabd" * 9_000])
def test_maps_of_one_endless_word(counts, library, text):
    chunks = list(tokens.cut(text.encode(), counts, 1000))
    maps = [tokens.chunk_map(c, counts) for c in chunks]
    assert len(chunks) > 20 and chunks[-1][0] == tokens.LAST
    assert tokens.compose(maps) == library([text])[0]
    # a state that a map does not list is told, not guessed
    assert tokens.compose([maps[0], {"elsewhere": (tokens.BETWEEN, 1)}]) is None


def test_later_letters_are_left_to_the_library(library):
    counts = tokens.WordCounts(PATH)
    text = "plain \U0001e922\U00030000 text"
    assert not tokens.is_steady(text) and tokens.token_count(text.encode(), counts, 4) == library([text])[0]


def test_a_long_text_is_counted_by_several_tasks(spark, library):
    rng = random.Random(8)
    words = ["alpha", "Beta", "中文", "слово", "x" * 300, "don't", "42"]
    mixed = " ".join(rng.choice(words) for _ in range(150_000))
    texts = [mixed, mixed, "哈" * 700_000, "short", None, ""]
    docs = spark.createDataFrame([(i, t, "k", t) for i, t in enumerate(texts)], "doc_id int, text string, key string, c0 string")
    rows = tokens.token_counts(docs, PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == library([t or "" for t in texts])
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts]
    assert [(r.key, r.c0) for r in rows] == [("k", t) for t in texts]
    long = docs.where("doc_id < 1").select(F.lit("one").alias("key"), F.col("text").cast("binary").alias("text"))
    plan = tokens.long_counts(long, PATH)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(key#\d+, part#\d+", plan)
    chunks = long.mapInArrow(lambda b: tokens._chunks(PATH, tokens.CHUNK_BYTES, b), tokens._CHUNK_SCHEMA)
    tasks = chunks.repartition(8, "key", "part").select(F.spark_partition_id()).distinct().count()
    assert tasks > 1


def test_maps_compose_in_blocks(spark):
    states = {"": ("a", 1)}, {"a": ("b", 2), "x": ("", 9)}, {"b": ("", 3)}
    schema = "key string, part int, states map<string,struct<to:string,n:bigint>>"
    rows = [("k", i, m) for i, m in enumerate(states)] + [("gap", i, m) for i, m in enumerate((states[0], states[2]))]
    maps = spark.createDataFrame(rows, schema)
    for width in (1, 2, 5):
        whole = tokens._composed(tokens._composed(maps, width), 1 << 30)
        found = {r.key: r.n for r in whole.select("key", F.expr("try_element_at(states, '').n").alias("n")).collect()}
        assert found == {"k": 6, "gap": None}
