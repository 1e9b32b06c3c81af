"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from turnweave.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, top):
    """Counter of (item, rank, doc_id, score)."""
    bags = [(d, Counter(split(t))) for d, t in docs if split(t)]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in set(items):
        scores = []
        for doc, bag in bags:
            m = 100 - 25 + 25 * sum(bag.values()) * n_docs // length
            score = 0
            for t in split(text):
                if bag[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc if doc is not None else 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1):
            out[(item, rank, doc, -score)] += 1
    return out


def tables(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 5))) for _ in range(600)] + ["É", "ẞ9", "日本"]
    some = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, some(rng.randint(1, 120))) for i in range(400)]
    docs += [(1_000 + i, docs[7][1]) for i in range(60)] + [docs[3], docs[3], (None, docs[9][1]), (None, docs[9][1])]  # ties
    docs += [(2_000, None), (2_001, ""), (2_002, " ,.\n"), (2_003, some(40_000)), (2_004, "the " * 70_000 + docs[5][1].upper())]
    items = [(i, some(rng.randint(1, 30))) for i in range(25)]
    items += [(50, docs[7][1]), (50, docs[7][1]), (50, "other words here a b c"), (None, docs[5][1]), (51, None), (52, ""), (53, "nowhere-seen")]
    items += [(54, "É É ẞ9 日本, 日本")]
    return docs, items


def test_search_equals_scoring_all(spark, monkeypatch):
    for seed, block, sample in ((1, 64, 50), (2, 2_048, 8_192)):
        docs, items = tables(seed)
        monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
        monkeypatch.setattr(ranked, "SAMPLE_DOCS", sample)
        table = spark.createDataFrame([(d, t, "own", 5) for d, t in docs], "doc_id long, text string, score string, n int").repartition(5)
        queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
        index = ranked.build_index(table)
        for top in (20, 3):
            found = ranked.ranked_search(index, queries, top=top)
            assert found.columns == ["item_id", "rank", "doc_id", "score"]
            assert Counter(map(tuple, found.collect())) == by_hand(docs, items, top)


def test_many_passes_and_empty_tables(spark, monkeypatch):
    docs, items = tables(3)
    monkeypatch.setattr(ranked, "PASS_TERMS", 300)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame(items, "item_id long, text string")
    index = ranked.build_index(table)
    assert Counter(map(tuple, ranked.ranked_search(index, queries).collect())) == by_hand(docs, items, 20)
    assert ranked.ranked_search(index, queries.limit(0)).collect() == []
    assert ranked.ranked_search(ranked.build_index(table.limit(0)), queries).collect() == []
    named = table.selectExpr("concat('d', doc_id) as doc_id", "text").where("doc_id not in ('d2003', 'd7')")
    best = ranked.ranked_search(ranked.build_index(named), queries, top=1).where("item_id = 50 and score > 0").collect()
    assert "d1000" in {r.doc_id for r in best}  # least of equal ids, as text


def test_bounds_hold():
    counts = np.concatenate([np.arange(1, 5_000), 10 ** np.arange(1, 10)])
    named = ranked.STEPS[np.searchsorted(ranked.STEPS, counts)]
    assert (named >= counts).all() and (named[:128] == counts[:128]).all() and len(ranked.STEPS) == 256
