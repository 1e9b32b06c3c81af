"""Corpus operators against brute force, on odd rows: nulls, empty, long, repeated, clashing columns."""

import hashlib
import io
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from turnweave.llm import chat, decontam, langid, mixing, neardup, pseudolm, quality, sharding, tokens, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, 160))) for _ in range(60)]
    out = list(base)
    for text in base[:25]:
        words = text.split()
        for _ in range(3):
            copy = [w if rng.random() > 0.02 else rng.choice(vocab) for w in words]
            out.append(" ".join(copy))
        out.append(text.upper())
    out += [None, "", " \n\t ", "one", "One", "two words", base[0], "é Ünïcode ß ẞ Σς", "x " * 30_000, "a\nb\na\nb"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 5}" if i % 7 else None, i) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[0], None, "src0", 0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_words long")


def shingles(text, k):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset((k, *words[i : i + k]) for i in range(len(words) - k + 1))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, texts, k):
    rows = [(r.doc_id, shingles(r.text, k)) for r in docs.collect()]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (doc_id, s) in enumerate(rows):
        if s and doc_id is not None:
            r = find(i)
            least[r] = doc_id if least[r] is None else min(least[r], doc_id)
    want = Counter((d, len(s), least[find(i)] if s else d, (least[find(i)] if s else d) == d) for i, (d, s) in enumerate(rows))
    assert Counter(tuple(r) for r in neardup.near_duplicates(docs, shingle=k).collect()) == want
    assert neardup.near_duplicates(empty(spark)).collect() == []


def test_large_bucket_meets_in_blocks(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in rng.sample(range(120), rng.randint(0, 9)):
            words[j] = f"x{i}-{j}"
        rows.append((i, " ".join(words)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [shingles(t, 5) for _, t in rows]
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = min(label[i], label[j])
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == label


def test_similarities_beyond_the_bands_are_refused(spark):
    for percent in (79, 101):
        with pytest.raises(ValueError):
            neardup.near_duplicates(empty(spark), percent=percent)


def test_vocabulary_takes_the_commonest_words(spark):
    texts = ["b a", "B c a", None, "", " ".join(f"w{i}" for i in range(1_500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known, n, table = pseudolm.vocabulary(pseudolm.word_counts(docs))
    named = pseudolm.VOCABULARY - pseudolm.SHARED
    count = Counter(w for t in texts if t for w in t.lower().split())
    want = sorted(count, key=lambda w: (-count[w], w))[:named]
    assert [known[w.encode()] for w in want] == list(range(named))
    assert n[:named].tolist() == [count[w] for w in want] and n.sum() == sum(count.values())
    others = Counter()
    for w in count.keys() - set(want):
        assert known[w.encode()] == pseudolm.OTHERS + zlib.crc32(w.encode()) % len(table)
        others[zlib.crc32(w.encode()) % len(table)] += count[w]
    assert {i: table[i] for i in np.flatnonzero(table)} == others


def test_learning_step_equals_a_plain_loop():
    rng = np.random.default_rng(1)
    flat = rng.normal(0, 0.3, pseudolm.TOTAL).astype(np.float32)
    target = np.minimum(rng.zipf(1.2, 300), pseudolm.VOCABULARY) - 1
    context = np.minimum(rng.zipf(1.2, (300, 4)), pseudolm.VOCABULARY + 1) - 1
    rate, n = 0.5, len(target)
    p, want = pseudolm.parts(flat.copy()), {k: v.astype(np.float64) for k, v in pseudolm.parts(flat).items()}
    grad = {k: np.zeros(v.shape) for k, v in want.items()}
    seen = Counter((target // pseudolm.PER_CLASS).tolist())
    for row, t in zip(context, target):
        c, j = divmod(int(t), pseudolm.PER_CLASS)
        hidden = np.tanh(want["shift"] + sum(want["places"][o][row[o]] for o in range(4)))
        outer = np.exp(hidden @ want["to_class"] + want["class_bias"])
        inner = np.exp(hidden @ want["to_word"][c] + want["word_bias"][c])
        outer, inner = outer / outer.sum(), inner / inner.sum()
        outer[c] -= 1
        inner[j] -= 1
        back = (want["to_class"] @ outer + want["to_word"][c] @ inner) * (1 - hidden * hidden)
        grad["to_class"] += np.outer(hidden, outer) / n
        grad["class_bias"] += outer / n
        grad["to_word"][c] += np.outer(hidden, inner) / (seen[c] * n) ** 0.5
        grad["word_bias"][c] += inner / (seen[c] * n) ** 0.5
        grad["shift"] += back / n
        for o in range(4):
            grad["places"][o][row[o]] += back / n**0.5
    pseudolm.learn_step(p, context.astype(np.int32), target.astype(np.int32), rate)
    for k in want:
        assert np.abs(p[k] - (want[k] - rate * grad[k])).max() < 1e-4, k


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(0)
    for n, shared in ((40, 30), (400, 300), (5000, 4000)):
        both = rng.integers(0, 2**64, shared, np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, n - shared, np.uint64)])) for _ in range(2))
        share, least = neardup.estimates(neardup.fine_registers(a), neardup.fine_registers(b)[None, :], len(a), np.array([len(b)]))
        assert abs(share[0] - shared / (2 * n - shared)) < 0.08 and least[0] < 0.8


def brute_contamination(docs, items):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = cut.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = Counter()
    for doc_id, text in docs:
        words = cut.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if items_hit := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= items_hit
        names = sorted(str(i) for i in found if i is not None)
        out[doc_id, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_decontamination(spark, docs, texts):
    words = [t.split() for t in texts[:8]]
    items = [(1, " ".join(words[0][:40])), (2, " ".join(words[1][3:14])), (2, "x x x"), (3, ""), (4, None), (5, "one"), (None, " ".join(words[2][:12])),
             (6, " ".join(words[3][:9])), (7, " ".join(words[0][:40])), (8, "x " * 25)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated_words(docs.select("doc_id", "text", "n_words"), bench)
    assert Counter(tuple(r) for r in found.collect()) == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], items)
    assert decontam.contaminated_words(docs.select("doc_id", "text"), bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contaminated_words(empty(spark), bench).count() == 0


def test_benchmark_items_are_winnowed(spark, monkeypatch):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randint(0, 10_000)}" for _ in range(2_000))
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    prints = decontam.benchmark_fingerprints(bench)
    places = {tuple(r.ctx): r.fp for r in prints.collect()}
    assert len(places) < 0.45 * (2_000 - 4)  # about 2 in 7 grams are the smallest of some window
    # a larger bitmap gives the same rows
    words = long.split()
    docs = spark.createDataFrame([(i, " ".join(words[7 * i : 7 * i + 9 + i % 3])) for i in range(200)], "doc_id long, text string")
    found = Counter(map(tuple, decontam.contaminated_words(docs, bench).collect()))
    assert found == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(1, long)])
    monkeypatch.setattr(decontam, "LEAST_LONGS", 1)
    assert Counter(map(tuple, decontam.contaminated_words(docs, bench).collect())) == found


def test_decontamination_by_items_of_every_length(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(60)) for _ in range(24)]
    # items of 1 to 12 words: inside, at the start, at the end of a text, and alone with a long item of the same words
    items = [(n, " ".join(texts[n].split()[at : at + n])) for n in range(1, 13) for at in (0, 20, 60 - n)]
    items += [(100, " ".join(texts[20].split()[:5])), (101, " ".join(texts[20].split()[:30])), (102, " ".join(texts[21].split()[:5])), (102, texts[5])]
    docs = [*enumerate(texts), (30, " ".join(texts[5].split()[:5])), (31, " ".join(texts[5].split()[:4])), (32, None)]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    for some in (items, [i for i in items if i[0] == 5]):
        found = decontam.contaminated_words(docs_df, spark.createDataFrame(some, "item_id long, text string"))
        assert Counter(tuple(r) for r in found.collect()) == brute_contamination(docs, some)


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i, f"text {i % 900} " + "y" * (i * 37 % 500)) for i in range(4000)] + [(10_000 + i, "hot " * 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.octet_length("text") + 16)
    found = sharding.shard_by_size(df, 10, F.xxhash64("text"), F.xxhash64("doc_id"), F.col("size")).collect()
    size, slots, home = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        home[r.text].add(r.shard)
    mean = sum(size.values()) / 10
    assert len(found) == 6000 and set(size) == set(range(10))
    assert max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in home.items() if not t.startswith("hot"))


def test_shards_of_odd_rows(spark, docs):
    found = sharding.shard_by_size(docs, 4, F.xxhash64("text"), F.col("doc_id"), F.octet_length("text")).collect()
    assert len(found) == docs.count() and {r.shard for r in found} <= set(range(4))
    assert sharding.shard_by_size(empty(spark), 4, F.xxhash64("text"), F.col("doc_id"), F.octet_length("text")).count() == 0


def test_mixing_targets_and_places(spark, docs):
    found = mixing.training_schedule(docs, mixing.word_count(), slice_rows=20).collect()
    again = mixing.training_schedule(docs, mixing.word_count(), slice_rows=10_000).collect()
    key = lambda r: (str(r.doc_id), r["size"], str(r.source), r.taken, r.positions)
    assert sorted(map(key, found)) == sorted(map(key, again))  # slices change nothing
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    taken, largest = Counter(), Counter()
    for r in found:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r["size"]
        assert len(r.positions) == r.copies and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in names)
    assert mixing.training_schedule(empty(spark), mixing.word_count()).count() == 0


def test_ramp_inverts(spark):
    row = spark.range(101).select((F.col("id") / 100).alias("x"))
    for slope in (0.5, -0.5, 0.0):
        back = row.select("x", mixing.given(mixing.due(F.col("x"), F.lit(slope)), F.lit(slope)).alias("y"))
        assert all(abs(r.x - r.y) < 1e-9 for r in back.collect())


def test_quality_features_and_order(spark, docs):
    found = quality.quality_cascade(docs).collect()
    assert len(found) == docs.count() and "n_words" in found[0].asDict()
    for r in quality.judge(docs.select(F.col("text").alias("copy"), "text"), quality.RULES).collect():
        text = (r.copy or "").encode()
        words = text.split()
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert r.n_words == len(words) and r.n_repeat_words == len(inside) and r.word_chars == sum(len(w.decode()) for w in words)
    plans = [quality.judge(docs, order).where("rejected_by is null").select("doc_id").collect() for order in (quality.RULES, quality.RULES[::-1])]
    assert sorted(map(str, plans[0])) == sorted(map(str, plans[1]))  # order changes no verdict
    assert quality.quality_cascade(empty(spark)).count() == 0
    ordered = quality.cascade_order(quality.estimate(docs))
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality.RULES)


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for chunk in (7, 1 << 16):
        for r in tokens.token_counts(docs.withColumn("copy", F.col("text")), path, limit=100, chunk_bytes=chunk).collect():
            assert r.n_tokens == count(r.copy or "") and r.n_bytes == len((r.copy or "").encode()) and r.over_limit == (r.n_tokens > 100)
    counts = tokens.WordCounts(path)
    rng = random.Random(5)
    signs = "abcXYZ019'’ \t\n\x1c\x85\xa0.,!?-_<|>éÉßñİıǅ²½ªº中文ΣςЖ́😀"
    for _ in range(1500):
        t = "".join(rng.choice([*signs, "<|endoftext|>", "don't", "I'LL", "the"]) for _ in range(rng.randint(0, 40)))
        assert tokens.token_count(t.encode(), counts, rng.choice([3, 16, 1 << 16])) == count(t), repr(t)
    assert tokens.token_counts(empty(spark), path).count() == 0


def test_language_spans(spark):
    rng = random.Random(2)
    parts = {"aa": ["tha", "ing", "oul", "wer"], "bb": ["schu", "pfe", "ung", "ich"], "cc": ["жук", "что", "они"]}
    say = lambda k, n: " ".join("".join(rng.choice(parts[k]) for _ in range(2)) for _ in range(n))
    train = spark.createDataFrame([(k, say(k, 60)) for k in parts for _ in range(20)], "lang string, text string")
    model = langid.learn(train)
    rows = [(0, say("aa", 30)), (1, say("bb", 30)), (2, say("cc", 30)), (3, say("aa", 20) + " " + say("bb", 40)), (4, None), (5, ""), (6, "12 — ٣"), (7, "ʰ")]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [found[i].lang_pred for i in range(8)] == ["aa", "bb", "cc", "bb", "und", "und", "und", found[7].lang_pred]
    assert found[7].lang_pred in parts and [tuple(s) for s in found[3].spans] == [("aa", 0, 20), ("bb", 20, 40)]
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = langid.learn(train.limit(0))
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), nothing).collect()} == {"und"}


def test_best_path_is_the_best(spark):
    rng = np.random.default_rng(0)
    lengths = np.array([6, 4, 4, 1])
    scores = rng.normal(size=(15, 3)).astype(np.float32)
    starts = np.cumsum(lengths) - lengths
    labels = langid.best_path(scores, starts, lengths, 0.7)
    import itertools

    value = lambda s, path: sum(s[i, k] for i, k in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
    for a, n in zip(starts, lengths):
        s = scores[a : a + n]
        best = max(value(s, p) for p in itertools.product(range(3), repeat=int(n)))
        assert value(s, labels[a : a + n]) == pytest.approx(best, abs=1e-4)


def test_pseudo_likelihood(spark, docs):
    rng = random.Random(4)
    lines = ["the cat sat on the mat and the dog ran", "a bird flew over the house in the rain"]
    corpus = spark.createDataFrame([(i, " ".join(rng.choice(lines) for _ in range(40))) for i in range(200)], "doc_id long, text string")
    network = pseudolm.train(corpus)
    natural = " ".join(lines * 5)
    mixed = natural.split()
    rng.shuffle(mixed)
    _, scores = pseudolm.score_texts([natural.encode(), " ".join(mixed).encode()], network)
    assert scores[0] > scores[1]
    p = pseudolm.parts(network.flat)
    ids = [pseudolm.EDGE] * 2 + [network.known[w] for w in natural.encode().split()] + [pseudolm.EDGE] * 2
    total = 0.0
    for i in range(2, len(ids) - 2):
        hidden = np.tanh(p["shift"] + sum(p["places"][k][ids[i + o]] for k, o in enumerate(pseudolm.OFFSETS)))
        c, j = divmod(ids[i], pseudolm.PER_CLASS)
        for logits, at in ((hidden @ p["to_class"] + p["class_bias"], c), (hidden @ p["to_word"][c] + p["word_bias"][c], j)):
            total += logits[at] - np.log(np.exp(logits).sum())
    assert scores[0] == pytest.approx(total, rel=1e-4)
    found = pseudolm.pseudo_likelihood(docs, network).collect()
    assert len(found) == docs.count() and all((r.perplexity is None) == (r.n_tokens == 0) for r in found)
    assert pseudolm.pseudo_likelihood(empty(spark), pseudolm.train(empty(spark))).count() == 0


def test_rare_words_share_an_entry_by_their_counts(spark):
    named, shared = pseudolm.VOCABULARY - pseudolm.SHARED, pseudolm.SHARED
    common = [f"c{i}" for i in range(named)]
    rare = [f"r{i}" for i in range(200)]
    texts = [" ".join(common * 5)] + [" ".join(rare[: 200 // (i + 1)]) for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    network = pseudolm.train(docs, rounds=1)
    count = Counter(w for t in texts[1:] for w in t.split())
    whole = Counter()
    for w, n in count.items():
        whole[zlib.crc32(w.encode()) % shared] += n
    asked = ["c1 r0 c2", "c1 r199 r199 c2", "c1 gibberish c2", "c1 c2", "", None]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(asked)], "uid long, rare string, text string")
    found = {r.uid: r for r in pseudolm.pseudo_likelihood(rows, network).collect()}
    assert [found[i].rare for i in range(6)] == asked
    bare = pseudolm.Network(network.known, network.flat, network.counts, np.zeros_like(network.shares))
    _, plain = pseudolm.score_texts([(t or "").encode() for t in asked], bare)
    for i, t in enumerate(asked):
        shares = [np.log(count.get(w, 1) / (whole[zlib.crc32(w.encode()) % shared] + 1)) for w in (t or "").split() if w[0] in "rg"]
        assert found[i].log_prob == pytest.approx(plain[i] + sum(shares), abs=1e-4)


def test_every_word_is_trained_on(spark):
    texts = [f"a{i} b{i} c{i}" for i in range(300)]
    network = pseudolm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    before, after = pseudolm.parts(pseudolm.start_values(network.counts)), pseudolm.parts(network.flat)
    place = dict(zip(pseudolm.OFFSETS, range(4)))
    for text in texts:
        a, b, c = (network.known[w.encode()] for w in text.split())
        # what stands beside a word moves only when the word is a target
        for offset, beside in ((1, b), (-1, a), (-1, b)):
            assert (after["places"][place[offset], beside] != before["places"][place[offset], beside]).any(), text


def test_archives_round_trip(spark):
    big = "<html>" + "ü" * 200
    rows = [(5, "http://a/ b\n", big), (2, "http://b", big), (2, "http://b", big), (9, None, big), (None, "http://c", big), (1, "u", "short"),
            (3, "u", "short"), (4, "v", None), (6, "w", ""), (7, "x", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    back = warc.round_trip(pages, package_bytes=400).collect()
    want = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        refers = 2 if html == big and page_id != 2 else None
        want.append((str(page_id), len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
        assert refers is not None or any(r.page_id == page_id and r.payload == raw for r in back)
    assert sorted(want, key=str) == sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_directory_of_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w", zipfile.ZIP_STORED, allowZip64=True) as out:
        out.comment = b"PK\x05\x06 in a comment"
        for i in range(5):
            with out.open(f"m{i}", "w", force_zip64=True) as member:
                member.write(bytes([65 + i]) * (20 + i))
    size = len(file.getvalue())
    for i, member in enumerate(warc.read_directory(file, size)):
        at = warc.member_place(file, member)
        assert file.getvalue()[at : at + member.size] == bytes([65 + i]) * (20 + i)
    with pytest.raises(ValueError):
        warc.read_directory(io.BytesIO(b"x" * 100), 100)


TURNS = "conv_id long, turn long, role string, text string"


def rendered_by_hand(rows, size=64):
    """{(conv, sample, perspective): (first message, messages, text, own ranges)} and one entry a message without dialogue."""
    talks = defaultdict(list)
    for i, (conv, turn, role, text) in enumerate(rows):
        talks[conv if conv is not None else ("alone", i)].append((turn is None, turn or 0, role or "unknown", text or ""))
    out = Counter()
    for conv, told in talks.items():
        told.sort()
        for view in {s for _, _, s, _ in told} - {"system"}:
            for first in range(0, len(told), size):
                some = told[first : first + size]
                some = [t for t in told[:first] if t[2] == "system"][-1:] + some
                page, own = "", []
                for _, _, role, text in some:
                    name = "system" if role == "system" else "assistant" if role == view else f"user name={role}"
                    page += f"<|im_start|>{name}\n"
                    begin = len(page)
                    page += f"{text}<|im_end|>\n"
                    if role == view:
                        own.append((begin, len(page) - 1))
                out[(None if isinstance(conv, tuple) else conv, first // size, view, first, len(some), page, tuple(own))] += 1
    return out


def test_perspectives(spark):
    rng = random.Random(6)
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé\nyou"), (1, 3, "ann", None), (1, None, None, "late"), (1, 70, "bob", "again"),
            (None, 0, "ann", "alone"), (None, 0, "ann", "alone"), (3, 0, "system", "only")]
    # 200 turns: a speaker silent after the first slices, a second system message, turns without a number, equal rows
    rows += [(4, i, "system" if i in (0, 150) else "cy" if i == 5 else ("ann", "bob")[i % 2], f"m{i}") for i in range(200)]
    rows += [(4, None, rng.choice(["ann", "bob", None]), f"x{i % 40}") for i in range(90)] + [(4, 7, "bob", "same")] * 70
    rows += [(5, 0, "ann", "long " * 40_000), (5, 1, "bob", "")]
    table = spark.createDataFrame([(*r, "own") for r in rows], TURNS + ", rendered string")
    shown = chat.perspectives(table)
    assert shown.columns == ["conv_id", "sample", "perspective", "first_message", "n_messages", "rendered", "mask"]
    found = Counter((*tuple(r)[:6], tuple((m.begin, m.end) for m in r.mask)) for r in shown.collect())
    assert found == rendered_by_hand(rows)
    views = {(r[0], r[1]): {x[2] for x in found if x[:2] == r[:2]} for r in found if r[0] == 4}
    assert len(views) == 6 and all(v == {"ann", "bob", "cy", "unknown"} for v in views.values())
    assert chat.perspectives(table.limit(0)).collect() == []
    plan = shown._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} <= ids, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
    last = pipeline.STAGES[4][1](spark, docs, folder).collect()
    assert len(last) == docs.count() and {r.shard for r in last} <= set(range(40))


def test_pipeline_keeps_one_row_of_each_group(spark, texts, monkeypatch, tmp_path):
    """Null and repeated ids: every group keeps its first row, unique texts all stay; run() against brute force."""
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    fresh = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(80))
    near = lambda t, n: [t + f" end{i}" for i in range(n)]
    rows = [(1, fresh()), (2, fresh()), (None, fresh()), (None, fresh()), (7, fresh()), (7, fresh()), (None, None), (None, ""), (9, "")]
    rows += [(None, near(rows[0][1], 1)[0])]  # near a row with an id
    rows += [(7, near(rows[1][1], 1)[0])]  # a repeated id, of which one text is a near copy
    rows += [(None, t) for t in near(fresh(), 3)]  # a group without ids
    rows += [(4, t) for t in near(fresh(), 3)] + [(3, "A b c d e f"), (5, "a B c d e f")]
    rows += rows[:3] + rows[-4:]
    sets = [shingles(t, 5) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = min(label[i], label[j])
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    groups = defaultdict(list)
    for (d, t), s, g in zip(rows, sets, label, strict=True):
        groups[g if s else (d, t)].append((d is None, d or 0, hashed[t], d, t))
    want = Counter(min(g)[3:] for g in groups.values())
    found = pipeline.near_dup_stage(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in found.collect()) == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # short rows are not what the quality rules or the mix are asked about here
    whole = [s for s in pipeline.STAGES if s[0] not in ("quality_rules", "source_mixing")]
    monkeypatch.setattr(pipeline, "STAGES", whole)
    assert Counter((r.doc_id, r.text) for r in pipeline.run(spark, str(tmp_path)).collect()) == want
