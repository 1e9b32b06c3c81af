"""Masked pseudo-likelihood of a bidirectional window network.

A word is predicted from two words on either side: the embeddings of the four
places are added, squashed, and give the class of the word and then the word
within its class.  Word counts over the whole corpus choose the vocabulary.  Words
beyond the commonest share entries by hash; the probability of a shared entry is
divided among its words by their counts, which come as a table of hashed counters
that grows with the number of distinct words.
Training is local: in each round every partition starts from the same parameters
and trains on its own words, and the average of what they learned, weighted by
words, starts the next round.  A text's score is the sum of the log-probabilities
of all its words, each predicted from both sides.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import ASCII_LOWER, Workspace, ship, utf8

CLASSES = 32
PER_CLASS = 32
VOCABULARY = CLASSES * PER_CLASS
#: entries at the end of the vocabulary shared by all other words, by hash
SHARED = 32
NAMED = VOCABULARY - SHARED
OFFSETS = (-2, -1, 1, 2)
WIDTH = 16
EDGE = VOCABULARY  # stands beyond both ends of a text
OTHERS = VOCABULARY + 1  # words without an entry of their own are numbered from here
#: a round trains on every word of the texts that its hash gives it; the rounds together meet every word once
ROUNDS = 3
RATE = 4.0
MINIBATCH = 4_096
BLOCK_WORDS = 8_192
#: counters of words in shared entries: as many as there are distinct words, a power of two between these
LEAST_COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 24
#: counters packed into one row on their way to the driver
COUNTER_ROW = 1 << 14
#: logits are held below this, so that no exponential overflows
HIGHEST = 80.0
#: parameters travel in rows of this many, as whole numbers of this fraction
ROW = 16
SCALE = float(1 << 24)

_SIZES = (
    ("places", (len(OFFSETS), VOCABULARY + 1, WIDTH)), ("shift", (WIDTH,)), ("to_class", (WIDTH, CLASSES)), ("class_bias", (CLASSES,)),
    ("to_word", (CLASSES, WIDTH, PER_CLASS)), ("word_bias", (CLASSES, PER_CLASS)),
)
TOTAL = sum(int(np.prod(s)) for _, s in _SIZES)


def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters in one flat array."""
    out, at = {}, 0
    for name, shape in _SIZES:
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def start_values(counts: np.ndarray) -> np.ndarray:
    """Small random embeddings; biases from the counts of vocabulary entries."""
    flat = np.random.default_rng(7).normal(0, 0.1, TOTAL).astype(np.float32)
    p = parts(flat)
    p["shift"][:] = 0
    table = counts.reshape(CLASSES, PER_CLASS) + 1.0
    p["class_bias"][:] = np.log(table.sum(axis=1) / table.sum())
    p["word_bias"][:] = np.log(table / table.sum(axis=1, keepdims=True))
    return flat


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; words as bytes, A-Z lower-cased."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(text.as_py().translate(ASCII_LOWER).split())
                if len(found) > 200_000:
                    yield rows()
                    found.clear()
        yield rows()

    ship(docs.sparkSession)
    partial_counts = docs.select(utf8().alias("text")).mapInArrow(count, "word binary, n bigint")
    return partial_counts.groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Word to its number: an entry, or beyond ``OTHERS`` the counter of a word without one, remembered up to a bound."""

    def __init__(self, named: dict[bytes, int], counters: int):
        super().__init__(named)
        self.counters = counters

    def __missing__(self, word: bytes) -> int:
        number = OTHERS + zlib.crc32(word) % self.counters
        if len(self) < 300_000:
            self[word] = number
        return number

    def __reduce__(self):
        return Vocabulary, (dict(self), self.counters)


def _pack(key: tuple, filled: pa.Table) -> pa.Table:
    """One row of counters; a count beyond 32 bits stays at their largest."""
    out = np.zeros(COUNTER_ROW, np.uint32)
    out[filled.column("slot").to_numpy() % COUNTER_ROW] = np.minimum(filled.column("n").to_numpy(), 2**32 - 1)
    return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "counters": pa.array([out.tobytes()], pa.binary())})


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The commonest words, in code-point order among equals, the count of each entry and the counters of all other words."""
    # collecting the limit itself would send as many rows from every partition to the driver
    both = counts.orderBy(F.desc("n"), "word").limit(NAMED).agg(F.collect_list(F.struct("n", "word")).alias("top")).first()["top"]
    top = sorted(both, key=lambda r: (-r["n"], bytes(r["word"])))  # a fixed number of rows
    size = LEAST_COUNTERS
    distinct = counts.count()
    while size < min(distinct, MOST_COUNTERS):
        size *= 2
    known = Vocabulary({bytes(r["word"]): i for i, r in enumerate(top)}, size)
    table = np.zeros(size, np.float64)
    slot = F.pmod(F.crc32("word"), F.lit(size))
    filled = counts.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"))
    rows = filled.groupBy(F.floor(F.col("slot") / COUNTER_ROW).cast("int").alias("row")).applyInArrow(_pack, "row int, counters binary")
    for r in rows.collect():  # a bounded table, four bytes a counter
        table[r["row"] * COUNTER_ROW : (r["row"] + 1) * COUNTER_ROW] = np.frombuffer(r["counters"], np.uint32)
    for r in top:
        table[zlib.crc32(bytes(r["word"])) % size] -= r["n"]
    n = np.zeros(VOCABULARY)
    n[: len(top)] = [r["n"] for r in top]
    n[NAMED:] = table.reshape(-1, SHARED).sum(axis=0)
    return known, n, table


def log_shares(table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log of a word's part of its shared entry, by counter; a word that was never counted stands like one counted once."""
    whole = np.tile(counts[NAMED:] + 1, len(table) // SHARED)
    return np.log(np.maximum(table, 1) / whole).astype(np.float32)


def entries_of(numbers: np.ndarray) -> np.ndarray:
    """Word numbers to vocabulary entries."""
    return np.where(numbers >= OTHERS, NAMED + (numbers - OTHERS) % SHARED, numbers)


def windows(texts: list[bytes], known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of all texts with edges between, places of words in them, and words per text."""
    lengths, ids = [], [EDGE, EDGE]
    for text in texts:
        words = text.translate(ASCII_LOWER).split()
        lengths.append(len(words))
        ids.extend(map(known.__getitem__, words))
        ids.extend((EDGE, EDGE))
    numbers = np.array(ids, np.int32)
    return numbers, np.flatnonzero(numbers != EDGE), np.array(lengths, np.int64)


def _softmax(x: np.ndarray) -> np.ndarray:
    np.minimum(x, HIGHEST, out=x)
    np.exp(x, out=x)
    x *= (1 / (x @ np.ones(x.shape[1], np.float32)))[:, None]
    return x


def _by_class(context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by the class of their target, that class, the place in it, and where each class begins."""
    home = (target // PER_CLASS).astype(np.int16)
    order = np.argsort(home, kind="stable")
    home = home.take(order)
    return order, home, (target % PER_CLASS).take(order), np.searchsorted(home, np.arange(CLASSES + 1))


def _hidden(p: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    hidden = p["places"][0].take(context[:, 0], axis=0)
    for o in range(1, len(OFFSETS)):
        hidden += p["places"][o].take(context[:, o], axis=0)
    hidden += p["shift"]
    return np.tanh(hidden, out=hidden)


def _word_logits(p: dict[str, np.ndarray], hidden: np.ndarray, home: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Logits of the words of each row's class; rows are runs of one class."""
    out = np.empty((len(hidden), PER_CLASS), np.float32)
    for c in range(CLASSES):
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            np.matmul(hidden[a:b], p["to_word"][c], out=out[a:b])
    out += p["word_bias"].take(home, axis=0)
    return out


def log_probs(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target given its context (rows of four entries)."""
    order, home, place, bounds = _by_class(context, target)
    hidden = _hidden(p, context.take(order, axis=0))
    rows = np.arange(len(target))
    found = np.zeros(len(target), np.float32)
    class_logits = hidden @ p["to_class"]
    class_logits += p["class_bias"]
    for logits, at in ((class_logits, home), (_word_logits(p, hidden, home, bounds), place)):
        np.minimum(logits, HIGHEST, out=logits)
        found += logits[rows, at]
        found -= np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))
    out = np.empty_like(found)
    out[order] = found
    return out


def learn_step(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step of gradient descent on a minibatch, in place."""
    n = len(target)
    # sorted by class once: a class is a run of rows
    order, home, place, bounds = _by_class(context, target)
    context = context.take(order, axis=0)
    hidden = _hidden(p, context)
    rows = np.arange(n)
    back = hidden @ p["to_class"]
    back += p["class_bias"]
    back = _softmax(back)
    back[rows, home] -= 1
    inner = _softmax(_word_logits(p, hidden, home, bounds))
    inner[rows, place] -= 1
    to_hidden = back @ p["to_class"].T
    step = rate / n
    p["to_class"] -= step * (hidden.T @ back)
    p["class_bias"] -= step * (np.ones(n, np.float32) @ back)
    for c in range(CLASSES):
        a, b = bounds[c], bounds[c + 1]
        if a < b:
            mine = inner[a:b]
            to_hidden[a:b] += mine @ p["to_word"][c].T
            # a class sees a part of the minibatch: it moves by the mean over that part
            scale = rate / (b - a) ** 0.5 / n**0.5
            p["to_word"][c] -= scale * (hidden[a:b].T @ mine)
            p["word_bias"][c] -= scale * (np.ones(b - a, np.float32) @ mine)
    np.multiply(hidden, hidden, out=hidden)
    np.subtract(1, hidden, out=hidden)
    to_hidden *= hidden
    p["shift"] -= step * to_hidden.sum(axis=0)
    # an embedding row sees few of the words of a minibatch: it moves by more than their mean
    to_hidden *= rate / n**0.5
    for o in range(len(OFFSETS)):
        by_entry = np.argsort(context[:, o].astype(np.int16), kind="stable")
        entry = context[:, o].take(by_entry)
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        p["places"][o][entry[first]] -= np.add.reduceat(to_hidden.take(by_entry, axis=0), first, axis=0)


def _train(flat: np.ndarray, known: Vocabulary, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What one partition learns: (row, weight, d0 ..), whole numbers that add up alike in any order."""
    mine = flat.copy()
    p = parts(mine)
    seen = 0
    for batch in batches:
        numbers, places, _ = windows(batch.column(0).to_pylist(), known)
        if not len(places):
            continue
        entries = entries_of(numbers)
        places = places[np.argsort((places * 2654435761) & 0xFFFFFFFF, kind="stable")]  # no text after text
        for at in np.array_split(places, -(-len(places) // MINIBATCH)):  # even, so that no step is a few words'
            context = np.stack([entries[at + o] for o in OFFSETS], axis=1)
            learn_step(p, context, entries[at], RATE / (1 + turn))
        seen += len(places)
    if seen:
        padded = np.zeros(-(-TOTAL // ROW) * ROW)
        padded[:TOTAL] = (mine.astype(np.float64) - flat) * seen
        moved = np.rint(padded.reshape(-1, ROW) * SCALE / 1024).astype(np.int64)
        rows = np.arange(len(moved))
        weight = np.full(len(rows), seen, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), pa.array(weight), *[pa.array(np.ascontiguousarray(moved[:, i])) for i in range(ROW)]],
            names=["row", "weight", *(f"d{i}" for i in range(ROW))],
        )


class Network:
    """Vocabulary, parameters, the count of each entry and the logs of the shares of words in shared entries."""

    def __init__(self, known: Vocabulary, flat: np.ndarray, counts: np.ndarray, shares: np.ndarray):
        self.known = known
        self.flat = flat
        self.counts = counts
        self.shares = shares


def train(docs: DataFrame, rounds: int = ROUNDS) -> Network:
    """Fit on all rows of ``docs``; what reaches the driver is the parameters and a bounded table of counters."""
    ship(docs.sparkSession)
    counts = Workspace(docs.sparkSession).save("words", word_counts(docs))
    known, n, table = vocabulary(counts)
    flat = start_values(n)
    texts = docs.select(utf8().alias("text"))
    # by content: no matter how rows are dealt over partitions and batches
    home = F.pmod(F.crc32("text"), F.lit(max(rounds, 1)))
    schema = "row int, weight bigint, " + ", ".join(f"d{i} bigint" for i in range(ROW))
    for turn in range(rounds):
        learned = texts.where(home == turn).mapInArrow(partial(_train, flat, known, turn), schema)
        sums = learned.groupBy("row").agg(F.sum("weight").alias("weight"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(ROW)])
        found = sums.orderBy("row").toPandas()  # one row per parameter row
        if not len(found):
            break
        moved = found[[f"d{i}" for i in range(ROW)]].to_numpy(np.float64) * (1024 / SCALE) / found[["weight"]].to_numpy(np.float64)
        flat = (flat + moved.reshape(-1)[:TOTAL]).astype(np.float32)
        p = parts(flat)
        for name in ("places", "to_class", "to_word"):
            np.clip(p[name], -4, 4, out=p[name])
    return Network(known, flat, n, log_shares(table, n))


def score_texts(texts: list[bytes], network: Network) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log-probability of each text."""
    p = parts(network.flat)
    numbers, places, lengths = windows(texts, network.known)
    entries = entries_of(numbers)
    found = np.empty(len(places), np.float64)
    for i in range(0, len(places), BLOCK_WORDS):
        at = places[i : i + BLOCK_WORDS]
        context = np.stack([entries[at + o] for o in OFFSETS], axis=1)
        found[i : i + BLOCK_WORDS] = log_probs(p, context, entries[at])
    words = numbers[places]
    other = np.flatnonzero(words >= OTHERS)
    found[other] += network.shares[words[other] - OTHERS]
    text = np.repeat(np.arange(len(texts)), lengths)
    return lengths, np.bincount(text, found, len(texts))


def _score(network: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, total = score_texts(batch.column(batch.num_columns - 1).to_pylist(), network)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(lengths, pa.int64()), pa.array(total, pa.float64())],
            names=[*batch.schema.names[:-1], "n_tokens", "log_prob"],
        )


def pseudo_likelihood(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` without its text, plus n_tokens, log_prob, perplexity and score.

    ``log_prob`` sums over all words of the whole text, each given the words
    around it and, in a shared entry, by its part of the entry's words;
    ``perplexity`` is ``exp(-log_prob / n_tokens)`` and ``score`` the mean
    log-probability of a word.  Null and empty texts have no words, log_prob 0 and
    neither perplexity nor score.  Repeated rows score alike; other columns are
    kept, unless named like a result; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    results = ("n_tokens", "log_prob", "perplexity", "score", "text")
    names = {c: f"k{i}" for i, c in enumerate(c for c in docs.columns if c not in results)}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()], utf8().alias("text"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    scored = rows.mapInArrow(partial(_score, network), ", ".join([*fields, "n_tokens bigint", "log_prob double"]))
    scored = scored.select(*[F.col(k).alias(c) for c, k in names.items()], "n_tokens", "log_prob")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.withColumn("perplexity", F.exp(-mean)).withColumn("score", mean)
