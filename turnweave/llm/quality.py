"""Quality rules in a short-circuit cascade.

Every rule is tried on a bounded sample of the texts, where its time and the
share of texts it rejects are measured.  The rules then run in the order of
rejections per second, and a text that one of them rejects meets no later one.
All rules must hold for a text to be kept, so the order never changes a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import ship, utf8

#: rows that the estimate of costs and rejections looks at, about
SAMPLE_ROWS = 2_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: characters that count as symbols
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


class Text:
    """A text as bytes; what rules ask for is computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line and not line.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:  # two windows of three need four words
            return 0
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, n)
        pairs = ids[:-1] * (len(known) + 1) + ids[1:]
        if len(known) < 1 << 20:
            windows = pairs[:-1] * (len(known) + 1) + ids[2:]
        else:  # too many words for one number: rank the pairs first
            windows = np.unique(pairs, return_inverse=True)[1][:-1].astype(np.int64) * (len(known) + 1) + ids[2:]
        order = np.argsort(windows, kind="stable")
        equal = np.diff(windows[order]) == 0
        twice = np.zeros(n - 2, bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        inside = np.zeros(n, bool)
        inside[:-2] |= twice
        inside[1:-1] |= twice
        inside[2:] |= twice
        return int(inside.sum())

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _UPPER))

    @cached_property
    def n_letters(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, _LETTERS))

    @cached_property
    def n_doubled(self) -> int:
        """Words equal to the word before them."""
        words = self.words
        return sum(map(bytes.__eq__, words[1:], words))


@dataclass(frozen=True)
class Rule:
    """``rejects`` tells whether a text fails the rule."""

    name: str
    rejects: Callable[[Text], bool]


def _few_words(t: Text) -> bool:
    return t.n_words < MIN_WORDS


def _repeats(t: Text) -> bool:
    return 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words


def _symbols(t: Text) -> bool:
    return 10 * t.n_symbols > t.n_words


def _same_lines(t: Text) -> bool:
    return 100 * t.n_dup_lines > 60 * len(t.lines)


def _shouting(t: Text) -> bool:
    return 100 * t.n_upper > 40 * t.n_letters


def _doubled(t: Text) -> bool:
    return 100 * t.n_doubled > 20 * t.n_words


def _word_length(t: Text) -> bool:
    return not 2 * t.n_words <= t.word_chars <= 15 * t.n_words


RULES = (
    Rule("few_words", _few_words),
    Rule("repeats", _repeats),
    Rule("symbols", _symbols),
    Rule("same_lines", _same_lines),
    Rule("shouting", _shouting),
    Rule("doubled", _doubled),
    Rule("word_length", _word_length),
)


def _trial(rules: Sequence[Rule], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per rule and task: texts tried, rejected, seconds; each rule on a fresh text."""
    tried = [0] * len(rules)
    rejected = [0] * len(rules)
    seconds = [0.0] * len(rules)
    for batch in batches:
        for raw in batch.column(0):
            raw = raw.as_py()
            for i, rule in enumerate(rules):
                begin = time.perf_counter()
                rejected[i] += rule.rejects(Text(raw))
                seconds[i] += time.perf_counter() - begin
                tried[i] += 1
    yield pa.RecordBatch.from_arrays(
        [pa.array([r.name for r in rules]), pa.array(tried, pa.int64()), pa.array(rejected, pa.int64()), pa.array(seconds)],
        names=["rule", "tried", "rejected", "seconds"],
    )


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """rule, tried, rejected, seconds on about ``sample_rows`` rows, picked by hash from all of ``docs``."""
    ship(docs.sparkSession)
    total = max(docs.count(), 1)
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    some = docs.where(chance < sample_rows / total).select(utf8().alias("text"))
    trials = some.mapInArrow(partial(_trial, rules), "rule string, tried bigint, rejected bigint, seconds double")
    return trials.groupBy("rule").agg(F.sum("tried").alias("tried"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))


def cascade_order(estimates: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules by rejections per second, highest first; ties and rules without an estimate as given."""
    found = {r["rule"]: (r["rejected"] / max(r["seconds"], 1e-9)) for r in estimates.collect()}  # one row per rule
    return sorted(rules, key=lambda r: -found.get(r.name, 0.0))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(rules: Sequence[Rule], features: Sequence[str], keep_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values: list[list[int]] = [[] for _ in features]
        verdicts = []
        for raw in batch.column(batch.num_columns - 1).cast(pa.binary()):
            text = Text(raw.as_py() or b"")
            verdicts.append(next((r.name for r in rules if r.rejects(text)), None))
            for column, feature in zip(values, features, strict=True):
                column.append(getattr(text, feature))
        kept = batch.num_columns - (not keep_text)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:kept], *[pa.array(v, pa.int64()) for v in values], pa.array(verdicts, pa.string())],
            names=[*batch.schema.names[:kept], *features, "rejected_by"],
        )


def judge(docs: DataFrame, order: Sequence[Rule], features: Sequence[str] = FEATURES, keep_text: bool = False) -> DataFrame:
    """``docs`` plus ``features`` and rejected_by, the first rule of ``order`` that fails, null if none does.

    A null text counts as empty: no words, so it fails ``few_words``.  The text
    itself goes unless ``keep_text``; other columns stay, unless named like a
    result.  Repeated rows stay.  No shuffle.
    """
    ship(docs.sparkSession)
    results = (*features, "rejected_by")
    kept = [c for c in docs.columns if c not in results and c != "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], "text")
    shown = rows.schema.fields if keep_text else rows.schema.fields[:-1]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in shown]
    schema = ", ".join([*fields, *(f"{f} bigint" for f in features), "rejected_by string"])
    return rows.mapInArrow(partial(_judge, tuple(order), tuple(features), keep_text), schema)


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, **options) -> DataFrame:
    """Estimate, order, judge."""
    return judge(docs, cascade_order(estimate(docs, rules, sample_rows), rules), **options)
