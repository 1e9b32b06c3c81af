"""Languages of spans and texts: script ranges, per-word scores, Viterbi.

Learned from labelled texts: how often hashed character trigrams occur in each
language, and which scripts a language is written in.  A word's script leaves the
languages written in it; its trigrams score those; Viterbi over the words of a
text, with a penalty for switching, labels spans.  A text has the language of
most of its letters.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import ship

SLOTS = 1 << 16
SMOOTH = 0.5
#: log-probability lost by a change of language between two words
SWITCH = 12.0
#: share of a language's letters from which a script counts as its own
OWN_SCRIPT = 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: letters that are scored at once, words that are labelled at once
SCORE_LETTERS = 1_000_000
LABEL_WORDS = 1_000_000

#: first code points of scripts, in order (fixed values of the Unicode blocks); the last field says letters or not
_RANGES = (
    (0x0000, "latin", 1), (0x0250, "ipa", 1), (0x02B0, "marks", 0), (0x0370, "greek", 1), (0x0400, "cyrillic", 1),
    (0x0530, "armenian", 1), (0x0590, "hebrew", 1), (0x0600, "arabic", 1), (0x0700, "syriac", 1), (0x0900, "devanagari", 1),
    (0x0980, "bengali", 1), (0x0A00, "gurmukhi", 1), (0x0A80, "gujarati", 1), (0x0B00, "oriya", 1), (0x0B80, "tamil", 1),
    (0x0C00, "telugu", 1), (0x0C80, "kannada", 1), (0x0D00, "malayalam", 1), (0x0D80, "sinhala", 1), (0x0E00, "thai", 1),
    (0x0E80, "lao", 1), (0x0F00, "tibetan", 1), (0x1000, "myanmar", 1), (0x10A0, "georgian", 1), (0x1100, "hangul", 1),
    (0x1200, "ethiopic", 1), (0x1780, "khmer", 1), (0x1800, "mongolian", 1), (0x1E00, "latin", 1), (0x1F00, "greek", 1),
    (0x2000, "signs", 0), (0x2C00, "other", 1), (0x2E00, "signs", 0), (0x3040, "kana", 1), (0x3130, "hangul", 1),
    (0x3200, "signs", 0), (0x3400, "han", 1), (0xA000, "other", 1), (0xAC00, "hangul", 1), (0xD7B0, "other", 1),
    (0xF900, "han", 1), (0xFB00, "latin", 1), (0xFB1D, "hebrew", 1), (0xFB50, "arabic", 1), (0xFE00, "signs", 0),
    (0xFE70, "arabic", 1), (0xFF00, "signs", 0), (0xFF66, "kana", 1), (0xFFF0, "signs", 0), (0x10000, "other", 1),
    (0x1F000, "signs", 0), (0x20000, "han", 1), (0xE0000, "signs", 0),
)
_STARTS = np.array([r[0] for r in _RANGES], np.uint32)
SCRIPTS = tuple(dict.fromkeys(r[1] for r in _RANGES))
_SCRIPT = np.array([SCRIPTS.index(r[1]) for r in _RANGES], np.int64)
_LETTERS = np.array([r[2] for r in _RANGES], bool)


class Words:
    """Words of some texts: trigram slots of their letters, where words begin, their text and script."""

    def __init__(self, texts: list[str]):
        joined = " ".join(texts).lower() if texts else ""
        ends = np.cumsum([len(t.lower()) + 1 for t in texts]) if texts else np.empty(0, np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        latin = points < 0x250
        letter = ((points >= 97) & (points <= 122)) | (
            (points >= 0xAA) & latin & (points != 0xD7) & (points != 0xF7) & ((points >= 0xC0) | (points == 0xAA) | (points == 0xB5) | (points == 0xBA))
        )
        script = np.zeros(len(points), np.int64)
        far = np.flatnonzero(~latin)
        if len(far):
            block = np.searchsorted(_STARTS, points[far], "right") - 1
            letter[far] = _LETTERS[block]
            script[far] = _SCRIPT[block]
        clean = np.where(letter, points, 32).astype(np.uint64)
        padded = np.concatenate(([np.uint64(32)], clean, [np.uint64(32)]))
        places = np.flatnonzero(letter)
        with np.errstate(over="ignore"):
            mixed = padded[places] * np.uint64(0x9E3779B97F4A7C15) + padded[places + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed += padded[places + 2] * np.uint64(0x165667B19E3779F9)
        self.slots = ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(16)).astype(np.int64) & (SLOTS - 1)
        self.starts = np.flatnonzero(np.diff(places, prepend=-2) > 1)
        self.text = np.searchsorted(ends, places[self.starts], "right") if len(places) else np.empty(0, np.int64)
        self.script = script[places[self.starts]] if len(places) else np.empty(0, np.int64)
        self.letters = np.diff(self.starts, append=len(places))


def _runs(texts: list[str], most: int) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): trigram counts, and after them letters by script, of one partition."""
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(SLOTS + len(SCRIPTS), np.int64))
    for batch in batches:
        by_lang = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_lang[lang].append(text)
        for lang, texts in by_lang.items():
            for part in _runs(texts, SCORE_LETTERS):
                found = Words(part)
                counts[lang][:SLOTS] += np.bincount(found.slots, minlength=SLOTS)
                by_script = np.bincount(found.script, found.letters, len(SCRIPTS))
                counts[lang][SLOTS:] += by_script.astype(np.int64)
    for lang, total in counts.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())],
            names=["lang", "slot", "n"],
        )


class Model:
    """Log-probabilities per slot and language, and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        trigrams = counts[:SLOTS].astype(np.float64) + SMOOTH
        self.scores = np.log(trigrams / trigrams.sum(axis=0)).astype(np.float32)
        scripts = counts[SLOTS:]
        own = scripts > OWN_SCRIPT * np.maximum(scripts.sum(axis=0), 1)
        self.common = int(scripts.sum(axis=0).argmax()) if langs else 0
        self.allowed = own | ~own.any(axis=1, keepdims=True)

    def word_scores(self, found: Words) -> np.ndarray:
        if not len(found.starts):
            return np.empty((0, len(self.langs)), np.float32)
        scores = np.add.reduceat(self.scores[found.slots], found.starts, axis=0)
        return np.where(self.allowed[found.script], scores, scores - 1000)


def learn(labelled: DataFrame) -> Model:
    """Fit on all rows of ``labelled`` (lang, text); both not null."""
    ship(labelled.sparkSession)
    sums = labelled.select("lang", "text").mapInArrow(_gather, "lang string, slot int, n bigint")
    rows = sums.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # at most languages x slots
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((SLOTS + len(SCRIPTS), max(len(langs), 1)), np.int64)
    place = {lang: i for i, lang in enumerate(langs)}
    counts[rows["slot"].to_numpy(), rows["lang"].map(place).to_numpy(int)] = rows["n"].to_numpy()
    return Model(langs, counts)


def best_path(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Label of each word: the best path of every text, all texts one step at a time.

    ``starts`` and ``lengths`` give the rows of ``scores`` of each text, longest text first.
    """
    labels = np.zeros(len(scores), np.int16)
    if not len(lengths) or not lengths[0]:
        return labels
    width = scores.shape[1]
    own = np.arange(width)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts longer than each step
    back = np.zeros(scores.shape, np.int16)
    value = scores[starts[: active[0]]].copy()
    for t in range(1, lengths[0]):
        n = active[t]
        at = starts[:n] + t
        best = value[:n].argmax(axis=1)
        top = value[np.arange(n), best][:, None] - switch
        stay = value[:n] >= top
        back[at] = np.where(stay, own, best[:, None])
        value[:n] = np.where(stay, value[:n], top) + scores[at]
    state = value.argmax(axis=1)  # of each text's last word: rows stop changing when their text ends
    for t in range(lengths[0] - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def label_texts(texts: list[str], model: Model, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, int]]]]:
    """Language index (-1: none) and its share of the letters, and spans (language, first word, words) of each text."""
    width = len(model.langs)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    best = np.full(len(texts), -1)
    share = np.zeros(len(texts))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not width:
        return best, share, spans
    group: list[int] = []
    size = 0
    most = max(1, LABEL_WORDS * 4 // width)

    def settle(members: list[int]) -> None:
        scores, owner, letters, done = [], [], [], 0
        for part in _runs([texts[i] for i in members], max(1, SCORE_LETTERS * 4 // width)):
            found = Words(part)
            scores.append(model.word_scores(found))
            owner.append(found.text + done)
            letters.append(found.letters)
            done += len(part)
        score, text, letter = np.concatenate(scores), np.concatenate(owner), np.concatenate(letters)
        lengths = np.bincount(text, minlength=len(members))
        starts = np.cumsum(lengths) - lengths
        longest = np.argsort(-lengths, kind="stable")
        labels = best_path(score, starts[longest], lengths[longest], switch)
        totals = np.bincount(text * width + labels, letter, len(members) * width).reshape(-1, width)
        whole = totals.sum(axis=1)
        chosen = totals.argmax(axis=1)
        turn = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
        after = np.append(turn[1:], len(labels))[: len(turn)]
        for a, b in zip(turn.tolist(), after.tolist(), strict=True):
            spans[members[text[a]]].append((int(labels[a]), int(a - starts[text[a]]), b - a))
        for j, i in enumerate(members):
            if whole[j]:
                best[i], share[i] = chosen[j], totals[j, chosen[j]] / whole[j]

    for i in order:
        if group and size + len(texts[i]) // 2 > most * 3:
            settle(group)
            group, size = [], 0
        group.append(i)
        size += len(texts[i]) // 2
    if group:
        settle(group)
    return best, share, spans


def _predict(model: Model, switch: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        best, share, spans = label_texts([t or "" for t in texts], model, switch)
        # scripts are told apart by blocks, which also hold a few signs; letters are exact
        lettered = [bool(model.langs and t and _LETTER.search(t)) for t in texts]
        names = [model.langs[i if i >= 0 else model.common] if a else UNKNOWN for i, a in zip(best, lettered, strict=True)]
        share = np.where(lettered, share, 0.0)
        spans = [s if a else [] for s, a in zip(spans, lettered, strict=True)]
        parts = [[{"lang": model.langs[k], "first_word": a, "words": n} for k, a, n in s] for s in spans]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(parts, kind)],
            names=[*batch.schema.names[:-1], "lang_pred", "score", "spans"],
        )


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` without its text, plus lang_pred, score and spans.

    ``spans`` lists language, first word and number of words of each span, in
    order; ``score`` is the share of letters in spans of the predicted language.
    Texts that are null, empty or without letters get ``und``, score 0 and no
    spans; so does everything when nothing was learned.  Ties go to the first
    language by name.  Other columns are kept, unless named like a result.
    """
    ship(docs.sparkSession)
    results = ("lang_pred", "score", "spans", "text")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results], "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = ", ".join([*fields, "lang_pred string", "score double", "spans array<struct<lang:string,first_word:bigint,words:bigint>>"])
    return rows.mapInArrow(partial(_predict, model, switch), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
