"""Text normalisation, character sets and tokenizers as Spark expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import (
    ANCHOR_ANSWER_PREFIX,
    ANCHOR_QUESTION_PREFIX,
    CANDIDATE_PREFIX,
    DEFAULT_LEXICON,
    Lexicon,
)

# Unicode white space plus the four ASCII separators that Java leaves out.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
CJK = r"一-鿿"
WORD = rf"[{CJK}A-Za-z0-9]"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def clean_text(value: Column, nan_is_missing: bool = False) -> Column:
    """Single-space, trimmed text; null becomes the empty string.

    ``nan_is_missing`` also maps the literal text ``nan`` (any case) to empty,
    the rule used where tables were re-read from text files.
    """
    raw = F.coalesce(value.cast("string"), F.lit(""))
    if nan_is_missing:
        raw = F.when(F.lower(raw) == "nan", "").otherwise(raw)
    return F.trim(F.regexp_replace(raw, BLANKS, " "))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """True when any term is a substring; one compiled pattern, no per-term code."""
    if not terms:
        return F.lit(False)
    return text.rlike("|".join(re.escape(t) for t in terms))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    A lambda body is evaluated per element, so a costly expression inside it
    must arrive as a bound variable.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan_pattern(terms: Sequence[str], group: int = 12) -> str:
    """A look-ahead that captures the longest term starting at a position.

    Terms are grouped by first character, and first characters by code range,
    so a position costs a few range tests and not one test per term.
    """
    rests: dict[str, list[str]] = {}
    for term in terms:
        rests.setdefault(term[0], []).append(term[1:])
    branch = {
        c: re.escape(c) + "(?:" + "|".join(re.escape(r) for r in sorted(tails, key=lambda t: (-len(t), t))) + ")"
        for c, tails in rests.items()
    }
    span = lambda chars: f"{re.escape(chars[0])}-{re.escape(chars[-1])}"
    # ASCII and other first characters never share a range
    sides = [side for side in (sorted(c for c in branch if c.isascii()), sorted(c for c in branch if not c.isascii())) if side]
    parts = [
        f"(?=[{span(chunk)}])(?:" + "|".join(branch[c] for c in chunk) + ")"
        for side in sides
        for chunk in (side[i:i + group] for i in range(0, len(side), group))
    ]
    return f"(?=[{''.join(map(span, sides))}])(?=(" + "|".join(parts) + "))"


def find_terms(text: Column, terms: Sequence[str]) -> Column:
    """Distinct terms contained in ``text``, found in one scan.

    The scan yields the longest term per position; terms that begin a longer
    one are added from a fixed table, so overlapping and nested terms count.
    """
    pool = list(dict.fromkeys(t for t in terms if t))
    if not pool:
        return F.array().cast("array<string>")
    longest = F.array_distinct(F.regexp_extract_all(text, F.lit(_scan_pattern(pool)), F.lit(1)))
    known = set(pool)
    nested = {t: [t[:i] for i in range(1, len(t)) if t[:i] in known] for t in pool}
    nested = {t: inner for t, inner in nested.items() if inner}
    if not nested:
        return longest
    table = F.create_map(
        *[item for t, inner in nested.items() for item in (F.lit(t), F.array(*[F.lit(i) for i in inner]))]
    )
    outer = F.array(*[F.lit(t) for t in nested])
    # the scan result is used twice below; bind keeps it a single scan
    return bind(
        longest,
        lambda hits: F.array_union(
            hits, F.flatten(F.transform(F.array_intersect(hits, outer), lambda t: table[t]))
        ),
    )


def count_found(found: Column, terms: Sequence[str]) -> Column:
    """How many listed terms are in ``found``; repeats in the list count again."""
    if not terms:
        return F.lit(0)
    pool = F.array(*[F.lit(t) for t in terms if t])
    if len(set(terms)) == len(terms):
        return F.size(F.array_intersect(found, pool))
    return F.size(F.filter(pool, lambda t: F.array_contains(found, t)))


def found_score(found: Column, terms: Sequence[str], normalizer: float) -> Column:
    """Share of ``normalizer`` hits among found terms, at most 1."""
    return F.least(count_found(found, terms) / F.lit(float(normalizer)), F.lit(1.0))


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    return count_found(find_terms(text, terms), terms)


def term_score(text: Column, terms: Sequence[str], normalizer: float) -> Column:
    """Share of ``normalizer`` term hits in a text, at most 1."""
    return found_score(find_terms(text, terms), terms, normalizer)


def group_score(text: Column, terms: Sequence[str]) -> Column:
    return term_score(text, terms, 2.0)


def question_mark_score(text: Column) -> Column:
    return F.least(F.regexp_count(text, F.lit("[?？]")) / F.lit(2.0), F.lit(1.0))


def word_chars(text: Column) -> Column:
    """Distinct CJK or ASCII alphanumeric characters, case kept."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def visible_chars(text: Column) -> Column:
    """Distinct lower-cased characters that are not white space."""
    raw = F.lower(F.coalesce(text, F.lit("")))
    return F.array_distinct(F.regexp_extract_all(raw, F.lit(r"(?U)[^\s\x1c-\x1f]"), F.lit(0)))


def set_jaccard(left: Column, right: Column) -> Column:
    """|A∩B| / |A∪B| of two distinct arrays; 0 when either is empty."""
    def ratio_of(sets: Column) -> Column:
        shared = F.size(F.array_intersect(sets["a"], sets["b"]))
        union = F.size(sets["a"]) + F.size(sets["b"]) - shared
        return F.when(shared > 0, shared / union).otherwise(F.lit(0.0))

    return bind(F.struct(left.alias("a"), right.alias("b")), ratio_of)


def char_jaccard(left: Column, right: Column) -> Column:
    return set_jaccard(word_chars(clean_text(left)), word_chars(clean_text(right)))


def visible_jaccard(left: Column, right: Column) -> Column:
    return set_jaccard(visible_chars(left), visible_chars(right))


def extract_terms(text: Column, stopwords: Sequence[str] = DEFAULT_LEXICON.term_stopwords) -> Column:
    """Distinct runs of 2 to 10 word characters without stop words."""
    runs = F.regexp_extract_all(text, F.lit(WORD + "{2,10}"), F.lit(0))
    if not stopwords:
        return F.array_distinct(runs)
    return F.array_except(runs, F.array(*[F.lit(s) for s in stopwords]))


def term_overlap(left: Column, right: Column) -> Column:
    """Shared terms over the smaller set; 0 when either set is empty."""
    smaller = F.least(F.size(left), F.size(right))
    return F.when(
        smaller > 0, F.size(F.array_intersect(left, right)) / smaller
    ).otherwise(F.lit(0.0))


def object_terms(text: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Known object terms plus lower-cased ASCII words, after salutations go."""
    body = text
    for pattern in lexicon.salutations:
        body = F.regexp_replace(body, pattern.replace(r"\s", r"\p{IsWhite_Space}"), " ")
    known = find_terms(body, lexicon.object_vocabulary())
    runs = F.regexp_extract_all(ascii_lower(body), F.lit(WORD + "{2,24}"), F.lit(0))
    mixed = body.rlike(f"[{CJK}]")  # without CJK every run is ASCII
    ascii_runs = F.when(mixed, F.filter(runs, lambda r: r.rlike("^[a-z0-9]+$"))).otherwise(runs)
    return F.array_union(known, ascii_runs)


def shared_objects(left_terms: Column, right_terms: Column) -> tuple[Column, Column]:
    """Score and the twelve longest shared terms (length down, then code order)."""
    shared = F.array_intersect(left_terms, right_terms)
    strong = F.size(F.filter(shared, lambda t: F.length(t) >= 3))
    score = F.least(strong * F.lit(0.5) + F.size(shared) * F.lit(0.12), F.lit(1.0))
    keyed = F.array_sort(F.transform(shared, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return score, F.array_join(F.slice(F.transform(keyed, lambda s: s["t"]), 1, 12), "|")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def bm25_tokens(text: Column) -> Column:
    """Bag of tokens: CJK bigrams, lone CJK characters, lower-cased ASCII words.

    Token order is not kept (scoring treats the result as a bag).  Text with no
    such token falls back to its characters.
    """
    ascii_words = F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    bigrams = F.regexp_extract_all(text, F.lit(rf"(?=([{CJK}][{CJK}]))"), F.lit(1))
    singles = F.regexp_extract_all(text, F.lit(rf"(?<![{CJK}])[{CJK}](?![{CJK}])"), F.lit(0))
    return _or_letters(F.concat(ascii_words, bigrams, singles), text)


def _or_letters(tokens: Column, text: Column) -> Column:
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return bind(tokens, lambda found: F.when(F.size(found) > 0, found).otherwise(letters))


def run_tokens(text: Column) -> Column:
    """Whole CJK runs and ASCII runs, case kept; characters when there is none."""
    return _or_letters(F.regexp_extract_all(text, F.lit(rf"[{CJK}]+|[A-Za-z0-9]+"), F.lit(0)), text)


def anchor_text(question: Column, answer: Column,
                prefixes: tuple[str, str] = (ANCHOR_QUESTION_PREFIX, ANCHOR_ANSWER_PREFIX)) -> Column:
    return F.concat(F.lit(prefixes[0]), clean_text(question), F.lit(prefixes[1]), clean_text(answer))


def candidate_text(question: Column, prefix: str = CANDIDATE_PREFIX) -> Column:
    return F.concat(F.lit(prefix), clean_text(question))


def text_protocol_hash(
    prefixes: tuple[str, str, str] = (ANCHOR_QUESTION_PREFIX, ANCHOR_ANSWER_PREFIX, CANDIDATE_PREFIX),
    version: str = "raw_q1_a1__q2_v1",
) -> str:
    """Identity of cleaning rule and templates; equal text input, equal hash."""
    return hashlib.sha256("\x1f".join((version, BLANKS, *prefixes)).encode("utf-8")).hexdigest()


def zero_fill(value: Column, width: int = 6) -> Column:
    """Left-pad with zeros, never truncate, a sign stays in front."""
    text = F.trim(value.cast("string"))
    sign = F.when(text.rlike("^[+-]"), F.substring(text, 1, 1)).otherwise(F.lit(""))
    digits = F.regexp_replace(text, "^[+-]", "")
    pad = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    return F.concat(sign, F.repeat(F.lit("0"), pad), digits)


def slugify(value: Column) -> Column:
    body = F.regexp_replace(F.lower(value), "[^0-9A-Za-z]+", "_")
    body = F.regexp_replace(body, "^_+|_+$", "")
    return F.when(body == "", "baseline").otherwise(body)
