"""Token counts from a finite-state form of a byte-pair tokenizer.

A byte-pair encoding is determined from left to right: for every prefix of a
pre-token exactly one vocabulary entry ends it, and whether an entry may follow
another depends on the two alone.  So the encoding is a deterministic transducer:
a state knows the longest suffix that may still grow into an entry, and which
entry ends at each of its places; a transition reads one byte and emits the
change of the token count.  States and transitions are compiled when first
reached and shared by all words after that.

Long texts are cut into chunks that are rows of their own, counted by any task.
A chunk becomes a map from the state it is entered in to the state it is left in
and the tokens emitted between.  Cut at white space or between pre-tokens it has
one entry state, the one between pre-tokens.  Chunks inside a pre-token longer
than a chunk list the states that the symbols before them may lead to.  Maps
compose associatively: blocks of chunks first, then the blocks of a text (the
scan's way up; a count needs its last prefix only).
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import Workspace, ship, utf8

CHUNK_BYTES = 1 << 16
#: a text of more chunks than these is counted chunk by chunk, by several tasks
SOLO_CHUNKS = 16
#: chunk maps of a text that one task composes into one
BLOCK_CHUNKS = 256
TOKEN_LIMIT = 2048
#: compiled states and remembered words that a worker keeps
MAX_STATES = 250_000
MAX_WORDS = 300_000
#: longer words are not remembered
MAX_WORD_BYTES = 64

#: pre-tokens of the word tokenizer, on lower-cased text (fixed pattern of its file, white space spelled out)
_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+"
)
#: characters whose lower case, class and normal form need no look at their history
_SIMPLE = regex.compile(r"[\x00-įı-ɏ]*")
_SPACES = [bytes([b]) for b in b"\t\n\v\f\r "]
_SPACE = regex.compile(rb"[\t-\r ]")
_END = "</w>"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free place."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_SYMBOL = {b: s for b, s in enumerate(byte_symbols())}


@lru_cache(1 << 16)
def steady(char: str) -> bool:
    """Whether every Unicode version since 3.2 gives a character its class and normal form of today.

    Signs, punctuation and format characters are as good as unassigned ones:
    neither is a letter or number.  What is left are letters, marks and numbers
    that came later; the library's own tables decide those.
    """
    now, old = unicodedata.category(char), unicodedata.ucd_3_2_0.category(char)
    if old == "Cn":
        return now[0] in "SPC" and now != "Cn"
    return all((kind in now) == (kind in old) for kind in "LN")


def is_steady(text: str) -> bool:
    return text.isascii() or bool(_SIMPLE.fullmatch(text)) or all(map(steady, set(text)))


def normal_form(text: str) -> str:
    if text.isascii():
        return text.lower()
    # the tokenizer lower-cases each character by itself, without a final form of sigma
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


StateMap = dict[str, tuple[str, int]]  # state at entry: state at exit, tokens emitted
#: the state between two pre-tokens
BETWEEN = ""


class Transducer:
    """Deterministic transducer of a byte-pair encoding with word ends, compiled on demand."""

    def __init__(self, merges: list[tuple[str, str]]):
        self.ranks = {tuple(pair): i for i, pair in enumerate(merges)}
        self.entries = {a + b for a, b in self.ranks}
        self.open = {""}
        for entry in self.entries:
            bare = entry.removesuffix(_END)
            self.open.update(bare[:i] for i in range(1, len(bare)))
            if entry.endswith(_END):
                self.open.add(bare[:-1])
        self.longest = max(map(len, self.open)) + 1
        self.follows: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.inner: list[dict] = []
        self.final: list[dict] = []
        self.follows.clear()
        self.whole.clear()
        self.start = self._state("", ((None, 0),))

    def _state(self, tail: str, ends: tuple) -> int:
        key = (tail, ends)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.inner.append({})
            self.final.append({})
        return self.ids[key]

    def encode(self, symbols: list[str]) -> list[str]:
        """Merges by rank, as defined; used on pairs of entries only."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    @staticmethod
    def _symbols(entry: str) -> list[str]:
        if entry.endswith(_END):
            bare = entry[: -len(_END)]
            return [*bare[:-1], bare[-1] + _END]
        return list(entry)

    def _is_whole(self, entry: str) -> bool:
        if entry not in self.whole:
            bare = entry.removesuffix(_END)
            self.whole[entry] = len(bare) == 1 or entry in self.entries and self.encode(self._symbols(entry)) == [entry]
        return self.whole[entry]

    def _may_follow(self, before: str | None, entry: str) -> bool:
        if before is None:
            return True
        key = (before, entry)
        if key not in self.follows:
            self.follows[key] = self.encode(self._symbols(before) + self._symbols(entry)) == [before, entry]
        return self.follows[key]

    def _last(self, state: int, symbol: str, end: str) -> tuple[str, int]:
        tail, ends = self.states[state]
        read = tail + symbol
        for k in range(len(read), 0, -1):
            entry = read[-k:] + end
            before, count = ends[k - 1]
            if self._is_whole(entry) and self._may_follow(before, entry):
                return entry, count + 1
        raise ValueError("the merges are no byte-pair encoding")

    def _compile(self, state: int, symbol: str) -> tuple[int, int]:
        tail, ends = self.states[state]
        entry, emitted = self._last(state, symbol, "")
        read = tail + symbol
        keep = next(n for n in range(len(read), -1, -1) if read[len(read) - n :] in self.open)
        places = ((entry, 0), *((e, c - emitted) for e, c in ends))[: keep + 1]
        step = self.inner[state][symbol] = (self._state(read[len(read) - keep :], places), emitted)
        return step

    def run(self, state: int, symbols: str) -> tuple[int, int]:
        """State and token count after symbols inside a pre-token."""
        total, inner = 0, self.inner
        for symbol in symbols:
            step = inner[state].get(symbol) or self._compile(state, symbol)
            state = step[0]
            total += step[1]
        return state, total

    def _finish(self, state: int, symbol: str) -> int:
        last = self.final[state]
        if symbol not in last:
            last[symbol] = self._last(state, symbol, _END)[1]
        return last[symbol]

    def count(self, piece: str) -> int:
        """Tokens of one pre-token, given as byte symbols."""
        if len(self.states) > MAX_STATES:
            self.reset()
        state, total = self.run(self.start, piece[:-1])
        return total + self._finish(state, piece[-1])

    def look_behind(self) -> int:
        """Symbols before a chunk from which its entry states are found."""
        return 4 * self.longest

    def state_map(self, before: str, symbols: str, last: bool) -> StateMap:
        """Map of a part of one pre-token.

        ``before`` holds the symbols ahead of it in the pre-token, as far as
        ``look_behind`` reaches; none: the part begins the pre-token.  Runs that
        begin at different places of ``before`` soon agree, or, in text that
        repeats, fall into as many states as it has phases.
        """
        if len(self.states) > MAX_STATES:
            self.reset()
        whole = len(before) < self.look_behind()
        starts = [0] if whole else range(2 * self.longest)
        entries = {self.run(self.start, before[i:])[0] for i in starts}
        found: StateMap = {}
        for entry in entries:
            if last:
                state, total = self.run(entry, symbols[:-1])
                out = BETWEEN, total + self._finish(state, symbols[-1])
            else:
                state, total = self.run(entry, symbols)
                out = self._name(state), total
            found[self._name(entry) if before else BETWEEN] = out
        return found

    def _name(self, state: int) -> str:
        """A state as text that means the same in every worker."""
        return json.dumps(self.states[state])


class WordCounts(dict):
    """Tokens of a run of bytes without ASCII white space, remembered up to a bound."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != _END:
            raise ValueError("a byte-pair tokenizer with word ends is expected")
        self.path = path
        self.library = None
        self.transducer = Transducer([tuple(m) for m in model["merges"]])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        if not all(s.startswith("<|") for s in special):
            raise ValueError("special strings are expected to begin with <|")

    def __missing__(self, word: bytes) -> int:
        value = self._count(word)
        if len(word) <= MAX_WORD_BYTES:
            if len(self) > MAX_WORDS:
                self.clear()
            self[word] = value
        return value

    def _count(self, word: bytes) -> int:
        count = self.transducer.count
        if word.isalpha():  # ASCII letters are their own symbols
            return count(word.lower().decode())
        text = word.decode("utf-8", "replace")
        if not is_steady(text):
            return self.by_library(text)
        return sum(1 if piece is None else count(piece) for piece in self.pieces(text))

    def by_library(self, text: str) -> int:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: str) -> Iterator[str | None]:
        """Pre-tokens as byte symbols; a special string is None."""
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        for i, part in enumerate(parts):
            if i:
                yield None
            for piece in _PIECES.finditer(normal_form(part)):
                yield "".join(map(_SYMBOL.__getitem__, piece.group().encode()))


#: kind, symbols before it in its pre-token, data: white-space separated text; pre-tokens, one a line (empty: a
#: special string); a part of a pre-token; its last part
Chunk = tuple[str, str, bytes]
TEXT, PIECES, PART, LAST = "text", "pieces", "part", "last"


def cut(text: bytes, counts: WordCounts, size: int) -> Iterator[Chunk]:
    """Chunks of about ``size`` bytes: at white space, else between pre-tokens, else inside one."""
    at = 0
    while len(text) - at > size:
        space = max(text.rfind(s, at, at + size) for s in _SPACES)
        if space >= 0:
            yield TEXT, "", text[at:space]
            at = space + 1
        else:
            found = _SPACE.search(text, at + size)
            stop = found.start() if found else len(text)
            yield from _cut_run(text[at:stop], counts, size)
            at = stop
    if at < len(text):
        yield TEXT, "", text[at:]


def _cut_run(run: bytes, counts: WordCounts, size: int) -> Iterator[Chunk]:
    text = run.decode("utf-8", "replace")
    if not is_steady(text):
        yield TEXT, "", run
        return
    behind = counts.transducer.look_behind()
    held: list[str] = []
    length = 0
    for piece in counts.pieces(text):
        piece = piece or ""
        if held and length + len(piece) > size:
            yield PIECES, "", "\n".join(held).encode()
            held, length = [], 0
        if len(piece) > size:
            for i in range(0, len(piece), size):
                kind = LAST if i + size >= len(piece) else PART
                yield kind, piece[max(0, i - behind) : i], piece[i : i + size].encode()
        else:
            held.append(piece)
            length += len(piece) + 1
    if held:
        yield PIECES, "", "\n".join(held).encode()


def chunk_map(chunk: Chunk, counts: WordCounts) -> StateMap:
    kind, before, data = chunk
    if kind == TEXT:
        return {BETWEEN: (BETWEEN, sum(map(counts.__getitem__, data.split())))}
    if kind == PIECES:
        return {BETWEEN: (BETWEEN, sum(counts.transducer.count(p) if p else 1 for p in data.decode().split("\n")))}
    return counts.transducer.state_map(before, data.decode(), kind == LAST)


def compose(maps: Iterable[StateMap]) -> int | None:
    """Tokens of maps in a row; None if one is entered in a state that it does not list."""
    state, total = BETWEEN, 0
    for step in maps:
        if state not in step:
            return None
        state, emitted = step[state]
        total += emitted
    return total


def token_count(text: bytes, counts: WordCounts, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Tokens of one text in this process, by chunks if it is longer than one."""
    total = None
    if len(text) > chunk_bytes:
        total = compose(chunk_map(c, counts) for c in cut(text, counts, chunk_bytes))
    return sum(map(counts.__getitem__, text.split())) if total is None else total


_COUNTS: dict[str, WordCounts] = {}


def _word_counts(path: str) -> WordCounts:
    return _COUNTS.get(path) or _COUNTS.setdefault(path, WordCounts(path))


def _counted(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _word_counts(path)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        tokens = [sum(map(counts.__getitem__, text.as_py().split())) for text in texts]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(tokens, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"]
        )


_CHUNK_SCHEMA = "key string, part int, kind string, before string, data binary"
_MAP_SCHEMA = "key string, part int, states map<string,struct<to:string,n:bigint>>"
_STATES = pa.map_(pa.string(), pa.struct([("to", pa.string()), ("n", pa.int64())]))


def _chunks(path: str, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _word_counts(path)
    names = ["key", "part", "kind", "before", "data"]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for key, text in zip(*batch.columns, strict=True):
            rows: list[tuple] = []
            for part, chunk in enumerate(cut(text.as_py(), counts, size)):
                rows.append((key.as_py(), part, *chunk))
                if len(rows) == 64:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)


def _mapped(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _word_counts(path)
    for batch in batches:
        key, part, *chunk = batch.columns
        found = [chunk_map(tuple(v.as_py() for v in row), counts) for row in zip(*chunk, strict=True)]
        states = pa.array([[(k, {"to": to, "n": n}) for k, (to, n) in m.items()] for m in found], _STATES)
        yield pa.RecordBatch.from_arrays([key, part, states], names=["key", "part", "states"])


def _composed(maps: DataFrame, width: int) -> DataFrame:
    """One map for every ``width`` consecutive maps of a text."""
    block = maps.groupBy("key", F.expr(f"part div {width}").cast("int").alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "states")), lambda a, b: a["part"] - b["part"])
    folded = """transform_values(run[0].states, (entry, out) -> aggregate(slice(run, 2, size(run)), out,
        (done, next) -> named_struct('to', try_element_at(next.states, done.to).to,
                                     'n', done.n + try_element_at(next.states, done.to).n)))"""
    return block.agg(ordered.alias("run")).select("key", F.col("block").alias("part"), F.expr(folded).alias("states"))


def long_counts(texts: DataFrame, tokenizer: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """key, n_tokens for rows of key (equal for equal texts only) and text (bytes).

    Chunks are dealt to tasks by (key, number); repeated texts are combined
    before they travel.  n_tokens is null where a chunk is entered in a state
    that its map does not list.
    """
    chunks = texts.select("key", "text").mapInArrow(partial(_chunks, tokenizer, chunk_bytes), _CHUNK_SCHEMA)
    once = chunks.groupBy("key", "part").agg(F.first(F.struct("kind", "before", "data")).alias("c"))
    maps = once.select("key", "part", "c.*").mapInArrow(partial(_mapped, tokenizer), _MAP_SCHEMA)
    whole = _composed(_composed(maps, BLOCK_CHUNKS), 1 << 30)
    return whole.select("key", F.expr(f"try_element_at(states, '{BETWEEN}').n").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` without its text, plus n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a byte-pair tokenizer with word ends (a .json
    file that every executor can read).  Null counts as empty, and empty texts
    and texts of white space have no tokens.  Special strings inside a text are
    one token each.  Any other column is kept, and replaced if it has the name
    of a result; repeated rows stay.  Texts of up to 16 chunks are counted where
    they are read; chunks of longer ones are shuffled, once for each different
    text, and should their maps not fit together, the text is counted in one go.
    """
    ship(docs.sparkSession)
    results = ("n_bytes", "n_tokens", "over_limit", "text")
    names = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c not in results)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], utf8().alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    kept = [*names.values(), "n_bytes"]
    is_long = F.col("n_bytes") > SOLO_CHUNKS * chunk_bytes
    counted_schema = ", ".join([*(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in kept), "n_tokens bigint"])

    def counted(some: DataFrame) -> DataFrame:
        return some.select(*kept, "text").mapInArrow(partial(_counted, tokenizer), counted_schema)

    longs = rows.where(is_long).withColumn("key", F.sha2("text", 256))
    solved = Workspace(docs.sparkSession).save("long_counts", long_counts(longs, tokenizer, chunk_bytes))
    known = longs.join(solved.where("n_tokens is not null"), "key").select(*kept, "n_tokens")
    rest = longs.join(solved.where("n_tokens is null").select("key"), "key")
    every = counted(rows.where(~is_long)).unionByName(known).unionByName(counted(rest))
    return every.select(
        *[F.col(n).alias(c) for c, n in names.items()], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
