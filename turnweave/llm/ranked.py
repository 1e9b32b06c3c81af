"""Ranked lexical search with hashed max-sketches.

A document's sketch has one byte for each of ``SKETCH`` coordinates: every term
falls on a coordinate by its hash, and the coordinate keeps the greatest number of
occurrences of the terms that fall there, rounded up to a step that a byte can
name.  Impacts grow with occurrences, so from the sketch follows the greatest
impact on each coordinate, and the product of sketches with a matrix of query
weights bounds the scores of all documents for a whole batch of queries from
above.  Documents are then scored exactly from the greatest bound downwards, until
the bound falls below the score of the last place.  Thresholds start from the
exact scores of a sample, so that no task has to begin at nothing.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm.common import Workspace, ship, utf8

TOP = 20
SKETCH = 1_024
#: documents whose exact scores give the first thresholds; any sample gives right results
SAMPLE_DOCS = 8_192
#: distinct terms of the queries answered in one pass; more queries take more passes
PASS_TERMS = 200_000
#: documents bounded at once inside a task
BLOCK_DOCS = 2_048
_NO_TERM = bytes(
    c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256)
)


def _steps() -> np.ndarray:
    """Occurrences that a byte stands for: all up to 128, then rising by a seventh, to beyond any text."""
    steps = list(range(129))
    while len(steps) < 256:
        steps.append(-(-steps[-1] * 8 // 7))
    return np.array(steps, np.int64)


STEPS = _steps()


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and anything beyond ASCII, only A-Z lower-cased."""
    return text.translate(_NO_TERM).split()


class Coordinates(dict):
    """Term to its coordinate, remembered up to a bound."""

    def __missing__(self, term: bytes) -> int:
        at = zlib.crc32(term) % SKETCH
        if len(self) < 200_000:
            self[term] = at
        return at


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = Coordinates()
    for batch in batches:
        told, times, sketches, lengths = [], [], [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            found = Counter(terms(text))
            counts = np.fromiter(found.values(), np.int64, len(found))
            sketch = np.zeros(SKETCH, np.uint8)
            if found:
                at = np.fromiter(map(places.__getitem__, found), np.int64, len(found))
                np.maximum.at(sketch, at, np.searchsorted(STEPS, counts).astype(np.uint8))
            told.append(b" ".join(found))
            times.append(counts.astype(np.int32))
            lengths.append(int(counts.sum()))
            sketches.append(sketch.tobytes() if found else b"")
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-1], pa.array(lengths, pa.int64()), pa.array(told, pa.binary()),
                pa.array(times, pa.list_(pa.int32())), pa.array(sketches, pa.binary()),
            ],
            names=[*batch.schema.names[:-1], "n", "terms", "times", "sketch"],
        )


class SearchIndex:
    """The written table (id, n, terms, times, sketch) and what all scores depend on."""

    def __init__(self, table: DataFrame, docs: int, length: int):
        self.table = table
        self.docs = docs
        self.length = length


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> SearchIndex:
    """One row a document that has a term: its length, distinct terms, their numbers and the sketch."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("id"), utf8(text).alias("text"))
    table = rows.mapInArrow(_index, f"id {kind}, n bigint, terms binary, times array<int>, sketch binary").where("n > 0")
    table = Workspace(spark).save("index", table)
    total = table.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    return SearchIndex(table, total["docs"], total["length"] or 0)


class Queries:
    """Weighted terms of one pass's queries and their matrix over coordinates.

    Bounds are whole numbers and stay below 2 to the 53rd for queries of up to some
    300,000 term occurrences; that is where products of doubles are exact.
    """

    def __init__(self, numbers: list[int], terms_of: list[list[tuple[bytes, int]]]):
        self.numbers = numbers
        self.terms_of = terms_of  # (term, weight times repeats)
        self.matrix = np.zeros((SKETCH, len(numbers)))
        for i, some in enumerate(terms_of):
            for term, weight in some:
                self.matrix[zlib.crc32(term) % SKETCH, i] += weight


def _document_frequencies(index: SearchIndex, wanted: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each wanted term; no more rows come back than terms are wanted."""
    spark = index.table.sparkSession
    asked = spark.createDataFrame(pa.table({"term": pa.array([w.decode() for w in wanted], pa.string())}))
    each = index.table.select(F.explode(F.split(F.col("terms").cast("string"), " ")).alias("term"))
    found = each.join(asked, "term", "left_semi").groupBy("term").count()
    return {r["term"].encode(): r["count"] for r in found.collect()}


def _exact(held: dict[bytes, int], m: int, asked: list[tuple[bytes, int]]) -> int:
    score = 0
    for term, weight in asked:
        tf = held.get(term)
        if tf:
            score += weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))
    return score


class _Places:
    """The best documents of one query so far; worse ones leave."""

    def __init__(self, top: int, floor: int):
        self.top = top
        self.floor = floor
        self.heap: list[tuple] = []

    def add(self, score: int, id_) -> None:
        if score < self.floor or score <= 0:
            return
        # the root is the worst: lowest score, then no id, then the greatest id
        item = (score, _Last(id_))
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)
        if len(self.heap) == self.top:
            self.floor = max(self.floor, self.heap[0][0])


class _Last:
    """Orders ids backwards, a missing one first."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other: "_Last") -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.id == other.id


def _search(queries: Queries, floors: list[int], docs: int, length: int, top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, score, id): of this task's documents those that may be among the best ``top``."""
    best = [_Places(top, floor) for floor in floors]
    type_ = None
    for batch in batches:
        type_ = batch.schema.field("id").type
        for start in range(0, batch.num_rows, BLOCK_DOCS):
            block = batch.slice(start, BLOCK_DOCS)
            ids = block.column("id").to_pylist()
            n = block.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            m = 75 + 25 * n * docs // length
            codes = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(len(ids), SKETCH)
            tf = STEPS[codes]
            # whole numbers below 2 to the 53rd: the product is exact in any order
            bounds = (1_000_000_000 * tf // (1000 * tf + 12 * m[:, None])).astype(np.float64) @ queries.matrix
            floor_now = np.array([max(p.floor, 1) for p in best], np.float64)
            told, times, held = block.column("terms"), block.column("times"), {}
            for q in np.flatnonzero((bounds >= floor_now).any(axis=0)):
                place, asked = best[q], queries.terms_of[q]
                mine = bounds[:, q]
                rows = np.flatnonzero(mine >= floor_now[q])
                for row in rows[np.argsort(-mine[rows], kind="stable")].tolist():
                    if mine[row] < place.floor:
                        break  # so are all bounds that follow
                    if row not in held:
                        held[row] = dict(zip(told[row].as_py().split(), times[row].as_py()))
                    place.add(_exact(held[row], int(m[row]), asked), ids[row])
    found = [(queries.numbers[q], score, last.id) for q, p in enumerate(best) for score, last in p.heap]
    if found:
        number, score, ids = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(score, pa.int64()), pa.array(ids, type_)], names=["query", "score", "id"])


def _passes(items: DataFrame) -> list[DataFrame]:
    """The queries (query, text), dealt over passes of bounded size."""
    rows = items.select("query", utf8().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("bytes")).first()["bytes"] or 0
    # a term takes two bytes with its break at least
    count = max(1, -(-size // (2 * PASS_TERMS)))
    return [rows.where(F.pmod(F.xxhash64("query"), F.lit(count)) == i) for i in range(count)]


def ranked_search(index: SearchIndex, items: DataFrame, item: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """item, rank, doc_id, score: the ``top`` best documents of every item, highest first.

    A term's weight is ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``; a document
    scores the sum of weight times impact over the item's terms, repeats included.
    Equal scores rank by ascending id, a missing id last; documents of score 0 are
    not given.  Null and empty texts of documents and items have no terms, an item
    without terms, an empty table of items or of documents gives no rows.  Items
    equal in id and text count once; other items with one id, or none, are ranked
    each by itself.  Repeated documents and documents of one id all take part.
    Other columns of either table are ignored.
    """
    spark = items.sparkSession
    ship(spark)
    chosen = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).distinct()
    # written, so that an item keeps its number
    chosen = Workspace(spark).save("items", chosen.withColumn("query", F.monotonically_increasing_id()))
    kind = index.table.schema["id"].dataType.simpleString()
    answers = []
    for some in _passes(chosen):
        asked = {r["query"]: Counter(terms(bytes(r["text"]))) for r in some.collect()}  # a pass of bounded size
        df = _document_frequencies(index, sorted({t for c in asked.values() for t in c}))
        weight = {t: math.floor(1000 * math.log((2 * index.docs + 2) / (2 * n + 1))) for t, n in df.items()}
        # terms that no document holds score nothing
        weighted = {q: [(t, k * weight[t]) for t, k in c.items() if t in weight] for q, c in asked.items()}
        numbers = [q for q in sorted(weighted) if weighted[q]]
        if not numbers:
            continue
        queries = Queries(numbers, [weighted[q] for q in numbers])
        floors = _floors(index, queries, top)
        run = partial(_search, queries, floors, index.docs, index.length, top)
        answers.append(index.table.mapInArrow(run, f"query bigint, score bigint, id {kind}"))
    if not answers:
        answers = [spark.createDataFrame([], f"query bigint, score bigint, id {kind}")]
    found = answers[0]
    for more in answers[1:]:
        found = found.union(more)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return found.join(chosen.select("query", "item"), "query").select(F.col("item").alias(item), "rank", F.col("id").alias("doc_id"), "score")


def _floors(index: SearchIndex, queries: Queries, top: int) -> list[int]:
    """The score of the last place among the documents of a sample: no result lies below it."""
    share = min(1.0, SAMPLE_DOCS / max(index.docs, 1))
    some = index.table.where(F.pmod(F.xxhash64("terms"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    run = partial(_search, queries, [0] * len(queries.numbers), index.docs, index.length, top)
    scores = some.mapInArrow(run, f"query bigint, score bigint, id {index.table.schema['id'].dataType.simpleString()}")
    best = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
    last = {r["query"]: r["score"] for r in best.where(F.col("rank") == top).select("query", "score").collect()}  # a row a query
    return [last.get(q, 0) for q in queries.numbers]
