"""Near-duplicate groups with HyperMinHash sketches.

Shingles are hashed once.  The top bits of a hash name its bucket; of each
bucket's smallest hash only the number of leading zeros and a few mantissa bits
are kept (one register).  Bands of registers give candidate pairs, the
share of equal registers, corrected for accidental equality, gives an estimate
of the Jaccard similarity, and what the estimate cannot rule out is confirmed
on full sets.

Copies (equal shingle sets) are one class each, so a class of any size takes
part as one row.  Inside a bucket of many classes no pairs are listed: all are
first compared with the bucket's smallest class; only classes that are still in
different components after that meet in blocks, and a block gives back only the
pairs that the estimate cannot rule out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import ASCII_LOWER, Workspace, salted_lookup, ship, utf8

SHINGLE = 5
SIMILARITY = 0.8
#: 2**BUCKET_BITS registers make the bands, 2**FINE_BITS the estimate
BUCKET_BITS = 8
FINE_BITS = 10
#: mantissa bits of a register of the bands (16 bits in all) and of the estimate (8 bits)
MANTISSA_BITS = 10
FINE_MANTISSA_BITS = 4
BAND_ROWS = 6
BANDS = 42
#: standard deviations (and slack) below the threshold that an estimate must lie to rule a pair out
SIGMAS = 5.0
SLACK = 0.01
#: buckets up to this many classes list their pairs at once
SMALL_BUCKET = 8
#: cells of 64 bits in the filter that picks texts to be read again
FILTER_CELLS = 1 << 14
#: classes on one side of a block
BLOCK = 2_048

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class _Hashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than ``size`` are one shingle."""
    words = text.translate(ASCII_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width = min(n, size)
    total = np.full(n - width + 1, np.uint64(width), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            # word and place are mixed before they are added up
            total += _mix(hashed[i : n - width + 1 + i] + _ODD[i % 8] * np.uint64(i // 8 + 1))
            total = (total << np.uint64(7)) | (total >> np.uint64(57))
        return np.unique(_mix(total))


def registers(hashes: np.ndarray, bits: int, mantissa_bits: int = MANTISSA_BITS) -> np.ndarray:
    """HyperMinHash registers of sorted hashes: 0 is empty, else 1 + zeros and mantissa."""
    kind, most = (np.uint16, 62) if mantissa_bits > FINE_MANTISSA_BITS else (np.uint8, 14)
    out = np.zeros(1 << bits, kind)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the smallest hash of each bucket
        rest = (hashes[first] << np.uint64(bits)) >> np.uint64(11)  # 53 bits: exact as a float
        length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
        zeros = np.minimum(53 - length, most).astype(np.uint64)
        shift = length - 1 - mantissa_bits
        mantissa = np.where(
            shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64)
        ) & np.uint64((1 << mantissa_bits) - 1)
        out[bucket[first]] = (zeros * np.uint64(1 << mantissa_bits) + mantissa + np.uint64(1)).astype(kind)
    return out


def fine_registers(hashes: np.ndarray) -> np.ndarray:
    return registers(hashes, FINE_BITS, FINE_MANTISSA_BITS)


#: where an empty register looks for a value: the same places in every text
_PROBES = np.random.default_rng(1).integers(0, 1 << BUCKET_BITS, (1 << BUCKET_BITS, 512), np.int16)


def filled(regs: np.ndarray) -> np.ndarray:
    """Empty registers take the first value on their way through the others.

    Then any register of two texts is equal with the chance of their Jaccard
    similarity, and short texts do not meet by what their bands lack.
    """
    out = regs.copy()
    for width in (16, 512):
        empty = np.flatnonzero(out == 0)
        if not len(empty):
            break
        found = regs[_PROBES[empty, :width]]
        out[empty] = found[np.arange(len(empty)), (found != 0).argmax(axis=1)]
    if (out == 0).any():
        out[out == 0] = regs.max()
    return out


def band_keys(regs: np.ndarray, rows: int = BAND_ROWS, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band of registers without gaps."""
    part = regs[: rows * bands].reshape(bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = _mix((part * _ODD[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _ODD[7])
        key = _mix(key + _mix(part + _ODD[6]).dot(_ODD[:rows]))
    return key.view(np.int64)


def accidental(n_a: float, n_b: float, bits: int) -> float:
    """Chance that a register of two disjoint sets is equal and in use.

    Sums over leading-zero counts; the mantissa cells inside one count are
    narrow, so the product of two cell masses is taken at its mean.
    """
    a, b = n_a / (1 << bits), n_b / (1 << bits)
    zeros = np.arange(0, 54)
    high, low = 0.5**zeros, 0.5 ** (zeros + 1)
    mass_a = np.exp(-a * low) - np.exp(-a * high)
    mass_b = np.exp(-b * low) - np.exp(-b * high)
    either = 1 - np.exp(-(a + b))
    return float((mass_a * mass_b).sum() / (1 << FINE_MANTISSA_BITS) / max(either, 1e-12))


def estimates(one: np.ndarray, others: np.ndarray, n_one: int, n_others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimates of one register row against others, and the least that cannot be ruled out."""
    used = (one != 0) | (others != 0)
    total = np.maximum(used.sum(axis=1), 1)
    equal = ((one == others) & used).sum(axis=1)
    by_chance = accidental(n_one, float(np.mean(n_others)), FINE_BITS)
    share = np.maximum(0.0, (equal / total - by_chance) / (1 - by_chance))
    union = np.maximum((n_one + n_others) / (1 + SIMILARITY), total)
    # registers are draws without replacement from the union
    spread = np.sqrt(SIMILARITY * (1 - SIMILARITY) / total * np.maximum(1 - total / union, 0.05))
    return share, SIMILARITY - SIGMAS * spread - SLACK


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sorted sets."""
    low, high = sorted((len(a), len(b)))
    if not low or 100 * low < percent * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, keys = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text, size)
                counts.append(len(found))
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(band_keys(filled(registers(found, BUCKET_BITS))) if len(found) else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "content", "n_shingles", "node", "keys"],
            )

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [], [])
            for nid, node, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = shingle_set(text, size)
                if hashlib.blake2b(found.tobytes(), digest_size=16).digest() == node:
                    for column, value in zip(
                        out,
                        (nid, len(found), fine_registers(found).tobytes(), found.tobytes(),
                         band_keys(filled(registers(found, BUCKET_BITS))).tobytes()),
                        strict=True,
                    ):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["nid", "n", "regs", "hashes", "bands"]
            )

    return run


def _ruled_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n_a, n_b, regs_a, regs_b) that the estimate cannot rule out."""
    for batch in batches:
        left, right, n_a, n_b, regs_a, regs_b = (batch.column(i).to_pylist() for i in range(6))
        keep = []
        for i in range(len(left)):
            one = np.frombuffer(regs_a[i], np.uint8)
            other = np.frombuffer(regs_b[i], np.uint8)[None, :]
            share, least = estimates(one, other, n_a[i], np.array([n_b[i]]))
            keep.append(bool(share[0] >= least[0]))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_a, sets_b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            mask = pa.array(
                [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(sets_a, sets_b, strict=True)],
                pa.bool_(),
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _block(table: pa.Table) -> pa.Table:
    """Pairs of a block that are in different components, and that the estimate cannot rule out.

    Classes that share several buckets give their pair in the first of them only.
    """
    nid = table["nid"].to_numpy()
    side = table["side"].to_numpy()
    label = table["label"].to_numpy()
    n = table["n"].to_numpy()
    regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint8).reshape(len(nid), -1)
    bands = np.frombuffer(b"".join(table["bands"].to_pylist()), np.int64).reshape(len(nid), -1)
    key = table["key"][0].as_py()
    same = bool(table["same"][0].as_py())
    rows = np.flatnonzero(side == 0)
    others = rows if same else np.flatnonzero(side == 1)
    found: tuple[list, list] = ([], [])
    for i in rows:
        apart = others[(label[others] != label[i]) & ((nid[others] > nid[i]) if same else True)]
        if len(apart):
            share, least = estimates(regs[i], regs[apart], int(n[i]), n[apart])
            near = apart[share >= least]
            first = (bands[near] == bands[i]).argmax(axis=1) if len(near) else near
            hits = nid[near[bands[i][first] == key]]
            found[0].extend(np.minimum(hits, nid[i]).tolist())
            found[1].extend(np.maximum(hits, nid[i]).tolist())
    return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})


def _check_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among distinct pairs (a, b): estimate first, then full sets."""
    narrow = sets.select("nid", "n", "regs")
    near = _attach(_attach(pairs, narrow, "a"), narrow, "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    near = near.mapInArrow(_ruled_in, "a bigint, b bigint")
    full = sets.select("nid", "hashes")
    both = _attach(_attach(near, full, "a"), full, "b").select("a", "b", "hashes_a", "hashes_b")
    return both.mapInArrow(_confirmed(percent), "a bigint, b bigint")


def _attach(pairs: DataFrame, sets: DataFrame, end: str) -> DataFrame:
    other = "b" if end == "a" else "a"
    named = sets.select(F.col("nid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in sets.columns if c != "nid"])
    return salted_lookup(pairs, named, [end], F.col(other), "inner", salts=8)


def components(space: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(nid, label): label is the smallest nid reachable; only for ends of links.

    Each round takes the smallest label among neighbours and then the label of
    that label; every round is written, so lost executors cost one round.
    """
    edges = space.save(f"{name}-edges", links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = space.save(f"{name}-0", edges.groupBy(F.col("a").alias("nid")).agg(F.least("nid", F.min("b")).alias("label")))
    turn = 0
    while True:
        turn += 1
        seen = salted_lookup(edges, labels.select(F.col("nid").alias("b"), "label"), ["b"], F.col("a"), "inner", 8)
        best = seen.groupBy(F.col("a").alias("nid")).agg(F.min("label").alias("near"))
        moved = labels.join(best, "nid").select("nid", "label", F.least("label", "near").alias("lower"))
        jump = labels.select(F.col("nid").alias("lower"), F.col("label").alias("target"))
        after = salted_lookup(moved, jump, ["lower"], F.col("nid"), "left", 8).select(
            "nid",
            F.least("lower", F.coalesce("target", "lower")).alias("label"),
            (F.least("lower", F.coalesce("target", "lower")) != F.col("label")).alias("changed"),
        )
        after = space.save(f"{name}-{turn}", after)
        done = after.where("changed").isEmpty()
        space.drop(f"{name}-{turn - 1}")
        labels = after.select("nid", "label")
        if done:
            space.drop(f"{name}-edges")
            return labels


def content(text: str = "text") -> Column:
    """Hash of a text's bytes; null counts as empty."""
    return F.xxhash64(utf8(text))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = round(100 * SIMILARITY), by_row: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Rows with
    an equal shingle set form one class; classes link when
    ``100 * intersection >= percent * union``.  ``component_id`` is the smallest
    doc_id reachable over links, and a row is kept when it carries that id.

    Nulls, empty texts and texts of white space have no shingles: they link with
    nothing and keep their own id.  Rows without doc_id take part; they are kept
    only if nothing reachable has an id.  Repeated rows all stay, with one answer.
    With ``by_row`` there is also ``content``, the hash of the row's text, and of a
    group only the row with the smallest doc_id (null last) and then the smallest
    content is kept, whatever ids are null or repeated; rows without shingles all are.
    An empty table gives an empty result; other columns are ignored.  Bands and
    estimates are laid out for similarities of 0.8 and more: a lower ``percent``
    would lose links and raises.
    """
    if not round(100 * SIMILARITY) <= percent <= 100:
        raise ValueError(f"percent must lie between {round(100 * SIMILARITY)} and 100")
    spark = docs.sparkSession
    ship(spark)
    space = Workspace(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), content().alias("content"), utf8().alias("text"))
    rows = space.save(
        "rows", base.mapInArrow(_sketch(shingle), "doc_id bigint, content bigint, n_shingles bigint, node binary, keys array<bigint>")
    )

    # one row per class, numbered in the order of its first row
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_rep"), F.col("doc_id").alias("rep"), F.col("content").alias("rep_content")))
    least = rows.where("node is not null").groupBy("node").agg(first.alias("first")).select("node", "first.*")
    keyed = rows.where("node is not null").select("node", "keys").dropDuplicates(["node"])
    numbered = (
        least.join(keyed, "node")
        .repartitionByRange("no_rep", "rep", "rep_content", "node")
        .sortWithinPartitions("no_rep", "rep", "rep_content", "node")
    )
    classes = space.save("classes", numbered.select(F.monotonically_increasing_id().alias("nid"), "node", "rep", "rep_content", "keys"))

    # buckets of two and more classes
    banded = classes.select("nid", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("nid").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = space.save("members", banded.join(shared, "key"))
    small = members.where(F.col("size") <= SMALL_BUCKET).select("key", "nid")
    listed = (
        small.groupBy("key")
        .agg(F.sort_array(F.collect_list("nid")).alias("all"))
        .select(F.explode(F.expr("flatten(transform(all, (x, i) -> transform(slice(all, i + 2, size(all)), y -> struct(x as a, y as b))))")).alias("p"))
        .select("p.a", "p.b")
    )
    stars = members.where((F.col("size") > SMALL_BUCKET) & (F.col("nid") != F.col("hub"))).select(
        F.col("hub").alias("a"), F.col("nid").alias("b")
    )
    pairs = space.save("pairs", listed.union(stars).distinct())

    # full sets of the classes that share a bucket, read again from the text of their first row
    involved = members.select("nid").distinct().join(classes.select("nid", "node", "rep", "rep_content"), "nid")
    involved = space.save("involved", involved)
    place = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "content")
    # a bit per hashed doc_id and content, of fixed size: it lets few other texts into the shuffle
    bits = involved.select(F.xxhash64(F.coalesce("rep", F.lit(-1)), "rep_content").alias("h"))
    bits = bits.select(F.pmod(F.shiftright("h", 6), F.lit(FILTER_CELLS)).alias("cell"), F.pmod("h", F.lit(64)).cast("int").alias("bit"))
    cells = bits.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    some = base.withColumn("h", place).withColumn("cell", F.pmod(F.shiftright("h", 6), F.lit(FILTER_CELLS)))
    some = some.join(F.broadcast(cells), "cell").where("getbit(bits, cast(pmod(h, 64) as int)) = 1").select("doc_id", "content", "text")
    first_row = some["doc_id"].eqNullSafe(involved["rep"]) & (some["content"] == involved["rep_content"])
    texts = some.join(involved, first_row).select("nid", "node", "text")
    sets = texts.mapInArrow(_full_sets(shingle), "nid bigint, n bigint, regs binary, hashes binary, bands binary")
    sets = space.save("sets", sets.dropDuplicates(["nid"]))

    links = space.save("links", _check_pairs(pairs, sets, percent))
    labels = components(space, links, "first")

    # large buckets whose classes are still apart
    large = members.where(F.col("size") > SMALL_BUCKET)
    tagged = large.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    open_keys = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    left_over = tagged.join(open_keys.select("key"), "key")
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = left_over.withColumn("chunk", F.pmod(F.xxhash64("nid"), chunks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), chunks - 1))
    )
    blocks = dealt.select(
        "key", "nid", "label",
        F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        (F.col("chunk") > F.col("other")).cast("int").alias("side"), (F.col("chunk") == F.col("other")).alias("same"),
    ).join(sets.select("nid", "n", "regs", "bands"), "nid")
    rest = blocks.groupBy("key", "i", "j").applyInArrow(_block, "a bigint, b bigint").distinct()
    more = space.save("more", _check_pairs(space.save("rest", rest), sets, percent))
    if not more.isEmpty():
        labels = components(space, links.union(more), "second")

    # back to rows: class -> label -> first row of the label
    reps = classes.select(F.col("nid").alias("label"), F.col("rep").alias("component_id"), F.col("rep_content").alias("component_content"))
    moved = salted_lookup(labels, reps, ["label"], F.col("nid"), "inner", 8).select("nid", "component_id", "component_content", F.lit(True).alias("linked"))
    final = classes.select("nid", "node", "rep", "rep_content").join(moved, "nid", "left")
    own = F.col("linked").isNull()
    answer = final.select(
        "node",
        F.when(own, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(own, F.col("rep_content")).otherwise(F.col("component_content")).alias("component_content"),
    )
    named = salted_lookup(rows.select("doc_id", "content", "n_shingles", "node"), answer, ["node"], F.coalesce("doc_id", F.lit(-1)), "left")
    alone = F.col("node").isNull()
    found = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(found)
    if by_row:
        kept = kept & (alone | (F.col("content") == F.col("component_content")))
    given = named.select("doc_id", "content", "n_shingles", found.alias("component_id"), kept.alias("kept"))
    return given if by_row else given.drop("content")
