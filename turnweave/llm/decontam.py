"""Benchmark decontamination by winnowing, in DataFrame operations only.

Benchmark items and documents are winnowed alike: a text's fingerprints are the smallest k-gram hash of every sliding window of
``window - k + 1`` k-grams, so two texts that share ``window`` consecutive words
share a fingerprint inside them.  A bitmap of the benchmark's fingerprints (a
literal) sorts out nearly all others in the row; what is left meets the benchmark
by hash, and each meeting is extended word by word to both sides.  A meeting
carries only the words around it, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import Workspace

WINDOW = 10
GRAM = 5
#: longs in the bitmap of benchmark fingerprints: a power of two between these, with some 16 bits a fingerprint
LEAST_LONGS, MOST_LONGS = 1 << 14, 1 << 18
#: benchmark fingerprints up to this many bytes are broadcast, more are joined by a shuffle
BROADCAST_BYTES = 64 << 20

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str = "text") -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    known = F.coalesce(F.col(text), F.lit(""))
    plain = F.length(known) == F.octet_length(known)
    # lower() changes more than A-Z outside ASCII
    low = F.when(plain, F.lower(known)).otherwise(F.translate(known, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, _BREAK), "")


def _grams(hashes: str, k: int) -> Column:
    rest = ", ".join(f"get({hashes}, i + {j})" for j in range(1, k))
    return F.expr(
        f"transform(slice({hashes}, 1, greatest(size({hashes}) - {k - 1}, 0)), (x, i) -> xxhash64({k}, x{', ' + rest if rest else ''}))"
    )


def _selected(grams: str, window: int, k: int) -> str:
    """Whether gram i is the smallest of some window of k-grams that holds it."""
    span = window - k + 1
    left = f"array_max(transform(sequence(0, {span - 1}), d -> if(i - d >= 0 and i - d + {span} <= size({grams}) and array_min(slice({grams}, i - d + 1, {span})) = get({grams}, i), 1, 0)))"
    return f"{left} = 1"


def benchmark_fingerprints(benchmark: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """(fp, width, item_id, ctx): fingerprints of an item and the words around each.

    ``width`` is k for items of at least ``window`` words; shorter items are one
    window and have the hash of all their words, with minus their number as width,
    so that whole items of k words are told from winnowed grams.
    ``ctx`` holds ``window - k`` places to either side, null beyond the ends.
    """
    side = window - k
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words().alias("w")).where("size(w) > 0").distinct()
    items = items.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    long = items.where(F.size("w") >= window).withColumn("g", _grams("h", k))
    # winnowed like the documents: equal windows have equal smallest grams, and ties are all kept
    kept = f"filter(transform(g, (x, i) -> if({_selected('g', window, k)}, struct(i as p, x as fp), null)), s -> s is not null)"
    long = long.select("item_id", "w", F.inline(F.expr(kept))).select(
        "fp", F.lit(k).alias("width"), "item_id",
        F.expr(f"transform(sequence(p - {side}, p + {window - 1}), q -> if(q < 0, null, get(w, q)))").alias("ctx"),
    )
    parts = [long]
    for n in range(1, window):
        some = items.where(F.size("w") == n).withColumn("g", _grams("h", n))
        parts.append(some.select(F.get("g", F.lit(0)).alias("fp"), F.lit(-n).alias("width"), "item_id", F.col("w").alias("ctx")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``docs`` without its text, plus n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit when it lies inside an occurrence of ``window``
    consecutive words of an item, or of all words of an item that has fewer.
    Null and empty texts have no words and are not contaminated; items without
    words are ignored, an item without id counts in n_hit but not in n_items.
    Every row of ``docs`` gives one row, repeated rows too; its other columns are
    kept, and an own column named like one of the results is replaced.
    """
    spark = docs.sparkSession
    prints = Workspace(spark).save("benchmark", benchmark_fingerprints(benchmark, window, k))
    # how full the bitmap gets decides only how much it sorts out
    longs, count = LEAST_LONGS, prints.count()
    while longs < MOST_LONGS and longs * 4 < count:
        longs *= 2
    bits = longs * 64
    slot = F.pmod("fp", F.lit(bits))
    filled = prints.select("width", (slot / 64).cast("int").alias("cell"), F.pmod(slot, F.lit(64)).cast("int").alias("bit"))
    cells = filled.groupBy("width", "cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).collect()
    maps: dict[int, dict[int, int]] = {}
    for row in cells:
        maps.setdefault(row["width"], {})[row["cell"]] = row["mask"]

    results = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    kept = [c for c in docs.columns if c not in (*results, "text")]
    names = {c: f"k{i}" for i, c in enumerate(kept)}
    base = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], words().alias("w"))
    base = base.withColumn("uid", F.monotonically_increasing_id()).withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    side = window - k
    seeds = []
    for width, cell in sorted(maps.items()):
        whole, n = width < 0, abs(width)
        grams = f"g{n}"
        if grams not in base.columns:  # items of k words and winnowed grams have the same hashes
            base = base.withColumn(grams, _grams("h", n))
        bitmap = ",".join(str(cell.get(i, 0)) for i in range(longs))
        bits_of = f"bits{n}{'w' if whole else ''}"
        base = base.withColumn(bits_of, F.split(F.lit(bitmap), ",").cast("array<bigint>"))
        at = f"pmod(get({grams}, i), {bits})"
        hit = f"getbit(get({bits_of}, cast({at} div 64 as int)), cast({at} % 64 as int)) = 1"
        if not whole:
            hit += f" and {_selected(grams, window, k)}"
        before, after = (0, n - 1) if whole else (side, window - 1)
        seeds.append(
            f"transform(filter(sequence(0, size({grams}) - 1), i -> size({grams}) > 0 and {hit}), i -> "
            f"struct(get({grams}, i) as fp, {width} as width, i as p, "
            f"transform(sequence(i - {before}, i + {after}), q -> if(q < 0, null, get(w, q))) as around))"
        )
    if not seeds:
        nothing = "cast(array() as array<struct<fp:bigint,width:int,p:int,around:array<string>>>)"
        seeds = [nothing]
    carried = ["uid", *names.values(), F.size("w").cast("bigint").alias("n_words")]
    every = base.select(*carried, F.expr(f"concat({', '.join(seeds)})" if len(seeds) > 1 else seeds[0]).alias("seeds"))
    met = every.select("uid", *names.values(), "n_words", F.explode_outer("seeds").alias("s"))
    met = met.select("uid", *names.values(), "n_words", "s.fp", "s.width", "s.p", "s.around")

    size = prints.select(F.sum(F.lit(24) + F.octet_length(F.concat_ws(" ", "ctx")))).first()[0] or 0
    known = prints.withColumnRenamed("width", "item_width").withColumnRenamed("fp", "item_fp")
    if size <= BROADCAST_BYTES:
        known = F.broadcast(known)
    met = met.join(known, (F.col("fp") == F.col("item_fp")) & (F.col("width") == F.col("item_width")), "left")
    # words equal outwards from the fingerprint, which must itself be equal
    same = "get(around, {0}) <=> get(ctx, {0}) and get(ctx, {0}) is not null"
    core = " and ".join(same.format(side + j) for j in range(k))
    left = "+".join("if(" + " and ".join(same.format(side - 1 - j) for j in range(d + 1)) + ", 1, 0)" for d in range(side)) or "0"
    right = "+".join("if(" + " and ".join(same.format(side + k + j) for j in range(d + 1)) + ", 1, 0)" for d in range(side)) or "0"
    grown = met.withColumn("l", F.expr(f"if(item_width = {k} and {core}, {left}, 0)")).withColumn(
        "r", F.expr(f"if(item_width = {k} and {core}, {right}, 0)")
    )
    short = "item_width < 0 and around = ctx"
    long = f"item_width = {k} and {core} and l + r + {k} >= {window}"
    span = F.expr(
        f"case when {long} then struct(p - l as s, p + {k} + r as e) when {short} then struct(p as s, p - item_width as e) end"
    )
    grown = grown.withColumn("span", span)
    gathered = grown.groupBy("uid", *names.values(), "n_words").agg(
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.collect_set(F.expr("if(span is not null, item_id, null)"))).alias("items"),
    )
    covered = "aggregate(spans, struct(0 as n, 0 as e), (a, x) -> struct(a.n + greatest(x.e - greatest(x.s, a.e), 0) as n, greatest(a.e, x.e) as e), a -> cast(a.n as bigint))"
    return gathered.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        "n_words",
        F.expr(covered).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
