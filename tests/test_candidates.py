import random

from pyspark.sql import functions as F

from turnweave.operators import candidates as C
from turnweave.operators.prefix import boundary_slice, integer_slice, sliced_index, sliced_running_sum, unit_slice


def turns(spark, seed=1, hot=120):
    """One session holds most rows; gaps in the order key, odd roles."""
    rng = random.Random(seed)
    rows = []
    for conv, size in ((1, hot), (2, 7), (3, 1), (4, 12)):
        turn = rng.randint(0, 5)
        for _ in range(size):
            role = rng.choice(["user", "user", "assistant", "system"])
            text = rng.choice(["", "  ", "q%d" % turn, "long text %d" % turn])
            rows.append((conv, turn, role, text))
            turn += rng.choice([1, 1, 1, 9])
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows


def expected(rows, window):
    records = {}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for conv, items in by.items():
        items.sort(key=lambda r: r[1])
        for i, (_, _, role, text) in enumerate(items):
            if role != "user":
                continue
            nxt = items[i + 1] if i + 1 < len(items) else None
            answer = nxt[3] if nxt and nxt[2] == "assistant" else ""
            records.setdefault(conv, []).append((" ".join(text.split()), " ".join(answer.split())))
    out = set()
    for conv, items in records.items():
        for i, (q, a) in enumerate(items):
            for j in range(i + 1, min(i + 1 + window, len(items))):
                if q and a and items[j][0]:
                    out.add((f"{conv}_{i}_{j}", q, a, items[j][0], j - i))
    return out


def collect(df):
    return {(r["edge_id"], r["Q1"], r["A1"], r["Q2"], r["distance"]) for r in df.collect()}


def test_both_layouts_match_a_plain_loop(spark):
    df, rows = turns(spark)
    for window in (1, 5):
        want = expected(rows, window)
        assert collect(C.candidate_edges(C.records_from_turns(df), window)) == want
        for block in (5, 16):
            got = C.candidate_edges(C.records_from_turns(df, block=block), window, block)
            assert collect(got) == want and got.count() == len(want)


def test_block_choice_follows_the_largest_session(spark):
    df, _ = turns(spark)
    assert C.choose_block(df, "conv_id", limit=1000) is None
    assert C.choose_block(df, "conv_id", limit=50, block=8) == 8


def test_carried_columns(spark):
    df, _ = turns(spark)
    records = C.records_from_turns(df).withColumn("m", F.length("Q"))
    bad = C.candidate_edges(records, 3, source=["m"], target=["m"]).where(
        (F.col("m") != F.length("Q1")) | (F.col("Q2_m") != F.length("Q2"))
    )
    assert bad.isEmpty()


def test_number_records_in_blocks(spark):
    rows = [("s", i * 3 % 50, i) for i in range(50)] + [("t", 5, 1)]
    df = spark.createDataFrame(rows, "session_id string, Qnumbr long, x int")
    a = C.number_records(df).select("session_id", "Qnumbr", "pos")
    b = C.number_records(df, block=4).select("session_id", "Qnumbr", "pos")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    dated = df.withColumn("Date", F.when(F.col("x") % 9 > 0, F.concat(F.lit("2019-0"), (F.col("x") % 9).cast("string"))))
    a, b = (C.number_records(dated, order=("Date", "x"), block=k).select("session_id", "x", "pos") for k in (None, 4))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_sliced_sums_equal_one_window(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else "cold", rng.random() * 1.2 - 0.1, rng.randint(0, 4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, s double, v int").dropDuplicates(["g", "s"])
    got = None
    for cut in (unit_slice(F.col("s"), 16), unit_slice(F.col("s") * 40 - 9, 4), boundary_slice(F.col("s"), [0.1, 0.11, 0.9]), F.lit(0).cast("long")):
        out = sliced_running_sum(df, ["g"], cut, [F.col("s").desc()], {"c": F.col("v")}, descending=True)
        now = sorted((r["g"], r["s"], r["c"]) for r in out.collect())
        assert got is None or now == got
        got = now
    want = []
    for g in ("hot", "cold"):
        total = 0
        for r in sorted((r for r in df.collect() if r["g"] == g), key=lambda r: -r["s"]):
            total += r["v"]
            want.append((g, r["s"], total))
    assert got == sorted(want)


def test_sliced_index_without_groups(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    out = sliced_index(df, [], integer_slice(F.col("k"), 100), [F.col("k")])
    assert [r["idx"] for r in out.orderBy("k").collect()] == list(range(out.count()))


def test_raw_records(spark):
    raw = spark.createDataFrame(
        [("2", "2019", "1", "q", None), (None, None, None, None, None), ("123456", " 2020", "2", "x", "y")],
        "` Scode` string, Year string, Qnumbr string, Qcntet string, Acntet string",
    )
    out = C.prepare_raw_records(raw)
    assert [r["session_id"] for r in out.orderBy("session_id").collect()] == ["000002_2019", "123456_2020"]


def test_sampling_keeps_the_best_half(spark):
    df, _ = turns(spark, hot=600)
    edges = C.candidate_edges(C.records_from_turns(df), 5)
    sample = C.sample_candidates(edges, 10, 1)
    assert sample.count() == 10 and sample.select("edge_id").distinct().count() == 10
    again = C.sample_candidates(edges.repartition(7), 10, 1)
    assert [r["edge_id"] for r in sample.collect()] == [r["edge_id"] for r in again.collect()]
    assert C.sample_candidates(edges, 10**6).count() == edges.count()


def test_turn_features_match_record_features_in_both_layouts(spark):
    df, _ = turns(spark)
    use = {"chars": C.word_chars}
    want = C.record_chars(C.records_from_turns(df)).select(
        "session_id", "pos", "q_chars", "a_chars", F.length("Q").alias("q_size"), F.length("A").alias("a_size")
    )
    for block in (None, 5):
        got = C.records_from_turns(df, block=block, features=use, texts=False).select(want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        edges = C.candidate_edges(C.records_from_turns(df, block=block, texts=False), 5, block, texts=False)
        keys = C.candidate_edges(C.records_from_turns(df), 5).select("edge_id")
        assert edges.select("edge_id").exceptAll(keys).isEmpty() and edges.count() == keys.count()
