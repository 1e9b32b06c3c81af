import random

from pyspark.sql import functions as F

from turnweave.functions import numeric as nm
from turnweave.functions import text as tx
from turnweave.functions.lexicon import DEFAULT_LEXICON, Lexicon


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_clean_text_unicode_blanks(spark):
    raw = "　a \u0085b\x1c\x1fc \n d　"
    assert one(spark, raw, tx.clean_text) == " ".join(raw.split()) == "a b c d"
    assert one(spark, None, tx.clean_text) == ""
    assert one(spark, "NaN", lambda c: tx.clean_text(c, nan_is_missing=True)) == ""
    assert one(spark, "NaN", tx.clean_text) == "NaN"


def test_find_terms_matches_plain_containment(spark):
    rng = random.Random(3)
    alphabet = "毛利率募集资金项目ab1.*"
    terms = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(60)})
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", tx.find_terms(F.col("t"), terms).alias("found")).collect():
        assert sorted(row["found"]) == sorted(t for t in terms if t in row["t"])


def test_repeated_terms_count_twice(spark):
    assert one(spark, "xay", lambda c: tx.count_terms(c, ["a", "a", "z"])) == 2
    assert one(spark, "xay", lambda c: tx.term_score(c, ["a"], 2.0)) == 0.5


def test_jaccard_variants(spark):
    df = spark.createDataFrame([("ABc", "abC"), ("", "x"), ("甲乙", "乙丙")], "a string, b string")
    got = df.select(tx.char_jaccard(F.col("a"), F.col("b")).alias("w"), tx.visible_jaccard(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r["w"] for r in got] == [0.0, 0.0, 1 / 3]
    assert [r["v"] for r in got] == [1.0, 0.0, 1 / 3]


def test_bm25_tokens(spark):
    assert sorted(one(spark, "公司AB的利润x1 甲", tx.bm25_tokens)) == sorted(["公司", "ab", "的利", "利润", "x1", "甲"])
    assert one(spark, "。！", tx.bm25_tokens) == ["。", "！"]
    assert one(spark, "", tx.bm25_tokens) == []
    assert one(spark, "公司AB 甲", tx.run_tokens) == ["公司", "AB", "甲"]


def test_extract_terms_and_overlap(spark):
    assert one(spark, "请问，利润增长。a bc", tx.extract_terms) == ["利润增长", "bc"]
    assert one(spark, "x" * 12, tx.extract_terms) == ["x" * 10, "xx"]


def test_object_terms_strip_salutations(spark):
    found = one(spark, "请问王总：临床批件 PVC项目 abc", tx.object_terms)
    assert {"临床批件", "批件", "临床", "PVC", "abc"} <= set(found)
    assert "项目" not in found and "pvc项目" not in found


def test_shared_object_order(spark):
    lex = Lexicon(objects=(), object_stopwords=(), events={}, salutations=())
    df = spark.createDataFrame([("bb aa cccc z", "cccc aa bb dd")], "a string, b string")
    score, names = tx.shared_objects(tx.object_terms(F.col("a"), lex), tx.object_terms(F.col("b"), lex))
    row = df.select(score.alias("s"), names.alias("n")).first()
    assert row["n"] == "cccc|aa|bb" and abs(row["s"] - (0.5 + 0.36)) < 1e-12


def test_zero_fill_never_truncates(spark):
    for value in ("2", "1234567", "-12", " 42 "):
        assert one(spark, value, tx.zero_fill) == value.strip().zfill(6)


def test_slugify(spark):
    assert one(spark, "Pairwise Transformer + top-K", tx.slugify) == "pairwise_transformer_top_k"
    assert one(spark, "！！", tx.slugify) == "baseline"


def test_numeric_helpers(spark):
    assert one(spark, "abc", lambda c: nm.to_number(c, 99)) == 99.0
    assert one(spark, "NaN", lambda c: nm.to_number(c, 7)) == 7.0
    assert one(spark, "inf", nm.is_finite) is False
    assert one(spark, "0", lambda c: nm.inverse_distance(c)) == 1.0
    assert nm.parse_grid("0.2,0.1,,0.2") == (0.1, 0.2)
    assert nm.format_grid((0.1, 0.25)) == "0.1,0.25"
    assert nm.parse_topk("3,1") == (1, 3)


def test_lexicon_terms_hold_no_blank():
    assert all(not any(c.isspace() for c in t) for t in DEFAULT_LEXICON.channel_vocabulary())
