import json

from pyspark.sql import functions as F

from turnweave.operators import labeling, pairs, splits
from turnweave.sources import readers
from turnweave.streaming.labeling import label_stream, labelled_so_far

COLUMNS = "edge_id string, session_id string, Q1_row int, Q2_row int, distance int, Q1 string, A1 string, Q2 string"


def edge_frame(spark, n=12):
    return spark.createDataFrame(
        [(f"s_{i}_{i + 1}", "s", i, i + 1, 1, f"q{i}", "a", f"毛利 question number {i} again") for i in range(n)], COLUMNS
    )


def test_response_parsing(spark):
    good = json.dumps({"dependent": "Yes", "dependency_type": "t", "relation_type": "Interaction-Complaint", "reason": "r"})
    rows = [(good,), (f"text {good} more",), ("",), (None,), ("nothing",), ('{"dependent":"No","relation_type":"x"}',), ('{"dependent":"?"}',)]
    df = spark.createDataFrame(rows, "response string").withColumn("p", labeling.parse_response(F.col("response")))
    rules = labeling.normalize_labels(F.col("p"), F.col("response"))
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in rules.items()]).collect()]
    assert got[0] == got[1] == ("Yes", "t", "Complaint", "r")
    assert got[2] == got[3] == got[4] == ("Error", "Error", "Error", "API failed")
    assert got[5][:3] == ("No", "No-Dependency", "Topic Shift")
    assert got[6][0] == "Error"


def test_label_run_and_resume(spark):
    edges = labeling.initialize_labels(edge_frame(spark))
    answer = lambda prompt: '{"dependent":"Yes","dependency_type":"t","relation_type":"Elaboration","reason":"x"}'
    first = labeling.label_edges(edges, answer, limit=5, pause=0)
    assert first.where("done = 1").count() == 5
    second = labeling.label_edges(first, answer, pause=0)
    assert second.where("done = 1 and dependent = 'Yes'").count() == 12

    def failing(prompt):
        raise RuntimeError("down")

    stopped = labeling.label_edges(edges.coalesce(1), failing, retries=1, pause=0, stop_after=3)
    assert stopped.where("done = 1 and dependent = 'Error'").count() == 3
    assert stopped.where(labeling.is_pending()).count() == 9
    assert stopped.where(labeling.is_pending(retry_errors=True)).count() == 12


def test_label_stream_is_idempotent(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    edges = edge_frame(spark)
    edges.repartition(3).write.parquet(source)
    calls = '{"dependent":"No"}'
    query = label_stream(spark, source, edges.schema, lambda p: calls, out, check, denoise=False, pause=0)
    query.awaitTermination()
    assert labelled_so_far(spark, out).where("dependent = 'No' and done = 1").count() == 12
    edge_frame(spark, 2).withColumn("edge_id", F.concat(F.lit("n"), "edge_id")).write.mode("append").parquet(source)
    label_stream(spark, source, edges.schema, lambda p: calls, out, check, denoise=True, pause=0).awaitTermination()
    assert labelled_so_far(spark, out).select("edge_id").distinct().count() == 14


def test_batches_with_a_hot_anchor(spark):
    rows = [("hot", f"c{i}") for i in range(40)] + [(f"a{i}", f"d{i}") for i in range(70)]
    df = spark.createDataFrame(rows, "anchor string, candidate string")
    out = pairs.unique_anchor_batches(df, 4, slices=8)
    sizes = out.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("anchor").alias("a")).collect()
    assert all(r["n"] == r["a"] and 2 <= r["n"] <= 4 for r in sizes)
    assert out.count() == 110 and out.distinct().count() == 110
    lonely = pairs.unique_anchor_batches(df.where("anchor = 'hot'"), 4)
    assert lonely.isEmpty()


def test_positive_mask_and_pairs(spark):
    df = edge_frame(spark).withColumn("split", F.lit("train")).withColumn(
        "dependent", F.when(F.col("Q1_row") % 2 == 0, " YES ").otherwise("No")
    )
    twice = df.unionByName(df)
    stats = pairs.pair_stats(twice).first()
    assert stats["train_positive_rows"] == 12
    assert stats["unique_train_positive_pairs"] == 6 and stats["duplicate_positive_pairs_removed"] == 6


def test_encodings(spark, tmp_path):
    text = "Scode,Year,Qnumbr,Qcntet,Acntet\n2,2019,10,公司的利润,谢谢\n2,2019,9,\"多行\n问题\",好\n"
    for name, encoding in (("gbk", "gbk"), ("utf", "utf-8"), ("bom", "utf-8-sig")):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(text.encode(encoding))
        want = "GBK" if name == "gbk" else "UTF-8"
        assert readers.detect_encoding(spark, str(path)) == want
        rows = readers.read_raw_records(spark, str(path)).orderBy("pos").collect()
        assert [(r["session_id"], r["pos"], r["Q"]) for r in rows] == [
            ("000002_2019", 0, "多行 问题"), ("000002_2019", 1, "公司的利润")
        ]


def test_manifest_contract(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("session_id,split\n a ,VAL\nb,train\nc,test\n", encoding="utf-8-sig")
    manifest = readers.read_manifest(spark, str(path), expected={"validation": 1})
    assert {r["session_id"]: r["split"] for r in manifest.collect()} == {"a": "validation", "b": "train", "c": "test"}
    bad = spark.createDataFrame([("a", "train"), ("a", "test"), ("", "x")], "session_id string, split string")
    try:
        splits.check_manifest(bad)
    except ValueError as error:
        assert "repeated_sessions=1" in str(error) and "empty_sessions=1" in str(error)
    else:
        raise AssertionError("a broken manifest passed")


def test_embedding_table_is_keyed_by_content(spark):
    import numpy as np

    from turnweave.operators import encoding

    encoder = lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=float)
    df = spark.createDataFrame([("e1", "aa"), ("e2", "b"), ("e3", "aa")], "edge_id string, text string")
    table = encoding.encode_texts(df, encoder)
    assert table.count() == 2
    fail = lambda texts: 1 / 0
    again = encoding.encode_texts(df, fail, known=table)
    for salts in (0, 4):
        out = encoding.attach(df, again, "text", salts=salts).orderBy("edge_id").collect()
        assert [list(r["embedding"]) for r in out] == [[2.0, 2.0], [1.0, 0.0], [2.0, 2.0]]
    pairs_ = encoding.encode_pairs(df.withColumn("b", F.lit("z")), lambda a, b: encoder(a), "text", "b")
    assert encoding.attach(df.withColumn("b", F.lit("z")), pairs_, "text", "b").where("embedding is null").isEmpty()


def test_records_and_hashes(tmp_path):
    from turnweave.functions.text import text_protocol_hash
    from turnweave.operators import contracts
    from turnweave.sources import writers

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("1")
    first = writers.directory_hash(str(tmp_path))
    (tmp_path / "a" / "x.txt").write_text("2")
    assert first != writers.directory_hash(str(tmp_path))
    assert text_protocol_hash() == text_protocol_hash() != text_protocol_hash(version="2")
    record = {**contracts.ENCODER_PROTOCOL, "train_file_sha256": "d", "session_manifest_sha256": "m", "session_counts": {"train": 1}}
    contracts.check_encoder_record(record, "d", "m", {"train": 1})
    try:
        contracts.check_encoder_record({**record, "train_only": False}, "x", "m", {"train": 1})
    except RuntimeError as error:
        assert "train_only" in str(error) and "train_file_sha256" in str(error)
    else:
        raise AssertionError("a foreign encoder passed")
