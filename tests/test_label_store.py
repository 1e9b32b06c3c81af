"""Labels merged by key: the same outcome for any partitioning, nothing changes on replay."""

import json

from turnweave.operators import labeling
from turnweave.streaming import label_store

COLUMNS = "edge_id string, session_id string, Q1_row int, Q2_row int, distance int, Q1 string, A1 string, Q2 string"


def frame(spark, numbers):
    return spark.createDataFrame([(f"e{i:03d}", f"s{i // 10}", i % 10, i % 10 + 1, 1, f"q{i}", "a", f"next {i}") for i in numbers], COLUMNS)


def answering():
    """A nested function, which travels to workers whole."""

    def answer(prompt):
        number = int(prompt.split("next ")[1].split("\n")[0])
        if number in (5, 17, 18, 23, 24, 25, 26, 40):
            return " "
        return json.dumps({"dependent": "Yes" if number % 2 else "No", "dependency_type": "t", "relation_type": "Elaboration", "reason": str(number)})

    return answer


answer = answering()


def content(spark, path):
    return sorted(map(tuple, label_store.read_store(spark, path).select("edge_id", "done", "dependent", "dep_reason").collect()))


def test_breaker_does_not_depend_on_partitions(spark):
    rows = labeling.initialize_labels(frame(spark, range(60)))
    found = []
    for parts in (1, 8):
        out = label_store.label_batch(rows.repartition(parts), answer, pause=0, retries=1, stop_after=3)
        found.append({(r.edge_id, r.dependent, r.done) for r in out.collect()})
    assert found[0] == found[1] and len(found[0]) == 26  # 23, 24 and 25 fail in a row
    assert {e for e, d, _ in found[0] if d == "Error"} == {"e005", "e017", "e018", "e023", "e024", "e025"}
    every = label_store.label_batch(rows, answer, pause=0, retries=1, stop_after=0)
    assert every.count() == 60 and label_store.label_batch(rows.limit(0), answer, pause=0).count() == 0


def test_batches_merge_and_replay(spark, tmp_path):
    path = f"{tmp_path}/store"
    label_store.create_store(frame(spark, range(20)), path, 4)
    options = {"buckets": 4, "pause": 0, "retries": 1, "stop_after": 3}
    label_store.merge_batch(spark, path, frame(spark, range(10, 35)), answer, **options)
    first = content(spark, path)
    assert len(first) == 35 and sum(d for _, d, _, _ in first) == 16  # 10 to 25; 0 to 9 were not in the batch
    label_store.merge_batch(spark, path, frame(spark, range(10, 26)), answer, **options)
    assert content(spark, path) == first  # all of it is labelled
    label_store.merge_batch(spark, path, frame(spark, range(26, 35)), (lambda a: lambda p: a(p.replace("next 26", "next 27")))(answer), **options)
    assert sum(d for _, d, _, _ in content(spark, path)) == 25


def test_stream_of_batches(spark, tmp_path):
    path, source = f"{tmp_path}/store", f"{tmp_path}/in"
    edges = frame(spark, range(12))
    label_store.create_store(edges.limit(0), path, 2)
    edges.repartition(2).write.parquet(source)
    label_store.merge_stream(spark, source, edges.schema, answer, path, f"{tmp_path}/cp", buckets=2, pause=0, retries=1).awaitTermination()
    done = content(spark, path)
    assert [e for e, d, _, _ in done if d] == [f"e{i:03d}" for i in range(12)]
    label_store.merge_stream(spark, source, edges.schema, answer, path, f"{tmp_path}/cp2", buckets=2, pause=0, retries=1).awaitTermination()
    assert content(spark, path) == done
