"""Vector blocks against edge-by-edge loops; long and short sessions in small blocks."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from turnweave.operators import blocks

DIM, WINDOW = 3, 2


def table(seed=5):
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 40), ("b", 1), ("c", 7), (None, 5), ("d", 2)):
        for pos in range(n):
            vector = lambda: [round(rng.uniform(-1, 1), 3) for _ in range(DIM)]
            rows.append((s, pos, rng.random() < 0.8, rng.random() < 0.9, vector(), vector()))
    return rows


SHAPE = "session_id string, pos int, opens boolean, asks boolean, s array<float>, t array<float>"


def edges_of(rows):
    by = defaultdict(dict)
    for r in rows:
        by[r[0]][r[1]] = r
    out = {}
    for s, records in by.items():
        for p in records:
            for q in range(p + 1, p + WINDOW + 1):
                if q in records and records[p][2] and records[q][3]:
                    out[(s, p, q)] = (np.float32(records[p][4]).astype(float), np.float32(records[q][5]).astype(float))
    return out


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(table(), SHAPE).repartition(3)


@pytest.fixture(params=[6, 4_096])
def block(request, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_A_GROUP", 20)
    return request.param


def test_cosine(records, block):
    want = {k: float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12)) for k, (a, b) in edges_of(table()).items()}
    out = blocks.cosine_edges(records, "s", "t", WINDOW, block=block).collect()
    found = {(r.session_id, r.Q1_row, r.Q2_row): r.cosine for r in out}
    assert len(out) == len(want) and found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-12 for k in want)


def states(edges):
    nodes = {}
    for (s, p, q), (a, b) in edges.items():
        nodes[(s, p, "source")], nodes[(s, q, "target")] = a, b
    return nodes


def neighbours(edges, node):
    s, row, role = node
    if role == "source":
        return [(s, q, "target") for (x, p, q) in edges if x == s and p == row]
    return [(s, p, "source") for (x, p, q) in edges if x == s and q == row]


def test_means(records, block):
    edges = edges_of(table())
    nodes = states(edges)
    out = {(r.session_id, r.row, r.role): r.neigh for r in blocks.mean_nodes(records, "s", "t", WINDOW, block=block).collect()}
    both = {(r.session_id, r.row, r.role): r for r in blocks.in_out_nodes(records, "s", "t", WINDOW, block=block).collect()}
    assert out.keys() == both.keys() == nodes.keys()
    for node, x in nodes.items():
        near = [nodes[n] for n in neighbours(edges, node)]
        assert np.abs(np.mean([x, *near], axis=0) - out[node]).max() < 1e-12
        mean, none = np.mean(near, axis=0), np.zeros(DIM)
        into, outof = (none, mean) if node[2] == "source" else (mean, none)
        assert np.abs(into - both[node].incoming).max() < 1e-12 and np.abs(outof - both[node].outgoing).max() < 1e-12


def network(directed, n_layers, hidden=4):
    rng = np.random.default_rng(1)
    width, layers = DIM, []
    for _ in range(n_layers):
        layers.append(blocks.Layer(rng.normal(size=(hidden, width * (3 if directed else 2))), rng.normal(size=hidden), rng.normal(size=hidden), rng.normal(size=hidden)))
        width = hidden
    head = blocks.EdgeHead(blocks.Layer(rng.normal(size=(hidden, 4 * hidden)), rng.normal(size=hidden), np.ones(hidden), np.zeros(hidden)), rng.normal(size=hidden), 0.25)
    return layers, head


def plain_layer(layer, x):
    z = [sum(w * v for w, v in zip(row, x)) + b for row, b in zip(layer.weight, layer.bias)]
    mean = sum(z) / len(z)
    spread = sum((v - mean) ** 2 for v in z) / len(z)
    z = [(v - mean) / math.sqrt(spread + 1e-5) * g + h for v, g, h in zip(z, layer.scale, layer.shift)]
    return np.array([0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in z])


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("n_layers", [1, 2])
def test_forward_pass(records, directed, n_layers):
    layers, head = network(directed, n_layers)
    edges = edges_of(table())
    h = states(edges)
    for layer in layers:
        new = {}
        for node, x in h.items():
            near = [h[n] for n in neighbours(edges, node)]
            none = np.zeros(len(x))
            if directed:
                mean = np.mean(near, axis=0)
                parts = [x, none, mean] if node[2] == "source" else [x, mean, none]
            else:
                parts = [x, np.mean([x, *near], axis=0)]
            new[node] = plain_layer(layer, np.concatenate(parts))
        h = new
    want = {}
    for s, p, q in edges:
        a, b = h[(s, p, "source")], h[(s, q, "target")]
        want[(s, p, q)] = float(plain_layer(head.hidden, np.concatenate([a, b, abs(a - b), a * b])) @ head.weight + head.bias)
    out = blocks.graph_scores(records, "s", "t", layers, head, directed, WINDOW, block=8).collect()
    found = {(r.session_id, r.Q1_row, r.Q2_row): r.margin for r in out}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_one_exchange_and_no_vector_on_an_edge(records):
    frame = blocks.cosine_edges(records, "s", "t", WINDOW)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_group") == 1 and "Join" not in plan and "Window" not in plan
    assert not [f for f in frame.schema if f.dataType.typeName() == "array"]


def test_errors_and_empty(spark, records):
    assert blocks.cosine_edges(records.limit(0), "s", "t", WINDOW).collect() == []
    for bad in ({"window": 0}, {"window": 2, "block": 1}):
        with pytest.raises(ValueError):
            blocks.cosine_edges(records, "s", "t", **bad)
    with pytest.raises(ValueError):
        blocks.graph_scores(records, "s", "t", [], None)
    weights = spark.createDataFrame([("w", 0, 0, 1.0), ("w", 1, 1, 2.0)], "name string, i int, j int, value double")
    with pytest.raises(ValueError):
        blocks.layers_from_table(weights)
    full = weights.union(spark.createDataFrame([("w", 0, 1, 3.0), ("w", 1, 0, 4.0)], weights.schema))
    assert blocks.layers_from_table(full)["w"].tolist() == [[1.0, 3.0], [4.0, 2.0]]


def test_sparse_product(spark, block):
    rng = random.Random(3)
    rows = table()
    bags = [({f"w{rng.randint(0, 9)}": rng.random() for _ in range(rng.randint(0, 5))}, {f"w{rng.randint(0, 9)}": 1.0 + rng.randint(0, 2) for _ in range(4)}) for _ in rows]
    shape = "session_id string, pos int, opens boolean, asks boolean, d array<struct<term:string,x:double>>, q array<struct<term:string,x:double>>"
    frame = spark.createDataFrame([(*r[:4], list(a.items()), list(b.items()) if i % 9 else None) for i, (r, (a, b)) in enumerate(zip(rows, bags))], shape)
    at = {(r[0], r[1]): (a, b if i % 9 else {}) for i, (r, (a, b)) in enumerate(zip(rows, bags))}
    out = blocks.sparse_product_edges(frame, "d", "q", "score", WINDOW, block=block).collect()
    want = {(s, p, q): sum(x * at[s, p][0].get(t, 0.0) for t, x in at[s, q][1].items()) for s, p, q in edges_of(rows)}
    found = {(r.session_id, r.Q1_row, r.Q2_row): r.score for r in out}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_followed_records_agree_in_both_layouts(spark):
    from turnweave.operators.candidates import with_followed

    rows = [(s, p, (p * 7 + len(s or "")) % 3 == 0) for s in ("a", "bb", None) for p in range(23)]
    frame = spark.createDataFrame(rows, "session_id string, pos long, asks boolean")
    plain = {(r.session_id, r.pos): r.followed for r in with_followed(frame, 2).collect()}
    assert plain == {(r.session_id, r.pos): r.followed for r in with_followed(frame, 2, 4).collect()} and len(plain) == 69
    assert plain == {(s, p): any((s, q, True) in rows for q in (p + 1, p + 2)) for s, p, _ in rows}


def test_term_counts(spark):
    from turnweave.operators.bm25 import term_counts

    frame = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (None,)], "k array<string>")
    found = [r.c and [tuple(x) for x in r.c] for r in frame.select(term_counts("k").alias("c")).collect()]
    assert found == [[("a", 1.0), ("b", 3.0)], [], None]


def test_no_edge_matrix_of_a_whole_group(spark, monkeypatch):
    """States, features and scores are made some edges at once, whatever the size of a group."""
    monkeypatch.setattr(blocks, "EDGES_AT_ONCE", 7)
    rows = [(s, p, [float(s + p), 1.0 + p], True, True) for s in range(3) for p in range(12)]
    frame = spark.createDataFrame(rows, "session_id long, pos long, v array<double>, opens boolean, asks boolean")

    def reduce(x):
        return {"rows": np.full(len(x), len(x), np.int32), "total": x.sum(axis=1)}

    out = blocks.state_edges(frame, "v", "v", reduce, "rows int, total double", 5).collect()
    assert len(out) == 3 * (11 + 10 + 9 + 8 + 7) and max(r.rows for r in out) <= 7
    for r in out:
        s, t = (np.array([r.session_id + k, 1.0 + k]) for k in (r.Q1_row, r.Q2_row))
        assert abs(r.total - (s.sum() + t.sum() + np.abs(s - t).sum() + (s * t).sum())) < 1e-9


def test_sparse_groups_follow_the_tokens(spark, monkeypatch):
    from turnweave.operators import bm25

    frame = spark.createDataFrame([(["a"] * 40, ["b"] * 59), (None, [])], "doc_tokens array<string>, query_tokens array<string>")
    monkeypatch.setattr(bm25, "TOKENS_A_GROUP", 5_050)
    found = bm25.group_sizes(frame, ("doc_tokens", "query_tokens"), 5)
    assert found == {"rows_a_group": 100, "block": 25}
    assert bm25.group_sizes(frame.limit(0), ("doc_tokens", "query_tokens"), 5)["block"] >= 5
