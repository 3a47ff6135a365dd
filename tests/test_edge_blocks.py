"""Sums over neighbours by blocks of edges, against plain loops."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.operators import edge_blocks, graphs
from foliant.operators.graphs import betweenness, block_parts, page_rank


def random_edges(seed, n, m):
    rng = np.random.default_rng(seed)
    rows = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, n, (m, 2)).tolist()] + [("hub", f"n{i}") for i in range(n)]
    return [*rows, ("n1", "n1"), ("n2", None), (None, "n3"), *rows[:9]]


def neighbours(rows):
    near = {}
    for a, b in rows:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


@pytest.mark.parametrize("width", [1, 3])
def test_sums(spark, monkeypatch, width):
    monkeypatch.setattr(edge_blocks, "GATHERED", 12)
    rows = random_edges(2, 25, 60)
    near = neighbours(rows)
    graph = edge_blocks.graph_of(spark.createDataFrame(rows, "src string, dst string"), size=15)
    assert graph.count > 3
    names = {r["id"]: r for r in graph.nodes.collect()}
    assert {r["node"]: r["n"] for r in names.values()} == {k: len(v) for k, v in near.items()}
    # Every third node has nothing to send.
    value = {r["node"]: np.arange(1, width + 1) * float(i + 1) for i, r in enumerate(sorted(names.values(), key=lambda r: r["node"])) if i % 3}
    sent = [(p, r["id"], value[r["node"]].tobytes()) for r in names.values() if r["node"] in value for p in r["at"]]
    assert len({p for r in names.values() if r["node"] == "hub" for p in r["at"]}) <= graph.count
    got = {}
    for r in graph.sums(spark.createDataFrame([(p, i, bytearray(v)) for p, i, v in sent], "p int, id long, value binary"), width).collect():
        node = names[r["id"]]["node"]
        got[node] = got.get(node, 0) + np.frombuffer(r["value"], np.float64)
    graph.blocks.unpersist()
    for node, others in near.items():
        want = sum((value[o] for o in others if o in value), np.zeros(width))
        assert np.allclose(got.get(node, np.zeros(width)), want), node


def test_page_rank_and_empty_graph(spark):
    rows = random_edges(3, 30, 50)
    near = neighbours(rows)
    rank = dict.fromkeys(near, 1.0)
    for _ in range(3):
        rank = {v: 0.15 + 0.85 * sum(rank[o] / len(near[o]) for o in near[v]) for v in near}
    edges = spark.createDataFrame(rows, "src string, dst string")
    found = {r["node"]: r["rank"] for r in page_rank(edges, 3).collect()}
    assert found.keys() == rank.keys() and all(abs(found[v] - rank[v]) < 1e-9 for v in rank)
    assert page_rank(edges.filter(F.lit(False)), 2).count() == 0


def test_betweenness_in_blocks_of_sources(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("d", "e"), ("e", "f"), ("x", "y"), ("y", "x")]
    near = neighbours(rows)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        level, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for o in near[v]:
                if o not in level:
                    level[o], paths[o] = level[v] + 1, 0.0
                    order.append(o)
                if level[o] == level[v] + 1:
                    paths[o] += paths[v]
        part = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            part[v] = sum(paths[v] / paths[o] * (1 + part[o]) for o in near[v] if level[o] == level[v] + 1)
            if v != s:
                want[v] += part[v] / 2
    found = {r["node"]: (r["betweenness"], r["bound"]) for r in betweenness(spark.createDataFrame(rows, "src string, dst string"), block_cells=40).collect()}
    assert found.keys() == want.keys() and all(abs(found[v][0] - want[v]) < 1e-9 and found[v][1] == 0 for v in want)


def test_pages_grow_with_rows_from_blocks(spark, monkeypatch):
    """A hub gets a row from each block, so a page's rows are bounded by those that come in, not by the nodes."""
    seen = []
    monkeypatch.setattr(graphs, "graph_of", lambda edges: seen.append(edge_blocks.graph_of(edges, size=8)) or seen[-1])
    monkeypatch.setattr(graphs, "block_parts", lambda graph, sources, width, pages: seen.append((width, pages)) or block_parts(graph, sources, width, pages))
    rows = [(f"h{i}", f"n{j}") for i in range(4) for j in range(20)]
    found = betweenness(spark.createDataFrame(rows, "src string, dst string"), pivots=6, block_cells=120)
    assert found.count() == 24
    sent = seen[0].nodes.select(F.sum(F.size("at"))).first()[0]
    assert seen[0].count > 4 and sent > 2 * 24
    assert all(sent * width / pages <= 30 for width, pages in seen[1:])


def test_packed_rows_are_not_copied():
    rows = np.arange(12.0).reshape(4, 3)
    column = pa.chunked_array([edge_blocks.packed(rows)[1:], pa.array([None], pa.binary()), edge_blocks.packed(rows[:1])])
    value, at = edge_blocks.unpacked(column, 3)
    assert [value[i].tolist() for i in at[[0, 1, 2, 4]]] == [*rows[1:].tolist(), rows[0].tolist()]
    one = pa.chunked_array([edge_blocks.packed(rows)[1:]])
    value, at = edge_blocks.unpacked(one, 3)
    assert value.tolist() == rows[1:].tolist() and not value.flags.owndata and at.tolist() == [0, 1, 2]
    assert edge_blocks.unpacked(pa.chunked_array([], pa.binary()), 3)[0].shape == (0, 3)
