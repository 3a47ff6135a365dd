"""split_oversized() against one pass of union-find over the edges, strongest first."""

import random

import pytest

from foliant.operators.graphs import split_oversized


def by_union_find(edges, most):
    root, size = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    stays = set()
    for score, a, b in sorted(edges, reverse=True):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            size[y] = size.get(x, 1) + size.get(y, 1)
        if size.get(find(a), 1) <= most:
            stays.add((score, a, b))
    return stays


def graphs():
    rng = random.Random(11)
    yield "rising chain", [(float(k), k, k + 1) for k in range(40)], 6
    yield "star", [(float(k % 5), 0, k) for k in range(1, 60)], 7
    yield "two hubs", [(rng.random(), h, k) for h in (1, 2) for k in range(3, 40)] + [(0.5, 1, 2)], 9
    for n, m, most in ((60, 120, 5), (40, 300, 3)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        yield f"random {n} {m}", [(float(rng.randrange(12)), *(p if rng.random() < 0.5 else p[::-1])) for p in sorted(pairs)], most
    yield "small", [(1.0, 1, 2), (2.0, 2, 3)], 5


@pytest.mark.parametrize(("name", "edges", "most"), graphs(), ids=lambda x: x if isinstance(x, str) else "")
def test_graphs(spark, name, edges, most):
    df = spark.createDataFrame([(a, b, s) for s, a, b in edges], "a long, b long, score double")
    assert {(r.score, r.a, r.b) for r in split_oversized(df, most).collect()} == by_union_find(edges, most)


def test_names(spark):
    edges = [(1.0 - k / 100, f"n{k:02}", f"n{k + 1:02}") for k in range(30)]
    df = spark.createDataFrame([(a, b, s) for s, a, b in edges], "a string, b string, score double")
    assert {(r.score, r.a, r.b) for r in split_oversized(df, 10).collect()} == by_union_find(edges, 10)
    assert split_oversized(df.filter("score > 5"), 10).collect() == []
