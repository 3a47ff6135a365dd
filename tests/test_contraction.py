"""Components by contraction: against a plain union of sets, with hashes that collide, and with edges that shrink as numbers."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import components
from foliant.operators.components import connected_components
from foliant.plans.lineage import cut


def plain(edges):
    at = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = at.setdefault(a, {a}), at.setdefault(b, {b})
            if x is not y:
                x |= y
                at.update(dict.fromkeys(y, x))
    return {n: min(s) for n, s in at.items()}


def found(df):
    return sorted(map(tuple, connected_components(df, "a", "b").select("node", "component").collect()))


@pytest.mark.parametrize("collide", [False, True])
def test_shapes(spark, monkeypatch, collide):
    """A long chain, a hub, a dense part, repeated edges, loops and nulls; also where hashes of nodes collide."""
    if collide:
        monkeypatch.setattr(components, "node_hash", lambda node: F.pmod(F.xxhash64(node), F.lit(7)))
    rng = random.Random(3)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(150)] + [("hub", f"h{i}") for i in range(60)] + [(f"d{rng.randrange(30)}", f"d{rng.randrange(30)}") for _ in range(200)]
    edges += [("x", "x"), ("y", None), (None, "z"), ("p", "q"), ("q", "p"), ("p", "q")]
    rng.shuffle(edges)
    assert found(spark.createDataFrame(edges, "a string, b string")) == sorted(plain(edges).items())
    assert found(spark.createDataFrame([], "a string, b string")) == []
    pairs = [(-5, 3), (3, 9), (2**62, -(2**62))]
    assert found(spark.createDataFrame(pairs, "a long, b long")) == sorted(plain(pairs).items())


def test_edges_shrink_as_numbers(spark, monkeypatch):
    """Edges of a dense graph are few after one round, and names are in none of the rounds."""
    kept = []
    monkeypatch.setattr(components, "cut", lambda df, name: kept.append((name, cut(df, name))) or kept[-1][1])
    rng = random.Random(4)
    edges = [(f"p{rng.randrange(300)}", f"s{rng.randrange(300)}") for _ in range(8000)]
    assert found(spark.createDataFrame(edges, "a string, b string")) == sorted(plain(edges).items())
    rounds = [df for name, df in kept if name == "contracted"]
    assert rounds and all(t == "bigint" for df in rounds for _, t in df.dtypes) and rounds[0].count() < 800
