"""Graph searches whose largest rows are not shuffled or sorted."""

from foliant.operators import graphs
from foliant.operators.graphs import co_occurrence, held_links, hops_from, modularity_communities, paths_from
from foliant.plans.casework import entity_retrieval
from foliant.plans.lineage import cut
from foliant.plans.relations import graph_shortest_paths

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_connections_are_not_made_distinct_again(spark):
    found = entity_retrieval(spark, SF)
    operators = [x.lstrip("+- *(0123456789):|") for x in plan(found).splitlines()]
    assert next(x for x in operators if "Aggregate" in x or "Join" in x).startswith(("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin"))
    assert found.count() == found.distinct().count() > 0


def test_hops_of_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e"), ("e", "e"), ("x", "y"), ("e", "f"), ("f", "g")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("x",), ("none",)], "a string")
    want = sorted(map(tuple, paths_from(edges, starts, 3).select("a", "b", "hops").collect()))
    assert sorted(map(tuple, hops_from(edges, starts, 3).collect())) == want


def test_hops_keep_no_paths(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graphs, "cut", lambda df, name: kept.append(df.columns) or cut(df, name))
    assert graph_shortest_paths(spark, SF).count()
    assert kept and not any("path" in columns for columns in kept)


def test_pairs_are_counted_by_numbers(spark):
    rows = [("p", "b"), ("p", "a"), ("p", "a"), ("p", None), (None, "a"), (None, "b"), ("q", "a"), ("q", "b"), ("q", "c")]
    found = co_occurrence(spark.createDataFrame(rows, "place string, item string"), "item", "place")
    assert "functions=[partial_count(1)]" in plan(found) and "keys=[x#" in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]


def test_links_of_communities_are_numbers_and_stay(spark, monkeypatch):
    """Names stay in tables of nodes; what a round looks at is joined to links that are dealt by their start already."""
    kept, held = [], []
    monkeypatch.setattr(graphs, "cut", lambda df, name: kept.append((name, df)) or cut(df, name))
    monkeypatch.setattr(graphs, "held_links", lambda links: held.append(links) or held_links(links))
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", 1.0), ("a1", "a1", 5.0), ("a2", None, 1.0), ("b1", "b2", None)]
    place = {r.node: r.community for r in modularity_communities(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert len(place) == 12 and {(n[0], c[0]) for n, c in place.items()} == {("a", "a"), ("b", "b")} and len(set(place.values())) == 2
    assert held and all(dict(links.dtypes) == {"src": "bigint", "dst": "bigint", "w": "double"} for links in held)
    assert all(dict(df.dtypes)["node"] == "bigint" for name, df in kept if name == "places")
    links = held_links(held[0])
    joined = links.join(spark.createDataFrame([(1,), (2,)], "src long").hint("merge"), "src", "left_semi")
    joined.collect()
    top = plan(joined).split("Final Plan ==")[-1].split("InMemoryRelation")[0]
    assert top.count("ShuffleQueryStage") <= 1
    links.unpersist()


def test_starts_share_rows_of_a_frontier(spark, monkeypatch):
    """130 starts that reach 60 nodes take a row for each node and 64 of them, not one for each pair; all hops are those of the paths."""
    kept = []
    monkeypatch.setattr(graphs, "cut", lambda df, name: kept.append((name, out := cut(df, name))) or out)
    rows = [(f"s{i}", f"c{(i * 7 + j) % 60}") for i in range(130) for j in range(20)] + [("c0", "d"), ("d", "e")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    starts = spark.createDataFrame([(f"s{i}",) for i in range(130)], "a string")
    found = sorted(map(tuple, hops_from(edges, starts, 4).collect()))
    fronts = sum(df.count() for name, df in kept if name == "front")
    assert found == sorted(map(tuple, paths_from(edges, starts, 4).select("a", "b", "hops").collect()))
    assert 0 < 5 * fronts < len(found)
