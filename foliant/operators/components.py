"""Connected components by contraction: nodes move to the least node near them, and edges that become one are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.lineage import cut


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that links reach.

    Nodes are 64-bit hashes while edges are contracted; a count shows that no two nodes share one, else they are numbered by joins. In a round every node
    points at the least of itself and its neighbours, then at what that one points at, twice over, and takes that node's place in all edges: what was joined stays
    joined, and nothing else gets joined. Hashes order nodes at random, so the nodes of a round shrink to a part of them, in dense graphs to far less than half, and
    edges that have become one are dropped. Pointers are composed from the last round back, so the work of all rounds is about that of the first.
    Edges with a null end and loops are passed over. No group is collected: a hub's neighbours stay rows.
    """
    names, e = numbered(edges, a, b)
    steps = []
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "pointers")
        for _ in range(2):
            to = to.join(to.select(F.col("u").alias("m"), F.col("m").alias("n")), "m").select("u", F.col("n").alias("m"))
        to = cut(to, "pointers")
        steps.append(to)
        x, y = (to.select(F.col("u").alias(end), F.col("m").alias(new)) for end, new in (("u", "p"), ("v", "q")))
        e = e.join(x, "u").join(y, "v").filter("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct()
        e = cut(e, "contracted")
        if e.isEmpty():
            break
    root = steps.pop()
    while steps:
        later = root.select(F.col("u").alias("m"), F.col("m").alias("n"))
        root = cut(steps.pop().join(later, "m", "left").select("u", F.coalesce("n", "m").alias("m")), "roots")
    placed = cut(names.join(root.select(F.col("u").alias("id"), "m"), "id").select("node", "m"), "placed")
    return placed.join(placed.groupBy("m").agg(F.min("node").alias("component")), "m").select("node", "component")


def numbered(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(node, id) of the ends of edges and the edges as (u, v) of ids, without null ends and loops. Ids are hashes; a count shows that no two nodes share one, else they are given by joins."""
    rows = cut(edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y")), "edges")
    names = cut(rows.select(F.col("x").alias("node")).unionByName(rows.select(F.col("y").alias("node"))).distinct().select("node", node_hash(F.col("node")).alias("id")), "names")
    if names.count() == names.select("id").distinct().count():
        return names, rows.select(node_hash(F.col("x")).alias("u"), node_hash(F.col("y")).alias("v"))
    names = cut(names.select("node", F.monotonically_increasing_id().alias("id")), "names")
    x, y = (names.select(F.col("node").alias(c), F.col("id").alias(end)) for c, end in (("x", "u"), ("y", "v")))
    return names, rows.join(x, "x").join(y, "y").select("u", "v")


def node_hash(node: Column) -> Column:
    return F.xxhash64(node)


def merged_components(stars: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """stars (node, component) after a batch of new edges: equal to connected_components() over all edges so far.

    Only the batch is walked: its ends are replaced by their components, whose links are solved by themselves, and nodes of components that were joined
    take the least component's name. The work of a round grows with the batch, that of the last join with the stars. Edges with a null end, loops
    and repeated edges change nothing but for adding the node of none, so the batch is not made distinct.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    ends = cut(ends, "batch")
    known = stars.select("node", "component")
    placed = ends
    for end in "uv":
        placed = placed.join(known.withColumnsRenamed({"node": end, "component": f"{end}_at"}), end, "left").withColumn(f"{end}_at", F.coalesce(f"{end}_at", end))
    joined = connected_components(placed.select(F.col("u_at").alias("x"), F.col("v_at").alias("y")), "x", "y")
    moved = cut(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "moved")
    fresh = ends.select(F.col("u").alias("node")).union(ends.select("v")).distinct().join(known.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    out = known.unionByName(fresh).join(moved, "component", "left")
    return out.select("node", F.coalesce("to", "component").alias("component"))
