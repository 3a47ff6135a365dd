"""Property-graph analytics over node and edge tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from foliant.operators.components import connected_components, numbered
from foliant.operators.edge_blocks import Graph, graph_of, packed, unpacked
from foliant.plans.lineage import cut, tasks


# Types of neighbours that say something; relations that may have dates.
NEIGHBOUR_TYPES = ["person", "organization", "location", "monetary_amount"]
TEMPORAL = ["MANAGES", "HAS_ROLE", "MEMBER_OF", "BOARD_MEMBER", "REPORTS_TO"]


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    extra = [F.col(c) for c in keep]
    return edges.select("src", "dst", *extra).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *extra))


def neighbours(edges: DataFrame, start: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """(src, dst, weight): the k strongest neighbours of each start node (column src), edges in either direction, missing weights as 1.

    parts: how many parts the edges are dealt into by start node, once for their weights and ranks; a task sorts one.
    """
    out = both_ways(edges, "weight").join(start, "src", "left_semi").filter("src <> dst")
    if parts is not None:
        out = out.repartition(parts, "src")
    best = out.groupBy("src", "dst").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def co_occurrence(mentions: DataFrame, item: str, place: str) -> DataFrame:
    """(a, b, weight), a < b: in how many places two items meet. Recounted from the mentions, so reruns agree."""
    one = mentions.select(place, item).filter(F.col(item).isNotNull() & F.col(place).isNotNull()).distinct()
    # Pairs are counted by numbers of items, as short rows hold more of them in memory before a shuffle.
    items = cut(one.select(item).distinct().withColumn("_number", F.monotonically_increasing_id()), "items")
    numbered = cut(one.join(items, item).select(place, "_number"), "numbered")
    x, y = numbered.select(place, F.col("_number").alias("x")), numbered.select(place, F.col("_number").alias("y"))
    met = x.join(y, place).filter("x < y").groupBy("x", "y").agg(F.count("*").alias("weight"))
    named = met.join(items.select(F.col("_number").alias("x"), F.col(item).alias("p")), "x").join(items.select(F.col("_number").alias("y"), F.col(item).alias("q")), "y")
    return named.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "weight")


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) of the undirected graph: rank = (1 - damping) + damping * sum of neighbours' rank / degree, from 1, for `rounds` rounds.

    Edges stay where they are, in blocks; a round sends each node's share to the blocks that have its edges, and gets a sum from each.
    """
    graph = graph_of(edges)
    state = graph.nodes.select("id", "n", "at").withColumn("rank", F.lit(1.0))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("id"), packed(batch.column("share").to_numpy()[:, None])], ["p", "id", "value"])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.frombuffer(b"".join(batch.column("value").to_pylist()), np.float64))], ["id", "got"])

    for k in range(rounds):
        sent = state.select(F.explode("at").alias("p"), "id", (F.col("rank") / F.col("n")).alias("share")).mapInArrow(shares, "p int, id long, value binary")
        got = graph.sums(sent, 1).mapInArrow(numbers, "id long, got double").groupBy("id").agg(F.sum("got").alias("got"))
        state = graph.nodes.select("id", "n", "at").join(got, "id").select("id", "n", "at", (F.lit(1 - damping) + damping * F.col("got")).alias("rank"))
        if k % 5 == 4:
            state = cut(state, "rank")
    out = cut(graph.nodes.select("id", "node").join(state.select("id", "rank"), "id").select("node", "rank"), "ranks")
    graph.blocks.unpersist()
    return out


def paths_from(edges: DataFrame, starts: DataFrame, most_hops: int = 5, relations: Sequence[str] | None = None) -> DataFrame:
    """(a, b, hops, path, names) from each start (column a) to every node b that a path of at most most_hops undirected edges reaches, itself with 0; of paths as
    short the least one.

    edges: src, dst and, if they have any, relation; relations leaves the others out. names: the relations along the path, the least where two
    nodes have several. A breadth-first loop of joins: a start's frontier holds each node once, with its least path, and only nodes that are new go on.
    """
    if "relation" not in edges.columns:
        edges = edges.withColumn("relation", F.lit(None).cast("string"))
    if relations is not None:
        edges = edges.filter(F.col("relation").isin(*relations))
    steps = both_ways(edges, "relation").groupBy("src", "dst").agg(F.min("relation").alias("relation"))
    front = starts.select("a").distinct().withColumns({"b": F.col("a"), "hops": F.lit(0), "path": F.array("a"), "names": F.array().cast("array<string>")})
    found = front
    for hop in range(1, most_hops + 1):
        nexts = front.join(steps, front["b"] == steps["src"]).select("a", F.col("dst").alias("b"), F.struct(F.concat("path", F.array("dst")).alias("path"), F.concat("names", F.array("relation")).alias("names")).alias("best"))
        nexts = nexts.groupBy("a", "b").agg(F.min("best").alias("best")).join(found.select("a", "b"), ["a", "b"], "left_anti")
        front = cut(nexts.select("a", "b", F.lit(hop).alias("hops"), "best.path", "best.names"), "front")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def hops_from(edges: DataFrame, starts: DataFrame, most_hops: int = 5) -> DataFrame:
    """(a, b, hops) of paths_from() where the paths themselves aren't asked for.

    64 starts are the bits of a word, and a frontier is a table (node, word, bits): an edge carries all of a word's starts in one row, and what arrives at a node is
    joined bit by bit on the map side before a shuffle. Starts that share a least node within two hops are numbered one after another, so that those which
    reach the same nodes tend to share words. Edges are numbers, held by their start. Pairs of names are made at the end, only where a caller's filters leave them.
    """
    names, rows = numbered(edges, "src", "dst")
    rows = both_ways(rows.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    steps = rows.repartition(tasks(rows), "src").distinct().persist(StorageLevel.DISK_ONLY)
    starts = starts.select("a").distinct()
    known = starts.join(names.withColumnsRenamed({"node": "a", "id": "src"}), "a")
    near = steps.join(known.select("src"), "src", "left_semi").join(steps.groupBy(F.col("src").alias("dst")).agg(F.min("dst").alias("least")), "dst")
    order = known.join(near.groupBy("src").agg(F.min("least").alias("least")), "src").orderBy("least", "a").select("a", "src", F.monotonically_increasing_id().alias("number"))
    placed = cut(order.select("a", "src", F.shiftright("number", 6).alias("word"), (F.col("number") % 64).cast("int").alias("place")), "starts")
    levels = [cut(placed.groupBy(F.col("src").alias("node"), "word").agg(F.expr("bit_or(shiftleft(1L, place))").alias("bits"), F.lit(0).alias("hops")), "front")]
    for hop in range(1, most_hops + 1):
        none = F.lit(0).cast("long")
        met = steps.join(levels[-1].withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "word", F.col("bits").alias("got"), none.alias("had"))
        # A neighbour lies a level further, in the same one, or in the one before.
        for level in levels[-2:]:
            met = met.unionByName(level.select("node", "word", none.alias("got"), F.col("bits").alias("had")))
        new = F.expr("bit_or(got) & ~bit_or(had)").alias("bits")
        front = cut(met.groupBy("node", "word").agg(new).filter("bits <> 0").select("node", "word", "bits", F.lit(hop).alias("hops")), "front")
        if front.isEmpty():
            break
        levels.append(front)
    steps.unpersist()
    found = starts.select("a", F.col("a").alias("b"), F.lit(0).alias("hops"))
    words = placed.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("place", "a"))).alias("asked"))
    for level in levels[1:]:
        named = level.join(names.select(F.col("id").alias("node"), F.col("node").alias("b")), "node").join(words, "word")
        pairs = named.select("b", "hops", "bits", F.explode("asked").alias("place", "a")).filter(F.bit_get("bits", F.col("place")) == 1)
        found = found.unionByName(pairs.select("a", "b", "hops"))
    return found


def shortest_paths(edges: DataFrame, pairs: DataFrame, most_hops: int = 5, relations: Sequence[str] | None = None) -> DataFrame:
    """(a, b, hops, path, names) of paths_from() for the pairs (a, b) that such a path joins. Each start is walked from once, whatever the number of its goals."""
    wanted = pairs.select("a", "b").distinct()
    return paths_from(edges, wanted, most_hops, relations).join(wanted, ["a", "b"], "left_semi")


def reporting_chain(edges: DataFrame, start: DataFrame, at: str, most: int = 10) -> DataFrame:
    """(start, manager, depth): REPORTS_TO edges (src, dst, since, until) upwards, all valid at a date (open ends are null), the shortest way to each manager.

    A round goes on from managers that are new to a start, so cycles end. Restrict nodes to a matter by passing its edges alone.
    """
    valid = cut(edges.filter((F.col("since").isNull() | (F.col("since") <= at)) & (F.col("until").isNull() | (F.col("until") >= at))).select("src", "dst").distinct(), "valid")
    front = start.select(F.col("node").alias("start"), F.col("node").alias("manager"), F.lit(0).alias("depth"))
    found = front
    for depth in range(1, most + 1):
        nexts = front.join(valid, front["manager"] == valid["src"]).select("start", F.col("dst").alias("manager"), F.lit(depth).alias("depth")).distinct()
        front = cut(nexts.join(found.select("start", "manager"), ["start", "manager"], "left_anti"), "chain")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.filter("depth > 0")


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): synchronous label propagation by edge weight; ties go to the smallest label, which makes reruns agree.

    A cheap stand-in for modularity_communities(); labels are node ids, so only the partition has a meaning.
    """
    out = cut(both_ways(edges.filter("src <> dst"), "weight").groupBy("src", "dst").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w")), "weights")
    label = out.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
    for k in range(rounds):
        votes = out.join(label, out["dst"] == label["node"]).groupBy("src", "community").agg(F.sum("w").alias("w"))
        label = votes.groupBy(F.col("src").alias("node")).agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("community"))
        if k % 3 == 2:
            label = cut(label, "labels")
    return label


def modularity_communities(edges: DataFrame, levels: int = 3, rounds: int = 8) -> DataFrame:
    """(node, community) by moves that raise the modularity of the undirected graph (src, dst, weight): Louvain's scheme as joins and aggregations.

    In a round each open node of one half, which a hash of node and round picks, goes to the neighbouring community of most gain, its own or else the smallest of
    equal ones; moving halves in turn keeps neighbours from trading places for ever. All nodes are open at first; one that was looked at is open again
    only if a neighbour moves, so later rounds read the links of few nodes. A round is one job. After a level communities become nodes of the next one.
    Deterministic; the communities are named by one of their nodes.

    Nodes are numbers in the order of their names, by which ties are decided; names stay in the tables of nodes. Links are held by their start, in parts of about a
    million, and stay there: a round sends on those of the nodes that it looks at, once to the communities of their ends and once, summed on the map side, to
    the choices. A start's links lie in one part, from which a task streams them.
    """
    rows = cut(edges.filter("src <> dst").select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("w")), "rows")
    names = rows.select(F.col("src").alias("name")).unionByName(rows.select(F.col("dst").alias("name"))).distinct()
    names = cut(names.orderBy("name").select("name", F.monotonically_increasing_id().alias("node")), "names")
    for end in ("src", "dst"):
        rows = rows.join(names.select(F.col("name").alias(end), F.col("node").alias(f"{end}_node")), end)
    rows = cut(rows.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), "w"), "numbered")
    links = held_links(both_ways(rows, "w"))
    place = names.select("node", F.col("node").alias("community"))
    twice = links.agg(F.sum("w")).first()[0] or 1.0
    for level in range(levels):
        start = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).join(names, "node")
        now = cut(start.select("node", "name", "k", F.col("node").alias("community"), F.lit(True).alias("open"), F.lit(False).alias("moved")), "places")
        between = links.filter("src <> dst")
        for r in range(rounds):
            if r:
                # Links go both ways, so those that start at a node which moved end at all of its neighbours.
                touched = between.join(now.filter("moved").select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"), F.lit(True).alias("touched")).distinct()
                looked = now.join(touched, "node", "left").withColumn("open", F.col("open") | F.col("touched").isNotNull())
            else:
                looked = now
            turn = F.pmod(F.xxhash64("name", F.lit(level * rounds + r)), F.lit(2)) == 0
            looked = looked.select("node", "name", "k", F.col("community").alias("own"), (F.col("open") & turn).alias("asks"), (F.col("open") & ~turn).alias("waits"))
            asks = looked.filter("asks").select("node", "k", "own")
            total = now.groupBy("community").agg(F.sum("k").alias("total"))
            near = now.select(F.col("node").alias("dst"), "community").join(total, "community")
            pulls = between.join(asks.withColumnRenamed("node", "src"), "src").join(near, "dst").select(F.col("src").alias("node"), "k", "own", "community", "total", F.col("w").alias("pull"))
            # A node's own community is a choice as well, with a pull of 0 if no neighbour is left in it.
            stay = asks.join(total.withColumnRenamed("community", "own"), "own").select("node", "k", "own", F.col("own").alias("community"), "total", F.lit(0.0).alias("pull"))
            choices = pulls.unionByName(stay).groupBy("node", "community").agg(F.sum("pull").alias("pull"), *(F.max(c).alias(c) for c in ("k", "own", "total")))
            rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("pull") - F.col("k") * rest / twice, 9)
            best = choices.groupBy("node").agg(F.min(F.struct((-gain).alias("loss"), (F.col("community") != F.col("own")).alias("away"), "community"))["community"].alias("to"))
            seen = Observation()
            moved = F.coalesce(F.col("to") != F.col("own"), F.lit(False))
            after = looked.join(best, "node", "left").select("node", "name", "k", F.coalesce("to", "own").alias("community"), F.col("waits").alias("open"), moved.alias("moved"))
            now = cut(after.observe(seen, F.count_if(F.col("moved") | F.col("open")).alias("n")), "places")
            if not seen.get["n"]:
                break
        found = now.select("node", "community")
        place = cut(place.join(found.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community")), "communities")
        if level + 1 == levels or found.filter("node <> community").isEmpty():
            break
        a, b = (found.select(F.col("node").alias(end), F.col("community").alias(end[0])) for end in ("src", "dst"))
        contracted = cut(links.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("w")), "contracted")
        links.unpersist()
        links = held_links(contracted)
    links.unpersist()
    named = place.join(names.select(F.col("node").alias("community"), F.col("name").alias("named")), "community")
    return named.join(names, "node").select(F.col("name").alias("node"), F.col("named").alias("community"))


def held_links(links: DataFrame) -> DataFrame:
    """(src, dst, w) with the weights of repeated links added up, held by src on the executors' disks, so that joins by src move none of them; release it in the end."""
    dealt = links.repartition(tasks(links), "src").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return dealt.sortWithinPartitions("src").persist(StorageLevel.DISK_ONLY)


def two_tiers(members: DataFrame, least: int = 3) -> DataFrame:
    """(id, member, level, parent_id) of (id, member): those of under `least` members share the parent `small`, whose level-1 rows hold each of their members once."""
    sizes = members.distinct().groupBy("id").agg(F.count("*").alias("n"))
    rows = members.distinct().join(sizes, "id").select("id", "member", F.lit(0).alias("level"), F.when(F.col("n") < least, F.lit("small")).alias("parent_id"))
    small = rows.filter("parent_id = 'small'").select(F.lit("small").alias("id"), "member").distinct()
    return rows.unionByName(small.select("id", "member", F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_id")))


def betweenness(edges: DataFrame, pivots: int | None = None, seed: int = 1, miss: float = 0.05, block_cells: int = 20_000_000) -> DataFrame:
    """(node, betweenness, bound) of the undirected graph: shortest paths counted level by level from blocks of sources, then shared out backwards.

    A node's paths from all sources of a block are one row of numbers. A level is one sum over neighbours, with edges that stay in their blocks and
    rows of the nodes that the last level reached; no component is held in a task. A block takes so many sources that the rows of a
    block of edges hold block_cells numbers at most. Without pivots, or with as many as there are nodes, all nodes are sources, the result is exact
    and bound is 0; the work is nodes times edges then.

    pivots: so many sources, the first by a hash with the seed, stand for all; their parts are scaled up. With a probability of 1 - miss, over seeds, no
    node's exact value is further than its bound from the estimate (the empirical Bernstein bound for all nodes at once: it shrinks with the
    spread of a node's parts, and with the root of the pivots).
    """
    graph = graph_of(edges)
    nodes = graph.nodes.select("id", "node", "at")
    n = nodes.count()
    count = n if pivots is None else min(pivots, n)
    sources = nodes.select("id", "node") if count == n else nodes.select("id", "node").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(count)
    # A node's rows come from each of its blocks, so a hub's grow with the blocks.
    most, rows = nodes.select(F.explode("at").alias("p")).groupBy("p").count().agg(F.coalesce(F.max("count"), F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    width = max(1, min(count, block_cells // most))
    blocks = max(1, -(-count // width))
    placed = sources.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    placed = cut(placed.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1), "sources")
    sums = None
    for block in range(blocks):
        mine = placed.filter(F.col("block") == block)
        size = mine.count()
        if size:
            parts = block_parts(graph, mine.select("id", "place"), size, max(1, -(-(2 * n + rows) * size // block_cells) * 4))
            sums = parts if sums is None else cut(sums.unionByName(parts).groupBy("id").agg(F.sum("part").alias("part"), F.sum("square").alias("square")), "sums")
    part, square = (F.coalesce(c, F.lit(0.0)).alias(c) for c in ("part", "square"))
    sums = cut(nodes.select("id", "node").join(sums, "id", "left").select("node", part, square), "sums") if sums is not None else nodes.select("node", F.lit(0.0).alias("part"), F.lit(0.0).alias("square"))
    graph.blocks.unpersist()
    value = (F.col("part") * (n / (2 * count)) if n else F.col("part")).alias("betweenness")
    if count == n:
        return sums.select("node", value, F.lit(0.0).alias("bound"))
    log = math.log(3 * n / miss)
    spread = F.greatest((F.col("square") - F.col("part") * F.col("part") / count) / max(1, count - 1), F.lit(0.0))
    bound = n / 2 * (F.sqrt(2 * spread * log / count) + 3 * (n - 2) * log / count)
    return sums.select("node", value, F.least(bound, F.lit((n - 1) * (n - 2) / 2.0)).alias("bound"))


def block_parts(graph: Graph, sources: DataFrame, width: int, pages: int) -> DataFrame:
    """(id, part, square): each node's parts of the shortest paths from the sources (id, place), which are `width`, and of their squares, in sum.

    Levels are tables (id, at, paths): rows of nodes that some source reaches in so many steps, 0 where that source doesn't. Rows of a node meet in one of `pages` groups, of which
    there are so many that one has a quarter of a block's cells on average: the rows that come in from blocks count, not the nodes.
    """
    page = F.pmod(F.xxhash64("id"), F.lit(pages)).cast("int").alias("page")
    none = F.lit(None).cast("binary")

    def rows(table: pa.Table, name: str, kind: int, ids: np.ndarray) -> np.ndarray:
        """The sums of a kind's rows by node, in the order of ids; rows of other nodes are passed over."""
        out, node = np.zeros((len(ids), width)), table.column("id").to_numpy()
        mine = np.flatnonzero((table.column("kind").to_numpy() == kind) & np.isin(node, ids))
        if len(mine):
            value, at = unpacked(table.column(name), width)
            place = np.searchsorted(ids, node[mine])
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.diff(place[order], prepend=-1))
            out[place[order][first]] = np.add.reduceat(value[at[mine[order]]], first, axis=0)
        return out

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, width))
            out[np.arange(batch.num_rows), batch.column("place").to_numpy()] = 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at"), packed(out)], ["id", "at", "paths"])

    def reached(table: pa.Table) -> pa.Table:
        """What came in (kind 1) at sources that the last two levels (kind 2) don't have; kind 0 tells a node's blocks."""
        known = table.filter(pc.equal(table.column("kind"), 0)).sort_by("id")
        ids = known.column("id").to_numpy()
        paths = rows(table, "value", 1, ids)
        paths[rows(table, "value", 2, ids) > 0] = 0
        some = pa.array(paths.any(axis=1))
        return known.select(["id", "at"]).append_column("paths", packed(paths)).filter(some)

    def shared(table: pa.Table) -> pa.Table:
        """A level's rows (kind 0) with their parts, from what came in (kind 1), and what they send on: where they have paths, (1 + part) / paths."""
        known = table.filter(pc.equal(table.column("kind"), 0)).sort_by("id")
        ids = known.column("id").to_numpy()
        paths = rows(table, "value", 0, ids)
        part = paths * rows(table, "value", 1, ids)
        send = np.divide(1 + part, paths, out=np.zeros_like(paths), where=paths > 0)
        out = known.select(["id", "at"]).append_column("part", pa.array(part.sum(axis=1))).append_column("square", pa.array((part * part).sum(axis=1)))
        return out.append_column("send", packed(send))

    blank = F.lit(None).cast("array<int>").alias("at")
    known = graph.nodes.select("id", "at", F.lit(0).alias("kind"), none.alias("value"))
    first = sources.join(graph.nodes.select("id", "at"), "id").mapInArrow(start, "id long, at array<int>, paths binary")
    levels = [cut(first, "level")]
    while True:
        got = graph.sums(levels[-1].select(F.explode("at").alias("p"), "id", F.col("paths").alias("value")), width)
        table = known.unionByName(got.select("id", blank, F.lit(1).alias("kind"), "value"))
        # A neighbour lies a level further, in the same one, or in the one before.
        for level in levels[-2:]:
            table = table.unionByName(level.select("id", blank, F.lit(2).alias("kind"), F.col("paths").alias("value")))
        found = cut(table.withColumn("page", page).groupBy("page").applyInArrow(reached, "id long, at array<int>, paths binary"), "level")
        if found.isEmpty():
            break
        levels.append(found)
    sums, later = None, None
    for level in reversed(levels[1:]):
        table = level.select("id", "at", F.lit(0).alias("kind"), F.col("paths").alias("value"))
        if later is not None:
            got = graph.sums(later.select(F.explode("at").alias("p"), "id", F.col("send").alias("value")), width)
            table = table.unionByName(got.select("id", blank, F.lit(1).alias("kind"), "value"))
        later = cut(table.withColumn("page", page).groupBy("page").applyInArrow(shared, "id long, at array<int>, part double, square double, send binary"), "back")
        mine = later.select("id", "part", "square")
        sums = mine if sums is None else sums.unionByName(mine)
    if sums is None:
        return graph.nodes.select("id", F.lit(0.0).alias("part"), F.lit(0.0).alias("square"))
    return cut(sums.groupBy("id").agg(F.sum("part").alias("part"), F.sum("square").alias("square")), "parts")


def split_oversized(matches: DataFrame, most: int = 50) -> DataFrame:
    """(a, b, score) without the weakest edges of components over `most` nodes, removed one at a time until none is left.

    Edges are ordered by (score, a, b). One stays just if the edges that are not weaker, itself included, join `most` nodes at most around it: single linkage,
    cut where a part first passes `most`. So each node of a larger component gets the edge at which its part does, in rounds of a maximum spanning forest:

    * Every open part points along its strongest edge; pointers form trees, and lead by ever stronger edges to two parts that point at each other.
    * A tree's parts join its root in the order of their edges, as long as no edge to another tree is stronger. The part that passes `most`
      closes the root at its edge; it, and all that come later or point to a closed part, close at their own.

    At most `most` + 1 parts of a tree are ranked, the others close at once, so no group is larger. A part that is joined is never looked at again.
    """
    parts = connected_components(matches, "a", "b")
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    placed = cut(matches.join(parts.withColumnRenamed("node", "a"), "a").join(sizes, "component").select("a", "b", "score", F.col("n") > most), "components").toDF("a", "b", "score", "large")
    small, large = placed.filter("NOT large").drop("large"), placed.filter("large").drop("large")
    if large.isEmpty():
        return small
    edges = large.select(F.struct("score", "a", "b").alias("key"), F.col("a").alias("x"), F.col("b").alias("y"))
    place = edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct().select("node", F.col("node").alias("part"))
    state = place.select("part", F.lit(1).cast("long").alias("size"), F.lit(None).cast(edges.schema["key"].dataType).alias("limit"))
    cross, state, place = cut(edges.filter("x <> y"), "cross"), cut(state, "parts"), cut(place, "places")
    while True:
        closed = state.select("part", F.col("limit").isNotNull().alias("closed"))
        ways = both_ways(cross.withColumnsRenamed({"x": "src", "y": "dst"}), "key").withColumnsRenamed({"src": "p", "dst": "q"})
        ways = ways.join(closed.withColumnsRenamed({"part": "p", "closed": "p_closed"}), "p").filter("NOT p_closed").join(closed.withColumnsRenamed({"part": "q", "closed": "q_closed"}), "q")
        ways = cut(ways.select("p", "q", "key", "q_closed"), "ways")
        if ways.isEmpty():
            break
        best = cut(ways.groupBy("p").agg(F.max(F.struct("key", "q", "q_closed")).alias("e")).select("p", "e.*"), "best")
        trees = connected_components(best.filter("NOT q_closed"), "p", "q").withColumnsRenamed({"node": "p", "component": "tree"})
        best = cut(best.join(trees, "p", "left").withColumn("tree", F.coalesce("tree", "p")).join(state.select(F.col("part").alias("p"), "size"), "p"), "trees")
        label = best.select("p", "tree")
        other = ways.join(label, "p").join(label.withColumnsRenamed({"p": "q", "tree": "to"}), "q", "left").filter("to IS NULL OR to <> tree")
        tree = best.groupBy("tree").agg(F.bool_or("q_closed").alias("lost")).join(other.groupBy("tree").agg(F.max("key").alias("out")), "tree", "left")
        order = Window.partitionBy("tree").orderBy(F.desc("key"), "p")
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most + 1)
        # Both parts of the root have one edge, which a range takes in at once.
        ranked = ranked.withColumn("sum", F.sum("size").over(Window.partitionBy("tree").orderBy(F.desc("key")).rangeBetween(Window.unboundedPreceding, 0)))
        ranked = cut(ranked.select("p", "tree", "key", "size", "sum"), "ranked")
        passing = ranked.filter(F.col("sum") > most).groupBy("tree").agg(F.max("key").alias("pass"))
        told = best.select("p", "tree", "key", "size").join(ranked.select("p", "sum"), "p", "left").join(tree, "tree").join(passing, "tree", "left")
        fits = ~F.col("lost") & (F.coalesce("sum", F.lit(most + 1)) <= most)
        told = told.withColumn("joins", fits & (F.col("out").isNull() | (F.col("key") > F.col("out")))).withColumn("fits", fits)
        roots = told.filter("joins").groupBy("tree").agg(
            F.min("p").alias("root"), F.sum("size").alias("whole"), F.first(F.when(F.col("out").isNull() | (F.col("pass") > F.col("out")), F.col("pass"))).alias("root_limit")
        )
        moved = told.join(roots, "tree", "left").select(
            F.col("p").alias("part"),
            F.when(F.col("joins"), F.col("root")).otherwise(F.col("p")).alias("to"),
            F.when(F.col("joins"), F.col("whole")).otherwise(F.col("size")).alias("size"),
            F.when(F.col("joins"), F.col("root_limit")).when(~F.col("fits"), F.col("key")).alias("limit"),
        )
        moved = cut(moved, "moved")
        rest = state.join(moved.select("part"), "part", "left_anti")
        state = cut(rest.unionByName(moved.select(F.col("to").alias("part"), "size", "limit").distinct()), "parts")
        place = cut(place.join(moved.select("part", "to"), "part", "left").select("node", F.coalesce("to", "part").alias("part")), "places")
        for end in "xy":
            cross = cross.join(moved.select(F.col("part").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        cross = cut(cross.filter("x <> y").groupBy("x", "y").agg(F.max("key").alias("key")), "cross")
    limits = place.join(state, "part").select(F.col("node").alias("a"), "limit")
    stays = large.join(limits, "a").filter(F.col("limit").isNull() | (F.struct("score", "a", "b") > F.col("limit")))
    return small.unionByName(stays.select("a", "b", "score"))


def plain_neighbours(edges: DataFrame, nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(name, other, relation): neighbours of the named start nodes, either way, that are no noise: of four types, five letters or more, and not the node itself.

    edges: src, dst, relation (names). nodes: name, type. Each (name, other, relation) once.
    """
    near = both_ways(edges, "relation").join(start.select(F.col("name").alias("src")).distinct(), "src", "left_semi")
    known = nodes.filter(F.col("type").isin(*NEIGHBOUR_TYPES) & (F.length("name") >= 5)).select(F.col("name").alias("dst")).distinct()
    return near.filter("src <> dst").join(known, "dst", "left_semi").select(F.col("src").alias("name"), F.col("dst").alias("other"), "relation").distinct()


def entity_connections(questions: DataFrame, edges: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, other, relation): connections of the entities whose names stand in a question, as whole words and in any case.

    Runs of up to three words of a question meet names by an equi-join, so no question is compared with all names.
    """

    def spoken(c: str) -> Column:
        return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    words = questions.select(key, spoken(text).alias("w"))

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))

    spans = F.flatten(F.array(runs(1), runs(2), runs(3)))
    said = words.filter(F.size("w") > 0).select(key, F.explode(F.array_distinct(spans)).alias("said"))
    named = nodes.select("name", F.array_join(spoken("name"), " ").alias("said")).distinct()
    found = cut(said.join(named, "said").select(key, "name").distinct(), "said")
    # Each question's name and each neighbour of a name is there once, so what they make is distinct: it is by far the largest table, and is not shuffled.
    return found.join(plain_neighbours(edges, nodes, found), "name").select(key, "name", "other", "relation")


def temporal_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges (src, dst, relation, since, until) after the new ones were merged in: of the allowed relations only, a new one's dates replace those of its like; the latest
    `since` holds if new ones repeat an edge."""
    keys = ["src", "dst", "relation"]
    once = new.filter(F.col("relation").isin(*TEMPORAL)).groupBy(*keys).agg(F.max(F.struct("since", "until")).alias("d")).select(*keys, "d.since", "d.until")
    return edges.select(*keys, "since", "until").join(once.select(*keys), keys, "left_anti").unionByName(once)


def edited(nodes: DataFrame, edges: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (name, type) and edges (src, dst, relation) after changes (name, new_name, new_type, gone), one a name at most: renamed and retyped where given, else kept;
    deleted nodes take their edges with them, renamed ones keep theirs."""
    c = changes.select("name", "new_name", "new_type", F.coalesce("gone", F.lit(False)).alias("gone"))
    out = nodes.join(c, "name", "left").filter("gone IS NULL OR NOT gone").select(F.coalesce("new_name", "name").alias("name"), F.coalesce("new_type", "type").alias("type"))
    moved = edges
    for end in ("src", "dst"):
        moved = moved.join(c.select(F.col("name").alias(end), "new_name", "gone"), end, "left").filter("gone IS NULL OR NOT gone").withColumn(end, F.coalesce("new_name", end)).drop("new_name", "gone")
    return out, moved.select("src", "dst", "relation")


def merged_nodes(nodes: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, mention_count, ...) and edges (src, dst, weight) after names were mapped (alias -> canonical): counts and weights added up, loops gone."""
    m = mapping.select("alias", "canonical")
    to = nodes.join(m.withColumnRenamed("alias", "name"), "name", "left").withColumn("target", F.coalesce("canonical", "name"))
    aliases = F.array_sort(F.collect_set(F.when(F.col("name") != F.col("target"), F.col("name"))))
    out = to.groupBy(F.col("target").alias("name")).agg(F.sum("mention_count").alias("mention_count"), aliases.alias("aliases"))
    moved = edges.join(m.select(F.col("alias").alias("src"), F.col("canonical").alias("s")), "src", "left").join(m.select(F.col("alias").alias("dst"), F.col("canonical").alias("d")), "dst", "left")
    moved = moved.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "weight").filter("src <> dst")
    return out, moved.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def repaired_scope(nodes: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """nodes (id, matter_id): a missing matter from any linked document, the least."""
    found = links.join(docs, "doc_id").groupBy("id").agg(F.min("matter_id").alias("m"))
    return nodes.join(found, "id", "left").withColumn("matter_id", F.coalesce("matter_id", "m")).drop("m")


def completed(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """nodes and the edge ends that they lack."""
    ends = edges.select(F.col("src").alias(key)).union(edges.select(F.col("dst").alias(key))).distinct()
    return nodes.select(key).union(ends.join(nodes, key, "left_anti")).distinct()

