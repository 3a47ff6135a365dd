"""A trie of conversations' prefixes, rolled up by centroid decomposition of its parent edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import WORD, cut

#: Nodes of a component that one task decomposes; a larger component is split by centroids in Spark first.
MOST = 1 << 15
#: Sums of 32 bits each that tell prefixes apart, beside their depth.
SUMS = ("a", "b", "c")
#: Characters of joined ids that travel as one row.
CHUNK = 1 << 20


def prefix_sums(rows: DataFrame, scope: str, order: Sequence[str], sums: Mapping[str, Column], name: str) -> DataFrame:
    """rows with running sums over each scope, this row included.

    Rows are dealt by ranges of (scope, order), each range adds up its own rows, and only the ranges' totals run over a scope, so that a scope of any
    size is spread over tasks. Rows that tie in `order` must be alike.
    """
    added = rows.withColumns({f"_{c}": x for c, x in sums.items()})
    placed = cut(added.repartitionByRange(F.col(scope), *(F.col(c).asc_nulls_first() for c in order)).withColumn("_range", F.spark_partition_id()), name)
    totals = placed.groupBy(scope, "_range").agg(*(F.sum(f"_{c}").alias(f"_t{c}") for c in sums))
    ranges = Window.partitionBy(scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(scope, "_range", *(F.coalesce(F.sum(f"_t{c}").over(ranges), F.lit(0)).alias(f"_b{c}") for c in sums))
    here = Window.partitionBy(scope, "_range").orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({c: F.sum(f"_{c}").over(here) for c in sums}).join(totals, [scope, "_range"])
    return out.withColumns({c: F.col(c) + F.col(f"_b{c}") for c in sums}).drop("_range", *(f"_{c}" for c in sums), *(f"_b{c}" for c in sums))


def ordered_turns(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, digest, words): each conversation's turns numbered from 1 by turn (null first, ties by digest), with the digest of role and text.

    Null role or text counts as empty; rows of a null conversation are left out; repeated rows are turns of their own; other columns aren't read.
    """
    role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    rows = convs.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words")
    )
    return prefix_sums(rows, "conv", ["turn", "digest"], {"pos": F.lit(1).cast("long")}, "turns").select("conv", "pos", "digest", "words")


def regrown(turns: DataFrame, stem: Column, keep: Column) -> DataFrame:
    """(conv, d, digest, words, len) where each conversation starts with the first `keep` turns of conversation `stem` instead of its own first ones.

    turns is as ordered_turns() gives it; stem and keep are expressions of conv, keep under 4. A stem that is absent, or has fewer turns, gives what it has.
    Conversations that are left without a turn come as one row with d = 0 and nulls.
    """
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("n")).withColumns({"stem": stem, "keep": keep.cast("long")})
    stems = sizes.select(F.col("conv").alias("stem"), F.col("n").alias("stem_n"))
    sizes = sizes.join(stems, "stem", "left").withColumn("head", F.least("keep", F.coalesce("stem_n", F.lit(0))))
    sizes = cut(sizes.withColumn("len", F.col("head") + F.greatest(F.col("n") - F.col("keep"), F.lit(0))).select("conv", "stem", "keep", "head", "len"), "sizes")
    first = turns.filter("pos < 4").withColumnRenamed("conv", "stem")
    heads = sizes.join(first, "stem").filter("pos <= keep").select("conv", F.col("pos").alias("d"), "digest", "words", "len")
    tails = turns.join(sizes, "conv").filter("pos > keep").select("conv", (F.col("pos") - F.col("keep") + F.col("head")).alias("d"), "digest", "words", "len")
    none = sizes.filter("len = 0").select("conv", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"), "len")
    return heads.unionByName(tails).unionByName(none)


def prefix_rows(turns: DataFrame) -> DataFrame:
    """(conv, d, node, parent, words, rest) for each conversation and each of its prefixes, d = 0 first, from (conv, d, digest, words, len).

    A node's name stands for its depth and three running sums of hashes of (digest, depth), 96 bits; rest is the number of turns behind the prefix.
    """
    own = {s: F.pmod(F.xxhash64(F.lit(k), "digest", "d"), F.lit(1 << 32)) for k, s in enumerate(SUMS)}

    def name(d: Column, *sums: Column) -> Column:
        return F.md5(F.concat_ws(",", *(x.cast("string") for x in (d, *sums))))

    some = prefix_sums(turns.filter("d > 0"), "conv", ["d"], own, "prefixes")
    d, sums = F.col("d"), [F.col(s) for s in SUMS]
    some = some.select("conv", "d", name(d, *sums).alias("node"), name(d - 1, *(x - own[s] for s, x in zip(SUMS, sums, strict=True))).alias("parent"), "words", (F.col("len") - d).alias("rest"))
    top = name(F.lit(0), *(F.lit(0) for _ in SUMS))
    root = turns.filter("d <= 1").select("conv", F.lit(0).cast("long").alias("d"), top.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("words"), F.col("len").alias("rest"))
    return some.unionByName(root)


def decompose(parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values (one row of them each) over every node's subtree in a forest, by centroid decomposition.

    parent holds positions, -1 at tops. weight is a positive weight of each node's subtree, that of a node more than its children's sum.
    In each round every component is split at its centroid, the deepest node with more than half of the weight: the total below it goes to the
    nodes on its path to the top, which are those with more than half of the weight, and its children's and the upper part go on as components.
    """
    n = len(parent)
    levels = np.argsort(depth, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(depth[levels]) != 0)) if n else []
    groups = [levels[a:b] for a, b in zip(bounds, [*bounds[1:], n], strict=True)]
    count = np.ones(n, np.int64)
    for g in reversed(groups):
        inner = g[parent[g] >= 0]
        np.add.at(count, parent[inner], count[inner])
    # Preorder: a node's subtree is a range of positions.
    order = np.argsort(parent, kind="stable")
    ahead = np.cumsum(count[order]) - count[order]
    first = np.append(True, parent[order][1:] != parent[order][:-1])
    ahead -= np.repeat(ahead[first], np.diff(np.append(np.flatnonzero(first), n)))
    shift = np.zeros(n, np.int64)
    shift[order] = ahead
    pre = np.zeros(n, np.int64)
    for g in groups:
        pre[g] = shift[g] + np.where(parent[g] >= 0, pre[parent[g]] + 1, 0)
    at = np.argsort(pre)
    up = np.where(parent[at] >= 0, pre[parent[at]], -1)
    end, weight, values = np.arange(n) + count[at], weight[at].copy(), values[:, at]
    sums = np.zeros_like(values)
    top = np.zeros(n, np.int64)
    for g in groups:
        p = pre[g]
        top[p] = np.where(up[p] >= 0, top[up[p]], p)
    live = np.arange(n)
    while len(live):
        of = top[live]
        heavy = 2 * weight[live] > weight[of]
        centre = np.full(n, -1)
        np.maximum.at(centre, of[heavy], live[heavy])
        c = centre[of]
        below = (live >= c) & (live < end[c])
        total = np.zeros_like(sums)
        for x, t, s in zip(values, total, sums, strict=True):
            np.add.at(t, of[below], x[live[below]])
            s[live[heavy]] += t[of[heavy]]
        loss = weight[c]
        upper = heavy & (live != c)
        weight[live[upper]] -= loss[upper]
        # Children of centroids are the tops of new components; ranges tell whose subtree a node is in.
        child = (up[live] == c) & (up[live] >= 0)
        keys = of[child] * n + live[child]
        move = below & (live != c)
        top[live[move]] = live[child][np.searchsorted(keys, of[move] * n + live[move], "right") - 1] if move.any() else 0
        live = live[live != c]
        # Labels are sorted by component and position for the next search.
        live = live[np.lexsort((live, top[live]))]
    out = np.zeros_like(sums)
    out[:, at] = sums
    return out


def rollup(nodes: DataFrame, paths: DataFrame, values: Sequence[str], most: int = MOST) -> DataFrame:
    """(node, *values): sums of values over each node's subtree.

    nodes: (node, parent, conv, d, weight, *values), where conv is a conversation that the node is a prefix of, the same for a node and those of its
    descendants that no smaller conversation has, and weight counts the prefixes of conversations at or below the node. paths: prefix_rows().

    A component of more than `most` nodes is split in Spark: its centroid is found and its total added up by aggregations, broadcast as one row for each such
    component (there are at most nodes / most of them), and nodes find the child of the centroid that they lie under by a join with the paths of their
    conversations. Smaller components are decomposed whole, many in a task (decompose()). A split halves a component's weight at least.
    """
    sums = [f"s_{v}" for v in values]
    state = nodes.withColumns({s: F.lit(0).cast("long") for s in sums}).withColumn("top", F.lit("")).withColumn("inner", F.lit(True))
    state = cut(state, "forest")
    while True:
        size = state.filter("inner").groupBy("top").agg(F.count("*").alias("n"), F.max("weight").alias("whole"))
        large = cut(size.filter(F.col("n") > most).select("top", "whole"), "large")
        if large.isEmpty():
            break
        heavy = 2 * F.col("weight") > F.col("whole")
        mine = state.filter("inner").join(F.broadcast(large), "top")
        centre = cut(mine.filter(heavy).groupBy("top").agg(F.max_by(F.struct("node", "d", "weight"), "d").alias("c"), F.first("whole").alias("whole")), "centres")
        under = paths.join(F.broadcast(centre.select(F.col("c.node").alias("parent"), "top")), "parent").select("conv", "top", F.col("node").alias("child"))
        marked = state.join(F.broadcast(centre), "top", "left").join(under, ["conv", "top"], "left")
        inside = F.col("inner") & F.col("c").isNotNull()
        marked = marked.withColumns({"is_centre": inside & (F.col("node") == F.col("c.node")), "child": F.when(inside & (F.col("d") > F.col("c.d")), F.col("child")), "path": inside & heavy})
        marked = cut(marked, "marked")
        total = marked.filter(F.col("is_centre") | F.col("child").isNotNull()).groupBy("top").agg(*(F.sum(v).alias(f"t_{v}") for v in values))
        state = marked.join(F.broadcast(total), "top", "left").select(
            *nodes.drop("weight").columns,
            F.when(F.col("path") & ~F.col("is_centre"), F.col("weight") - F.col("c.weight")).otherwise(F.col("weight")).alias("weight"),
            *(F.when(F.col("path"), F.col(s) + F.col(f"t_{v}")).otherwise(F.col(s)).alias(s) for v, s in zip(values, sums, strict=True)),
            F.coalesce("child", "top").alias("top"),
            (F.col("inner") & ~F.coalesce("is_centre", F.lit(False))).alias("inner"),
        )
        state = cut(state, "forest")
    done = state.filter("NOT inner").select("node", *(F.col(s).alias(v) for v, s in zip(values, sums, strict=True)))
    pages = 2 * max(state.sparkSession.sparkContext.defaultParallelism, -(-state.count() // most))

    def run(table: pa.Table) -> pa.Table:
        name = pd.Index(table.column("node").to_pandas())
        where = name.get_indexer(table.column("parent").to_pandas())
        tops = pd.factorize(table.column("top").to_pandas())[0]
        where = np.where((where >= 0) & (tops[where] == tops), where, -1)
        add, held = (np.array([table.column(p + v).to_numpy() for v in values]) for p in ("", "s_"))
        got = decompose(where, table.column("d").to_numpy(), table.column("weight").to_numpy(), add) + held
        return pa.table([table.column("node"), *map(pa.array, got)], ["node", *values])

    small = state.filter("inner").withColumn("page", F.pmod(F.xxhash64("top"), F.lit(pages))).select("page", "node", "parent", "top", "d", "weight", *values, *sums)
    return small.groupBy("page").applyInArrow(run, "node string, " + ", ".join(f"{v} long" for v in values)).unionByName(done)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of each node's conversations, numerically ascending and joined by commas, from (node, conv).

    Ranges of (node, conv) join their ids to texts of CHUNK characters; a node's texts then pass through one hash as a stream, so nothing holds a node's list.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, str]] = []
        node, first, ids, size = None, 0, [], 0
        for batch in batches:
            for k, c in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if ids and (k != node or size > CHUNK):
                    held.append((node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], ["node", "first", "ids"])
                held = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for k, text in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == node:
                    state.update(b",")
                else:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = k, hashlib.sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    chunks = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(joined, "node string, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, most: int = MOST) -> DataFrame:
    """The trie of conversations' prefixes, one row for each distinct prefix, from (conv, d, digest, words, len): turns numbered from 1, a conversation without
    turns as one row with d = 0. own_turns() makes them of a table of conversations, regrown() of conversations that start like others.

    A prefix of d turns is a node of depth d, the empty one the root; conversations that start with it are its members. Returns conv_id (smallest member), depth,
    parent_conv_id (that of its parent, null for the root), n_convs, n_children, n_leaves (childless nodes at or below it), saved_tokens (summed over nodes
    at or below it: (n_convs - 1) * words of the last turn), ends_sha256 (of its members without further turns) and node (its name). An empty table has no nodes.
    """
    paths = cut(prefix_rows(turns), "paths")
    plain = paths.groupBy("node").agg(
        F.min("conv").alias("conv"),
        F.first("parent").alias("parent"),
        F.first("d").alias("d"),
        F.max("words").alias("words"),
        F.count("*").alias("n_convs"),
        F.sum(F.col("rest") + 1).alias("weight"),
        F.count_if(F.col("rest") == 0).alias("n_ends"),
    )
    plain = cut(plain, "nodes")
    # All members of a childless node end there.
    leaf = (F.col("n_convs") == F.col("n_ends")).cast("long")
    summed = plain.select("node", "parent", "conv", "d", "weight", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    summed = rollup(summed, paths, ["n_leaves", "saved_tokens"], most)
    children = plain.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    ends = end_digests(paths.filter("rest = 0").select("node", "conv"))
    out = cut(plain.join(summed, "node").join(children, "node", "left").join(ends, "node", "left"), "trie")
    above = out.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return out.join(above, "parent", "left").select(
        F.col("conv").alias("conv_id"),
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        "node",
    )


def own_turns(turns: DataFrame) -> DataFrame:
    """(conv, d, digest, words, len) of ordered_turns() as they are."""
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("len"))
    return turns.join(sizes, "conv").select("conv", F.col("pos").alias("d"), "digest", "words", "len")
