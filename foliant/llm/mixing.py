"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import WORD, cut

#: Bins of each of two refinements of a selection, which tell 2**24 positions of the seeded hash apart.
BINS = 4096
#: A row of the plan for each membership pattern.
PLAN = pa.schema(
    [
        ("_sources", pa.list_(pa.string())), ("whole", pa.int32()), ("rest", pa.int64()), ("targets", pa.list_(pa.struct([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64())]))),
        ("routed", pa.list_(pa.struct([("source", pa.string()), ("words", pa.int64())]))),
    ]
)


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight; none above most * size, the excess is shared again by weight."""
    target, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = weights[i] * unit
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in over]
    return target


def route(capacity: Sequence[int], member: Sequence[Sequence[int]], quota: Sequence[int], repeats: int) -> dict[tuple[int, int], int]:
    """Min-cost flow: words of each pattern for each source.

    A pattern's words enter through `repeats` arcs of its capacity; the k-th costs k * k, so costs are convex and words of other
    patterns are taken before any are taken again. Successive shortest paths with potentials; the network has a node for each
    pattern and source, not for documents.
    """
    patterns, sources = len(capacity), len(quota)
    first, last = 0, 1 + patterns + sources
    arcs: list[list[int]] = []  # to, capacity left, cost; the arc at i ^ 1 runs back
    at: list[list[int]] = [[] for _ in range(last + 1)]

    def arc(a: int, b: int, c: int, cost: int) -> int:
        at[a].append(len(arcs))
        arcs.append([b, c, cost])
        at[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    links = {}
    for p, c in enumerate(capacity):
        for k in range(repeats):
            arc(first, 1 + p, c, k * k)
        for s in member[p]:
            links[p, s] = arc(1 + p, 1 + patterns + s, c * repeats, 0)
    for s, q in enumerate(quota):
        arc(1 + patterns + s, last, q, 0)
    height = [0] * (last + 1)
    while True:
        dist, back = {first: 0}, {}
        heap = [(0, first)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for i in at[a]:
                b, c, cost = arcs[i]
                if c > 0 and (e := d + cost + height[a] - height[b]) < dist.get(b, 1 << 62):
                    dist[b], back[b] = e, i
                    heapq.heappush(heap, (e, b))
        if last not in dist:
            return {k: arcs[i ^ 1][1] for k, i in links.items() if arcs[i ^ 1][1]}
        furthest = max(dist.values())
        height = [h + dist.get(a, furthest) for a, h in enumerate(height)]
        push, b = 1 << 62, last
        while b != first:
            push, b = min(push, arcs[back[b]][1]), arcs[back[b] ^ 1][0]
        b = last
        while b != first:
            arcs[back[b]][1] -= push
            arcs[back[b] ^ 1][1] += push
            b = arcs[back[b] ^ 1][0]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def placed(docs: DataFrame, sources: Column, size: Column, id_col: str, seed: int) -> DataFrame:
    """docs with _sources (sorted, distinct; the source null where there is none), _size, and the seeded hash of the id as _bin and _sub."""
    member = F.array_sort(F.array_distinct(F.when(F.size(F.coalesce(sources, F.array())) == 0, F.array(F.lit(None).cast("string"))).otherwise(sources)))
    spot = F.xxhash64(F.lit(seed), F.col(id_col))
    at = {"_bin": F.shiftrightunsigned(spot, 52).cast("int"), "_sub": F.shiftrightunsigned(F.shiftleft(spot, 12), 52).cast("int")}
    return docs.withColumns({"_sources": member, "_size": F.coalesce(size, F.lit(0)).cast("long"), **at})


def plan_mix(rows: DataFrame, weights: dict | None, budget: int | None, repeats: int, most_patterns: int) -> tuple[DataFrame, Column]:
    """A table by _sources, small enough to broadcast, and the column that gives from it how many times a placed row is taken."""
    patterns = rows.groupBy("_sources").agg(F.sum("_size").alias("words")).limit(most_patterns + 1).collect()
    if len(patterns) > most_patterns:
        raise ValueError(f"over {most_patterns} membership patterns; raise most_patterns if the driver can hold them")
    patterns.sort(key=lambda r: [(s is None, s or "") for s in r["_sources"]])
    names = sorted({s for r in patterns for s in r["_sources"]}, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    own = [sum(r.words for r in patterns if s in r["_sources"]) for s in names]
    share = [(weights.get(s, 0) if weights is not None else i % 3 + 1) for i, s in enumerate(names)]
    total = sum(r.words for r in patterns) if budget is None else budget
    target = water_fill(own, share, total, repeats) if any(share) else [0.0] * len(names)
    flow = route([r.words for r in patterns], [[index[s] for s in r["_sources"]] for r in patterns], [round(t) for t in target], repeats)
    plan = []
    for k, r in enumerate(patterns):
        parts = [(names[s], f) for s in range(len(names)) if (f := flow.get((k, s), 0))]
        whole, rest = divmod(sum(f for _, f in parts), r.words) if r.words else (0, 0)
        targets = [{"source": s, "source_size": own[index[s]], "target": float(target[index[s]])} for s in r["_sources"]]
        plan.append({"_sources": list(r["_sources"]), "whole": whole, "rest": rest, "targets": targets, "routed": [{"source": s, "words": f} for s, f in parts]})
    # An Arrow table becomes a DataFrame without a Python worker on the executors.
    cuts = rows.sparkSession.createDataFrame(pa.Table.from_pylist(plan, PLAN))
    taken, rest = F.lit(False), cuts.filter("rest > 0").select("_sources", "rest")
    for k in itertools.count():
        # What a round leaves over is less than the next document; the next round fills it with smaller ones, until none fits anywhere.
        rest = cut(refine(rows.join(F.broadcast(cuts), "_sources").filter(~taken).select("_sources", "_bin", "_sub", "_size"), rest), "rest")
        rest = rest.filter("left < most")
        if rest.isEmpty():
            break
        cuts = cuts.join(F.broadcast(rest.select("_sources", *(F.col(c).alias(f"{c}{k}") for c in ("most", "end", "sub_end")))), "_sources", "left")
        here = (F.col("_bin") < F.col(f"end{k}")) | ((F.col("_bin") == F.col(f"end{k}")) & (F.col("_sub") <= F.col(f"sub_end{k}")))
        taken = taken | F.coalesce((F.col("_size") <= F.col(f"most{k}")) & here, F.lit(False))
        rest = rest.filter("left > 0").select("_sources", F.col("left").alias("rest"))
    return cut(cuts, "plan"), F.col("whole") + taken.cast("int")


def mix(docs: DataFrame, sources: Column, size: Column, id_col: str = "doc_id", weights: dict | None = None, budget: int | None = None, repeats: int = 3, seed: int = 17, most_patterns: int = 100_000) -> DataFrame:
    """Mix documents so that each source's words come near its share of the budget.

    sources: array of the sources a document belongs to (duplicates count once; null or empty array: the source null).
    size: its words (null: 0). weights: by source; by default 1, 2, 3, repeating, over sources in code point order, null last.
    budget: words in the mix, all sizes by default. Targets stop at `repeats` times the source's size; the excess is shared again.

    Documents are aggregated by membership pattern, so the driver sees a row for each pattern (an error above `most_patterns`)
    and solves a min-cost flow of words from patterns to sources, in which another repetition costs more than the one before.
    A pattern's flow is whole passes over all its documents plus a part of one more; the documents of that part are those whose
    seeded hash lies below a threshold, found by histograms of BINS bins, so no pattern's rows are sorted or gathered in one task;
    further rounds fill what is left with smaller documents, each at least leaves out another size, until what is left is under the smallest
    document of the pattern that isn't in the part. The sum never exceeds the flow.

    Returns a row for each input row: id_col, sources, size, times (int), taken = times * size (long), `targets` (source, source_size and target
    of each of its sources) and `routed` (words of the row's pattern that go to each source). Rows that repeat an id are all taken alike.
    Null ids hash as one id. An empty table gives an empty result; documents of no words follow the whole passes of their pattern.
    """
    rows = cut(placed(docs.select(F.col(id_col).alias("_id"), sources.alias("_of"), size.alias("_words")), F.col("_of"), F.col("_words"), "_id", seed).drop("_of", "_words"), "sizes")
    cuts, times = plan_mix(rows, weights, budget, repeats, most_patterns)
    out = rows.join(F.broadcast(cuts), "_sources").withColumn("_times", times)
    return out.select(F.col("_id").alias(id_col), F.col("_sources").alias("sources"), F.col("_size").alias("size"), F.col("_times").alias("times"), (F.col("_times") * F.col("_size")).alias("taken"), "targets", "routed")


def mixed_rows(docs: DataFrame, sources: Column, size: Column, id_col: str = "doc_id", weights: dict | None = None, budget: int | None = None, repeats: int = 3, seed: int = 17, most_patterns: int = 100_000) -> DataFrame:
    """The rows of docs, all columns, each as many times as mix() takes it. The plan is broadcast, texts are not shuffled."""
    narrow = cut(placed(docs, sources, size, id_col, seed).select("_sources", "_size", "_bin", "_sub"), "sizes")
    cuts, times = plan_mix(narrow, weights, budget, repeats, most_patterns)
    # The row's own columns travel as one, so that none can clash with the plan's.
    rows = placed(docs, sources, size, id_col, seed).select(F.struct(*docs.columns).alias("_row"), "_sources", "_size", "_bin", "_sub")
    out = rows.join(F.broadcast(cuts), "_sources").select("_row", times.alias("_times")).filter("_times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def refine(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """(sources, most, end, sub_end, left): of the rows of at most `rest` = `most` words, in the order of bin and sub, those that
    fit into `rest` end with sub-bin sub_end of bin `end`; `left` words are left. Two histograms of BINS bins a pattern find it."""
    fits = rows.join(F.broadcast(rest), "_sources").filter(F.col("_size") <= F.col("rest"))
    before = F.sum("w").over(Window.partitionBy("_sources").orderBy("b")) - F.col("w")
    bins = fits.groupBy("_sources", "rest", F.col("_bin").alias("b")).agg(F.sum("_size").alias("w")).withColumn("left", F.col("rest") - before)
    ends = bins.filter("left >= 0").groupBy("_sources", "rest").agg(F.max_by(F.struct("b", "left"), "b").alias("at")).select("_sources", F.col("rest").alias("most"), F.col("at.b").alias("end"), "at.left")
    inner = rows.join(F.broadcast(ends), "_sources").filter("_size <= most AND _bin = end")
    subs = inner.groupBy("_sources", F.col("_sub").alias("b"), "left").agg(F.sum("_size").alias("w")).withColumn("left", F.col("left") - before - F.col("w"))
    last = subs.filter("left >= 0").groupBy("_sources").agg(F.max_by(F.struct("b", "left"), "b").alias("at")).select("_sources", F.col("at.b").alias("sub_end"), F.col("at.left").alias("sub_left"))
    return ends.join(F.broadcast(last), "_sources", "left").select("_sources", "most", "end", F.coalesce("sub_end", F.lit(-1)).alias("sub_end"), F.coalesce("sub_left", "left").alias("left"))
