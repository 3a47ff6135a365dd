"""Joins, upserts and per-group choices (J, K, W)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.lineage import cut


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in a total order (DISTINCT ON); Spark prunes groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def flag_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: str) -> DataFrame:
    """All rows, `flag` true for the first of each group."""
    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def best_per_cluster(hits: DataFrame, cluster: str, final: str, score: str, tie: str) -> DataFrame:
    """One hit for each cluster, final versions first, then the best score; hits without a cluster all stay."""
    alone = hits.filter(F.col(cluster).isNull())
    order = [F.coalesce(F.col(final), F.lit(False)).desc(), F.col(score).desc(), F.col(tie)]
    return first_by(hits.filter(F.col(cluster).isNotNull()), [cluster], order).unionByName(alone)


def merge_hits(hits: DataFrame, key: str, score: str, weight: Column) -> DataFrame:
    """The best weighted score of each key over several result lists."""
    return hits.groupBy(key).agg(F.max(F.col(score) * weight).alias(score))


def fuse_ranks(ranked: DataFrame, query: Sequence[str], item: str, rank: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lists that hold an item."""
    return ranked.groupBy(*query, item).agg(F.sum(1.0 / (k + F.col(rank))).alias("rrf"))


def page_numbers(items: DataFrame, scope: Sequence[str], order: Sequence[Column], pages: str, prefix: str, start: int = 1, width: int = 6) -> DataFrame:
    """Running page numbers within a scope (a production set): each item's begin and end, zero-padded and never cut off.

    Items are dealt by ranges of their order and each range adds up its own pages; only the sums of the ranges run over a whole scope, so a set of any
    size is spread over tasks. End `order` with a unique column.
    """
    placed = cut(items.repartitionByRange(*scope, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*scope, "_range").agg(F.sum(pages).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*scope).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")
    here = Window.partitionBy(*scope, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("_own", F.sum(pages).over(here)).join(sums.withColumn("_before", before).drop("_sum"), [*scope, "_range"])
    end = F.col("_own") + F.col("_before") + start - 1
    pad = lambda n: F.concat(F.lit(prefix), F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(width)), F.lit("0")))
    out = numbered.withColumns({"begin_no": end - F.col(pages) + 1, "end_no": end}).drop("_range", "_own", "_before")
    return out.withColumns({"bates_begin": pad(F.col("begin_no")), "bates_end": pad(F.col("end_no"))})


def upsert_counts(old: DataFrame, new: DataFrame, keys: Sequence[str], count: str, earliest: str, latest: str) -> DataFrame:
    """Counters by key after new rows were added to old ones: a re-aggregation, so that reruns don't count twice."""
    both = old.select(*keys, count, earliest, latest).unionByName(new.select(*keys, count, earliest, latest))
    return both.groupBy(*keys).agg(F.sum(count).alias(count), F.min(earliest).alias(earliest), F.max(latest).alias(latest))


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new whose key old doesn't have, one for each key, the least by its other columns (nulls in keys are equal)."""
    once = first_by(new, keys, [F.col(c) for c in new.columns if c not in keys] or [F.lit(1)]).alias("n")
    seen = old.select(*keys).distinct().alias("o")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return once.join(seen, on, "left_anti")


def overlay(rows: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rows with the columns of updates where they are not null; updates has a row for each key at most."""
    renamed = updates.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(renamed, key, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns})
    return out.drop(*(f"_{c}" for c in columns))


def with_counts(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """left with the number of right's rows by key, 0 if there are none."""
    counts = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def purge(tables: Mapping[str, DataFrame], key: str, gone: DataFrame, keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every table without the rows of the keys in gone; tables named in keep (the audit trail) stay whole."""
    return {name: t if name in keep else t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def thread_depth(messages: DataFrame, key: str, parent: str) -> DataFrame:
    """(id, root, depth) of messages with one row a key: the end of each reply chain of any length, by doubling pointers.

    A chain ends at a message without a parent (depth 0), or at a parent that isn't there, which is the root then. Each round every open message jumps to
    where its parent's pointer leads, so a chain of n takes log2(n) rounds, each one join of the open messages. A round closes the nearest open message
    of any chain, so what is open when a round closes none lies on or above a cycle; those messages get no row.
    """
    links = messages.select(F.col(key).alias("id"), F.col(parent).alias("up"))
    known = links.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    start = links.join(known, "up", "left")
    start = start.select("id", F.when(F.col("up").isNull(), F.col("id")).otherwise(F.col("up")).alias("to"), F.col("up").isNotNull().cast("int").alias("depth"), (F.col("up").isNull() | F.col("there").isNull()).alias("closed"))
    state, left = cut(start, "pointers"), None
    while (now := state.filter("NOT closed").count()) and now != left:
        left = now
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"), F.col("closed").alias("ends"))
        jumped = state.filter("NOT closed").join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("closed"))
        state = cut(state.filter("closed").unionByName(jumped), "pointers")
    return state.filter("closed").select("id", F.col("to").alias("root"), "depth")


def order_statistics(rows: DataFrame, group: str, value: str, ranks: Mapping[str, Column], bins: int = 1 << 16, most_rounds: int = 60) -> DataFrame:
    """(group, n, a column for each rank): the values at the given ranks, from 0, of each group's sorted non-null doubles; ranks are functions of n.

    No group is sorted or gathered: each round counts `bins` equal bins of the range that is left for a rank and goes on with the one that holds it, until
    its values are equal. A round is one aggregation by group and bin over the rows still in question; where there
    are many groups, their ranges meet the rows by a shuffle. `group` must not be null.
    """
    data = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    total = cut(data.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "totals")
    seek = total.select("g", "lo", "hi", F.explode(F.create_map(*(x for name, rank in ranks.items() for x in (F.lit(name), rank.cast("long"))))).alias("name", "rank"))
    found: DataFrame | None = None
    for _ in range(most_rounds):
        seek = cut(seek, "seek")
        done = seek.filter("lo = hi").select("g", "name", F.col("lo").alias("v"))
        found = done if found is None else found.unionByName(done)
        seek = seek.filter("lo < hi")
        if seek.isEmpty():
            break
        inside = data.join(seek, "g").filter("v BETWEEN lo AND hi")
        spot = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy("g", "name", "rank", spot.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("c").over(Window.partitionBy("g", "name").orderBy("bin")) - F.col("c")
        counts = counts.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        seek = counts.select("g", "lo", "hi", "name", (F.col("rank") - F.col("before")).alias("rank"))
    else:
        raise RuntimeError(f"ranks are not found in {most_rounds} rounds")
    wide = found.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks))
    return total.select("g", "n").join(wide, "g").withColumnRenamed("g", group)
