"""Jaccard join of documents' word n-grams through a token-group matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_IDS, cut, give_back, restrict, small_batches, spans, text_bytes
from foliant.llm.words import mixed, windows, words
from foliant.operators.components import connected_components

#: Bytes of text, and tokens, that a Python worker holds at once.
CHUNK, BLOCK = 1 << 19, 1 << 20
#: Pairs of hashes whose minima a document is grouped by.
SLOTS = 2
#: Tokens below it are a quarter of all.
QUARTER = np.uint64(1 << 62)
#: A token that occurs LOCAL times in a window of WINDOW_TOKENS tokens is reported; one with reports of FREQUENT comes late in the order.
#: Any order is right; this one keeps common tokens out of prefixes. At most ORDERED tokens, the most frequent, are ordered so (8 MB each).
WINDOW_TOKENS, LOCAL, FREQUENT, ORDERED = 1 << 20, 2, 8, 1_000_000


def need(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of n must share with a partner: the least integer of 0.8 * n."""
    return (4 * n + 4) // 5


def similar(both: np.ndarray, n: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return 100 * both >= 80 * (n + m - both)


def token_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, offsets, tokens): each row's distinct tokens, sorted. A token is the hash of `size` words, or of all words of a shorter text."""
    data, offsets = text_bytes(column)
    for i, j in spans(offsets, CHUNK):
        row, _, code = windows(words(data, offsets[i : j + 1], lower=True), size, short=True)
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        if len(row):
            new = np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))
            row, code = row[new], code[new]
        yield i, j, np.searchsorted(row, np.arange(j - i + 1)), code


def set_rows(docs: DataFrame, size: int) -> DataFrame:
    """For each (id, text) its set's size, two digests and SLOTS group keys; and, as rows with a token, the reports of frequent tokens."""
    names = ["id", "n", "d1", "d2", *(f"a{s}" for s in range(SLOTS)), "token", "reports"]
    salts = [mixed(np.array([k + 1], np.uint64))[0] for k in range(2 * SLOTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def reports() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            token, count = token[count >= LOCAL], count[count >= LOCAL]
            held.clear()
            seen.clear()
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none] * (4 + SLOTS) + [pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], names)

        for batch in give_back(batches):
            for i, j, at, token in token_sets(batch.column("text"), size):
                n = np.diff(at)
                some, start = np.flatnonzero(n), at[:-1][n > 0]
                out = np.zeros((2 + SLOTS, j - i), np.uint64)
                if len(some):
                    out[0, some] = np.add.reduceat(mixed(token), start)
                    out[1, some] = np.add.reduceat(mixed(token ^ np.uint64(0x5851F42D4C957F2D)), start)
                    for s in range(SLOTS):
                        low = [np.minimum.reduceat(mixed(token ^ salts[2 * s + k]), start) for k in range(2)]
                        out[2 + s, some] = mixed(low[0] + mixed(low[1]))
                new = [k for k in some.tolist() if (d := int(out[0, k])) not in seen and not seen.add(d)]
                held += [token[at[k] : at[k + 1]] for k in new]
                none = pa.nulls(j - i, pa.int64())
                columns = [pa.array(x.view(np.int64)) for x in out]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(n.astype(np.int64)), *columns, none, none], names)
                if sum(map(len, held)) >= WINDOW_TOKENS:
                    yield reports()
        yield reports()

    return small_batches(docs).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def token_rows(docs: DataFrame, size: int, part: bool = False) -> DataFrame:
    """docs with tokens, the sorted distinct tokens as 64-bit integers, instead of text.

    part: only tokens of the first quarter of the hash space, of each 32 bits (an eighth of the bytes).
    """
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(batches):
            for i, j, at, token in token_sets(batch.column("text"), size):
                lists = [token[at[k] : at[k + 1]] for k in range(j - i)]
                if part:
                    lists = [((x[: np.searchsorted(x, QUARTER)]) >> np.uint64(30)).astype(np.uint32) for x in lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in kept), pa.array([x.tobytes() for x in lists], pa.binary())], [*kept, "tokens"])

    return small_batches(docs.select(*kept, "text")).mapInArrow(run, docs.select(*kept).schema.add("tokens", "binary"))


def clusters(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the index of the first set that links reach within the list.

    Breadth first, over an inverted index of the sets not reached yet: a reached set is never compared again, so a large group of near copies
    costs about one pass, and the index is made anew when half of it is used up.
    """
    n = np.array([len(x) for x in sets])
    label, left, queue = np.full(len(sets), -1), np.arange(len(sets)), []
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    width = int(ids.max()) + 1 if len(ids) else 0

    def index(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate([ids[ends[r] : ends[r + 1]] for r in rows]) if len(rows) else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        return np.repeat(np.arange(len(rows)), n[rows])[order], np.searchsorted(flat[order], np.arange(width + 1))

    rows, (owner, first), open_ = left, index(left), len(left)
    seed = 0
    while open_:
        if not queue:
            while label[seed] >= 0:
                seed += 1
            label[seed], open_ = seed, open_ - 1
            queue.append(seed)
        x = queue.pop()
        if open_ * 2 < len(rows):
            rows = np.flatnonzero(label < 0)
            owner, first = index(rows)
        mine = ids[ends[x] : ends[x + 1]]
        lo, hi = first[mine], first[mine + 1]
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(rows))
        hit = rows[similar(both, n[rows], n[x]) & (label[rows] < 0) & (both > 0)]
        label[hit], open_ = label[x], open_ - len(hit)
        queue += hit.tolist()
    return label


def blocked(rows: DataFrame, key: list[str], id_col: str, weight: str) -> DataFrame:
    """rows with a column block: those of a key are dealt by id into as many blocks as hold BLOCK of the weight each."""
    total = rows.groupBy(*key).agg(F.ceil(F.sum(weight) / BLOCK).alias("_blocks"))
    return rows.join(total, key).withColumn("block", F.pmod(F.xxhash64(id_col, *key), F.col("_blocks"))).drop("_blocks")


def grouped(sets: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Links (a, b) within groups of documents that share a key: each document of a group's block with the first one that links reach."""
    members = reduce_union([sets.select(F.lit(s).alias("slot"), F.col(f"a{s}").alias("key"), "id", "n") for s in range(SLOTS)])
    several = members.groupBy("slot", "key").agg(F.count("*").alias("c")).filter("c > 1").select("slot", "key")
    members = cut(blocked(members.join(several, ["slot", "key"]), ["slot", "key"], "id", "n"), "members")
    # Many small groups share a task's call; a large one's block is alone in it.
    placed = members.select("id", "slot", "key", "block", page("slot", "key", "block", count=pages(members)).alias("page"))
    dealt = token_rows(attach(docs, placed), size)

    def link(table: pa.Table) -> pa.Table:
        a: list[int] = []
        b: list[int] = []
        frame = table.to_pandas()
        for _, g in frame.groupby(["slot", "key", "block"], sort=False):
            ids = g["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, blobs = ids[order], g["tokens"].to_numpy()[order]
            if len(ids) > 1:
                found = clusters([np.frombuffer(x, np.uint64) for x in blobs])
                tied = found != np.arange(len(ids))
                a += ids[tied].tolist()
                b += ids[found[tied]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("page").applyInArrow(link, "a long, b long")


def attach(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with their documents' text. Broadcast only when a count shows that they are few, so that texts needn't be shuffled."""
    small = rows.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4
    return docs.join(F.broadcast(rows) if small else rows, "id")


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def pages(rows: DataFrame) -> int:
    """Calls of about BLOCK tokens that rows with a column n need, for evenly dealt keys; two for each core at least, so that few rows don't meet in one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(2 * cores, -(-(rows.agg(F.sum("n")).first()[0] or 0) // BLOCK) * 2)


def page(*columns: str, count: int) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def prefixes(docs: DataFrame, frequent: np.ndarray, size: int) -> DataFrame:
    """(id, n, prefix) of each (id, text): those tokens, in the global order, one of which any similar set has in its prefix as well.

    frequent: tokens that come last in the order, by rising frequency; the others come first, by their hash.
    """
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rank = order.value
        for batch in give_back(batches):
            for i, j, at, token in token_sets(batch.column("text"), size):
                n = np.diff(at)
                place = np.zeros(len(token), np.int32)
                if len(late) and len(token):
                    k = np.minimum(np.searchsorted(late, token), len(late) - 1)
                    place = np.where(late[k] == token, rank[k] + 1, 0)
                row = np.repeat(np.arange(j - i), n)
                if place.any():
                    token = token[np.lexsort((token, place, row))]
                length = np.where(n > 0, n - need(n) + 1, 0)
                inside = np.arange(len(token)) - at[row] < length[row]
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(token[inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(n.astype(np.int64)), lists], ["id", "n", "prefix"])

    return small_batches(docs).mapInArrow(run, "id long, n long, prefix array<long>")


def contested(rows: DataFrame) -> DataFrame:
    """The rows of the token-group matrix whose token two groups or more have, from (token, gid, n, rest) sorted by token and gid.

    A row holds the least and largest set size of the group's sets with that token in their prefix, and the most tokens from it on.
    Sorted rows are gone through as a stream: of a token that runs on into the next batch only its first group is held.
    """
    names = ["token", "gid", "n_least", "n_most", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # token, gid, sizes and rest of the first group of the last token, and whether it went out
        for batch in batches:
            t, g, n, r = (batch.column(c).to_numpy() for c in ("token", "gid", "n", "rest"))
            if not len(t):
                continue
            pair = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (g[1:] != g[:-1])))
            t, g, least, most, rest = t[pair], g[pair], np.minimum.reduceat(n, pair), np.maximum.reduceat(n, pair), np.maximum.reduceat(r, pair)
            if last is not None and last[0] == t[0] and not last[5]:
                t, g, least, most, rest = (np.append(x, y) for x, y in zip(last[:5], (t, g, least, most, rest), strict=True))
            begin = np.append(True, t[1:] != t[:-1])
            group = np.cumsum(begin) - 1
            first = np.flatnonzero(begin)
            several = np.minimum.reduceat(g, first) != np.maximum.reduceat(g, first)
            if last is not None and last[0] == t[0] and last[5]:
                several[0] = True
            keep = several[group]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (t, g, least, most, rest)], names)
            k = first[-1]
            # If that token is in one group so far, its rows are merged into one.
            last = (t[k], g[k], least[k:].min(), most[k:].max(), rest[k:].max(), bool(several[-1]))

    dealt = rows.repartition("token").sortWithinPartitions("token", "gid")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def group_pairs(matrix: DataFrame) -> DataFrame:
    """Pairs of groups (g < h) that share a token of their prefixes and whose sizes and positions leave room for a similarity of 0.8."""
    a, b = (matrix.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("gid", "n_least", "n_most", "rest"))) for s in "gh")
    # Sets of x and y tokens need 4/9 (x + y) in common; what comes from the shared token on bounds it.
    fits = (F.col("gid_g") < F.col("gid_h")) & (5 * F.col("n_most_g") >= 4 * F.col("n_least_h")) & (5 * F.col("n_most_h") >= 4 * F.col("n_least_g"))
    fits = fits & (9 * F.least("rest_g", "rest_h") >= 4 * (F.col("n_least_g") + F.col("n_least_h")))
    return a.join(b, "token").filter(fits).select(F.col("gid_g").alias("g"), F.col("gid_h").alias("h")).distinct()


def opened(pairs: DataFrame, member: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Links (a, b) between groups: the smaller group's sets are queries to the blocks of the larger one.

    First an eighth of each set's bytes bounds what a query shares with a block's union, then with its sets: the tokens of a quarter of the
    hash space are compared, all others could be shared. What is left is opened with all tokens and compared exactly. A query's
    first link to a block is enough, as a group's sets are linked already.
    """
    weight = cut(member.groupBy("gid").agg(F.sum("n").alias("w")), "weights")
    sized = pairs.join(weight.withColumnsRenamed({"gid": "g", "w": "wg"}), "g").join(weight.withColumnsRenamed({"gid": "h", "w": "wh"}), "h")
    less = (F.col("wg") < F.col("wh")) | ((F.col("wg") == F.col("wh")) & (F.col("g") < F.col("h")))
    asks = cut(sized.select(F.when(less, F.col("g")).otherwise(F.col("h")).alias("q"), F.when(less, F.col("h")).otherwise(F.col("g")).alias("gid")), "asks")
    sets = cut(member.join(asks.select("gid").distinct(), "gid", "left_semi").select("gid", "id", "n"), "sets")
    queries = cut(asks.join(member.withColumnRenamed("gid", "q"), "q").select("gid", "id", "n"), "queries")
    left = cut(meet(sets, queries, docs, size, bounded, "gid long, id long", part=True).distinct(), "qualified")
    queries = cut(queries.join(left, ["gid", "id"], "left_semi"), "queries")
    sets = cut(sets.join(left.select("gid").distinct(), "gid", "left_semi"), "sets")
    return meet(sets, queries, docs, size, linked, "a long, b long")


def meet(sets: DataFrame, queries: DataFrame, docs: DataFrame, size: int, look: Callable, schema: str, part: bool = False) -> DataFrame:
    """look(sets, queries) for each block of a group's sets and block of its queries, both (gid, id, n) with their tokens."""
    sets, queries = cut(blocked(sets, ["gid"], "id", "n"), "blocks"), cut(blocked(queries, ["gid"], "id", "n").withColumnRenamed("block", "ask"), "asking")
    sides = cut(sets.select("gid", "block").distinct().join(queries.select("gid", "ask").distinct(), "gid"), "sides")
    count = max(pages(sets), pages(queries))
    left = attach(docs, sets.join(sides, ["gid", "block"]).withColumn("page", page("gid", "block", "ask", count=count)))
    right = attach(docs, queries.join(sides, ["gid", "ask"]).withColumn("page", page("gid", "block", "ask", count=count)))
    names = {c: f"at_{c}" for c in ("gid", "block", "ask", "id", "n", "page", "tokens")}
    left, right = token_rows(left, size, part), token_rows(right, size, part).withColumnsRenamed(names)

    def run(key: tuple, sets: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        of = {k: g for k, g in sets.groupby(["gid", "block", "ask"], sort=False)}
        for k, asked in queries.groupby(["at_gid", "at_block", "at_ask"], sort=False):
            if k in of:
                out += look(of[k], asked)
        return pd.DataFrame(out, columns=["x", "y"], dtype="int64").set_axis([c.split(" ")[0] for c in schema.split(", ")], axis=1)

    return left.groupBy("page").cogroup(right.groupBy("at_page")).applyInPandas(run, schema)


def overlaps(lists: list[np.ndarray]) -> Callable[[np.ndarray], tuple[int, np.ndarray]]:
    """A function of a query's tokens: how many of them the lists' union holds, and how many each list does."""
    n = np.array([len(x) for x in lists])
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def count(tokens: np.ndarray) -> tuple[int, np.ndarray]:
        lo, hi = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
        shared = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(shared)[:-1]]), shared) + np.arange(shared.sum())
        return int((shared > 0).sum()), np.bincount(owner[at], minlength=len(n))

    return count


def bounded(sets: pd.DataFrame, asked: pd.DataFrame) -> list[tuple[int, int]]:
    """(gid, query) of the queries that some set of the block may be similar to, by their parts."""
    lists = [np.frombuffer(x, np.uint32) for x in sets["tokens"]]
    n, held = sets["n"].to_numpy(), np.array([len(x) for x in lists])
    count, out = overlaps(lists), []
    for gid, q, m, blob in zip(asked["at_gid"], asked["at_id"], asked["at_n"], asked["at_tokens"], strict=True):
        tokens = np.frombuffer(blob, np.uint32)
        union, both = count(tokens)
        if union + m - len(tokens) >= need(m) and similar(np.minimum(both + np.minimum(n - held, m - len(tokens)), np.minimum(n, m)), n, m).any():
            out.append((gid, q))
    return out


def linked(sets: pd.DataFrame, asked: pd.DataFrame) -> list[tuple[int, int]]:
    """(query, set) links, one for each query at most. The union is looked at first: a block below the bound isn't opened."""
    lists = [np.frombuffer(x, np.uint64) for x in sets["tokens"]]
    n, ids = sets["n"].to_numpy(), sets["id"].to_numpy()
    count, out = overlaps(lists), []
    for q, m, blob in zip(asked["at_id"], asked["at_n"], asked["at_tokens"], strict=True):
        union, both = count(np.frombuffer(blob, np.uint64))
        if union >= need(m) and len(hit := np.flatnonzero(similar(both, n, m) & (both > 0))):
            out.append((q, ids[hit[0]]))
    return out


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """Classes of documents that links reach; two documents link if the Jaccard similarity of their sets of `size`-word tokens is 0.8 or more.

    Words are runs of non-white-space ASCII, A-Z lower-cased; a text with fewer words is one token; null or empty text has an empty set, which
    links with nothing. No link between different texts is lost, and none is left out for cost:

    1. Equal sets are one from here on, so copies cost nothing more.
    2. Sets are partitioned into groups that share two minima of hashes, in SLOTS ways, and linked within blocks of a group; linked sets
       are one group from here on, so near copies do not meet in pairs either.
    3. Token-group matrix: the union of the groups' prefix tokens, in an order that puts frequent tokens last. Groups that share no token of it
       can't hold similar sets (prefix filter); sizes and positions exclude more.
    4. Pairs of groups that are left are opened if the whole token union of a block of sets reaches the bound of the query's set.
    5. Connected components of all links.

    Texts are tokenised seven times, which costs less than to store their tokens, and never shuffled, but where too many to broadcast their ids are
    read for links (attach()). Equality and overlap are those of 64-bit hashes of words: texts made to collide could be taken for each other.
    Returns id_col, n_shingles (long), set_id (smallest id with the same set; null for empty sets) and component_id, a row for each input row.
    Rows that repeat an id are one node. Null ids get a null component and link with nothing. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = cut(set_rows(docs, size), "sets")
    every = rows.filter("token IS NULL")
    keys = ["d1", "d2", "n"]
    sets = every.filter("n > 0 AND id IS NOT NULL").groupBy(*keys).agg(F.min("id").alias("id"), *(F.min(f"a{s}").alias(f"a{s}") for s in range(SLOTS)))
    sets = cut(sets, "distinct")
    near = cut(grouped(sets, docs, size), "near")
    first = connected_components(near, "a", "b")
    groups = sets.select("id", "n").join(first.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("gid"))
    groups = cut(groups, "groups")

    often = rows.filter("token IS NOT NULL").groupBy("token").agg(F.sum("reports").alias("r")).filter(F.col("r") >= FREQUENT)
    often = often.orderBy(F.desc("r"), "token").limit(ORDERED).toPandas()
    frequent = often["token"].to_numpy(np.int64)[::-1].view(np.uint64) if len(often) else np.zeros(0, np.uint64)
    prefix = prefixes(docs, frequent, size).drop("n").join(groups, "id").select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    matrix = cut(contested(prefix.select("token", "gid", "n", (F.col("n") - F.col("pos")).alias("rest"))), "matrix")
    pairs = cut(group_pairs(matrix), "pairs")
    links = cut(opened(pairs, groups, docs, size), "links")

    root = connected_components(near.unionByName(links), "a", "b")
    classes = sets.join(root.withColumnRenamed("node", "id"), "id", "left").select(*keys, F.col("id").alias("set_id"), F.coalesce("component", "id").alias("component"))
    out = every.join(classes, keys, "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "set_id", component.alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which the id is the smallest of its class; rows without an id stay."""
    found = ngram_components(docs, id_col, text_col)
    gone = cut(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    return restrict(docs, gone, [id_col], "left_anti")
