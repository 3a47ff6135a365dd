"""Dense, sparse and hybrid retrieval over array and map columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from foliant.operators.rows import fuse_ranks, order_statistics
from foliant.plans.lineage import cut, spread


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector is all zeros."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def truncated(v: Column, dims: int) -> Column:
    """The first dims of a nested embedding."""
    return F.slice(v, 1, dims)


def blended(a: Column, b: Column, weight: float) -> Column:
    """weight * a + (1 - weight) * b, element by element (a hypothetical answer and the question)."""
    return F.zip_with(a, b, lambda x, y: F.lit(weight) * x.cast("double") + F.lit(1 - weight) * y.cast("double"))


def ranked(scored: DataFrame, query: Sequence[str], score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each query with their ranks, ties by `tie`; Spark keeps k rows a task before the shuffle."""
    w = Window.partitionBy(*query).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


#: Queries that go to every task at once.
MOST_QUERIES = 10_000


def against_all(queries: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], most: int = MOST_QUERIES) -> DataFrame:
    """work(queries), whose rows belong to one query each, for queries that are joined with all rows of a table.

    They are broadcast if a count shows that there are `most` at most; else they are dealt by hash into blocks of about half of that, which are worked on one
    after the other, each with its own pass over the table.
    """
    n = queries.count()
    if n <= most:
        return work(F.broadcast(queries))
    blocks = -(-2 * n // most)
    dealt = cut(queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))), "queries")
    parts = [cut(work(F.broadcast(dealt.filter(F.col("_block") == b).drop("_block"))), "answers") for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Scores that a task holds at once.
CELLS = 4_000_000
#: What the order of additions may change in a score; what rounding to nine places may.
ADDED, ROUNDED = 1e-10, 1e-9


def rounded(x: np.ndarray, places: int = 9) -> np.ndarray:
    """Doubles rounded as F.round() does: half up by their decimal digits, which matter only near halves."""
    scaled = x * 10.0**places
    out = np.rint(scaled) / 10.0**places
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-3):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of `width` numbers each as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up from the first element on as dot() does."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        out += x * y
    return out


def sizes(m: np.ndarray) -> np.ndarray:
    return np.sqrt(products(m, m))


def cosines(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """cosine() of rows, to the last bit."""
    size = a_size * b_size
    with np.errstate(all="ignore"):
        return np.where(size == 0, 0.0, products(a, b) / size)


class Cosine:
    """Scores of blocks of vectors with all queries: rough ones (queries x points) by a matrix product, exact ones of chosen pairs."""

    slack, cells = ADDED, 1

    def __init__(self, queries: pa.Table, width: int) -> None:
        self.width, self.q = width, matrix(queries.column("vector").combine_chunks(), width)
        self.q_size = sizes(self.q)
        self.q_unit = self.units(self.q, self.q_size)

    @staticmethod
    def units(m: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.where(size[:, None] == 0, 0.0, m / size[:, None])

    def rough(self, block: pa.RecordBatch) -> np.ndarray:
        self.m = matrix(block.column("vector"), self.width)
        self.size = sizes(self.m)
        return self.q_unit @ self.units(self.m, self.size).T

    def exact(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        return cosines(self.m[p], self.size[p], self.q[q], self.q_size[q])


class MaxSim:
    """As Cosine, for lists of vectors: max_sim() to nine places."""

    slack = ADDED + ROUNDED

    def __init__(self, queries: pa.Table, width: int) -> None:
        self.width = width
        self.q, self.q_start, self.q_count = self.parts(queries.column("vector").combine_chunks())
        self.q_size = sizes(self.q)
        self.q_unit = Cosine.units(self.q, self.q_size)
        self.cells = max(1, int(self.q_count.max(initial=1)))

    def parts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        return matrix(column.flatten(), self.width), np.cumsum(count) - count, count

    def rough(self, block: pa.RecordBatch) -> np.ndarray:
        self.m, self.start, self.count = self.parts(block.column("vector"))
        self.size = sizes(self.m)
        unit = Cosine.units(self.m, self.size)
        # Few query vectors at a time, as there is a score for each pair of vectors.
        step, out = max(1, CELLS // max(1, len(unit) * self.cells)), []
        for low in range(0, len(self.q_start), step):
            high = min(low + step, len(self.q_start))
            first, last = self.q_start[low], self.q_start[high - 1] + self.q_count[high - 1]
            best = np.maximum.reduceat(self.q_unit[first:last] @ unit.T, self.start, axis=1)
            out.append(np.add.reduceat(best, self.q_start[low:high] - first, axis=0) / self.q_count[low:high, None])
        return np.concatenate(out)

    def exact(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        total = np.zeros(len(q))
        for i in range(int(self.q_count[q].max(initial=0))):
            has = self.q_count[q] > i
            x, best = np.minimum(self.q_start[q] + i, len(self.q) - 1), np.full(len(q), -np.inf)
            for j in range(int(self.count[p].max(initial=0))):
                y = np.minimum(self.start[p] + j, len(self.m) - 1)
                score = cosines(self.q[x], self.q_size[x], self.m[y], self.size[y])
                best = np.where(self.count[p] > j, np.maximum(best, score), best)
            total += np.where(has, best, 0.0)
        return rounded(total / self.q_count[q])


class Sparse:
    """As Cosine, for sparse vectors (lists token and weight): dot products to nine places, minus infinity where no token is shared.

    Tokens that many queries and points of a block have go through a matrix product, the others through lists of their owners.
    """

    slack, cells = ADDED + ROUNDED, 1

    def __init__(self, queries: pa.Table) -> None:
        owner, token, self.weight = self.flat(queries.combine_chunks().to_batches()[0] if queries.num_rows else pa.RecordBatch.from_pylist([], queries.schema))
        self.n, self.tokens = queries.num_rows, pd.Index(pd.unique(token))
        code = self.tokens.get_indexer(token)
        order = np.argsort(code, kind="stable")
        self.owner, self.weight = owner[order], self.weight[order]
        self.start = np.searchsorted(code[order], np.arange(len(self.tokens) + 1))

    @staticmethod
    def flat(block: pa.RecordBatch) -> tuple[np.ndarray, pd.Series, np.ndarray]:
        count = pc.list_value_length(block.column("token")).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat(np.arange(block.num_rows), count), block.column("token").flatten().to_pandas(), block.column("weight").flatten().to_numpy(zero_copy_only=False).astype(float)

    def rough(self, block: pa.RecordBatch) -> np.ndarray:
        row, token, weight = self.flat(block)
        code = self.tokens.get_indexer(token)
        order = np.argsort(code, kind="stable")
        order = order[np.searchsorted(code[order], 0) :]
        row, weight, code = row[order], weight[order], code[order]
        here, start = np.unique(code, return_index=True)
        end = np.append(start[1:], len(code))
        wide = (self.start[here + 1] - self.start[here]) * (end - start) * 64 >= self.n * block.num_rows
        self.score, shared = np.zeros((self.n, block.num_rows)), np.zeros((self.n, block.num_rows), bool)
        for low in range(0, int(wide.sum()), 256):
            some = np.flatnonzero(wide)[low : low + 256]
            q, p = np.zeros((self.n, len(some))), np.zeros((len(some), block.num_rows))
            q_has, p_has = np.zeros(q.shape, np.float32), np.zeros(p.shape, np.float32)
            for x, t in enumerate(some):
                of, at = slice(self.start[here[t]], self.start[here[t] + 1]), slice(start[t], end[t])
                q[self.owner[of], x], q_has[self.owner[of], x] = self.weight[of], 1
                p[x, row[at]], p_has[x, row[at]] = weight[at], 1
            self.score += q @ p
            shared |= q_has @ p_has > 0
        for t in np.flatnonzero(~wide):
            of, at = slice(self.start[here[t]], self.start[here[t] + 1]), slice(start[t], end[t])
            cells = np.ix_(self.owner[of], row[at])
            self.score[cells] += np.outer(self.weight[of], weight[at])
            shared[cells] = True
        self.score[~shared] = -np.inf
        return self.score

    def exact(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        return rounded(self.score[q, p])


class Best:
    """The k best points of each of n queries among those that came by; of equal scores those that came first."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k, self.floor = n, k, np.full(n, -np.inf)
        self.held, self.size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

    def add(self, scorer: Cosine | MaxSim | Sparse, block: pa.RecordBatch, first: int) -> None:
        """A block whose rows came as numbers first, first + 1, ... Only pairs whose rough score may be among the best get an exact one."""
        rough = scorer.rough(block)
        if np.isnan(rough.sum()):
            # NaN is above all numbers, as in Spark.
            rough = np.where(np.isnan(rough), np.inf, rough)
        floor = self.floor - scorer.slack
        hit = (rough >= floor[:, None]) & (rough > -np.inf)
        if block.num_rows > self.k and hit.sum() > 2 * self.n * self.k:
            floor = np.maximum(floor, np.partition(rough, block.num_rows - self.k, axis=1)[:, block.num_rows - self.k] - 2 * scorer.slack)
            hit &= rough >= floor[:, None]
        q, p = np.nonzero(hit)
        for low in range(0, len(q), 1 << 18):
            some_q, some_p = q[low : low + (1 << 18)], p[low : low + (1 << 18)]
            score = scorer.exact(some_q, some_p)
            # What equals the least of k came later than they did.
            keep = ~(score <= self.floor[some_q])
            self.held.append((some_q[keep], some_p[keep] + first, score[keep]))
            self.size += int(keep.sum())
            if self.size > max(1 << 18, self.n * self.k):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, at, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((at, -np.where(np.isnan(score), np.inf, score), q))
        q, at, score = q[order], at[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = np.where(np.isnan(score[last]), np.inf, score[last])
        keep = rank < self.k
        self.held, self.size = [(q[keep], at[keep], score[keep])], 0
        return self.held[0]


def scored_best(points: DataFrame, queries: pa.Table, scorer: Callable[[pa.Table], Cosine | MaxSim | Sparse], k: int, key: str, query_key: str) -> DataFrame:
    """(query_key, key, score): each task's k best points of each query, ties by key. points: key and the scorer's columns; a task holds its points' keys, the queries and k rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, best, keys, n = scorer(queries), Best(queries.num_rows, k), [], 0
        step = max(1, CELLS // max(1, queries.num_rows * score.cells))
        for batch in batches:
            keys.append(batch.column(key))
            for low in range(0, batch.num_rows, step):
                best.add(score, batch.slice(low, step), n + low)
            n += batch.num_rows
        if not n:
            return
        q, at, value = best.settle()
        ids, asked = pa.chunked_array(keys), queries.column(query_key)
        for low in range(0, len(q), 1 << 16):
            part = slice(low, low + (1 << 16))
            columns = [x.take(pa.array(i[part])).combine_chunks() for x, i in ((asked, q), (ids, at))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value[part])], [query_key, key, "score"])

    id_type, query_type = points.schema[key].dataType, from_arrow_type(queries.schema.field(query_key).type)
    out = T.StructType([T.StructField(query_key, query_type), T.StructField(key, id_type), T.StructField("score", T.DoubleType())])
    # Rows come by key, so of equal scores the first ones stay.
    return spread(points).sortWithinPartitions(key).mapInArrow(run, out)


def dense_top_k(points: DataFrame, queries: DataFrame, k: int, allowed: Column | None = None, vector: str = "vector", key: str = "id", query_key: str = "query_id", query_vector: str = "query_vector", dims: int | None = None, most: int = MOST_QUERIES) -> DataFrame:
    """Exact cosine top-k of each query; `allowed` filters points before any score. Queries go to every task, `most` at a time.

    A task compares blocks of points with all queries by matrix products and keeps the k best of each; only those meet in a shuffle. A vector that is null or
    holds nulls has no score and comes last; one of another width than the query's meets it by cosine() itself.
    """
    points = points if allowed is None else points.filter(allowed)
    p, q = (F.col(vector), F.col(query_vector)) if dims is None else (truncated(F.col(vector), dims), truncated(F.col(query_vector), dims))
    points = points.select(key, p.cast("array<double>").alias("vector"))
    whole = F.coalesce(~F.exists("vector", lambda x: x.isNull()), F.lit(False))
    none = F.lit(None).cast("double").alias("score")

    def first(rows: DataFrame) -> DataFrame:
        return rows.select(key).orderBy(key).limit(k)

    def work(asked: DataFrame) -> DataFrame:
        asked = asked.select(query_key, q.cast("array<double>").alias("vector")).withColumn("width", F.when(whole, F.size("vector")).otherwise(-1))
        table = asked.toArrow()
        parts = []
        for width in pc.unique(table.column("width")).to_pylist():
            some = table.filter(pc.equal(table.column("width"), width)).select([query_key, "vector"])
            mine = asked.filter(F.col("width") == width)
            if width >= 0:
                parts.append(scored_best(points.filter(whole & (F.size("vector") == width)), some, lambda t, w=width: Cosine(t, w), k, key, query_key))
                # Vectors of other widths have no score either, but for those of zeros.
                others = points.filter(whole & (F.size("vector") != width)).join(F.broadcast(mine.select(query_key, F.col("vector").alias("asked"))))
                parts.append(others.select(query_key, key, cosine(F.col("vector"), F.col("asked")).alias("score")))
            unscored = points.filter(~whole) if width >= 0 else points
            parts.append(mine.select(query_key).join(F.broadcast(first(unscored))).select(query_key, key, none))
        if not parts:
            return points.limit(0).join(asked.limit(0)).select(query_key, key, none, F.lit(1).alias("rank"))
        return ranked(reduce(DataFrame.unionByName, parts), [query_key], "score", key, k)

    return against_all(queries, query_key, work, most)


def max_sim_top_k(points: DataFrame, queries: DataFrame, k: int, patches: str = "patches", key: str = "id", query_key: str = "query_id", query: str = "query", most: int = MOST_QUERIES) -> DataFrame:
    """The k best max_sim() scores of each query, to nine places. Lists of vectors of the usual width are compared in blocks as dense_top_k() does; what holds nulls, other widths or nothing meets by max_sim() itself."""
    p, q = F.col(patches).cast("array<array<double>>").alias("vector"), F.col(query).cast("array<array<double>>").alias("vector")

    def fits(width: int) -> Column:
        return F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: F.coalesce((F.size(x) == width) & ~F.exists(x, lambda y: y.isNull()), F.lit(False))), F.lit(False))

    def plain(some: DataFrame, asked: DataFrame) -> DataFrame:
        score = F.round(max_sim(F.col("asked"), F.col("vector")), 9).alias("score")
        return some.join(F.broadcast(asked.withColumnRenamed("vector", "asked"))).select(query_key, key, score)

    points = points.select(key, p)

    def work(asked: DataFrame) -> DataFrame:
        asked = asked.select(query_key, q)
        width = asked.select(F.max(F.size(F.col("vector")[0]))).first()[0] or 0
        usual = fits(width)
        parts = [plain(points, asked.filter(~usual)), plain(points.filter(~usual), asked.filter(usual))]
        table = asked.filter(usual).toArrow()
        if table.num_rows:
            parts.append(scored_best(points.filter(usual), table, lambda t: MaxSim(t, width), k, key, query_key))
        return ranked(reduce(DataFrame.unionByName, parts), [query_key], "score", key, k)

    return against_all(queries, query_key, work, most)


#: Rows that pivots are chosen from. The choice changes how much is compared, never what is found.
PIVOT_ROWS = 2_000
#: What rounding may add to an angle.
SLACK = 1e-6


def units(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def choose_pivots(rows: DataFrame, n: int, steps: int = 5) -> np.ndarray:
    """At most n unit vectors: from the PIVOT_ROWS rows of least hash those that lie farthest from each other, moved to the middle of what is nearest to them."""
    m = units(np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(PIVOT_ROWS).collect()], float))
    picked, nearest = [0], m @ m[0]
    while len(picked) < min(n, len(m)) and nearest.min() < 1 - SLACK:
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, m @ m[picked[-1]])
    pivots = m[picked]
    for _ in range(steps):
        own = (m @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, m)
        pivots = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, units(sums), pivots)
    return pivots


def meetings(rows: DataFrame, threshold: float, block: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Rows (kind, id, v) in blocks, as (kind, own, id, v, angles), and the pairs of blocks (kind, low, high) that may hold a pair of the threshold.

    A kind of over `block` vectors is dealt by nearest pivot, and a pivot's vectors by hash. An angle to a pivot differs between two vectors by no more
    than the angle between them; so blocks, of which the least and largest angles to each pivot are known, meet only if for no pivot the ranges lie further
    apart than the threshold's angle. low_range and high_range are the ranges of the two blocks: for each pivot the least and the largest angle.
    """
    sizes = rows.groupBy("kind").agg(F.count("*").alias("n"))
    reach = float(np.arccos(min(threshold, 1.0))) + SLACK if threshold > 0 else float("inf")
    at = choose_pivots(rows, pivots) if reach < np.pi and not sizes.filter(F.col("n") > block).isEmpty() else np.zeros((0, 0))

    @F.pandas_udf("array<double>")
    def angles(v: pd.Series) -> pd.Series:
        if not len(at) or not len(v):
            return pd.Series([[]] * len(v))
        return pd.Series(list(np.arccos(np.clip(units(np.array(v.tolist(), float)) @ at.T, -1, 1))))

    if not len(at):
        dealt = rows.withColumns({"angles": F.array().cast("array<double>"), "cell": F.lit(0)}).join(sizes, "kind")
    else:
        near = F.array_position("angles", F.array_min("angles")).cast("int")
        dealt = cut(rows.withColumn("angles", angles("v")), "angles").join(sizes, "kind").withColumn("cell", F.when(F.col("n") > block, near).otherwise(0))
    cells = dealt.groupBy("kind", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
    own = F.shiftleft(F.col("cell").cast("long"), 40) + F.pmod(F.xxhash64("id"), F.col("parts"))
    dealt = dealt.join(cells, ["kind", "cell"]).select("kind", own.alias("own"), "id", "v", "angles")
    if len(at):
        dealt = cut(dealt, "blocks")
    seen = F.array(*(F.array(F.min(F.col("angles")[k]), F.max(F.col("angles")[k])) for k in range(len(at)))).cast("array<array<double>>")
    boxes = dealt.groupBy("kind", "own").agg(F.count("*").alias("n"), seen.alias("range"))
    if len(at):
        boxes = cut(boxes, "ranges")
    low, high = (boxes.select("kind", F.col("own").alias(c), F.col("range").alias(f"{c}_range")) for c in ("low", "high"))
    apart = F.lit(False)
    for k in range(len(at)):
        a, b = F.col("low_range")[k], F.col("high_range")[k]
        apart = apart | (a[0] - b[1] > reach) | (b[0] - a[1] > reach)
    return dealt, low.join(high, "kind").filter((F.col("low") <= F.col("high")) & ~apart)


def similar_pairs(points: DataFrame, kind: str, threshold: float, key: str = "id", vector: str = "vector", block: int = 4096, pivots: int = 32) -> DataFrame:
    """(a, b, score), a < b: pairs of one kind whose cosine reaches the threshold; exact.

    Vectors of a kind are dealt into blocks of about `block` around `pivots`; a task compares two blocks by matrix products and only pairs that reach the
    threshold leave it. Blocks that are too far apart for the threshold never meet (meetings()), and of those that meet, vectors that are too far from all of
    the other block stay behind. Where vectors lie in groups, a vector is compared with what is around it; vectors that are alike in no way (random ones) are
    compared with all of their kind, as any exact join would. Null vectors and kinds have no pairs, vectors of zeros those of a threshold of 0 or less.
    """
    rows = points.select(F.col(kind).alias("kind"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("kind IS NOT NULL AND v IS NOT NULL")
    if threshold > 0:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    dealt, pairs = meetings(rows, threshold, block, pivots)
    reach = float(np.arccos(min(max(threshold, -1.0), 1.0))) + SLACK
    first = pairs.select("kind", "low", "high", F.col("low").alias("own"), F.col("high_range").alias("range"))
    second = pairs.filter("low < high").select("kind", "low", "high", F.col("high").alias("own"), F.col("low_range").alias("range"))
    # An empty list of angles (no pivots) is near everything.
    near = F.forall(F.arrays_zip("angles", "range"), lambda x: (x["angles"] >= x["range"][0] - reach) & (x["angles"] <= x["range"][1] + reach))
    met = dealt.join(first.unionByName(second), ["kind", "own"]).filter(near).select("kind", "id", "v", "own", "low", "high")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low = pdf["own"] == pdf["low"]
        sides = [pdf[low], pdf[low if pdf["low"].iloc[0] == pdf["high"].iloc[0] else ~low]]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"a": pdf["id"].iloc[:0], "b": pdf["id"].iloc[:0], "score": np.zeros(0)})
        left, right = (units(np.array(side["v"].tolist(), float)) for side in sides)
        score = left @ right.T
        i, j = np.nonzero(score >= threshold)
        x, y = sides[0]["id"].to_numpy()[i], sides[1]["id"].to_numpy()[j]
        keep = x != y if sides[0] is not sides[1] and pdf["low"].iloc[0] != pdf["high"].iloc[0] else x < y
        return pd.DataFrame({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep], "score": score[i, j][keep]})

    id_type = points.schema[key].dataType.simpleString()
    return met.groupBy("kind", "low", "high").applyInPandas(compare, f"a {id_type}, b {id_type}, score double")


def sparse_top_k(postings: DataFrame, queries: DataFrame, k: int, token: str = "token", weight: str = "weight", key: str = "id", query_key: str = "query_id", query_weight: str = "query_weight", most: int = MOST_QUERIES) -> DataFrame:
    """The k best dot products, to nine places, of sparse vectors given as (key, token, weight) rows; only points that share a token with the query. Rows of a null token or weight are passed over.

    Postings meet their vector in one shuffle; vectors are compared with all queries in blocks, so that pairs that share a token never become rows.
    """

    def vectors(rows: DataFrame, of: str, value: str) -> DataFrame:
        one = rows.filter(F.col(token).isNotNull() & F.col(value).isNotNull()).groupBy(of, F.col(token).alias("token")).agg(F.sum(F.col(value).cast("double")).alias("weight"))
        both = F.collect_list(F.struct("token", "weight"))
        return one.groupBy(of).agg(both.alias("both")).select(of, F.col("both.token").alias("token"), F.col("both.weight").alias("weight"))

    points = vectors(postings, key, weight)

    def work(asked: DataFrame) -> DataFrame:
        return ranked(scored_best(points, asked.toArrow(), Sparse, k, key, query_key), [query_key], "score", key, k)

    return against_all(vectors(queries, query_key, query_weight), query_key, work, most)


def hybrid_top_k(lists: Sequence[DataFrame], k: int, query_key: str = "query_id", key: str = "id", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (columns query_key, key, rank), then the k best; scores that differ by less than 1e-9 tie."""
    both = lists[0].select(query_key, key, "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select(query_key, key, "rank"))
    fused = fuse_ranks(both, [query_key], key, "rank", constant).withColumn("rrf", F.round("rrf", 9))
    return ranked(fused, [query_key], "rrf", key, k)


def max_sim(query: Column, patches: Column) -> Column:
    """Mean over query vectors of the largest cosine with any patch vector."""
    best = F.transform(query, lambda q: F.array_max(F.transform(patches, lambda p: cosine(q, p))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(query)


def visual_blend(text: Column, visual: Column, weight: float = 0.3) -> Column:
    """Text score blended with a visual one where there is one."""
    return F.when(visual.isNull(), text).otherwise((1 - weight) * text + weight * visual)


# Words that don't count as overlap.
STOPWORDS = "the a an is was were are be been being have has had do does did will would could should may might shall can to of in for on with at by from as into through during before after above below between and but or not no nor so if then than that this these those it its what which who whom".split()


def keywords(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z0-9]+(?:'[a-z]+)?\b"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 1)))


def relevance(question: Column, context: Column, score: Column, weight: float = 0.2) -> Column:
    """(1 - weight) * score + weight * share of the question's keywords in the context, in [0, 1]."""
    q = keywords(question)
    overlap = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, keywords(context))) / F.size(q))
    return F.least(F.greatest((1 - weight) * score + weight * overlap, F.lit(0.0)), F.lit(1.0))


def upper_medians(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): element n // 2 of each group's sorted values; groups are not collected."""
    return order_statistics(rows, key, value, {name: F.floor(F.col("n") / 2)}).select(key, name)


def ranking_metrics(hits: DataFrame, relevant: DataFrame, k: int, query: str = "query_id", item: str = "id", rank: str = "rank") -> DataFrame:
    """MRR, recall, precision (divided by k) and binary NDCG at k of each query that has relevant items."""
    marked = relevant.select(query, item).distinct()
    totals = marked.groupBy(query).agg(F.count("*").alias("n_relevant"))
    return hit_metrics(hits.join(marked, [query, item]), totals, k, query, rank)


def hit_metrics(hits: DataFrame, totals: DataFrame, k: int, query: str = "query_id", rank: str = "rank") -> DataFrame:
    """ranking_metrics() of relevant hits alone and (query, n_relevant), how many relevant items there are, where those need not be listed."""
    found = hits.filter(F.col(rank) <= k).groupBy(query).agg(F.min(rank).alias("first"), F.count("*").alias("n"), F.sum(1 / F.log2(F.col(rank) + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    n = F.coalesce("n", F.lit(0))
    return totals.join(found, query, "left").select(
        query,
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (n / F.col("n_relevant")).alias("recall"),
        (n / F.lit(float(k))).alias("precision"),
        F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )
