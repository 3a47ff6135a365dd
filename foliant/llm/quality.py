"""Quality rules and robust multivariate outliers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import cut, give_back, small_batches, spans, text_bytes
from foliant.llm.words import windows, words

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
CHUNK = 1 << 20


def text_stats(docs: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """keys and the STATS (long) of each whole text; null text has none of anything. Nothing is shuffled.

    n_repeat_words: words in windows of WINDOW words that occur twice or more in the text, the first included. n_dup_lines: lines (ended by \\n)
    that hold a word and equal an earlier line. n_lines: lines that hold a word.
    """
    keys = list(keys)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def repeated(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurs at least twice in its row, is not the first) of each item."""
        order = np.lexsort((np.arange(len(row)), code, row))
        r, c = row[order], code[order]
        same = np.zeros(len(r) + 1, bool)
        same[1:-1] = (r[1:] == r[:-1]) & (c[1:] == c[:-1])
        twice, later = np.zeros(len(r), bool), np.zeros(len(r), bool)
        twice[order], later[order] = same[1:] | same[:-1], same[:-1]
        return twice, later

    def stats(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(offsets) - 1
        w = words(data, offsets)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        inner = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = np.bincount(w.row, inner[w.end] - inner[w.start], n)
        signs = np.concatenate([[0], np.cumsum(symbol[data])])
        signs = signs[offsets[1:]] - signs[offsets[:-1]]
        row, at, code = windows(w, WINDOW, short=False)
        twice, _ = repeated(row, code)
        mark = np.zeros(len(w.row) + 1, np.int64)
        np.add.at(mark, at[twice], 1)
        np.add.at(mark, at[twice] + WINDOW, -1)
        again = np.bincount(w.row, np.cumsum(mark)[:-1] > 0, n)
        # Lines are texts of their own, compared by the hash of all their bytes: that of a word without spaces.
        breaks = np.flatnonzero(data == 10)
        starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        owner = np.searchsorted(offsets, starts, "right") - 1
        # A break that ends a text starts no line of the next text; that start is there already.
        ends = np.concatenate([starts[1:], offsets[-1:]])
        valid = (owner < n) & (starts < ends)
        starts, ends, owner = starts[valid], ends[valid], owner[valid]
        ends = ends - (data[ends - 1] == 10)
        full = np.searchsorted(w.start, ends, "left") > np.searchsorted(w.start, starts, "left")
        starts, ends, owner = starts[full], ends[full], owner[full]
        line = line_hash(data, starts, ends)
        _, later = repeated(owner, line)
        return [np.diff(w.first), chars, signs, np.bincount(owner[later], minlength=n), again, np.bincount(owner, minlength=n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(batches):
            data, offsets = text_bytes(batch.column(text_col))
            parts = [stats(data, offsets[i : j + 1]) for i, j in spans(offsets, CHUNK)]
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)] or [pa.array([], pa.int64())] * len(STATS)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], [*keys, *STATS])

    schema = docs.select(*keys).schema
    for name in STATS:
        schema = schema.add(name, "long")
    return small_batches(docs.select(*keys, text_col)).mapInArrow(run, schema)


def line_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from foliant.llm.words import mixed, powers

    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chi2_quantile(p: float, k: int) -> float:
    """Quantile of chi-squared with k degrees of freedom, by bisection on the series of the incomplete gamma function."""

    def below(x: float) -> float:
        a, term, total, n = k / 2, 1.0, 1.0, 0
        while term > 1e-16 * total:
            n += 1
            term *= x / 2 / (a + n)
            total += term
        return total * np.exp(a * log(x / 2) - x / 2 - lgamma(a + 1))

    lo, hi = 1e-9, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return lo


#: Grid units to one unit of a statistic, and of a product in a starting shape; buckets to a doubling of a squared distance.
GRID, FINE, OCTAVE = 256, 1 << 20, 32
#: Starting shapes, and groups whose estimates (720 bytes each) may be broadcast.
STARTS, FEW_GROUPS = 3, 20_000


def beside(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with a table of one row a group, which is broadcast only where a count shows that it is small."""
    return rows.join(F.broadcast(small) if small.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS else small, keys)


def placed(rows: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """(by, judge, teaches): the group whose estimate judges the rows of each value of `by`, and the groups whose estimates they are part of.

    A group is a value of the first columns of `by`, at first of all of them. One of fewer than `least` rows is judged by the next wider one, at last by all rows.
    """
    fine = cut(rows.groupBy(*by).agg(F.count("*").alias("n")), "groups")
    keys = [F.to_json(F.struct(F.lit(k).alias("wider"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by[: len(by) - k]))) for k in range(len(by) + 1)]
    out = fine.withColumns({f"key{k}": key for k, key in enumerate(keys)})
    for k in range(1, len(by) + 1):
        out = out.join(out.groupBy(f"key{k}").agg(F.sum("n").alias(f"n{k}")), f"key{k}")
    judge = F.col(f"key{len(by)}")
    for k in reversed(range(len(by))):
        judge = F.when((F.col("n") if k == 0 else F.col(f"n{k}")) >= least, F.col(f"key{k}")).otherwise(judge)
    out = cut(out.withColumn("judge", judge), "placed")
    used = out.select("judge").distinct()
    teaches = []
    for k in range(len(by) + 1):
        out = out.join(used.select(F.col("judge").alias(f"key{k}"), F.lit(True).alias(f"used{k}")), f"key{k}", "left")
        teaches.append(F.when(F.col(f"used{k}"), F.col(f"key{k}")))
    return out.select(*by, "judge", F.array_compact(F.array(*teaches)).alias("teaches"))


def distance(names: list[str], start: int = 0) -> Column:
    """Squared distance of a row from a group's centre; the group's columns hold `centre` and `inverse` (lower triangle) of each start in turn."""
    k = len(names)
    off = [F.col(d) - F.col("centre")[start * k + i] for i, d in enumerate(names)]
    at, terms = start * k * (k + 1) // 2, []
    for i in range(k):
        for j in range(i + 1):
            terms.append(off[i] * off[j] * F.col("inverse")[at] * F.lit(1.0 if i == j else 2.0))
            at += 1
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def lower(m: np.ndarray) -> list[float]:
    return m[np.tril_indices(len(m))].tolist()


def full(sums: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.tril_indices(k)] = sums
    return out + np.tril(out, -1).T


def starting_model(members: DataFrame, names: list[str], floor: np.ndarray) -> DataFrame:
    """(g, n, centre, inverse) with STARTS shapes around the medians: of the median deviations, of spatial signs and of bounded (tanh) deviations."""
    k = len(names)
    middle = cut(members.groupBy("g").agg(F.count("*").alias("n"), *(F.percentile(d, 0.5).alias(f"m{i}") for i, d in enumerate(names))), "medians")
    far = [F.abs(F.col(d) - F.col(f"m{i}")) for i, d in enumerate(names)]
    wide = beside(members, middle, ["g"]).groupBy("g").agg(*(F.percentile(x, 0.5).alias(f"d{i}") for i, x in enumerate(far)))
    middle = cut(middle.join(wide, "g"), "deviations")
    z = [(F.col(d) - F.col(f"m{i}")) / F.greatest(1.4826 * F.col(f"d{i}"), F.lit(float(floor[i]))) for i, d in enumerate(names)]
    scaled = beside(members, middle.select("g", *(f"{c}{i}" for c in "md" for i in range(k))), ["g"]).select("g", *(x.alias(f"z{i}") for i, x in enumerate(z)))
    norm = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, k)), F.col("z0") * F.col("z0")))
    scaled = scaled.withColumn("norm", F.greatest(norm, F.lit(1e-12)))
    ways = {"u": lambda i: F.col(f"z{i}") / F.col("norm"), "t": lambda i: F.tanh(f"z{i}")}
    sums = [F.sum(F.round(f(i) * f(j) * FINE).cast("long")).alias(f"{w}{i}_{j}") for w, f in ways.items() for i in range(k) for j in range(i + 1)]
    found = middle.join(scaled.groupBy("g").agg(*sums), "g")

    def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                centre = [r[f"m{i}"] for i in range(k)]
                scale = np.array([max(1.4826 * r[f"d{i}"], floor[i]) for i in range(k)])
                inverse = lower(np.diag(1 / scale**2))
                for w in ways:
                    shape = full(np.array([r[f"{w}{i}_{j}"] for i in range(k) for j in range(i + 1)], float), k) / FINE / r["n"]
                    shape += np.eye(k) * 0.01 * max(np.trace(shape) / k, 1e-6)
                    inverse += lower(np.linalg.inv(shape * np.outer(scale, scale)))
                out.append((r["g"], r["n"], centre * STARTS, inverse))
            yield pd.DataFrame(out, columns=["g", "n", "centre", "inverse"])

    return found.mapInPandas(shapes, "g string, n long, centre array<double>, inverse array<double>")


def mcd_model(members: DataFrame, names: list[str], floor: np.ndarray, share: float, steps: int) -> DataFrame:
    """(g, n, centre, inverse, det, start): of each group the estimate of least determinant, from whole-number columns `names` of members."""
    k = len(names)
    # Consistency of the covariance of the `share` most central rows of a normal distribution.
    scale = share / chi2_share(chi2_quantile(share, k), k + 2)
    now = cut(starting_model(members, names, floor), "start")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]

    def estimates(last: bool) -> Callable:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for r in pdf.to_dict("records"):
                    found = []
                    for s in range(STARTS):
                        h = r[f"h{s}"]
                        mean = np.array([r[f"m{s}_{i}"] for i in range(k)], float) / h
                        cov = full(np.array([r[f"s{s}_{i}_{j}"] for i, j in pairs], float) / h, k) - np.outer(mean, mean)
                        cov = cov * scale + np.diag(floor**2)
                        found.append((float(np.linalg.slogdet(cov)[1]), s, mean.tolist(), lower(np.linalg.inv(cov))))
                    if last:
                        found = [min(found)]
                    out.append((r["g"], r["n"], sum((f[2] for f in found), []), sum((f[3] for f in found), []), found[0][0], found[0][1]))
                yield pd.DataFrame(out, columns=["g", "n", "centre", "inverse", "det", "start"])

        return run

    bucket = [F.floor(F.log2(distance(names, s) + 1e-9) * OCTAVE).cast("int").alias(f"b{s}") for s in range(STARTS)]
    for step in range(steps):
        seen = beside(members, now.select("g", "n", "centre", "inverse"), ["g"]).select("g", "n", *names, *bucket)
        bins = seen.select("g", "n", F.posexplode(F.array(*(f"b{s}" for s in range(STARTS)))).alias("s", "b")).groupBy("g", "n", "s", "b").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("g", "s").orderBy("b"))
        limits = bins.withColumn("upto", upto).filter(F.col("upto") >= F.ceil(F.col("n") * share)).groupBy("g").agg(*(F.min(F.when(F.col("s") == s, F.col("b"))).alias(f"l{s}") for s in range(STARTS)))
        near = beside(seen, cut(limits, "limits"), ["g"])
        sums = []
        for s in range(STARTS):
            inside = F.col(f"b{s}") <= F.col(f"l{s}")
            sums.append(F.sum(inside.cast("long")).alias(f"h{s}"))
            sums += [F.sum(F.when(inside, F.col(d)).otherwise(0)).alias(f"m{s}_{i}") for i, d in enumerate(names)]
            sums += [F.sum(F.when(inside, F.col(names[i]) * F.col(names[j])).otherwise(0)).alias(f"s{s}_{i}_{j}") for i, j in pairs]
        now = cut(near.groupBy("g", "n").agg(*sums).mapInPandas(estimates(step == steps - 1), "g string, n long, centre array<double>, inverse array<double>, det double, start int"), "estimates")
    return now


def mcd_outliers(rows: DataFrame, by: Sequence[str], dims: dict[str, Column], floor: Sequence[float], quantile: float = 0.99999, share: float = 0.75, steps: int = 5) -> DataFrame:
    """All columns of rows, d2 (squared robust distance) and outlier (boolean), by minimum-covariance-determinant estimates of groups.

    From each of STARTS deterministic shapes around the medians, `steps` concentration steps over all rows keep the `share` of a group's rows with the
    smallest distances and take their mean and covariance; the estimate of least determinant is the group's, scaled for consistency. A
    row is an outlier if its distance is beyond the chi-squared quantile.

    A step is two aggregations by group, a histogram of the distances and the sums, so a group of any size is added up in parts, and no group's rows
    or estimates reach the driver. Statistics are taken as whole multiples of 1 / GRID, whose sums are exact: the estimates don't depend on the partitions.
    Medians keep a count for each distinct multiple, so dims should be bounded.

    by: columns from wide to narrow. A group of fewer than 5 rows for each dimension is judged by the estimate of the next wider one, at last by that of
    all rows; if these are too few, nothing is rejected. dims: transformed statistics without nulls. floor: a standard deviation of each that is added
    to the covariance, so that a statistic which is constant in most rows doesn't reject the others. Ties count as near. An empty table gives an empty result.
    """
    names, least = [f"_q{i}" for i in range(len(dims))], 5 * len(dims)
    wide = np.asarray(floor, float) * GRID
    grid = rows.withColumns({q: F.round(x * GRID).cast("long") for q, x in zip(names, dims.values(), strict=True)})
    known = beside(grid, cut(placed(grid, by, least), "judges"), list(by))
    members = cut(known.select(F.explode("teaches").alias("g"), *names), "members")
    model = mcd_model(members, names, wide, share, steps).select(F.col("g").alias("judge"), F.col("n").alias("_n"), "centre", "inverse")
    out = beside(known, model, ["judge"]).withColumn("d2", distance(names))
    return out.withColumn("outlier", (F.col("_n") >= least) & (F.col("d2") > F.lit(chi2_quantile(quantile, len(names))))).select(*rows.columns, "d2", "outlier")


def chi2_share(x: float, k: int) -> float:
    """Share of chi-squared with k degrees of freedom below x."""
    lo, hi = 1e-12, 1 - 1e-12
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_quantile(mid, k) < x else (lo, mid)
    return lo


def quality(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_words: int = 20, most_repeat: int = 30) -> DataFrame:
    """Base rules, then robust outliers for each language and source.

    A document fails the base rules with under `least_words` words or over `most_repeat` % of its words in repeated windows. The others are judged by
    the minimum-covariance-determinant estimate of their language and source (nulls form a group of their own), or of their language or all documents
    where these are few (see mcd_outliers()), on: log of the words, mean characters of a word (64 at most), root of symbols a word (16 at most), share of
    repeated lines, share of repeated words.

    Returns id_col, the STATS, base_failed, d2 (null if base_failed), outlier and kept, a row for each input row.
    Null and empty texts fail. Repeated rows count each. An empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit("")).alias("_lang"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_source"), F.col(text_col).alias("text"))
    stats = text_stats(keyed, ["id", "_lang", "_source"], "text")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    stats = cut(stats.withColumn("base_failed", failed), "stats")
    dims = {
        "_x0": F.log1p("n_words"),
        "_x1": F.least(F.col("word_chars") / F.col("n_words"), F.lit(64.0)),
        "_x2": F.least(F.sqrt(F.col("n_symbols") / F.col("n_words")), F.lit(16.0)),
        "_x3": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "_x4": F.col("n_repeat_words") / F.col("n_words"),
    }
    judged = mcd_outliers(stats.filter("NOT base_failed"), ["_lang", "_source"], dims, FLOOR)
    rest = stats.filter("base_failed").withColumns({"d2": F.lit(None).cast("double"), "outlier": F.lit(False)})
    out = judged.unionByName(rest)
    return out.select(F.col("id").alias(id_col), *STATS, "base_failed", "d2", "outlier", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"))


#: Standard deviations that clean text of any source may show: e-folds of length, characters, root of symbols a word, shares.
FLOOR = (0.9, 0.5, 0.12, 0.1, 0.1)
