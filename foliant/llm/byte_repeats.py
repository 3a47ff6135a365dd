"""Repeated substrings of bytes, by refining buckets of a sparse suffix array until they are as deep as the length asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_IDS, cut, give_back, small_batches, text_bytes
from foliant.llm.words import mixed, powers

#: Bytes of text whose buckets a Python worker computes at once, whatever the texts' lengths.
PIECE = 1 << 17
#: Low bits of an anchor's key, which hold its place within a piece.
PLACE = np.uint64((1 << 18) - 1)


@dataclass(frozen=True)
class Shape:
    """Windows of `length` bytes. One of them holds `reach` grams of `gram` bytes; a node's windows fall into `cells` cells of `width` places."""

    length: int
    cells: int
    width: int

    @classmethod
    def of(cls, length: int) -> Shape:
        if not 1 < length < PIECE:
            raise ValueError(f"length must be over 1 and under {PIECE}")
        cells = min(16, length // 2)
        return cls(length, cells, max(1, length * 76 // 100 // cells))

    @property
    def reach(self) -> int:
        return self.cells * self.width

    @property
    def gram(self) -> int:
        return self.length - self.reach + 1


class Buckets:
    """Bucket identifiers of the suffixes of a piece of bytes: first those of their grams, then of longer prefixes by the grams at later offsets."""

    def __init__(self, part: np.ndarray, gram: int) -> None:
        n, self.gram = len(part), gram
        up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[:n], out=self.total[1:])

    def every(self) -> np.ndarray:
        n = len(self.total) - self.gram
        return mixed((self.total[self.gram :] - self.total[:n]) * self.down[:n])

    def grams(self, at: np.ndarray) -> np.ndarray:
        return mixed((self.total[at + self.gram] - self.total[at]) * self.down[at])

    def refined(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Identifiers of [start, end), of a gram at least: the bucket of the first gram, refined by those at each gram's length further on, the last one at the end."""
        out, at, last = self.grams(start), start, end - self.gram
        while (more := at < last).any():
            at = np.minimum(at + self.gram, last)
            out = np.where(more, mixed(out * np.uint64(0x9E3779B97F4A7C15) + self.grams(at)), out)
        return out


def least(key: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` entries in a row."""
    n = len(key) - size + 1
    blocks = np.full((-(-len(key) // size), size), np.iinfo(np.uint64).max, np.uint64)
    blocks.reshape(-1)[: len(key)] = key
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


Rows = tuple[np.ndarray, ...]


def anchored(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> Iterator[Rows]:
    """(text, p, a, b, core, whole): the windows that start from a to b in a text and have their least gram at p, with the bucket of that gram and of all
    bytes [a, b + length).

    Equal windows have the same least gram at the same place, so they lie in one bucket of grams.
    """
    for low in range(int(offsets[0]), int(offsets[-1]), PIECE):
        part = data[low : min(low + PIECE + shape.length - 1, int(offsets[-1]))]
        n = len(part) - shape.length + 1
        if n <= 0:
            continue
        buckets = Buckets(part, shape.gram)
        first = buckets.every()
        place = np.arange(len(first), dtype=np.uint64)
        anchor = (least((first & ~PLACE) | place, shape.reach) & PLACE).astype(np.int64)
        edge = np.zeros(n + 1, np.int64)
        i, j = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, low + n, "left")
        begin, end = np.maximum(offsets[i:j] - low, 0), np.minimum(offsets[i + 1 : j + 1] - low - shape.length + 1, n)
        np.add.at(edge, begin[begin < end], 1)
        np.add.at(edge, end[begin < end], -1)
        inside = np.cumsum(edge)[:n] > 0
        change = np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]))
        a = np.flatnonzero(change)
        b = np.append(a[1:], n) - 1
        a, b = a[inside[a]], b[inside[a]]
        if not len(a):
            continue
        p = anchor[a]
        row = np.searchsorted(offsets, a + low, "right") - 1
        whole = mixed(buckets.refined(a, b + shape.length) + spread(p - a, p - b))
        back = low - offsets[row]
        yield row, p + back, a + back, b + back, first[p], whole


def spread(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + y.astype(np.uint64) * np.uint64(0x94D049BB133111EB)


def pieces(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, nodes: Rows, shape: Shape) -> Iterator[tuple[Buckets, np.ndarray, Rows, int]]:
    """(buckets, text, nodes with places in the piece, first byte) of each piece of the texts that has nodes (p, a, b), given by their text."""
    shift = offsets[row]
    p, a, b = (x + shift for x in nodes)
    which = (a - offsets[0]) // PIECE
    order = np.argsort(which, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(which[order]) != 0)) if len(order) else []
    for i, j in zip(bounds, [*bounds[1:], len(order)], strict=True):
        at = order[i:j]
        low = int(offsets[0] + which[at[0]] * PIECE)
        part = data[low : min(low + PIECE + shape.reach + shape.length, int(offsets[-1]))]
        yield Buckets(part, shape.gram), row[at], (p[at] - low, a[at] - low, b[at] - low), low


def split(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, nodes: Rows, shape: Shape) -> Iterator[Rows]:
    """anchored()'s rows for the cells of nodes; a cell's core is what all of its windows have in common, whether or not the node has all of them."""
    for buckets, text, (p, a, b), low in pieces(data, offsets, row, nodes, shape):
        for k in range(shape.cells):
            high = p - k * shape.width
            x, y = np.maximum(high - shape.width + 1, a), np.minimum(high, b)
            some = np.flatnonzero(x <= y)
            if len(some):
                x, y, high, at, t = x[some], y[some], high[some], p[some], text[some]
                core = mixed(buckets.refined(high, high - shape.width + 1 + shape.length) + np.uint64(k + 1))
                whole = mixed(buckets.refined(x, y + shape.length) + spread(at - x, at - y))
                back = low - offsets[t]
                yield t, at + back, x + back, y + back, core, whole


def single(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, nodes: Rows, shape: Shape) -> Iterator[Rows]:
    """anchored()'s rows for each window of nodes."""
    for buckets, text, (p, a, b), low in pieces(data, offsets, row, nodes, shape):
        size = b - a + 1
        at = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        text, p = np.repeat(text, size), np.repeat(p, size)
        code = buckets.refined(at, at + shape.length)
        back = low - offsets[text]
        yield text, p + back, at + back, at + back, buckets.grams(p), code


NODE = "k1 long, k2 long, p int, a int, b int, core long, whole long"


def node_rows(docs: DataFrame, work: Callable[..., Iterator[Rows]], shape: Shape) -> DataFrame:
    """NODE rows of (k1, k2, text) by anchored(), or of (k1, k2, text, p, a, b), where p, a and b are lists of nodes, by split() or single()."""
    names = [c.split(" ")[0] for c in NODE.split(", ")]
    listed = "p" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(batches):
            data, offsets = text_bytes(batch.column("text"))
            more = ()
            if listed:
                nodes = tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in "pab")
                sizes = batch.column("p").value_lengths().to_numpy(zero_copy_only=False)
                more = (np.repeat(np.arange(len(sizes)), sizes), nodes)
            keys = [batch.column(c).to_numpy() for c in ("k1", "k2")]
            for row, p, a, b, core, whole in work(data, offsets, *more, shape):
                columns = [pa.array(k[row]) for k in keys] + [pa.array(x.astype(np.int32)) for x in (p, a, b)] + [pa.array(x.view(np.int64)) for x in (core, whole)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return small_batches(docs).mapInArrow(run, NODE)


def settle(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(found, open): nodes of rows whose bytes occur elsewhere, as (k1, k2, a, b), and nodes to be split, as (k1, k2, p, a, b).

    A core's bucket of one is final: none of the node's windows repeats, nor do others need it. Where all bytes of a node repeat, all of its windows do; the
    first of such equal nodes stays open, for nodes that share a part of it. Joins by identifiers shuffle at every size, and AQE splits their hot keys.
    """
    rows = cut(rows, name)
    several = cut(rows.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select("core"), f"{name}-cores")
    rows = cut(rows.join(several, "core", "left_semi"), f"{name}-kept")
    place = F.struct("k1", "k2", "p", "a")
    same = cut(rows.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"), f"{name}-same")
    told = rows.join(same, ["core", "whole"], "left")
    found = told.filter(F.col("first").isNotNull()).select("k1", "k2", "a", "b")
    return found, told.filter(F.col("first").isNull() | (F.col("first") == place)).select("k1", "k2", "p", "a", "b")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2), k1 and k2 being two hashes of the text; null is the empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def opened(docs: DataFrame, nodes: DataFrame, copies: DataFrame) -> DataFrame:
    """(k1, k2, text, p, a, b) with the lists of nodes of each text that has some, one row for a text with copies."""
    lists = nodes.distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("p", "a", "b"))).alias("n"))
    lists = lists.join(copies.select("k1", "k2", F.col("id").alias("only"), F.lit(True).alias("many")), ["k1", "k2"], "left")
    lists = cut(lists.select("k1", "k2", *(F.col(f"n.{c}").alias(c) for c in "pab"), "only", F.coalesce("many", F.lit(False)).alias("many")), "lists")
    found = joined(docs, lists, F.size("p"), "inner")
    return found.filter(~F.col("many") | F.col("id").eqNullSafe(F.col("only"))).select("k1", "k2", "text", "p", "a", "b")


def joined(docs: DataFrame, lists: DataFrame, entries: Column, how: str) -> DataFrame:
    """docs with lists by (k1, k2); lists are broadcast only when counts show that they and their entries are few, so that texts needn't be shuffled."""
    n, total = lists.agg(F.count("*"), F.coalesce(F.sum(entries), F.lit(0))).first()
    small = n <= BROADCAST_IDS // 4 and total <= BROADCAST_IDS
    return docs.join(F.broadcast(lists) if small else lists, ["k1", "k2"], how)


def merged(spans: DataFrame) -> DataFrame:
    """(k1, k2, starts, ends): the spans (k1, k2, start, end) of each text in order, those that overlap or touch as one."""
    order = Window.partitionBy("k1", "k2").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.distinct().withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int"))
    runs = new.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("k1", "k2", "run").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("s"))
    lists = runs.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return lists.select("k1", "k2", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))


def byte_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """What is left of each text, as UTF-8 bytes, without the bytes covered by a string of `length` bytes that also starts anywhere else.

    Elsewhere is another place of the same text or of any other; strings don't cross texts, overlaps count, and all is judged on the input.
    Returns id_col, n_bytes (long), starts and ends (arrays of int: the removed spans, maximal and in order) and kept (binary), a row for each input row.
    Null text counts as empty. Rows with equal texts are copies of each other, whether their ids are equal, null or not. Ties don't arise. Other columns
    are not read; an empty table gives an empty result. Equality is that of 64-bit identifiers, twice: of the least gram and of a node's bytes.

    Bucket refinement of a sparse suffix array:

    1. Every window of `length` bytes belongs to the suffix that starts at its least gram (by a hash; the leftmost). These anchors, about one in 150
       bytes, are put into buckets by their gram. A bucket of one is done, and so are all windows of its anchor.
    2. An anchor's windows are a range of starts, a node. A node's identifier is refined by the identifiers of grams at later offsets; nodes with
       equal bytes are settled at once, and only the first of them is looked at further, so that groups of copies cost nothing more.
    3. What is left is split into cells of windows, whose common core is a bucket that is refined in the same way, then into single windows.

    Only nodes' identifiers are shuffled, and counted with partial aggregation, so a bucket may hold any share of all rows. Texts are read again for
    each of the three levels, and shuffled only if the lists of their nodes are too many to broadcast. Texts with copies are removed whole.
    """
    shape = Shape.of(length)
    docs = keyed(docs, id_col, text_col)
    size = F.octet_length("text").cast("int")
    copies = docs.filter(size >= length).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.max(size).alias("size")).filter("n > 1")
    copies = cut(copies, "copies")
    found, left = settle(node_rows(docs.select("k1", "k2", "text"), anchored, shape), "grams")
    spans = [found]
    found, left = settle(node_rows(opened(docs, left, copies), split, shape), "cells")
    spans.append(found)
    ones = cut(node_rows(opened(docs, left, copies), single, shape).select("k1", "k2", "a", "b", "core", "whole"), "windows")
    several = cut(ones.groupBy("core", "whole").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "windows-cores")
    spans.append(ones.join(several, ["core", "whole"], "left_semi").select("k1", "k2", "a", "b"))
    every = spans[0].unionByName(spans[1]).unionByName(spans[2]).select("k1", "k2", F.col("a").alias("start"), (F.col("b") + length).alias("end"))
    lists = merged(every.join(copies.select("k1", "k2"), ["k1", "k2"], "left_anti"))
    lists = cut(lists.unionByName(copies.select("k1", "k2", F.array(F.lit(0)).alias("starts"), F.array("size").alias("ends"))), "removed")
    return removed(joined(docs, lists, F.size("starts"), "left").select("id", "text", "starts", "ends"), id_col)


def removed(docs: DataFrame, id_col: str) -> DataFrame:
    """byte_repeats()'s result from (id, text, starts, ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(batches):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends = (batch.column(c).fill_null([]) for c in ("starts", "ends"))
            row = np.repeat(np.arange(len(offsets) - 1), starts.value_lengths().to_numpy(zero_copy_only=False))
            begin, end = (x.flatten().to_numpy(zero_copy_only=False) + offsets[row] for x in (starts, ends))
            kept = []
            for i in range(len(offsets) - 1):
                a, b = np.searchsorted(row, [i, i + 1])
                at = [int(offsets[i]), *end[a:b].tolist()]
                to = [*begin[a:b].tolist(), int(offsets[i + 1])]
                kept.append(b"".join(data[x:y].tobytes() for x, y in zip(at, to, strict=True)))
            size = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, starts, ends, pa.array(kept, pa.binary())], ["id", "n_bytes", "starts", "ends", "kept"])

    schema = docs.select("id").schema.add("n_bytes", "long").add(docs.schema["starts"]).add(docs.schema["ends"]).add("kept", "binary")
    return small_batches(docs).mapInArrow(run, schema).withColumnRenamed("id", id_col)
