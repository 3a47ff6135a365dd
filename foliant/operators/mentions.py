"""Names found in texts by automatons, and the edges that follow from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.plans.lineage import cut

#: Characters of names that one automaton holds (about 100 bytes of memory each in a Python worker).
NAMES = 2_000_000
#: Texts whose mentions a task holds before it gives them on; one text at a time is a Python string.
ROWS = 200
#: Names of a block at most, whose counts with another block's a task holds as a matrix (4 bytes a cell); mentions that are sent in a row; cells that are given on at once.
SIDE, SENT, CELLS = 8192, 250_000, 250_000


def names_found(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, least: int = 2, most: int = NAMES) -> DataFrame:
    """(key, columns of names, mentions): which names a text contains, in any case, and at how many places, overlaps counted.

    names: a column name and others, such as its type; names that differ in case alone are looked for once and all found. Names under `least` characters and
    null names are passed over; null texts contain nothing; repeated rows of names are one; texts that repeat a key are one text with all of their mentions.

    All names are looked for in one pass over a text, by an automaton that goes on from the longest name's beginning that still fits, so no text is joined
    with all names. Names reach the tasks as a broadcast of `most` characters at most: where there are more, they are dealt by hash into
    parts of about that many, with one pass over the texts for each.
    """
    rows = names.filter(F.char_length(name) >= least).distinct().withColumn("_said", F.lower(name))
    said = cut(rows.select("_said").distinct(), "names")
    total = said.agg(F.coalesce(F.sum(F.char_length("_said")), F.lit(0))).first()[0]
    # Parts are half full on average, so that one which hash puts more into stays within the bound.
    parts = 1 if total <= most else -(-2 * total // most)
    spark, found = texts.sparkSession, None
    for part in range(parts):
        mine = [r[0] for r in said.filter(F.pmod(F.xxhash64("_said"), F.lit(parts)) == part).orderBy("_said").collect()]
        if not mine and (found is not None or part + 1 < parts):
            continue
        hits = scanned(texts.select(F.col(key).alias("k"), F.lower(text).alias("text")), spark.sparkContext.broadcast(mine))
        found = hits if found is None else found.unionByName(hits)
    edges = found.groupBy("k", "said").agg(F.sum("n").alias("mentions"))
    out = edges.join(rows, F.col("said") == F.col("_said"))
    return out.select(F.col("k").alias(key), *(F.col(c) for c in names.columns), "mentions")


def scanned(texts: DataFrame, names: object) -> DataFrame:
    """(k, said, n) of (k, text) by the automaton of a broadcast list of names; each task builds it once and gives on what ROWS texts have, however large its batches are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, name in enumerate(names.value):
            automaton.add_word(name, i)
        automaton.make_automaton()
        said = pa.array(names.value, pa.string())
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows, which, count = [], [], []
            for row, text in enumerate(batch.column("text")):
                here: dict[int, int] = {}
                for _, i in automaton.iter(text.as_py()) if text.is_valid and names.value else ():
                    here[i] = here.get(i, 0) + 1
                rows += [row] * len(here)
                which += here.keys()
                count += here.values()
            found = [batch.column("k").take(pa.array(rows, pa.int64())), said.take(pa.array(which, pa.int64())), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(found, ["k", "said", "n"])
            pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, texts.select("k").schema.add("said", "string").add("n", "long"))


def numbered_mentions(texts: DataFrame, names: object, first: int) -> DataFrame:
    """(k, said) of (k, text): the numbers, rising, of the names in a text; names is a broadcast list of what to look for, the i-th with the number first + i. Texts without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, alike = ahocorasick.Automaton(), {}
        for i, name in enumerate(names.value):
            alike.setdefault(name, []).append(first + i)
        for name, numbers in alike.items():
            automaton.add_word(name, numbers)
        automaton.make_automaton()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows, said = [], []
            for row, text in enumerate(batch.column("text")):
                here = {i for _, numbers in automaton.iter(text.as_py()) for i in numbers} if text.is_valid and names.value else ()
                if here:
                    rows.append(row)
                    said.append(np.sort(np.fromiter(here, np.int32, len(here))))
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(rows, pa.int64())), pa.array(said, pa.list_(pa.int32()))], ["k", "said"])
            pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, texts.select("k").schema.add("said", T.ArrayType(T.IntegerType())))


def packed_gaps(keys: np.ndarray) -> bytes:
    """Rising numbers as their gaps, the lowest bytes of all first, so that the others, mostly 0, take little room in a shuffle."""
    gaps = np.diff(keys, prepend=0).astype("<u4")
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def unpacked_gaps(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], -1)
    gaps = np.zeros((planes.shape[1], 4), np.uint8)
    gaps[:, : packed[0]] = planes.T
    return np.cumsum(gaps.view("<u4")[:, 0], dtype=np.int64)


def name_pairs(texts: DataFrame, names: DataFrame, key: str, text: str, name: str, least: int = 2, most: int = NAMES, side: int = SIDE) -> DataFrame:
    """(a, b, weight), a < b: in how many texts two names are found, as names_found() finds them, without a row for each pair of each text.

    A text's names are a list of numbers. Names are dealt into blocks of `side` at most, and each pair of blocks is counted in one task's matrix: a name's mention is
    sent once to each block, in a byte or two, so what is shuffled grows with mentions times blocks; the pairs, by far more, are written only as the result, with
    the names that the task got with its blocks. A task holds a matrix and one row of lists at a time, however many texts there are.
    """
    spark = texts.sparkSession
    said = cut(names.filter(F.char_length(name) >= least).select(F.col(name).alias("name"), F.lower(name).alias("said")).distinct(), "names")
    total, chars = said.agg(F.count("*"), F.coalesce(F.sum(F.char_length("said")), F.lit(0))).first()
    parts = 1 if chars <= most else -(-2 * chars // most)
    first, found, listed = 0, None, None
    for part in range(parts):
        mine = said.filter(F.pmod(F.xxhash64("said"), F.lit(parts)) == part).orderBy("name").collect()
        if not mine and (found is not None or part + 1 < parts):
            continue
        hits = numbered_mentions(texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lower(text).alias("text")), spark.sparkContext.broadcast([r["said"] for r in mine]), first)
        here = cut(spark.createDataFrame([(first + i, r["name"]) for i, r in enumerate(mine)], "number int, name string"), "listed")
        found, listed = (hits, here) if found is None else (found.unionByName(hits), listed.unionByName(here))
        first += len(mine)
    found = cut(found, "mentions")
    if not found.groupBy("k").count().filter("count > 1").isEmpty():
        found = found.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("said")))).alias("said"))
    # So many blocks that no matrix is too large, and that each core has two pairs of them.
    blocks, cores = max(1, -(-total // side)), spark.sparkContext.defaultParallelism
    while blocks * (blocks + 1) < 4 * cores:
        blocks += 1
    size = -(-total // blocks) + 1
    pages = [(x, y) for x in range(blocks) for y in range(x, blocks)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("said")
            flat, count = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(count)), count)
            ends = np.cumsum(count)
            low = 0
            while low < len(count):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SENT, "right")))
                part = slice(ends[low - 1] if low else 0, ends[high - 1])
                at, keys = flat[part] % blocks, (row[part] - low) * size + flat[part] // blocks
                sides = [packed_gaps(keys[at == x]) for x in range(blocks)]
                for x in range(blocks):
                    mine = [(p, sides[x], sides[y] if y > x else None) for p, (z, y) in enumerate(pages) if z == x and len(sides[x]) > 1 and len(sides[y]) > 1]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in mine], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["page", "x", "y"])
                low = high

    def told(page: int, counts: np.ndarray, held: dict[int, str]) -> Iterator[pa.RecordBatch]:
        x, y = pages[page]
        one, two = (pa.array([held.get(i * blocks + z) for i in range(size)], pa.string()) for z in (x, y))
        step = max(1, CELLS // size)
        for low in range(0, size, step):
            part = counts[low : low + step]
            i, j = np.nonzero(part if x < y else np.triu(part, low + 1))
            p, q = one.take(pa.array(i + low)), two.take(pa.array(j))
            less = pc.less(p, q)
            yield pa.RecordBatch.from_arrays([pc.if_else(less, p, q), pc.if_else(less, q, p), pa.array(part[i, j].astype(np.int64))], ["a", "b", "weight"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, counts, held = None, None, {}
        for batch in batches:
            for now, number, said, packed_x, packed_y in zip(*(batch.column(c) for c in ("page", "number", "name", "x", "y")), strict=True):
                if now.as_py() != page:
                    if counts is not None:
                        yield from told(page, counts, held)
                    page, counts, held = now.as_py(), None, {}
                if number.is_valid:
                    held[number.as_py()] = said.as_py()
                    continue
                if counts is None:
                    counts = np.zeros((size, size), np.int32)
                cells = counts.reshape(-1)
                xs = unpacked_gaps(packed_x.as_py())
                ys = unpacked_gaps(packed_y.as_py()) if packed_y.is_valid else xs
                rows = np.intersect1d(xs // size, ys // size)
                ends = [np.searchsorted(z, np.stack([rows, rows + 1]) * size) for z in (xs, ys)]
                xs, ys = xs % size * size, ys % size
                for a, b, c, d in zip(*ends[0].tolist(), *ends[1].tolist(), strict=True):
                    # A text has a name once, so no cell comes twice.
                    cells[(xs[a:b, None] + ys[c:d]).reshape(-1)] += 1
        if counts is not None:
            yield from told(page, counts, held)

    sent = found.select("said").mapInArrow(send, "page int, x binary, y binary").select("page", F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("name"), "x", "y")
    none = F.lit(None).cast("binary")
    of = spark.createDataFrame([(p, z) for p, (x, y) in enumerate(pages) for z in {x, y}], "page int, block int")
    known = listed.withColumn("block", F.col("number") % blocks).join(F.broadcast(of), "block").select("page", "number", "name", none.alias("x"), none.alias("y"))
    return sent.unionByName(known).repartition(4 * len(pages), "page").sortWithinPartitions("page").mapInArrow(count, "a string, b string, weight long")


def chunk_graph(chunks: DataFrame, names: DataFrame, key: str, text: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(edges, pairs): EXTRACTED_FROM edges (key, name columns, mentions) of names to the chunks that contain them, and CO_OCCURS pairs (a, b, weight) of
    names with the number of chunks that they share. Rebuilt from the chunks, so reruns agree."""
    return names_found(chunks, names, key, text, name), name_pairs(chunks, names, key, text, name)
