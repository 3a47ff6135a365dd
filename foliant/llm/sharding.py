"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import cut

#: Ring positions that loads are added up for; with 64 size classes the driver sees 64 * CELLS sums at most, whatever the input.
CELLS = 4096
#: Rows of at least full >> k bytes are placed before smaller ones.
TIERS = (3, 4, 5, 6, 8, 10, 12, 14)


def owners(shards: int, vnodes: int) -> list[list[int]]:
    """For each cell of the ring, all shards in the order in which a clockwise walk from it first meets them."""
    ring = sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(vnodes))
    points, out = [p for p, _ in ring], []
    for cell in range(CELLS):
        i, seen = bisect_left(points, (cell << 64) // CELLS), {}
        for k in range(len(ring)):
            seen.setdefault(ring[(i + k) % len(ring)][1])
            if len(seen) == shards:
                break
        out.append(list(seen))
    return out


def fill(cells: list[tuple[int, int, int]], walk: list[list[int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(size class, cell, from, to, shard): which bytes of a cell go where; room: what each shard can still take, is used up.

    Cells come in order of falling size class, so that small rows fill what large ones leave; what a full shard can't take
    continues clockwise. What finds no room at all goes to the first shard of its walk.
    """
    out = []
    for rank, cell, w in sorted(cells, key=lambda c: (-c[0], c[1])):
        done = 0
        # The row at a part's end may reach over it by half its size, less than `over`; room for that is kept at first.
        for over in (1 << rank >> 1, 0):
            for s in walk[cell]:
                if done < w and (take := min(room[s] - over, w - done)) > 0:
                    room[s] -= take
                    out.append((rank, cell, done, done + take, s))
                    done += take
        if done < w:
            room[walk[cell][0]] -= w - done
            out.append((rank, cell, done, w, walk[cell][0]))
    return out


def shard(docs: DataFrame, size: Column, id_col: str = "doc_id", shards: int = 40, vnodes: int = 128, slack: float = 0.0, extra: dict[str, Column] | None = None) -> DataFrame:
    """Shards of near equal size: a hash of the id gives a row's place on a ring, the next virtual node clockwise its shard, and
    rows that a full shard can't take continue clockwise.

    The work on single rows is Spark's: sizes are added up by size class (powers of 2) and ring cell, the walk is done on those
    sums, whose number doesn't grow with the input, and rows find their part of a cell by a running sum within it.
    A part ends at the row whose middle is nearest, so a tier's loads differ from its plan by half a row at each end; the tier of
    smaller rows that comes next makes up for it. With slack 0 a shard is full at the mean load.

    size: bytes, positive (null: 1). extra: more columns to compute and return.
    Returns id_col, size, shard (int), slot (long; gapless from 0 in each shard) and the extra columns, a row for each input row.
    Rows that repeat an id share a ring place, ordered by their size and extra columns. Null ids hash as one id. An empty table
    gives an empty result. Reruns agree.
    """
    extra = extra or {}
    spot = F.xxhash64(F.lit("ring"), F.col(id_col))
    rows = docs.select(F.col(id_col), F.coalesce(size, F.lit(1)).cast("long").alias("size"), *(c.alias(k) for k, c in extra.items()), spot.alias("_spot"))
    rows = rows.withColumns({"_class": F.length(F.bin("size")), "_cell": F.shiftrightunsigned("_spot", 52).cast("int")})
    rows = cut(rows, "sizes")
    sums = [tuple(r) for r in rows.groupBy("_class", "_cell").agg(F.sum("size").alias("w")).collect()]
    total, walk, spark = sum(w for _, _, w in sums), owners(shards, vnodes), docs.sparkSession
    full = int(total * (1 + slack)) // shards + 1
    order = [F.col("_spot"), F.col(id_col), F.col("size"), *(F.col(k) for k in extra)]
    cell = Window.partitionBy("_class", "_cell").orderBy(*order)
    ends = F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, 0))
    # Tiers by size; each starts from the loads that the rows of the tiers before really gave.
    tiers = sorted({max(1, full >> k).bit_length() for k in TIERS} | {0}, reverse=True)
    room, placed, above = [full] * shards, [], 1 << 30
    for least in tiers:
        some = [c for c in sums if least <= c[0] < above]
        here, above = F.col("_class").between(least, above - 1), least
        if not some and (placed or least):
            continue
        parts = spark.createDataFrame(fill(some, walk, list(room)), "_class int, _cell int, _from long, _to long, shard int")
        mid = rows.filter(here).withColumn("_mid", ends - F.floor(F.col("size") / 2) - 1)
        on = [mid[c] == parts[c] for c in ("_class", "_cell")] + [mid["_mid"] >= parts["_from"], mid["_mid"] < parts["_to"]]
        placed.append(cut(mid.join(F.broadcast(parts), on).select(mid["*"], parts["shard"], parts["_from"]), "placed"))
        for s, w in placed[-1].groupBy("shard").agg(F.sum("size")).collect():
            room[s] -= w
    placed = reduce(DataFrame.unionByName, placed)
    # Slots: a row's number in its part of a cell, after the counts of the parts before it; there are as few of these as of parts.
    counts = placed.groupBy("shard", "_class", "_cell", "_from").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_class", "_cell", "_from")) - F.col("n")
    counts = counts.withColumn("_before", before).drop("n")
    part = Window.partitionBy("shard", "_class", "_cell", "_from").orderBy(*order)
    slots = placed.withColumn("_nth", F.row_number().over(part) - 1).join(F.broadcast(counts), ["shard", "_class", "_cell", "_from"])
    return slots.select(id_col, "size", "shard", (F.col("_nth") + F.col("_before")).alias("slot"), *extra)
