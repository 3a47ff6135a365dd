"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.lineage import cut, shared_dir, spread

__all__ = ["BROADCAST_IDS", "WORD", "cut", "fold_case", "give_back", "restrict", "shared_dir", "small_batches", "spans", "table", "text_bytes"]

#: Words of all contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Ids that a size-checked broadcast may hold (8 MB of longs).
BROADCAST_IDS = 1_000_000
#: Rows and bytes of an Arrow batch of texts: whichever is reached first ends it, so that only a longer text makes a larger batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer partitions than cores is dealt out first."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only. lower() is the same, and faster, where a text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def restrict(df: DataFrame, ids: DataFrame, keys: list[str], how: str = "left_semi", most: int = BROADCAST_IDS) -> DataFrame:
    """Semi or anti join; ids are broadcast only when a count shows that there are `most` of them at most."""
    small = ids.limit(most + 1).count() <= most
    return df.join(F.broadcast(ids) if small else ids, keys, how)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded by BATCH unless it chose bounds: texts are long, and a batch is held several times over.

    Spark reads these settings when a plan runs, so they stay set.
    """
    conf = df.sparkSession.conf
    for name, (default, ours) in BATCH.items():
        if conf.get(name) == default:
            conf.set(name, ours)
    return df


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows, without copies; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def spans(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges [i, j) of about `most` bytes each; a longer row stands alone."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out


def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; what Arrow's pool holds of batches gone by is given back, so that idle workers stay small."""
    for n, batch in enumerate(batches):
        yield batch
        if n % 8 == 7:
            pa.default_memory_pool().release_unused()
    pa.default_memory_pool().release_unused()
