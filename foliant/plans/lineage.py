"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder, but only if all run in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        shared_dir.own = at
    return at.rstrip("/")


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def tasks(table: DataFrame, rows: int = 1_000_000) -> int:
    """Partitions of a shuffle of a table, as it was read (counting it reads no columns): each gets about so many rows, however large the table is."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // rows))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out evenly if it has no more partitions than there are cores (splits of one row group are empty but for one); larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
