"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import BROADCAST_IDS, cut, give_back, restrict, shared_dir, small_batches, spans, text_bytes

ENTRY = T.StructType([T.StructField("version", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
#: Bytes of text that are handed to the tokenizer at once.
BATCH_BYTES = 1 << 20
LOADED: dict[str, object] = {}


def tokenizer_version(tokenizer_file: str) -> str:
    """Digest of the tokenizer file and of the library's version: a change of either misses the cache."""
    import tokenizers

    with open(tokenizer_file, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def load(tokenizer_file: str) -> object:
    """The tokenizer, once for each Python worker, without truncation and padding."""
    if tokenizer_file not in LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_file)
        t.no_truncation()
        t.no_padding()
        LOADED[tokenizer_file] = t
    return LOADED[tokenizer_file]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's entries; none before the first append. Two runs that encoded the same text left two equal entries."""
    try:
        return spark.read.schema(ENTRY).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def count_tokens(docs: DataFrame, tokenizer_file: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text, from the cache where it has them, else encoded once for each distinct text and appended to it.

    A text's content digest is SHA-256 of the text that the tokenizer would get (null: empty); the cache key is that digest and
    tokenizer_version(). cache_path: a Parquet folder that all executors share; by default a new one in the shared folder, so that nothing is found and
    whoever clears that folder clears it.

    Of each missing digest one row is encoded, that of the smallest row key; digests are grouped before any text moves, so a text that
    a third of all rows share is encoded once. Rows that another row stands for are taken out by an anti join, broadcast only
    when they are few enough; otherwise texts are dealt out by row key, which no text's copies can skew.

    Returns id_col, digest (binary), n_bytes (UTF-8), n_tokens and cached (boolean), a row for each input row. Null and empty texts have the
    tokenizer's count for empty text. Null ids and repeated ids are kept as they are. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = cache_path or f"{shared_dir(spark)}/foliant/token-cache-{uuid.uuid4().hex}"
    version = tokenizer_version(tokenizer_file)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = cut(docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    cache = read_cache(spark, path).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    cache = cut(cache, "cache")
    # A row key that needs no order: the id, or the digest's head where the id is null.
    missing = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).join(cache, "digest", "left_anti")
    missing = cut(missing, "missing")
    others = rows.join(missing.filter("n > 1").select("digest", "first"), "digest").filter("id <> first").select("id", "digest")
    found = rows.join(cache, "digest", "left_semi").select("id", "digest")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest.alias("digest"))
    todo = restrict(texts, cut(others.unionByName(found).distinct(), "others"), ["id", "digest"], "left_anti", BROADCAST_IDS // 4)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(tokenizer_file)
        for batch in give_back(batches):
            digests, column = batch.column("digest"), batch.column("text")
            counts: list[int] = []
            for i, j in spans(text_bytes(column)[1], BATCH_BYTES):
                counts += [len(e.ids) for e in t.encode_batch_fast(column.slice(i, j - i).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), digests.cast(pa.binary()), pa.array(counts, pa.int64())], ["version", "digest", "n_tokens"])

    # A repeated row (or null ids) may be encoded twice; the counts agree.
    small_batches(todo.select("digest", "text")).mapInArrow(encode, ENTRY).write.mode("append").parquet(path)
    new = read_cache(spark, path).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = cache.select("digest", F.lit(True).alias("cached"))
    counts = new.join(known, "digest", "left").select("digest", "n_tokens", F.coalesce("cached", F.lit(False)).alias("cached"))
    return rows.join(counts, "digest").select(F.col("id").alias(id_col), "digest", "n_bytes", "n_tokens", "cached")
