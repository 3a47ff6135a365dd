"""The registered queries op1_ to op13_ and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import sql
from foliant.llm.byte_repeats import byte_repeats
from foliant.llm.common import WORD, cut, table
from foliant.llm.exact_dedup import exact_dedup
from foliant.llm.html_text import extract
from foliant.llm.language_id import held_out, predict, train
from foliant.llm.license_scan import license_scan
from foliant.llm.mixing import mix, word_count
from foliant.llm.ngram_join import ngram_components
from foliant.llm.periodic_runs import periodic_runs
from foliant.llm.piece_bpe import encode_digests
from foliant.llm.prefix_trie import ordered_turns, prefix_trie, regrown
from foliant.llm.quality import quality
from foliant.llm.sharding import shard
from foliant.llm.token_cache import count_tokens


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: classes of documents by Jaccard similarity of 5-word tokens."""
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents, mixed to targets by source."""
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, F.array("source"), word_count(F.col("text")))
    own = F.col("targets")[0]
    return mixed.select("doc_id", "size", own["source_size"].alias("source_size"), own["target"].alias("target"), F.col("taken").cast("long").alias("taken"), own["source"].alias("source"), "times")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: license texts and notices in all documents."""
    return license_scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: tokens of every text, over 1024 flagged. The cache is new for each run, so every distinct text is encoded."""
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: languages learned from the rows that are not held out, predicted for all."""
    docs = table(spark, sf_dir, "documents")
    profiles = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).drop("text")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: groups of texts equal but for the case of A-Z; the largest doc_id stays."""
    out = exact_dedup(table(spark, sf_dir, "documents"), keep="max")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: ids and decoded text of every document, as digests."""
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: base rules, then robust outliers by language and source."""
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: 40 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    out = shard(docs, F.octet_length(text).cast("long") + 16, extra={"text_crc32": F.crc32(text)})
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def made_periodic(text: Column, doc_id: Column) -> Column:
    """The text whose words repeat from some word on, for the tenth of all ids that op11's contract names; other texts as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def one(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        root = F.slice(words, a + 1, p)
        tail = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), 1, n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(F.lit(""))

    # The words are bound to a lambda's variable, so that they are cut out once.
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"))
    return F.when(h % 10 == 0, F.transform(F.array(words), one)[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: maximal runs of words, the longest of each document, and digests of all runs and of the text without repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    out = periodic_runs(docs, ["doc_id"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return out.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: documents without the bytes of 400-byte strings that start in two places or more."""
    out = byte_repeats(table(spark, sf_dir, "documents"), length=400)
    taken = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    return out.select("doc_id", "n_bytes", taken.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the trie of all conversations, of which the first turns come from the conversation that starts their twenty."""
    conv = F.col("conv")
    turns = cut(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "ordered")
    return prefix_trie(regrown(turns, conv - conv % 20, F.crc32(conv.cast("string")) % 4)).drop("node")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_source_mix": op2_source_mix,
    "op3_license_scan": op3_license_scan,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_piece_bpe": op7_piece_bpe,
    "op8_html_text": op8_html_text,
    "op9_quality": op9_quality,
    "op10_ring_sharding": op10_ring_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_repeats": op12_byte_repeats,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op11_periodic_runs": sql.PERIODIC_RUNS,
    "op12_byte_repeats": sql.BYTE_REPEATS,
    "op13_prefix_trie": sql.PREFIX_TRIE,
    "op6_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
}
