"""Documents to training ids: language, exact copies, near copies, source mix, piece ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of documents, but for
the last, which returns ids. run() writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import cut, table
from foliant.llm.exact_dedup import drop_copies
from foliant.llm.language_id import predict, train
from foliant.llm.mixing import mixed_rows, word_count
from foliant.llm.ngram_join import drop_near_copies
from foliant.llm.piece_bpe import encode


#: Scores are counted in so many bins, so that a quantile of them is exact to a bin and doesn't depend on the order of rows.
BINS = 1 << 16


def limits(own: DataFrame) -> dict[str, float]:
    """For each language, the score under which a document predicted as it goes, from (label, lang_pred, score) of the labelled rows.

    Half of the 0.001 quantile of the scores of its n rows that are predicted right, less 1 / sqrt(n), 0 at least: the fewer rows show how low a clean
    document's score can be, the further the limit stays below what they show, for any n alike. One row for each language reaches the driver.
    """
    bins = own.filter("label = lang_pred").groupBy("label", F.floor(F.col("score") * BINS).alias("bin")).agg(F.count("*").alias("c"))
    by = Window.partitionBy("label")
    counted = bins.select("label", "bin", F.sum("c").over(by).alias("n"), F.sum("c").over(by.orderBy("bin")).alias("upto"))
    low = counted.filter(1000 * F.col("upto") > F.col("n")).groupBy("label").agg(F.min("bin").alias("bin"), F.first("n").alias("n"))
    return {r.label: max(0.0, r.bin / BINS / 2 - r.n**-0.5) for r in low.collect()}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that labelled documents show; those without a letter, or without text, go, as do those that score under limits().

    Where no row has a language, only those without a letter go. Null text goes. Repeated rows are judged alike and all stay or go; rows whose scores tie
    with the limit stay. An empty table gives an empty result. Columns of any name pass through. Each text is predicted once.
    """
    profiles = train(docs)
    if not profiles.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # Under other names, so that no column clashes with the prediction's.
    held = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    found = predict(docs.select(*(F.col(c).alias(h) for c, h in held.items())), profiles, held["text"]).filter("lang_pred <> 'und'")
    found = cut(found, "predicted")
    lowest = {k: v for k, v in limits(found.select(F.col(held["lang"]).alias("label"), "lang_pred", "score")).items() if v > 0}
    if lowest:
        limit = F.create_map(*(F.lit(x) for pair in lowest.items() for x in pair))[F.col("lang_pred")]
        found = found.filter(F.col("score") >= F.coalesce(limit, F.lit(0.0)))
    return found.select(*(F.col(h).alias(c) for c, h in held.items()))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts equal but for the case of A-Z.

    Null text counts as empty text. Null ids stay only if all of their group are null; of repeated rows one stays. Empty in, empty out.
    """
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class linked by a 5-word Jaccard similarity of 0.8 or more.

    Texts without words, and rows without an id, link with nothing and stay. Rows that repeat the smallest id all stay. Empty in, empty out.
    """
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 1, 2, 3, repeating, in all as many words as there are.

    A null source is one of its own, the last. Rows that repeat an id are taken alike. Empty in, empty out.
    """
    return mixed_rows(docs, F.array("source"), word_count(F.col("text")))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and whether the ids decode to the text, for each row. Null text gives no ids and decodes to the empty text."""
    import public_tokenizers

    out = encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", piece_ids),
]

#: SQL expresses neither the language model nor the piece encoding; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each stage's rows are written to the shared folder, so a lost executor costs one stage at most.

    Null, empty and very long texts, ties, repeated rows and extra columns are treated as each stage says; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.split(" ")[0].lower())
    return docs
