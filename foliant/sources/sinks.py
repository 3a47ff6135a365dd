"""Exports (K5, K7-K9, K11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.filters import missing_as, privilege_text


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with headers, nulls as ''; one file for each partition, in a folder."""
    flat = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
    flat.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("emptyValue", "").csv(path)


def append_audit(df: DataFrame, path: str) -> None:
    """The audit trail is appended to, never rewritten."""
    df.write.mode("append").parquet(path)


def write_points(points: DataFrame, path: str, scope: str = "matter_id") -> None:
    """Vectors by tenant, so that a scoped search reads one folder; sorted by document for tight statistics."""
    points.repartition(scope, "doc_id").sortWithinPartitions(scope, "doc_id").write.mode("overwrite").partitionBy(scope).parquet(path)


def privilege_log(docs: DataFrame) -> DataFrame:
    """Rows of a privilege log from documents (doc_id, bates_begin, bates_end, document_date, author, sender, recipients, document_type, privilege_status, basis)."""
    ends = F.when(F.col("bates_begin") == F.col("bates_end"), F.col("bates_begin")).otherwise(F.concat_ws(" - ", "bates_begin", "bates_end"))
    shown = docs.filter(F.col("privilege_status").isin("privileged", "work_product"))
    return shown.select(
        F.coalesce(ends, F.lit("")).alias("bates_range"), F.coalesce(F.date_format("document_date", "yyyy-MM-dd"), F.lit("")).alias("date"), missing_as(F.col("author"), F.col("sender")).alias("author"), F.array_join(F.coalesce("recipients", F.array()), "; ").alias("recipients"),
        F.coalesce("document_type", F.lit("")).alias("type"), privilege_text(F.col("privilege_status")).alias("privilege"), F.coalesce("basis", F.lit("")).alias("basis"), "doc_id",
    )


def court_package(citations: DataFrame, log: DataFrame, path: str, as_of: str) -> None:
    """citation_index, privilege_log and manifest under one folder; the manifest counts both."""
    write_csv(citations, f"{path}/citation_index")
    write_csv(log, f"{path}/privilege_log")
    counts = citations.agg(F.count("*").alias("citations")).join(log.agg(F.count("*").alias("privileged")))
    counts.select("citations", "privileged", F.lit(as_of).alias("generated_at")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_edrm(docs: DataFrame, path: str, tags: Sequence[str]) -> None:
    """EDRM XML: a Document element for each row of (doc_id, filename, path, mime_type), tags as Tag elements."""
    tag = F.array(*(F.struct(F.lit(t).alias("_TagName"), F.col(t).cast("string").alias("_TagValue")) for t in tags))
    file = F.array(F.struct(F.col("filename").alias("_FileName"), F.col("path").alias("_FilePath")))
    rows = docs.select(F.col("doc_id").alias("_DocID"), F.col("mime_type").alias("_MimeType"), F.struct(file.alias("File")).alias("Files"), F.struct(tag.alias("Tag")).alias("Tags"))
    rows.write.mode("overwrite").format("xml").option("rowTag", "Document").option("rootTag", "Documents").save(path)
