"""Readers of load files and corpora (S1-S21); each gives documents as doc_id, filename, text and a metadata map where it can."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import clean_control, content_hash, strip_tags
from foliant.operators.rows import first_by

# Parsers by file extension.
ROUTES = {
    "layout": ["pdf", "docx", "xlsx", "pptx", "html", "htm", "png", "jpg", "jpeg", "tiff", "tif"],
    "eml": ["eml"],
    "msg": ["msg"],
    "csv": ["csv", "tsv"],
    "rtf": ["rtf"],
    "plaintext": ["txt"],
    "unsupported": ["doc"],
    "zip_extract": ["zip"],
}
# Concordance delimiters.
DAT_FIELD, DAT_QUOTE = "\x14", "\xfe"
DAT_IDS = ["DOCID", "DocID", "doc_id", "ID", "BEGDOC"]
OPT_FIELDS = ["page_id", "volume", "path", "document_break", "folder_break", "page_count"]

DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "filename", "text", "content_hash", "source", "doc_type")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def parser_of(name: Column) -> Column:
    """The parser of a file name; null for unknown extensions."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    out = None
    for parser, exts in ROUTES.items():
        out = F.when(ext.isin(*exts), parser) if out is None else out.when(ext.isin(*exts), parser)
    return out


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder with their bytes and parser; a listing of one partition set, nothing is read before it is selected."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.withColumn("parser", parser_of(F.col("path")))


def as_documents(df: DataFrame, doc_id: Column, filename: Column, text: Column, source: str, doc_type: Column, metadata: Column | None = None) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    return df.select(
        doc_id.cast("string").alias("doc_id"), filename.alias("filename"), text.alias("text"), content_hash(F.coalesce(text, F.lit(""))).alias("content_hash"), F.lit(source).alias("source"), doc_type.alias("doc_type"), (empty if metadata is None else metadata).alias("metadata")
    )


# Extensions of files that are text; names that systems leave behind.
TEXT_EXTENSIONS = ["txt", "csv", "tsv", "md"]
ARTIFACTS = ["__MACOSX", ".DS_Store", "Thumbs.db", ".gitkeep"]


def read_text(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Whole text files below a folder, but for hidden ones, those that systems leave behind, and blank ones; bytes that aren't UTF-8 are read as Latin-1.

    limit: the first files by path only, for a trial.
    """
    raw = files(spark, path, f"*.{{{','.join(TEXT_EXTENSIONS + [e.upper() for e in TEXT_EXTENSIONS])}}}")
    below = F.split(F.substring_index("path", "/", -3), "/")
    raw = raw.filter(~F.arrays_overlap(below, F.array(*(F.lit(x) for x in ARTIFACTS))) & ~F.element_at(below, -1).startswith("."))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    out = as_documents(raw, F.col("path"), F.element_at(F.split("path", "/"), -1), text, "directory", F.lit("text")).filter(F.col("text").rlike(r"\S"))
    return out if limit is None else out.orderBy("doc_id").limit(limit)


def read_dat(spark: SparkSession, path: str) -> DataFrame:
    """Concordance DAT: (doc_id, fields) of each line; a header line in each file, fields divided by U+0014, each in U+00FE; short rows get '' for what they lack.

    Files may have different headers. A file's header is the first line of its first block; headers, one a file, meet the lines by the file's name.
    """
    bare = F.regexp_replace("value", "^\ufeff", "")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), bare.alias("line"), F.monotonically_increasing_id().alias("at")).filter("trim(line) <> ''")
    cells = F.transform(F.split("line", DAT_FIELD), lambda c: F.trim(F.regexp_replace(c, f"^\\s*{DAT_QUOTE}|{DAT_QUOTE}\\s*$", "")))
    heads = lines.filter("block = 0").groupBy("file").agg(F.min_by("line", "at").alias("line"), F.min("at").alias("first")).select("file", "first", cells.alias("names"))
    rows = lines.select("file", "at", cells.alias("cells")).join(heads, "file").filter("at <> first OR first IS NULL")
    value = F.transform("names", lambda n, i: F.coalesce(F.get("cells", i), F.lit("")))
    ids = F.filter(F.transform(F.array(*(F.lit(k) for k in DAT_IDS)), lambda k: F.array_position("names", k).cast("int")), lambda i: i > 0)
    key = F.coalesce(F.try_element_at("values", F.coalesce(F.get(ids, F.lit(0)), F.lit(1))), F.lit(""))
    return rows.withColumn("values", value).select(key.alias("doc_id"), F.map_from_arrays("names", "values").alias("fields")).filter("doc_id <> ''")


def read_opticon(spark: SparkSession, path: str) -> DataFrame:
    """Opticon OPT: six fields by position, missing ones ''; lines without a page id are passed over."""
    schema = ", ".join(f"{c} string" for c in OPT_FIELDS)
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    return rows.select(*(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in OPT_FIELDS)).filter("page_id <> ''")


def read_edrm(spark: SparkSession, path: str) -> DataFrame:
    """EDRM XML: (doc_id, fields) of each Document element: its attributes, those of its files (File_i_ before them from the second on), its tags."""
    pairs = T.ArrayType(T.StructType([T.StructField("_TagName", T.StringType()), T.StructField("_TagValue", T.StringType())]))
    file = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("_FileName", "_FilePath", "_FileType")]))
    schema = T.StructType([T.StructField("_DocID", T.StringType()), T.StructField("_MimeType", T.StringType()), T.StructField("Files", T.StructType([T.StructField("File", file)])), T.StructField("Tags", T.StructType([T.StructField("Tag", pairs)]))])
    xml = spark.read.format("xml").option("rowTag", "Document").option("ignoreNamespace", "true")
    # Attributes of any name are wanted: their names are read from the files first.
    more = [f.name for f in xml.load(path).schema if f.name.startswith("_") and f.name not in ("_DocID", "_MimeType", "_corrupt_record")]
    rows = xml.schema(T.StructType([*schema, *(T.StructField(c, T.StringType()) for c in more)])).load(path)
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    tags = F.transform(F.coalesce("Tags.Tag", F.array()), lambda t: entry(t["_TagName"], t["_TagValue"]))
    prefix = lambda i: F.when(i == 0, "").otherwise(F.concat(F.lit("File_"), i.cast("string"), F.lit("_")))
    of = F.flatten(F.transform(F.coalesce("Files.File", F.array()), lambda f, i: F.array(*(entry(F.concat(prefix(i), F.lit(c)), f[f"_{c}"]) for c in ("FileName", "FilePath", "FileType")))))
    own = F.array(*(entry(F.lit(c[1:]), F.col(c)) for c in ("_MimeType", *more)))
    found = F.filter(F.concat(own, of, tags), lambda e: e["value"].isNotNull())
    last = F.filter(found, lambda e, i: ~F.exists(F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return rows.filter("_DocID IS NOT NULL").select(F.col("_DocID").alias("doc_id"), F.map_from_entries(last).alias("fields"))


def read_ocr_corpus(df: DataFrame, least: int = 50, releases: Mapping[str, str] | None = None) -> DataFrame:
    """An OCR corpus (filename, text): image rows and short texts go; numbers of the file name's form PREFIX-digits become metadata.

    releases: what release a prefix stands for; a prefix that isn't there names its own. A null file name is read as empty.
    """
    missing = {"filename", "text"} - set(df.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing")
    df = df.withColumn("filename", F.coalesce(F.col("filename").cast("string"), F.lit("")))
    rows = df.filter(~F.col("filename").startswith("IMAGES/")).withColumn("clean", clean_control(F.coalesce("text", F.lit("")))).filter(F.length("clean") >= least)
    leaf = F.when(F.col("filename").contains("/"), F.regexp_replace("filename", "^[^/]*/", "")).otherwise(F.col("filename"))
    prefix, number = F.regexp_extract(leaf, r"^([A-Z_]+?)[-_]?(\d+)", 1), F.regexp_extract(leaf, r"^([A-Z_]+?)[-_]?(\d+)", 2)
    release = prefix
    for known, name in (releases or {}).items():
        release = F.when(prefix == known, F.lit(name)).otherwise(release)
    plain = F.create_map(F.lit("original_path"), F.col("filename"))
    bates = F.create_map(F.lit("original_path"), F.col("filename"), F.lit("bates_prefix"), prefix, F.lit("bates_number"), number, F.lit("release_source"), release)
    return as_documents(rows, F.col("filename"), leaf, F.col("clean"), "ocr_corpus", F.lit("document"), F.when(prefix == "", plain).otherwise(bates))


def read_ocr_csv(spark: SparkSession, path: str) -> DataFrame:
    """The OCR corpus as CSV files with a header; texts in quotes may run over lines, quotes in them are doubled."""
    return read_ocr_corpus(spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path))


MESSAGES = "array<struct<sender:string,recipients:array<string>,timestamp:string,subject:string,body:string>>"


def read_email_corpus(df: DataFrame, least: int = 20) -> DataFrame:
    """An email corpus, flat (a row for each message, HTML bodies) or threaded (a JSON array of messages); broken JSON is passed over.

    Returns doc_id, thread_id, position, sender, recipients, subject, sent, text of messages of `least` characters or more.
    """
    if "message_html" in df.columns:
        both = F.filter(F.array("to_address", "other_recipients"), lambda a: a.isNotNull() & (a != ""))
        out = df.select(
            F.concat_ws("-", "document_id", "message_order").alias("doc_id"), F.col("document_id").cast("string").alias("thread_id"), F.col("message_order").cast("int").alias("position"), F.col("from_address").alias("sender"),
            F.array_join(both, ", ").alias("recipients"), "subject", F.col("timestamp_iso").alias("sent"), strip_tags(F.coalesce("message_html", F.lit("")), " ").alias("text"),
        )
    else:
        rows = df.select(F.col("thread_id").cast("string"), F.col("subject").alias("s"), F.posexplode(F.from_json("messages", MESSAGES)).alias("position", "m"))
        out = rows.select(
            F.concat_ws("-", "thread_id", "position").alias("doc_id"), "thread_id", "position", F.col("m.sender").alias("sender"), F.array_join("m.recipients", ", ").alias("recipients"),
            F.coalesce("m.subject", "s").alias("subject"), F.col("m.timestamp").alias("sent"), F.trim(F.coalesce("m.body", F.lit(""))).alias("text"),
        )
    return out.filter(F.length("text") >= least)


EML = "path string, message_id string, in_reply_to string, references string, subject string, sender string, recipients string, cc string, bcc string, sent string, text string, attachments array<string>"


def parse_eml(raw: bytes) -> dict:
    """Headers, body (plain text first, else HTML without tags) and attachment names of one message."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    head = lambda k: str(m.get(k) or "").strip()
    part = m.get_body(preferencelist=("plain", "html"))
    body = ""
    if part is not None:
        try:
            body = part.get_content()
        except (LookupError, UnicodeDecodeError):
            body = (part.get_payload(decode=True) or b"").decode("latin-1")
        if part.get_content_type() == "text/html":
            body = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", body))
    shown = [f"{k}: {head(k)}" for k in ("From", "To", "Cc", "Subject", "Date") if head(k)]
    names = [a.get_filename() or "" for a in m.iter_attachments()]
    return {"message_id": head("Message-ID"), "in_reply_to": head("In-Reply-To"), "references": " ".join(head("References").split()), "subject": head("Subject"), "sender": head("From"), "recipients": head("To"), "cc": head("Cc"), "bcc": head("Bcc"), "sent": head("Date"), "text": "\n".join(shown) + "\n\n" + body.strip(), "attachments": names}


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """RFC 5322 messages, parsed in Arrow batches where their files are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"path": p, **parse_eml(bytes(c))} for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=[f.split(" ")[0] for f in EML.split(", ")])

    return files(spark, path, "*.eml").select("path", "content").mapInPandas(run, EML)


def csv_table(raw: bytes, most: int = 1000) -> tuple[str, int, int, bool]:
    """(markdown table, rows, columns, cut off) of a CSV or TSV file; rows are padded or cut to the header's width."""
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    try:
        dialect = csv.Sniffer().sniff(text[:8192], ",\t;|")
    except csv.Error:
        dialect = csv.excel
    rows = [r for r in csv.reader(io.StringIO(text), dialect) if r]
    if not rows:
        return "", 0, 0, False
    head, body = rows[0], rows[1:]
    fit = lambda r: (r + [""] * len(head))[: len(head)]
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in fit(r)) + " |"
    lines = [line(head), "| " + " | ".join(["---"] * len(head)) + " |", *(line(r) for r in body[:most])]
    return "\n".join(lines), len(body), len(head), len(body) > most


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """CSV and TSV files as markdown tables for indexing (the first thousand rows; data at scale is read with spark.read.csv)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *csv_table(bytes(c))) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=["path", "text", "row_count", "column_count", "truncated"])

    return files(spark, path, "*.{csv,tsv}").select("path", "content").mapInPandas(run, "path string, text string, row_count long, column_count long, truncated boolean")


# Groups of an RTF file that hold no text of the document.
RTF_ASIDE = frozenset("fonttbl colortbl stylesheet info pict header footer generator listtable listoverridetable themedata datastore".split())
RTF_TOKEN = re.compile(r"[{}]|\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|[^{}\\\r\n]+|[\r\n]")
RTF_TEXT = {"par": "\n", "line": "\n", "sect": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rtf_text(raw: bytes) -> str:
    """Text of an RTF file: groups nested to any depth, those of tables and pictures left out; paragraphs become lines."""
    out, skip = [], [False]
    spare = 0
    for m in RTF_TOKEN.finditer(raw.decode("latin-1")):
        token, word, symbol = m[0], m[2], m[4]
        if token == "{":
            skip.append(skip[-1])
        elif token == "}":
            skip[-1:] = [] if len(skip) > 1 else [False]
        elif symbol == "*" or word in RTF_ASIDE:
            skip[-1] = True
        elif skip[-1] or token in "\r\n":
            continue
        elif m[1]:
            out.append("" if spare else bytes([int(m[1], 16)]).decode("cp1252", "replace"))
            spare = max(0, spare - 1)
        elif word == "u" and m[3]:
            # The character that older readers show instead comes next.
            out.append(chr(int(m[3]) % 65536))
            spare = 1
        elif word:
            out.append(RTF_TEXT.get(word, ""))
        elif symbol:
            out.append({"~": "\u00a0", "_": "-", "-": ""}.get(symbol, symbol))
        else:
            out.append(token[spare:])
            spare = 0
    return "".join(out).strip()


def read_rtf(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [rtf_text(bytes(c)) for c in pdf["content"]]})

    return files(spark, path, "*.rtf").select("path", "content").mapInPandas(run, "path string, text string")


def zip_members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of an archive but folders, system files, dotfiles and archives inside it; a broken archive has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for info in z.infolist():
                leaf = info.filename.rsplit("/", 1)[-1]
                if info.is_dir() or not leaf or leaf.startswith(".") or info.filename.startswith("__MACOSX/") or leaf in ("Thumbs.db", "desktop.ini") or leaf.lower().endswith(".zip"):
                    continue
                yield info.filename, z.read(info)
    except zipfile.BadZipFile:
        return


def expand_zips(spark: SparkSession, path: str) -> DataFrame:
    """A row for each member of each archive; members leave a task one at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                for name, data in zip_members(bytes(c)):
                    yield pd.DataFrame({"archive": [p], "member": [name], "content": [data]})

    out = files(spark, path, "*.zip").select("path", "content").mapInPandas(run, "archive string, member string, content binary")
    return out.withColumn("parser", parser_of(F.col("member")))


def changed_files(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Files of a drive listing (file_id, modified_time) that are new or changed since the state of the last sync."""
    return listing.join(state.select("file_id", "modified_time"), ["file_id", "modified_time"], "left_anti")


def resume(docs: DataFrame, done: DataFrame, scope: list[str]) -> DataFrame:
    """Documents with text whose (scope, content_hash) isn't done yet, each content once in a scope."""
    keys = [*scope, "content_hash"]
    new = docs.filter(F.trim(F.coalesce("text", F.lit(""))) != "").join(done.select(*keys).distinct(), keys, "left_anti")
    return first_by(new, keys, [F.col(c) for c in ("doc_id", "filename", "source", "doc_type", "text") if c in new.columns] or [F.lit(1)])


ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "directory": read_text,
    "concordance_dat": read_dat,
    "edrm_xml": read_edrm,
    "eml": read_eml,
    "opticon": read_opticon,
    "ocr_csv": read_ocr_csv,
    "ocr_parquet": lambda spark, path: read_ocr_corpus(spark.read.parquet(path)),
    "email_parquet": lambda spark, path: read_email_corpus(spark.read.parquet(path)),
}


def import_documents(spark: SparkSession, adapter: str, path: str) -> DataFrame:
    """What an adapter reads, in its own columns."""
    if adapter not in ADAPTERS:
        raise ValueError(f"no adapter {adapter!r}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[adapter](spark, path)


# Fields of load files that hold a text or a file's name.
TEXT_FIELDS = ["EXTRACTED_TEXT", "ExtractedText", "TEXT", "Text", "text"]
NAME_FIELDS = ["FILENAME", "FileName", "Filename", "filename"]


def common_documents(spark: SparkSession, adapter: str, path: str) -> DataFrame:
    """import_documents() of any adapter as DOCUMENT rows: doc_id, filename, text, content_hash, source, doc_type, metadata.

    Load files give the fields that hold a text and a file's name, and all others as metadata; mail gives subjects as names and headers as metadata;
    Opticon rows have no text. Other columns go into metadata as strings, nulls left out.
    """
    df = import_documents(spark, adapter, path)
    if set(DOCUMENT.names) <= set(df.columns):
        return df.select(*DOCUMENT.names)
    columns = set(df.columns)
    of_fields = lambda names: F.coalesce(*(F.try_element_at("fields", F.lit(n)) for n in names))
    key = next(c for c in ("doc_id", "page_id", "path") if c in columns)
    if "fields" in columns:
        return as_documents(df, F.col(key), F.coalesce(of_fields(NAME_FIELDS), F.col(key)), of_fields(TEXT_FIELDS), adapter, F.lit("document"), F.col("fields"))
    text = next((F.col(c) for c in ("text", "body") if c in columns), F.lit(None).cast("string"))
    name = F.col("subject") if "subject" in columns else F.element_at(F.split(F.col("path"), r"[/\\]"), -1) if "path" in columns else F.col(key)
    rest = [c for c in df.columns if c not in (key, "text", "body", "content_hash")]
    as_string = lambda c: F.to_json(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c).cast("string")
    entries = F.array(*(F.struct(F.lit(c).alias("key"), as_string(c).alias("value")) for c in rest))
    metadata = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return as_documents(df, F.col(key), name, text, adapter, F.lit("email" if "subject" in columns else "document"), metadata)
