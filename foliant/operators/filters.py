"""Predicates, projections and pages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words in error texts, by category; the first category found holds.
ERROR_WORDS = [
    ("TIMEOUT", ["timed out", "softtimelimitexceeded", "deadline exceeded", "task timed out"]),
    ("OOM", ["memoryerror", "cannot allocate memory", "killed", "oom"]),
    ("PARSE_ERROR", ["parseerror", "pdfsyntaxerror", "invalid pdf", "corrupt", "unicodedecodeerror", "doclingerror", "conversionerror"]),
    ("NETWORK", ["connectionerror", "timeouterror", "remotedisconnected", "econnrefused", "connectionrefused", "connectionreset"]),
    ("LLM_API", ["anthropic", "openai", "rate_limit", "apierror", "insufficient_quota", "ratelimit", "overloaded"]),
    ("VALIDATION", ["validationerror", "pydantic", "typeerror", "valueerror"]),
    ("STORAGE", ["nosuchkey", "nosuchbucket", "s3error", "minio"]),
]
# Phrases that make a question deep, or fast if it starts with one.
DEEP = ["compare", "contrast", "analyze", "relationship between", "pattern", "timeline of", "all mentions", "summarize all", "how does", "what is the connection", "explain the"]
FAST = ["who is", "what is", "when did", "where is", "how many", "name the", "list the", "which", "who are", "what are", "who was", "what was", "where did", "when was", "what company", "what organization", "who did", "what role", "what position", "what job"]
# Broad document types by file extension.
FILE_TYPES = {
    "document": ["pdf", "docx", "doc", "rtf"],
    "spreadsheet": ["xlsx"],
    "presentation": ["pptx"],
    "web_page": ["html", "htm"],
    "email": ["eml", "msg"],
    "text": ["txt"],
    "data": ["csv", "tsv"],
    "image": ["png", "jpg", "jpeg", "tiff", "tif"],
}
# Privilege labels.
PRIVILEGE_TEXT = {"privileged": "Attorney-Client Privilege", "work_product": "Work Product Doctrine"}
#: Statuses that only counsel and administrators see; no status is visible to all.
RESTRICTED = ("privileged", "work_product")


def every(conditions: Iterable[Column | None]) -> Column:
    """Conjunction of the conditions that are given; true if none is."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def visible(status: Column, counsel: bool = False) -> Column:
    """Privilege exclusion: null statuses stay visible."""
    return F.lit(True) if counsel else status.isNull() | ~status.isin(*RESTRICTED)


def select_documents(docs: DataFrame, *, types: Sequence[str] = (), single_type: str | None = None, name_like: str | None = None, suffix: str | None = None, least: tuple[str, float] | None = None, scope: tuple[str, object] | None = None, counsel: bool = True, type_col: str = "type", name_col: str = "name", status_col: str | None = None) -> DataFrame:
    """Conjunctive document filter: types (a list beats a single one), case-insensitive substring and suffix of the name, a least score, tenant scope, privilege."""
    return docs.filter(
        every(
            [
                F.col(scope[0]) == F.lit(scope[1]) if scope else None,
                F.col(type_col).isin(*types) if types else (F.col(type_col) == single_type if single_type else None),
                F.col(name_col).ilike(f"%{name_like}%") if name_like else None,
                F.col(name_col).ilike(f"%{suffix}") if suffix else None,
                F.col(least[0]) >= least[1] if least else None,
                visible(F.col(status_col), counsel) if status_col else None,
            ]
        )
    )


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page in a total order (end `order` with a unique column), nulls as the order says."""
    return df.orderBy(*order).offset(offset).limit(limit)


def in_dates(at: Column, start: str | None, end: str | None) -> Column:
    """Inclusive range that leaves out nulls; an end at midnight means the whole day."""
    parts = [at.isNotNull()]
    if start:
        parts.append(at >= F.lit(start).cast("timestamp"))
    if end:
        last = F.lit(end).cast("timestamp")
        whole = F.when(F.date_trunc("day", last) == last, last + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")).otherwise(last)
        parts.append(at <= whole)
    return every(parts)


def within(at: Column, as_of: str, **interval: int) -> Column:
    """at >= as_of less an interval (days, hours, mins); as_of is explicit so that reruns agree."""
    return at >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(*(F.lit(interval.get(k, 0)) for k in ("days", "hours", "mins")))


def classify_error(message: Column) -> Column:
    low, out = F.lower(message), None
    for category, words in ERROR_WORDS:
        hit = reduce(lambda a, b: a | b, (low.contains(w) for w in words))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return F.when(message.isNull(), F.lit(None)).otherwise(out.otherwise("UNKNOWN"))


def question_tier(text: Column) -> Column:
    low = F.lower(text)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    deep = reduce(lambda a, b: a | b, (low.contains(m) for m in DEEP)) | (words > 30)
    fast = (words <= 20) & (text.contains("?") | reduce(lambda a, b: a | b, (low.startswith(m) for m in FAST)))
    return F.when(deep, "deep").when(fast, "fast").otherwise("standard")


def extension(name: Column) -> Column:
    """Lower-case extension without its dot; '' if there is none (a leading dot starts none)."""
    return F.lower(F.regexp_extract(name, r"[^/.]\.([^./\s]+)$", 1))


def file_type(name: Column) -> Column:
    ext, out = extension(name), None
    for kind, exts in FILE_TYPES.items():
        out = F.when(ext.isin(*exts), kind) if out is None else out.when(ext.isin(*exts), kind)
    return out.otherwise("other")


def visually_complex(text: Column, name: Column, has_tables: Column) -> Column:
    return extension(name).isin("pptx", "xlsx") | F.coalesce(has_tables, F.lit(False)) | (F.length(F.trim(text)) < 100)


def privilege_text(status: Column) -> Column:
    out = None
    for k, v in PRIVILEGE_TEXT.items():
        out = F.when(status == k, v) if out is None else out.when(status == k, v)
    return out.otherwise(F.coalesce(status, F.lit("")))


def missing_as(x: Column, *others: Column) -> Column:
    """The first value that is neither null nor ''; else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (x, *others)), F.lit(""))


def open_by_default(items: DataFrame, grants: DataFrame, item: str, user_col: str, user: str) -> DataFrame:
    """Items without any grant, and those granted to the user."""
    free = items.join(grants.select(item).distinct(), item, "left_anti")
    return free.unionByName(items.join(grants.filter(F.col(user_col) == user).select(item).distinct(), item, "left_semi"))


def token_valid(revoked: Column, expires: Column, as_of: str) -> Column:
    return ~F.coalesce(revoked, F.lit(False)) & (expires.isNull() | (expires > F.lit(as_of).cast("timestamp")))


def health(expected: Column, indexed: Column) -> Column:
    """Of a document's chunks in two stores: missing, partial or healthy."""
    have = F.coalesce(indexed, F.lit(0))
    return F.when(have == 0, "missing").when(have < expected, "partial").otherwise("healthy")


def recency(at: Column, as_of: str) -> Column:
    days = F.datediff(F.lit(as_of).cast("date"), at.cast("date"))
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days <= 7, "This Week").otherwise("Older")


def cut_text(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def capped_limit(asked: int | None, most: int) -> int:
    return most if asked is None else max(0, min(asked, most))
