"""Text functions as columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Boilerplate patterns, with what all of a pattern's matches hold in lower case.
BOILERPLATE = {
    r"(?i)\bCONFIDENTIAL\b": "confidential",
    r"(?i)\bPRIVILEGED AND CONFIDENTIAL\b": "privileged and confidential",
    r"(?i)Page\s+\d+\s+of\s+\d+": "page",
    r"\bEXHIBIT\s+[A-Z0-9]+\b": "exhibit",
    r"(?i)\bTABLE OF CONTENTS\b": "table of contents",
    r"(?i)\bATTORNEY.CLIENT PRIVILEGE\b": "client privilege",
    r"(?i)\bWORK PRODUCT\b": "work product",
    r"(?i)\bDO NOT DISTRIBUTE\b": "do not distribute",
    r"(?i)\bFOR INTERNAL USE ONLY\b": "for internal use only",
    r"(?m)^\s*[-_=]{10,}\s*$": None,
}
# OCR corrections in the order in which they apply.
OCR = [
    ("ﬁ", "fi"),
    ("ﬂ", "fl"),
    ("ﬀ", "ff"),
    ("ﬃ", "ffi"),
    ("ﬄ", "ffl"),
    (r"\bl\b(?=\d)", "1"),
    (r"(?<=\d)O(?=\d)", "0"),
    (r"(?<=\d)l(?=\d)", "1"),
    (r"(?<=\d)S(?=\d)", "5"),
    (r"(\w+)-\s*\n\s*(\w+)", "$1$2"),
    (r"[ \t]{2,}", " "),
    (r"\bPlaintitf\b", "Plaintiff"),
    (r"\bDefendanr\b", "Defendant"),
    (r"\bAttomey\b", "Attorney"),
    (r"\bJudgrnent\b", "Judgment"),
    (r"\bExhibii\b", "Exhibit"),
    (r"\bTestirnony\b", "Testimony"),
    (r"\bDeposiiion\b", "Deposition"),
    (r"\bAffidavii\b", "Affidavit"),
    (r"\bSubpcena\b", "Subpoena"),
    (r"\bStatuie\b", "Statute"),
]
# Personal data patterns and medical keywords.
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
DOB = r"\b(?:0[1-9]|1[0-2])[/\-](?:0[1-9]|[12]\d|3[01])[/\-](?:19|20)\d{2}\b"
DOB_ISO = r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"
MEDICAL = [
    "diagnosis", "prognosis", "prescription", "hipaa", "patient", "medical record", "treatment plan", "icd-10", "icd-9", "medication",
    "clinical", "psychiatric", "psychological", "substance abuse", "hiv", "std", "disability", "blood type", "allergies", "health insurance",
]
# Citation marks in answers.
CITATION = r"\[Source:\s*([^,\]]+),\s*[Pp]age\s*(\d+)\]"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"\S")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]\s"), strip), lambda s: s != "")


def coherence(n: Column, total: Column) -> Column:
    """From the number of sentences and of their words, both columns of their own: each is used several times."""
    mean = total / F.greatest(n, F.lit(1))
    count = F.when(n >= 5, 1.0).when(n >= 3, 0.8).when(n >= 2, 0.6).otherwise(0.4)
    length = F.when(mean < 3, 0.2).when(mean < 5, 0.4).when(mean <= 50, 1.0).when(mean <= 80, 0.6).otherwise(0.3)
    return F.when(n == 0, 0.1).otherwise(0.6 * count + 0.4 * length)


def plate(text: Column, lower: Column, pattern: str, part: str | None) -> Column:
    """Characters of a pattern: those that go when its matches are taken out. A text in lower case without the part that all matches have holds none."""
    chars = F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    return chars if part is None else F.when(lower.contains(part), chars).otherwise(F.when(text.isNotNull(), 0))


def density(text: Column, lower: Column, stripped: Column, lines: Column, entities: Column) -> Column:
    chars = reduce(lambda a, b: a + b, (plate(text, lower, p, part) for p, part in BOILERPLATE.items()))
    tables = F.size(F.filter(lines, lambda s: s.rlike(r"^\s*\|"))) / F.greatest(F.size(lines), F.lit(1))
    base = (1.0 - F.least(F.try_divide(chars, F.length(stripped)), F.lit(1.0))) * F.when(tables > 0.8, 0.6).otherwise(1.0)
    bonus = F.when(entities > 0, F.least(base + F.least(entities / 3.0, F.lit(1.0)) * 0.2, F.lit(1.0))).otherwise(base)
    return F.greatest(bonus, F.lit(0.0))


def completeness(stripped: Column) -> Column:
    last = strip(F.element_at(F.split(stripped, "\n"), -1))
    score = 1.0 - F.when(stripped.rlike(r"[.!?:;)\]\"']\s*$"), 0.0).otherwise(0.3)
    score = score - F.when(stripped.rlike(r"^\p{Ll}"), 0.2).otherwise(0.0)
    return F.greatest(score - F.when(last.startswith("|") & ~last.endswith("|"), 0.3).otherwise(0.0), F.lit(0.0))


def length_score(tokens: Column) -> Column:
    return F.when(tokens < 20, 0.1).when(tokens < 50, 0.3).when(tokens < 100, 0.6).when(tokens <= 512, 1.0).when(tokens <= 600, 0.8).otherwise(0.5)


def chunk_quality(chunks: DataFrame, text: str, tokens: Column, entities: Column | None = None) -> DataFrame:
    """chunks with the five scores of each text, 0 for null or blank text: overall, coherence, information_density, completeness, length_score."""
    e = F.lit(0) if entities is None else entities
    names = ["coherence", "information_density", "completeness", "length_score"]
    # Each score is a column of its own before it is used again, so that no text is gone through twice.
    out = chunks.withColumns({"_stripped": strip(F.col(text)), "_lower": F.lower(text), "_parts": sentences(F.col(text)), "_tokens": tokens, "_entities": e})
    said = F.aggregate("_parts", F.lit(0), lambda a, s: a + F.size(words(s)))
    lines = F.filter(F.split("_stripped", "\n"), lambda s: s.rlike(r"\S"))
    out = out.withColumns({"_n": F.size("_parts"), "_said": said, "_lines": lines})
    scores = [coherence(F.col("_n"), F.col("_said")), density(F.col(text), F.col("_lower"), F.col("_stripped"), F.col("_lines"), F.col("_entities")), completeness(F.col("_stripped")), length_score(F.col("_tokens"))]
    out = out.withColumns({f"_{n}": x for n, x in zip(names, scores, strict=True)})
    total = 0.30 * F.col("_coherence") + 0.35 * F.col("_information_density") + 0.20 * F.col("_completeness") + 0.15 * F.col("_length_score")
    whole = F.col("_stripped") != ""
    final = {n: F.when(whole, F.round(x, 4)).otherwise(0.0) for n, x in {"overall": total, **{n: F.col(f"_{n}") for n in names}}.items()}
    return out.withColumns(final).drop("_stripped", "_lower", "_parts", "_n", "_said", "_lines", "_tokens", "_entities", *(f"_{n}" for n in names))


def ocr_corrected(docs: DataFrame, text: str, out: str = "corrected", count: str = "corrections") -> DataFrame:
    """docs with the corrected text and the number of corrections; null text stays null.

    Corrections follow one another, each over the last one's text, which is a column of its own so that a step is evaluated once. A text in which
    no pattern occurs passes all steps untouched.
    """
    any_ = "|".join(f"(?:{p})" for p, _ in OCR)
    rows = docs.withColumns({"_faulty": F.coalesce(F.col(text).rlike(any_), F.lit(False)), "_text": F.col(text), "_n": F.lit(0)})
    for pattern, to in OCR:
        n = F.col("_n") + F.when(F.col("_faulty"), F.regexp_count("_text", F.lit(pattern))).otherwise(0)
        rows = rows.withColumns({"_text": F.when(F.col("_faulty"), F.regexp_replace("_text", pattern, to)).otherwise(F.col("_text")), "_n": n})
    return rows.withColumns({out: F.col("_text"), count: F.col("_n")}).drop("_faulty", "_text", "_n")


def strip_tags(html: Column, space: str = "") -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", space), r"\s+", " "))


def clean_control(text: Column) -> Column:
    """Without control characters but tab and newline, runs of four newlines or more as three, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"\n{4,}", "\n\n\n"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def pii_counts(text: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    medical = reduce(lambda a, b: a + b, (F.regexp_count(F.lower(text), F.lit(rf"\Q{k}\E")) for k in MEDICAL)).cast("long")
    return {"ssn": count(SSN), "phone": count(PHONE), "email": count(EMAIL), "dob": count(DOB) + count(DOB_ISO), "medical": medical}


def occurrences(text: Column, pattern: str) -> Column:
    """array of struct(start, end) of a pattern's matches, none of which may be empty: what lies between them gives the places."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["hit"]).alias("end"))
        return F.struct((begin + x["hit"]).alias("at"), F.when(x["hit"] > 0, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(sizes, start, step, lambda acc: acc["out"]))


def pii_spans(text: Column) -> Column:
    """array of struct(start, end, category, confidence, text) of personal data in a text, by start, then by category in the order of the patterns.

    Patterns count fully, medical keywords 0.9. Spans of different categories may overlap. Null text gives no spans.
    """
    kinds = [("ssn", SSN, text, 1.0), ("phone", PHONE, text, 1.0), ("email", EMAIL, text, 1.0), ("dob", DOB, text, 1.0), ("dob", DOB_ISO, text, 1.0)]
    kinds += [("medical", rf"\Q{k}\E", F.lower(text), 0.9) for k in MEDICAL]

    def spans(order: int, kind: str, pattern: str, where: Column, confidence: float) -> Column:
        found = F.coalesce(occurrences(where, pattern), F.array().cast("array<struct<start:int,end:int>>"))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("category"), F.lit(confidence).alias("confidence")))

    every = F.array_sort(F.concat(*(spans(i, *k) for i, k in enumerate(kinds))))
    return F.transform(every, lambda s: F.struct(s["start"], s["end"], s["category"], s["confidence"], F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))


def sanitised(message: Column, most: int = 500) -> Column:
    """An error message without quoted content and personal data, cut to `most` characters."""
    out = message
    for pattern, to in ((r'"[^"]*"', "[REDACTED]"), (r"'[^']*'", "[REDACTED]"), (SSN, "[SSN]"), (PHONE, "[PHONE]"), (EMAIL, "[EMAIL]")):
        out = F.regexp_replace(out, pattern, to)
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most - 3), F.lit("..."))).otherwise(out)


def subject_key(subject: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(subject), r"(?i)^((re|fwd?|fw)\s*:\s*)+", "")))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def address(raw: Column) -> Column:
    """struct(name, email) of `"Name" <a@b>` or a bare address; '' where there is none."""
    bare = F.regexp_extract(raw, r"([\w.+-]+@[\w.-]+\.\w+)", 1)
    name = F.trim(F.regexp_replace(F.regexp_extract(raw, r'^\s*"?([^"<]*?)"?\s*<', 1), '"', ""))
    parts = lambda angle: F.struct(F.when(angle != "", name).otherwise("").alias("name"), F.trim(F.when(angle != "", angle).otherwise(bare)).alias("email"))
    return bound(F.regexp_extract(raw, r"<([^>]+)>", 1), parts)


def addresses(raw: Column) -> Column:
    """The addresses of a list that commas or semicolons divide."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"[;,]"), address), lambda a: a["email"] != "")


def document_date(raw: Column, as_of_year: int) -> Column:
    """RFC 2822, ISO 8601 or month/day/year; null if it can't be read, has no year, or lies outside 1950 to as_of_year + 2."""
    t = F.regexp_replace(F.trim(raw), r"\s*\([A-Za-z]+\)$", "")
    t = F.regexp_replace(t, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+", "")
    t = F.regexp_replace(t, r"\s+(?:GMT|UTC)$", " +0000")
    formats = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "M/d/yyyy HH:mm", "MMM-d-yyyy"]

    def read(t: Column) -> Column:
        iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00")))
        # A format that doesn't fit costs an exception, so those with an offset are tried only where one is.
        offset = t.rlike(r"[+-]\d{4}\s*$")
        return F.coalesce(iso, *(F.when(offset, F.try_to_timestamp(t, F.lit(f))) if f.endswith("Z") else F.try_to_timestamp(t, F.lit(f)) for f in formats))

    return bound(bound(t, read), lambda at: F.when(F.year(at).between(1950, as_of_year + 2), at))


def citations(answer: Column) -> Column:
    """array of struct(filename, page)."""
    names = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    pages = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(2))
    return F.transform(F.arrays_zip(names.alias("f"), pages.alias("p")), lambda x: F.struct(F.trim(x["f"]).alias("filename"), x["p"].cast("int").alias("page")))


def matches_either_way(name: Column, names: Column) -> Column:
    """Does name lie within one of names, or one of them within name?"""
    return F.exists(names, lambda n: n.contains(name) | name.contains(n))


def citation_rates(answer: Column, expected: Column, retrieved: Column, fused: Column) -> dict[str, Column]:
    """accuracy, hallucination and post_rationalization of an answer's citations; 1, 0 and 0 of an answer without any.

    expected: array of struct(document_id, page_start, page_end); a citation is right if names match either way and its page lies within. retrieved,
    fused: names of the files that a search found, and that reached the answer; a citation of none of them counts as made up, or as found afterwards.
    """
    cited = citations(answer)
    share = lambda part: F.size(part) / F.size(cited)
    right = F.filter(cited, lambda c: F.exists(expected, lambda e: (e["document_id"].contains(c["filename"]) | c["filename"].contains(e["document_id"])) & c["page"].between(e["page_start"], e["page_end"])))
    outside = lambda names: F.filter(cited, lambda c: ~matches_either_way(c["filename"], F.coalesce(names, F.array().cast("array<string>"))))
    none = F.size(cited) == 0
    return {"accuracy": F.when(none, 1.0).otherwise(share(right)), "hallucination": F.when(none, 0.0).otherwise(share(outside(retrieved))), "post_rationalization": F.when(none, 0.0).otherwise(share(outside(fused)))}


def numbered_citations(answer: Column, sources: Column) -> Column:
    """The sources, an array, that an answer's marks [1], [2], ... name, in the order of the marks; numbers out of range are passed over."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int"))
    return F.transform(F.filter(numbers, lambda n: n.between(1, F.size(sources))), lambda n: F.element_at(sources, n))


def with_context(text: Column, prefix: Column) -> Column:
    """What is embedded of a chunk: its context, if it has one, a blank line, its text."""
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("\n\n"), text)).otherwise(text)
