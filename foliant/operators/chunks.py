"""Chunks of texts, redaction and line differences."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks at which a quoted reply begins.
REPLY = r"(?mid)^(?:(?:>{1,}\s)|(?:On .+ wrote:$)|(?:-{3,}\s*Original Message\s*-{3,})|(?:-{3,}\s*Forwarded .+\s*-{3,}))"
SENTENCE = re.compile(r"(?s).*[.?!][ \n]")


def portable(text: str) -> list[str]:
    """Tokens without a vocabulary: words with the space before them, so that tokens joined give the text again."""
    return re.findall(r"\s*\S+|\s+", text)


def text_blocks(text: str) -> list[str]:
    """Paragraphs between blank lines; neighbouring table lines are one block."""
    out: list[str] = []
    held: list[str] = []
    table = False
    for line in [*text.split("\n"), ""]:
        row = line.lstrip().startswith("|")
        if held and (row != table or not line.strip()):
            if block := "\n".join(held).strip():
                out.append(block)
            held = []
        table = row
        if line.strip():
            held.append(line)
    return out + (["\n".join(held).strip()] if held else [])


def long_block(block: str, most: int) -> Iterator[str]:
    """Parts of a block over `most` tokens, each up to its last sentence end if it has one."""
    tokens = portable(block)
    while tokens:
        part = "".join(tokens[:most])
        if len(tokens) > most and (end := SENTENCE.match(part)) and end.end() > 2:
            part = end[0]
        used = max(1, len(portable(part)))
        if piece := part.strip():
            yield piece
        tokens = tokens[used:] if len(tokens) > most else []


def runs(sizes: np.ndarray, most: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(first block, block after the last, tokens carried over) of each chunk, from running sums of the blocks' sizes.

    A run ends before the block that would take it over `most` together with what it carries: the last `overlap` tokens of the run before, which it
    carries even if its first block then takes it over. A block that is too large by itself is a run of its own and passes nothing on.
    """
    ends = np.cumsum(sizes)
    large = np.append(np.flatnonzero(sizes > most), len(sizes))
    at, carried = 0, 0
    while at < len(sizes):
        stop = int(large[np.searchsorted(large, at)])
        if stop == at:
            yield at, at + 1, 0
            at, carried = at + 1, 0
            continue
        before = ends[at] - sizes[at]
        until = min(stop, max(at + 1, int(np.searchsorted(ends, before + most - carried, "right"))))
        yield at, until, carried
        carried = int(min(overlap, carried + ends[until - 1] - before)) if until < stop else 0
        at = until


def pack(text: str, most: int = 512, overlap: int = 64) -> list[str]:
    """Chunks of the blocks of a text, about `most` tokens each; but for the first one and after a large block they begin with the end of the one before."""
    blocks = text_blocks(text)
    out: list[str] = []
    for first, stop, carried in runs(np.array([len(portable(b)) for b in blocks], np.int64), most, overlap):
        tail = ["".join(portable(out[-1])[-carried:])] if carried else []
        whole = "\n\n".join(tail + blocks[first:stop])
        out += [whole] if stop - first > 1 or tail or len(portable(whole)) <= most else long_block(whole, most)
    return out


def sections(text: Column, mail: Column) -> Column:
    """array of struct(label, text): a mail up to its first quoted reply and from there on, any other text whole."""
    at = F.regexp_instr(text, F.lit(REPLY))
    whole = F.struct(F.lit("body").alias("label"), text.alias("text"))
    parts = F.array(F.struct(F.lit("body").alias("label"), F.substring(text, F.lit(1), at - 1).alias("text")), F.struct(F.lit("quoted_reply").alias("label"), F.substring(text, at, F.length(text)).alias("text")))
    return F.when(mail & (at > 0), F.filter(parts, lambda s: s["text"].rlike(r"\S"))).otherwise(F.array(whole))


def chunk(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: Column | None = None, most: int = 512, overlap: int = 64) -> DataFrame:
    """(key, chunk_index, section, text, token_count): each text's chunks in order; mails (kind 'email') are cut at the first reply mark first.

    Null and blank texts have no chunks. Each text is worked on whole where it is read; a batch of chunks leaves the task at a time.
    """
    mail = F.coalesce(kind == "email", F.lit(False)) if kind is not None else F.lit(False)
    rows = docs.filter(F.col(text).rlike(r"\S")).select(F.col(key).alias("id"), sections(F.col(text), mail).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "chunk_index", "section", "text", "token_count"]
        for pdf in batches:
            out = []
            for i, parts in zip(pdf["id"], pdf["parts"], strict=True):
                found = [(p["label"], c) for p in parts for c in pack(p["text"].strip() if len(parts) > 1 else p["text"], most, overlap)]
                out += [(i, n, label, c, len(portable(c))) for n, (label, c) in enumerate(found)]
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType)]).add("chunk_index", "integer").add("section", "string").add("text", "string").add("token_count", "integer")
    return rows.mapInPandas(run, schema).withColumnRenamed("id", key)


def redacted(text: Column, spans: Column, mark: Column) -> Column:
    """text with its spans (array of struct(start, end), in any order) replaced by mark; spans that overlap or touch are one. Null spans leave it as it is."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = (s["start"] > acc["at"]) | (acc["out"] == "")
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))

    ordered = F.array_sort(F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))
    return F.when(spans.isNull(), text).otherwise(F.aggregate(ordered, begin, step, rest))


def still_there(text: Column, removed: Column) -> Column:
    """Does any of the removed strings occur in text?"""
    return F.exists(removed, lambda r: (r != "") & text.contains(r))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("a_from", T.IntegerType()), T.StructField("a_to", T.IntegerType()), T.StructField("b_from", T.IntegerType()), T.StructField("b_to", T.IntegerType())])))
def line_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Opcodes (equal, replace, delete, insert) that turn the lines of a into those of b."""
    find = lambda x, y: [dict(zip(("op", "a_from", "a_to", "b_from", "b_to"), c, strict=True)) for c in difflib.SequenceMatcher(None, x.split("\n"), y.split("\n"), False).get_opcodes()]
    return pd.Series([find(x or "", y or "") for x, y in zip(a, b, strict=True)])
