"""Language ID with hyperdimensional n-gram profiles."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import cut, give_back, small_batches, spans, text_bytes
from foliant.llm.words import mixed

#: Dimensions of the vectors.
DIMENSIONS = 1024
#: Bits of a letter (a code point; 0 is the gap between words) in a trigram, trigrams whose vectors a worker holds at once, and rows bundled together.
BITS, SLICE, ROWS = 21, 4096, 128
#: Bytes of text, and distinct trigrams with their counts, that a worker holds.
CHUNK, HELD = 1 << 19, 1 << 18
#: Weights are whole numbers of this unit, so that sums don't depend on their order.
UNIT = 1 << 24
TABLE: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """The lower-case letter of every code point; 0 for all that are no letters."""
    if not TABLE:
        table = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(unicodedata.normalize("NFC", ch.lower())[0])
        TABLE.append(table)
    return TABLE[0]


def trigrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from row, to row, row of each trigram, trigram, rows with a letter). Runs of other characters are one gap; words have gaps at both ends."""
    _, offsets = text_bytes(column)
    table = letter_table()
    for i, j in spans(offsets, CHUNK):
        texts = column.slice(i, j - i).to_pylist()
        size = np.array([len(t or "") for t in texts], np.int64)
        points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        # A gap stands before each text and after the last.
        at = np.arange(len(points)) + np.repeat(np.arange(1, len(texts) + 1), size)
        code, row = np.zeros(len(points) + len(texts) + 1, np.int64), np.repeat(np.arange(len(texts) + 1), np.append(size + 1, 1))
        code[at] = table[points]
        letters = np.bincount(row[code > 0], minlength=len(texts) + 1)[: len(texts)] > 0
        keep = np.append(True, (code[1:] > 0) | (code[:-1] > 0) | (row[1:] != row[:-1]))
        code, row = code[keep], row[keep]
        gram = (code[:-2] << 2 * BITS) | (code[1:-1] << BITS) | code[2:]
        one = (code[1:-1] > 0) & (row[:-2] == row[1:-1])
        yield i, j, row[1:-1][one], gram[one], letters


def letter_vectors(letters: np.ndarray, seed: int) -> np.ndarray:
    """The random sign vector of each letter, drawn from its code point and the seed."""
    start = np.frombuffer(hashlib.sha256(f"letters {seed}".encode()).digest()[:8], np.uint64)
    word = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    drawn = mixed(mixed(letters.astype(np.uint64)[:, None] + start) + word + np.uint64(1))
    return (np.unpackbits(drawn.view(np.uint8), axis=1).view(np.int8) << 1) - np.int8(1)


def gram_vectors(grams: np.ndarray, seed: int) -> np.ndarray:
    """Bind: the product of the letters' vectors, those of the first and second letter permuted (rolled) by 2 and 1."""
    parts = [grams >> 2 * BITS, grams >> BITS & (1 << BITS) - 1, grams & (1 << BITS) - 1]
    letters, at = np.unique(np.concatenate(parts), return_inverse=True)
    vectors, (a, b, c) = letter_vectors(letters, seed), np.split(at, 3)
    return np.roll(vectors, 2, 1)[a] * np.roll(vectors, 1, 1)[b] * vectors[c]


@dataclass
class Profiles:
    """Prototypes by language, 4 KB each, and their mean as the last row; trigrams' vectors are made from the seed where they are needed."""

    langs: list[str]
    prototypes: np.ndarray
    seed: int


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", seed: int = 11, most_langs: int = 10_000) -> Profiles:
    """Prototypes from all trigrams of all rows of labelled with a language.

    Spark adds up the counts by language and trigram. A language's prototype bundles the vectors of all its trigrams by the root of their share;
    these bundles are sums as well, and only DIMENSIONS numbers a language reach the driver, which takes the mean of all prototypes off each.
    Rows without a language or text are passed over. Over most_langs languages are an error: there are fewer than 8,000 in the world.
    """
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return gram, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def flush(sums: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang in list(sums):
            gram, n = merge(sums.pop(lang))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in give_back(batches):
            langs = batch.column("lang").dictionary_encode()
            names, index = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for i, j, row, gram, _ in trigrams(batch.column("text")):
                which = index[i:j][row]
                for k in np.unique(which):
                    sums.setdefault(names[k], []).append(np.unique(gram[which == k], return_counts=True))
                if sum(len(g) for parts in sums.values() for g, _ in parts) > 2 * HELD:
                    sums = {lang: [merge(parts)] for lang, parts in sums.items()}
                    if sum(len(parts[0][0]) for parts in sums.values()) > HELD:
                        yield from flush(sums)
        yield from flush(sums)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            index, gram = langs.indices.to_numpy(), batch.column("gram").to_numpy()
            weight = np.rint(np.sqrt(batch.column("share").to_numpy()) * UNIT)
            total = np.zeros((len(langs.dictionary), DIMENSIONS))
            for k in range(0, len(gram), SLICE):
                vectors = gram_vectors(gram[k : k + SLICE], seed).astype(np.float64)
                for m in np.unique(index[k : k + SLICE]):
                    own = index[k : k + SLICE] == m
                    total[m] += weight[k : k + SLICE][own] @ vectors[own]
            names = np.repeat(langs.dictionary.to_pylist(), DIMENSIONS)
            at = np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(total))
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(at), pa.array(total.ravel().astype(np.int64))], ["lang", "at", "value"])

    counts = small_batches(labelled).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = cut(counts, "grams")
    whole = counts.groupBy("lang").agg(F.sum("n").alias("all")).limit(most_langs + 1)
    if whole.count() > most_langs:
        raise ValueError(f"over {most_langs} languages")
    shares = counts.join(F.broadcast(whole), "lang").select("lang", "gram", (F.col("n") / F.col("all")).alias("share"))
    sums = shares.mapInArrow(bundle, "lang string, at int, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).select("lang", "v.value").collect()
    found.sort(key=lambda r: r.lang)
    prototypes = np.array([r.value for r in found], np.float64).reshape(len(found), DIMENSIONS) / UNIT
    centre = prototypes.mean(0) if len(found) > 1 else np.zeros(DIMENSIONS)
    return Profiles([r.lang for r in found], np.vstack([prototypes - centre, centre[None]]).astype(np.float32), seed)


def bundles(row: np.ndarray, gram: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """The vector of each text: its trigrams' vectors, bundled by the root of their share of the text."""
    out = np.zeros((rows, DIMENSIONS), np.float32)
    distinct, at = np.unique(gram, return_inverse=True)
    total = np.maximum(np.bincount(row, minlength=rows), 1).astype(np.float32)
    for k in range(0, len(distinct), SLICE):
        here = distinct[k : k + SLICE]
        inside = slice(None) if len(distinct) <= SLICE else (at >= k) & (at < k + SLICE)
        counts = np.bincount(row[inside] * len(here) + at[inside] - k, minlength=rows * len(here)).reshape(rows, len(here))
        out += np.sqrt(counts / total[:, None], dtype=np.float32) @ gram_vectors(here, seed).astype(np.float32)
    return out


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of docs and the language whose prototype has the largest cosine with the document's vector, and that cosine, 0 at least.

    A document's vector bundles the vectors of its trigrams by the roots of their shares, less the prototypes' mean. Null text, text without
    a letter, or no learned language give `und` and 0. Letters that no language has give a vector that is nearly at right angles to all prototypes,
    so a score near 0. Ties go to the first language in code point order. Columns named lang_col or score_col are replaced. Repeated rows get equal
    results. Nothing is shuffled; a text of any length is worked on whole, by SLICE distinct trigrams at a time.
    """
    kept = [c for c in docs.columns if c not in (lang_col, score_col)]
    schema = docs.select(*kept).schema.add(lang_col, "string").add(score_col, "double")
    norms = np.linalg.norm(profiles.prototypes[:-1], axis=1, keepdims=True)
    langs, unit, centre, seed = profiles.langs, (profiles.prototypes[:-1] / np.maximum(norms, 1e-12)).T, profiles.prototypes[-1], profiles.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(batches):
            for i, j, row, gram, letters in trigrams(batch.column(text_col)):
                best, score = np.zeros(j - i, np.int64), np.zeros(j - i)
                for k in range(0, j - i if langs else 0, ROWS):
                    m = min(ROWS, j - i - k)
                    lo, hi = np.searchsorted(row, (k, k + m))
                    vector = bundles(row[lo:hi] - k, gram[lo:hi], m, seed)
                    vector -= centre * (np.abs(vector).sum(1, keepdims=True) > 0)
                    cosine = vector @ unit / np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
                    best[k : k + m], score[k : k + m] = cosine.argmax(1), cosine.max(1)
                und = ~letters if langs else np.ones(j - i, bool)
                found = ["und" if u else langs[b] for u, b in zip(und, best, strict=True)]
                score = np.where(und, 0.0, np.clip(score, 0, 1))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.string()), pa.array(score, pa.float64())], [*kept, lang_col, score_col])

    return small_batches(docs.select(*kept)).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The rows kept for the measure of accuracy: crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
