"""Periodic runs of words, from Lyndon arrays that a suffix sorter's first phase yields under both orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import give_back, small_batches, spans, text_bytes
from foliant.llm.words import Words, mixed, powers, words

#: Bytes of text that a Python worker cuts into words at once; a longer text stands alone.
CHUNK = 1 << 19
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))


def lyndon_lengths(letters: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each letter; letters are 1, 2, ... in their order, 0 ends a sequence (its own entry is 0).

    Grouping phase of a suffix sorter: suffixes start in groups by their first letter, and groups are taken from the highest down. A suffix of the group in
    hand has its final context, its longest Lyndon prefix; the nearest suffix to its left that is still waiting, which lies in a lower group, has
    its context lengthened by it. Suffixes of one group that are lengthened by as many copies move together into a group next above their own.
    The suffixes that wait are a linked list, so each is looked at once.
    """
    n = len(letters)
    out = np.zeros(n + 1, np.int64).tolist()
    kinds = int(letters.max()) + 1 if n else 1
    by_letter = np.argsort(letters, kind="stable")
    ends = np.searchsorted(letters[by_letter], np.arange(kinds + 1))
    members = [by_letter[ends[k] : ends[k + 1]].tolist() for k in range(kinds)]
    size = [1] * kinds
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    group = [*letters.tolist(), 0]
    left, right = [n, *range(n)], [*range(1, n + 1), 0]
    g = kinds - 1
    while g > 0:
        width, counts = size[g], {}
        for i in sorted(j for j in members[g] if group[j] == g):
            before, after = left[i], right[i]
            right[before], left[after] = after, before
            out[i] = width
            if group[before]:
                counts[before] = counts.get(before, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in counts.items():
            moved.setdefault((k, group[j]), []).append(j)
        for k, old in sorted(moved, reverse=True):
            new = len(size)
            size.append(size[old] + k * width)
            members.append(moved[k, old])
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            below[up] = new
            for j in members[new]:
                group[j] = new
        members[g] = []
        g = below[g]
    return np.array(out[:n], np.int64)


def ahead(code: np.ndarray, a: int, b: int) -> int:
    """Longest common extension: how many entries from a on equal those from b on (a < b)."""
    k, step = 0, 16
    while b + k < len(code):
        m = min(step, len(code) - b - k)
        differs = code[a + k : a + k + m] != code[b + k : b + k + m]
        if differs.any():
            return k + int(differs.argmax())
        k, step = k + m, step * 4
    return k


def find_runs(letters: np.ndarray, exponent: int, length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least `exponent` periods and `length` letters, by start and period.

    Every run has a Lyndon root under one of the two orders of letters at least, and the Lyndon array of that order has the root at each place where
    it lies in the run. Roots that repeat are extended both ways by their longest common extensions.
    """
    n = len(letters)
    if not n:
        return []
    # Ends of sequences are equal to nothing.
    code = np.where(letters > 0, letters, -np.arange(1, n + 1))
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(code.astype(np.uint64)) * up[:n], out=total[1:])
    roots = []
    for order in (letters, np.where(letters > 0, letters.max() + 1 - letters, 0)):
        period = lyndon_lengths(order)
        i = np.flatnonzero((period > 0) & (np.arange(n) + (exponent - 1) * period <= n))
        q = period[i]
        # Equal parts have equal sums; what passes is compared letter by letter below.
        span = (exponent - 2) * q
        i, q = (x[(total[i + span] - total[i]) * down[i] == (total[i + q + span] - total[i + q]) * down[i + q]] for x in (i, q))
        roots.append(np.stack([q, i]))
    q, i = np.concatenate(roots, axis=1)
    at = np.lexsort((i, q))
    q, i = q[at], i[at]
    # Roots of one period that overlap or touch lie in one run when they repeat.
    new = np.append(True, (q[1:] != q[:-1]) | (i[1:] - i[:-1] > q[1:])) if exponent > 2 and len(q) else np.ones(len(q), bool)
    found, back = {}, code[::-1]
    for period, start in zip(q[new].tolist(), i[new].tolist(), strict=True):
        end = start + period + ahead(code, start, start + period)
        start -= ahead(back, n - start - period, n - start)
        if end - start >= max(length, exponent * period):
            found[start, end] = min(period, found.get((start, end), period))
    return [(start, end - start, period) for (start, end), period in sorted(found.items(), key=lambda x: (x[0][0], x[1]))]


def repeated_stretches(w: Words, exponent: int, length: int) -> np.ndarray:
    """True for words that may lie in a run: those of windows (2 or 3 words) that occur often enough in the text.

    Any window of 2 words within a run of e periods occurs e - 1 times at least, as does one of 3 words if a run has over e words; so a run lies
    within one stretch of such windows, and so do the words that end it or the stretch ends with it.
    """
    size = 3 if length > exponent else 2
    n = len(w.hash)
    inside = np.zeros(n + 1, np.int64)
    at = np.arange(max(0, n - size + 1))
    at = at[w.row[at] == w.row[at + size - 1]] if len(at) else at
    key = mixed(w.row[at].astype(np.uint64) + np.uint64(1))
    for k in range(size):
        key = mixed(key + w.hash[at + k])
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1]) if len(at) else np.zeros(0, bool)
    often = np.zeros(len(at), bool)
    if len(at):
        first = np.flatnonzero(new)
        often[order] = np.repeat(np.diff(np.append(first, len(at))), np.diff(np.append(first, len(at)))) >= exponent - 1
    np.add.at(inside, at[often], 1)
    np.add.at(inside, at[often] + size, -1)
    return np.cumsum(inside)[:n] > 0


def runs_of_words(data: np.ndarray, w: Words, exponent: int, length: int) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of the runs of several texts; start is the number of a word in its text."""
    inside = repeated_stretches(w, exponent, length)
    begin = inside & np.append(True, ~inside[:-1] | (w.row[1:] != w.row[:-1]))[: len(inside)]
    if not inside.any():
        return []
    at = np.flatnonzero(inside)
    stretch = np.cumsum(begin)[at]
    size = np.bincount(stretch)
    at, stretch = at[size[stretch] >= length], stretch[size[stretch] >= length]
    if not len(at):
        return []
    # Words themselves, not their hashes, make the letters.
    raw = data.tobytes()
    names: dict[bytes, int] = {}
    letter = np.array([names.setdefault(raw[a:b], len(names) + 1) for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)], np.int64)
    shift = np.cumsum(np.append(False, stretch[1:] != stretch[:-1]))
    letters, place = np.zeros(len(at) + int(shift[-1]), np.int64), np.zeros(len(at) + int(shift[-1]), np.int64)
    letters[np.arange(len(at)) + shift] = letter
    place[np.arange(len(at)) + shift] = at
    out = []
    for start, n, period in find_runs(letters, exponent, length):
        word = int(place[start])
        row = int(w.row[word])
        out.append((row, word - int(w.first[row]), n, period))
    return out


def collapsed(data: np.ndarray, w: Words, rows: int, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each text's words that are not dropped, joined by one space."""
    kept = np.flatnonzero(~dropped)
    row = w.row[kept]
    last = np.append(row[1:] != row[:-1], True)[: len(kept)]
    out = data.copy()
    # The byte behind a word that has another after it is white space.
    gap = w.end[kept][~last]
    out[gap] = 32
    edge = np.zeros(len(data) + 2, np.int32)
    edge[w.start[kept]] += 1
    np.add.at(edge, w.end[kept] + ~last, -1)
    mask = np.cumsum(edge)[: len(data)] > 0
    size = np.bincount(row, weights=w.end[kept] - w.start[kept] + ~last, minlength=rows).astype(np.int64)
    return out[mask], np.concatenate([[0], np.cumsum(size)])


def periodic_runs(docs: DataFrame, keep: list[str], text_col: str = "text", exponent: int = 4, length: int = 6) -> DataFrame:
    """The runs of each whole text's words, and the text with every run collapsed to one period.

    A word is a run of bytes other than ASCII white space. A run is a stretch of words of smallest period q, of at least `exponent` * q and `length`
    words, that no neighbouring word extends. exponent is 2 or more.

    Returns the columns `keep`, n_words (long), runs (array of struct<start, length, period>, by start and period, words numbered from 0) and collapsed
    (string: the words that no run contains behind its first q words, joined by one space), a row for each input row. Null and empty texts have no
    words, no runs and an empty collapsed text. Repeated rows give repeated results; null ids pass through; an empty table gives an empty result.
    Only `keep` and the text are read, and columns of other names don't matter; `keep` must not name an output column.

    Texts are independent, so nothing is shuffled. Texts are cut into words by numpy; only words in windows that occur often enough for a run
    (repeated_stretches()) reach the suffix sorter's grouping phase, which takes time in proportion to them.
    """
    if exponent < 2:
        raise ValueError("exponent must be 2 or more")
    clash = {"n_words", "runs", "collapsed"} & set(keep)
    if clash:
        raise ValueError(f"rename {sorted(clash)}: the result has columns of that name")
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_col).alias("text"))
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(batches):
            data, offsets = text_bytes(batch.column("text"))
            for i, j in spans(offsets, CHUNK):
                part = data[offsets[i] : offsets[j]]
                w = words(part, offsets[i : j + 1] - offsets[i])
                runs = sorted(runs_of_words(part, w, exponent, length), key=lambda r: (r[0], r[1], r[3]))
                edge = np.zeros(len(w.hash) + 1, np.int64)
                for row, start, n, period in runs:
                    edge[w.first[row] + start + period] += 1
                    edge[w.first[row] + start + n] -= 1
                text, ends = collapsed(part, w, j - i, np.cumsum(edge)[:-1] > 0)
                cols = np.array(runs, np.int64).reshape(-1, 4).T
                lists = pa.ListArray.from_arrays(
                    np.searchsorted(cols[0], np.arange(j - i + 1)).astype(np.int32), pa.StructArray.from_arrays([pa.array(c) for c in cols[1:]], fields=list(struct))
                )
                strings = pa.StringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text))
                count = pa.array(np.diff(w.first).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names), count, lists, strings], [*names, "n_words", "runs", "collapsed"])

    schema = rows.select(*names).schema.add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    return small_batches(rows).mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep, strict=True)))
