"""License texts and notices in documents, by patience alignment of words with templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm.common import give_back, small_batches, spans, text_bytes
from foliant.llm.words import words

FOLDER = Path(__file__).parent / "licenses"
#: Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")
KEEP = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
#: What a broadcast of templates may hold.
MOST_TEMPLATES, MOST_WORDS = 1_000, 500_000
CHUNK = 1 << 20


@dataclass
class Template:
    """words: ids in the vocabulary; needed: ids of the words without which a notice is another license's."""

    license: str
    words: list[int]
    needed: list[int]


@dataclass
class Templates:
    hashes: np.ndarray  # of the vocabulary, sorted; a word's id is its place
    all: list[Template]


def bare(text: str) -> list[str]:
    return [w.translate(LOWER) for w in WORD.findall(text)]


LOWER = {c: c + 32 for c in range(65, 91)}


def bundled() -> list[tuple[str, str]]:
    """(license, text) of foliant/llm/licenses: whole texts by file name, and the lines of notices.txt, whose needed words stand in braces."""
    texts = [(p.stem, p.read_text(encoding="utf-8").replace("{", " ").replace("}", " ")) for p in sorted(FOLDER.glob("*.txt")) if p.stem != "notices"]
    lines = (FOLDER / "notices.txt").read_text(encoding="utf-8").splitlines()
    return texts + [(name.strip(), text) for name, text in (x.split("|", 1) for x in lines if x.strip())]


def compiled(templates: list[tuple[str, str]]) -> Templates:
    lists = [(name, bare(text), [w for x in re.findall(r"\{(.*?)\}", text) for w in bare(x)]) for name, text in templates]
    lists = [x for x in lists if x[1]]
    if len(lists) > MOST_TEMPLATES or sum(len(x[1]) for x in lists) > MOST_WORDS:
        raise ValueError(f"over {MOST_TEMPLATES} templates or {MOST_WORDS} words of them")
    vocabulary = sorted({w for x in lists for w in x[1]})
    data = "".join(w + " " for w in vocabulary).encode()
    hashes = words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash if vocabulary else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    place = {vocabulary[k]: n for n, k in enumerate(order)}
    return Templates(hashes[order], [Template(name, [place[w] for w in ws], [place[w] for w in dict.fromkeys(need)]) for name, ws, need in lists])


def unique_places(seq: list[int], lo: int, hi: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for k in range(lo, hi):
        out[seq[k]] = -1 if seq[k] in out else k
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), both rising. The longest rising run of words that are unique in both are anchors, and so again in
    each gap between them; in a gap without such words, equal words at its start match, else those at its end."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        ours, theirs = unique_places(a, alo, ahi), unique_places(b, blo, bhi)
        both = [(i, theirs[w]) for w, i in ours.items() if i >= 0 and theirs.get(w, -1) >= 0]
        if both:
            both.sort()
            tops: list[int] = []
            piles: list[int] = []
            back: list[int] = []
            for n, (_, j) in enumerate(both):
                k = bisect_left(tops, j)
                back.append(piles[k - 1] if k else -1)
                tops[k : k + 1], piles[k : k + 1] = [j], [n]
            n, i1, j1 = piles[-1], ahi, bhi
            while n >= 0:
                i, j = both[n]
                out.append((i, j))
                todo.append((i + 1, i1, j + 1, j1))
                n, i1, j1 = back[n], i, j
            todo.append((alo, i1, blo, j1))
            continue
        n = 0
        while alo + n < ahi and blo + n < bhi and a[alo + n] == b[blo + n]:
            out.append((alo + n, blo + n))
            n += 1
        if n:
            todo.append((alo + n, ahi, blo + n, bhi))
            continue
        while alo < ahi - n and blo < bhi - n and a[ahi - 1 - n] == b[bhi - 1 - n]:
            n += 1
            out.append((ahi - n, bhi - n))
        if n:
            todo.append((alo, ahi - n, blo, bhi - n))
    return sorted(out)


def shape(m: int, least: float) -> tuple[int, int, int]:
    """(words of a window, words between windows, words that must match) for a template of m words. A stretch of up to a window less
    the step lies whole in some window."""
    step = max(1, m // 4)
    return m + max(2, m // 2), step, max(1, int(np.ceil(least * m - 1e-9)))


def picked(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first, last, matched): the most matched first, those that overlap a picked one left out."""
    out: list[tuple[int, int, int]] = []
    for x in sorted(set(found), key=lambda x: (-x[2], x[1] - x[0], x[0])):
        if all(x[1] < y[0] or x[0] > y[1] for y in out):
            out.append(x)
    return sorted(out)


def scan(column: pa.Array, templates: Templates, least: float) -> Iterator[tuple[int, str, int, int, int, int, bool]]:
    """(row, license, first word, last word, matched, words of the template, best) of each occurrence in a column of texts."""
    data, offsets = text_bytes(column)
    size = len(templates.hashes)
    member = []
    for t in templates.all:
        count = np.zeros(size + 1, np.int32)
        np.add.at(count, t.words, 1)
        member.append((count, count > 0))
    for i, j in spans(offsets, CHUNK):
        w = words(KEEP[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], lower=True)
        if not len(w.hash) or not size:
            continue
        at = np.minimum(np.searchsorted(templates.hashes, w.hash), size - 1)
        ids = np.where(templates.hashes[at] == w.hash, at, size).astype(np.int32)
        in_vocabulary = np.flatnonzero(ids < size)
        order = in_vocabulary[np.argsort(ids[in_vocabulary], kind="stable")]
        start_of = np.searchsorted(ids[order], np.arange(size + 1))
        length = np.diff(w.first)
        rows: dict[int, list] = {}
        for t, (count, isin) in zip(templates.all, member, strict=True):
            m = len(t.words)
            window, step, need = shape(m, least)
            if t.needed:
                # Only windows with the needed word that is rarest here.
                k = min(t.needed, key=lambda x: start_of[x + 1] - start_of[x])
                hits = order[start_of[k] : start_of[k + 1]]
                row = w.row[hits]
                inside = hits - w.first[row]
                steps = np.arange(window // step + 1)
                number = (inside // step)[:, None] - steps[None, :]
                row, inside = np.repeat(row, len(steps)), np.repeat(inside, len(steps))
                number = number.ravel()
                last = np.maximum(0, -(-(length[row] - window) // step))
                ok = (number >= 0) & (number <= last) & (number * step + window > inside) & (length[row] >= need)
                row, number = row[ok], number[ok]
                both = np.unique(np.stack([row, number]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
                row, number = both[0], both[1]
            else:
                long = np.flatnonzero(length >= need)
                n = np.maximum(0, -(-(length[long] - window) // step)) + 1
                row = np.repeat(long, n)
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if not len(row):
                continue
            lo = w.first[row] + number * step
            hi = np.minimum(lo + window, w.first[row + 1])
            total = np.concatenate([[0], np.cumsum(isin[ids], dtype=np.int64)])
            ok = total[hi] - total[lo] >= need
            found: dict[int, list] = {}
            for r, p, q in zip(row[ok].tolist(), lo[ok].tolist(), hi[ok].tolist(), strict=True):
                # As many of the template's words, each as often as both have it, must stand in the window.
                place, often = np.unique(ids[p:q], return_counts=True)
                if np.minimum(often, count[place]).sum() < need:
                    continue
                pairs = patience(ids[p:q].tolist(), t.words)
                if len(pairs) < need:
                    continue
                got = {t.words[y] for _, y in pairs}
                if all(x in got for x in t.needed):
                    base = p - int(w.first[r])
                    found.setdefault(r, []).append((base + pairs[0][0], base + pairs[-1][0], len(pairs)))
            for r, x in found.items():
                rows.setdefault(r, []).extend((t.license, *y, m) for y in picked(x))
        for r in sorted(rows):
            taken: list[tuple[int, int]] = []
            for name, first, last, matched, m in sorted(rows[r], key=lambda x: (-x[3], -x[3] / x[4], x[1], x[0], x[4])):
                best = all(last < y[0] or first > y[1] for y in taken)
                if best:
                    taken.append((first, last))
                yield i + r, name, first, last, matched, m, best


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, first_word, last_word, matched, template_words, coverage, best): one row for each place of a text where a template is covered.

    Each window of a text (half as long again as the template, a quarter of it apart, so that all of a text is seen) is aligned with the
    template; coverage is the share of the template's words that match. Windows that cannot reach `least` by their counts of the
    template's words are not aligned. Of windows of one template that overlap, the one with most matches counts; `best` marks those that no
    occurrence with more matches overlaps. A notice's words in braces must match. Nothing is shuffled; templates are broadcast, MOST_TEMPLATES
    and MOST_WORDS at most. Null and empty text give no row; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(compiled(bundled() if templates is None else templates))
    out = [("license", "string"), ("first_word", "long"), ("last_word", "long"), ("matched", "long"), ("template_words", "long"), ("coverage", "double"), ("best", "boolean")]
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType)])
    for name, kind in out:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in give_back(batches):
            rows = list(scan(batch.column(text_col), model.value, least))
            if rows:
                at, name, first, last, matched, m, best = map(list, zip(*rows, strict=True))
                numbers = [pa.array(x, pa.int64()) for x in (first, last, matched, m)]
                share = pa.array([x / y for x, y in zip(matched, m, strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(at)), pa.array(name, pa.string()), *numbers, share, pa.array(best, pa.bool_())], ["_id", *(x for x, _ in out)])

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
