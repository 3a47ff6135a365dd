"""Repeated bytes against windows in a dictionary; the registered query against the same."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from foliant.llm import byte_repeats as module
from foliant.llm import queries
from foliant.llm.byte_repeats import Buckets, Shape, byte_repeats, least

from .helpers import BASE, EDGE, SF, frame


def plain(texts, length):
    """(spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1] += 1
                gone[i + 1 + length] -= 1
        gone = np.cumsum(gone) > 0
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        out.append((list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(np.frombuffer(d, np.uint8)[~gone[1 : len(d) + 1]]) if d else b""))
    return out


def compare(spark, rows, length):
    out = byte_repeats(frame(spark, rows), length=length).collect()
    want = sorted(((i, len((t or "").encode()), *map(str, w)) for (i, t, _, _), w in zip(rows, plain([r[1] for r in rows], length), strict=True)), key=str)
    got = sorted(((r.doc_id, r.n_bytes, str(list(zip(r.starts, r.ends, strict=True))), str(bytes(r.kept))) for r in out), key=str)
    assert got == want


def test_least():
    rng = np.random.default_rng(1)
    for n, size in ((1, 1), (10, 3), (64, 16), (100, 100), (33, 32)):
        x = rng.integers(0, 50, n).astype(np.uint64)
        assert least(x, size).tolist() == [x[i : i + size].min() for i in range(n - size + 1)]


def test_buckets():
    data = np.frombuffer(b"abcabcabdabcabcabd" * 3, np.uint8)
    b = Buckets(data, 3)
    at = np.arange(len(data) - 10)
    code = b.refined(at, at + 10)
    for i in at:
        for j in at:
            assert (code[i] == code[j]) == (data[i : i + 10].tobytes() == data[j : j + 10].tobytes())
    assert [Shape.of(n).gram for n in (2, 3, 5, 20, 400)] == [2, 2, 4, 11, 97]


@pytest.mark.parametrize("length", [2, 5, 20])
def test_random_texts(spark, length):
    """Letters of a few kinds, runs of one letter, copies with changes: overlaps within a text and across texts, at any edge."""
    rng = random.Random(length)
    base = "".join(rng.choice("abcdé") for _ in range(120))
    texts = ["a" * 60, "ab" * 30, base, base, base[:50] + "Z" + base[51:], base[30:90], "x" + base[60:] + base[:25]]
    for _ in range(60):
        i, j = sorted(rng.sample(range(121), 2))
        texts.append("".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) + base[i:j] + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))))
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(3, base, "en", "s"), (None, base[:70], "en", "s"), (None, None, None, None)]
    compare(spark, rows, length)


def test_pieces(monkeypatch):
    """Texts longer than a piece, and pieces with many texts, give the same windows."""
    monkeypatch.setattr(module, "PIECE", 64)
    rng, shape = random.Random(4), Shape.of(20)
    texts = ["".join(rng.choice("abc") for _ in range(n)).encode() for n in (300, 0, 5, 19, 20, 21, 64, 85, 130)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    seen = Counter()
    for row, p, a, b, _, _ in module.anchored(data, offsets, shape):
        nodes = (p, a, b)
        ones = [x for part in module.single(data, offsets, row, nodes, shape) for x in zip(part[0].tolist(), part[2].tolist(), part[5].tolist(), strict=True)]
        cells = [x for part in module.split(data, offsets, row, nodes, shape) for k in range(len(part[0])) for x in range(part[2][k], part[3][k] + 1)]
        assert len(cells) == len(ones) == sum((b - a + 1).tolist())
        seen.update(ones)
    assert sorted((r, i) for r, i, _ in seen) == [(r, i) for r, t in enumerate(texts) for i in range(len(t) - 19)] and set(seen.values()) == {1}
    codes = {}
    for r, i, code in seen:
        assert codes.setdefault(texts[r][i : i + 20], code) == code
    assert len(set(codes.values())) == len(codes)


def test_edges(spark):
    compare(spark, [*EDGE, (30, "tail " + BASE[50:], "en", "a"), (31, "x" * 399, "en", "a"), (32, "x" * 400, "en", "a")], 400)
    assert byte_repeats(frame(spark, [(1, "", "en", "a")]).filter("doc_id > 1")).collect() == []
    with pytest.raises(ValueError, match="length"):
        byte_repeats(frame(spark, EDGE), length=1)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = {r.doc_id: r for r in queries.op12_byte_repeats(spark, SF).collect()}
    assert len(out) == len(docs)
    for d, (spans, kept) in zip(docs, plain([d.text for d in docs], 400), strict=True):
        r = out[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(d.text.encode()), sum(b - a for a, b in spans), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
