"""Lyndon arrays and runs against their definitions; the registered query against plain Python."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from foliant.llm import queries
from foliant.llm.periodic_runs import find_runs, lyndon_lengths, periodic_runs

from .helpers import EDGE, SF, frame, words


def plain_runs(s, exponent=4, length=6):
    """All stretches whose entries equal those q later, for each q; the smallest q of a stretch is its period."""
    found, code = {}, np.unique(np.array(s, object), return_inverse=True)[1] if len(s) else np.zeros(0, int)
    for q in range(1, len(s) // exponent + 1):
        same = np.concatenate([[0], code[:-q] == code[q:], [0]])
        for i, j in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if j + q - i >= max(length, exponent * q):
                found.setdefault((int(i), int(j + q - i)), q)
    return sorted((a, n, q) for (a, n), q in found.items())


def plain_collapse(s, runs):
    return [x for i, x in enumerate(s) if not any(a + q <= i < a + n for a, n, q in runs)]


def test_lyndon_lengths():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 18))]
        want = []
        for i in range(len(s)):
            lyndon = [j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))]
            want.append(max(lyndon))
        assert lyndon_lengths(np.array(s)).tolist() == want


@pytest.mark.parametrize(("exponent", "length"), [(4, 6), (2, 2), (3, 3), (4, 4), (2, 5)])
def test_runs_of_letters(exponent, length):
    rng = random.Random(exponent * 10 + length)
    for t in range(400):
        s = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(1, 40))]
        if t % 2:
            s = (s[: rng.randint(1, 6)] * 9)[: rng.randint(1, 40)] + s[:5]
        assert find_runs(np.array(s), exponent, length) == plain_runs(s, exponent, length)


def test_long_repeats_take_linear_time():
    assert find_runs(np.array([1] * 300_000), 4, 6) == [(0, 300_000, 1)]
    assert find_runs(np.array([1, 2, 1, 3] * 50_000 + [4]), 4, 6) == [(0, 200_000, 4)]


def test_edges(spark):
    """Null, empty, short, very long and repeated texts; ends of texts don't let a run go on in the next text."""
    rows = [*EDGE, (20, "a b a b a b", "en", "a"), (21, "a b a b a b a b", "en", "a"), (22, "a  b\ta\nb a b a b tail " + "x " * 9 + "é é é é é é", "en", "a")]
    out = periodic_runs(frame(spark, rows), ["doc_id", "n_chars"]).collect()
    assert len(out) == len(rows)
    for r, (i, text, _, _) in zip(sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        w = words(text)
        runs = plain_runs(w)
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs]) == (i, len(w), runs)
        assert r.collapsed == " ".join(plain_collapse(w, runs))
    empty = frame(spark, [(1, "", "en", "a")]).filter("doc_id > 1")
    assert periodic_runs(empty, ["doc_id"]).collect() == []
    with pytest.raises(ValueError, match="rename"):
        periodic_runs(empty.withColumnRenamed("run", "runs"), ["doc_id", "runs"])


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(out) == len(docs)
    for d in docs:
        w, h = words(d.text), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        r = out[d.doc_id]
        best = min(((-n, a, q) for a, n, q in runs), default=None)
        want = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(plain_collapse(w, runs)).encode()).hexdigest()
