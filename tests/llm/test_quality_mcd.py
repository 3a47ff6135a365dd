"""Minimum-covariance-determinant verdicts against numpy over whole groups, and against many random starts."""

import random
from collections import defaultdict
from math import ceil, floor, log1p, sqrt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import queries
from foliant.llm.quality import FINE, FLOOR, GRID, OCTAVE, chi2_quantile, chi2_share, mcd_model, mcd_outliers

from .helpers import SF

K, SHARE, STEPS = 5, 0.75, 5
WIDE = np.array(FLOOR) * GRID
SCALE = SHARE / chi2_share(chi2_quantile(SHARE, K), K + 2)


def squared(x, centre, cov):
    off = x - centre
    return np.maximum(np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov), off), 0)


def concentrate(x, centre, cov, steps=STEPS):
    for _ in range(steps):
        b = np.floor(np.log2(squared(x, centre, cov) + 1e-9) * OCTAVE)
        near = x[b <= np.sort(b)[ceil(len(x) * SHARE) - 1]]
        centre = near.mean(0)
        cov = ((near.T @ near) / len(near) - np.outer(centre, centre)) * SCALE + np.diag(WIDE**2)
    return np.linalg.slogdet(cov)[1], centre, cov


def estimate(x):
    """(log determinant, centre, covariance): the best of three starts."""
    med = np.median(x, 0)
    scale = np.maximum(1.4826 * np.median(np.abs(x - med), 0), WIDE)
    z = (x - med) / scale
    shapes = [np.eye(K)]
    for y in (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12), np.tanh(z)):
        m = np.round(y[:, :, None] * y[:, None, :] * FINE).sum(0) / FINE / len(x)
        shapes.append(m + np.eye(K) * 0.01 * max(np.trace(m) / K, 1e-6))
    return min((concentrate(x, med, m * np.outer(scale, scale)) for m in shapes), key=lambda e: e[0])


def verdicts(rows):
    """{id: outlier} of (id, lang, source, five whole numbers)."""
    groups = defaultdict(list)
    for i, lang, source, *x in rows:
        for key in ((lang, source), (lang,), ()):
            groups[key].append((i, x))
    known, out = {}, {}
    for i, lang, source, *x in rows:
        key = next((k for k in ((lang, source), (lang,)) if len(groups[k]) >= 5 * K), ())
        if len(groups[key]) < 5 * K:
            out[i] = False
            continue
        if key not in known:
            known[key] = estimate(np.array([y for _, y in groups[key]], float))
        out[i] = bool(squared(np.array([x], float), *known[key][1:])[0] > chi2_quantile(0.99999, K))
    return out


def judge(spark, rows):
    frame = spark.createDataFrame([(i, a, b, *map(float, x)) for i, a, b, *x in rows], "id long, a string, b string, " + ", ".join(f"x{k} double" for k in range(K)))
    return mcd_outliers(frame, ["a", "b"], {f"d{k}": F.col(f"x{k}") / GRID for k in range(K)}, FLOOR)


def drawn(rng, n, start, lang, source, far=0.0):
    """Correlated rows, a share of which is moved away together."""
    out = []
    for k in range(n):
        base = rng.gauss(0, 1)
        x = [1200 + 200 * base, 1200 + 100 * base + rng.gauss(0, 40), rng.gauss(20, 10), rng.gauss(10, 8), rng.gauss(12, 6)]
        if k < far * n:
            x = [x[0], x[1] + 900, x[2] + 400, x[3], x[4] + 300]
        out.append((start + k, lang, source, *map(round, x)))
    return out


def test_equals_numpy(spark):
    rng = random.Random(12)
    rows = drawn(rng, 400, 0, "en", "a", 0.1) + drawn(rng, 60, 1000, "en", "b", 0.05) + drawn(rng, 20, 2000, "en", "c", 0.1) + drawn(rng, 24, 3000, "de", "a") + drawn(rng, 7, 4000, "fr", "x")
    rows += [(5000 + k, "es", "tied", 5, 5, 5, 5, 5) for k in range(40)] + [(6000, "es", "tied", 5, 5, 5, 5, 900)]
    out = judge(spark, rows).collect()
    assert len(out) == len(rows)
    want = verdicts(rows)
    assert {r.id: r.outlier for r in out} == want
    assert all(want[k] for k in (*range(40), 1000, 1001, 1002, 2000, 2001, 6000)) and sum(want.values()) < 50
    assert judge(spark, []).count() == 0


def test_least_determinant(spark):
    """No random start of 300 finds an estimate of clearly smaller determinant."""
    rows = drawn(random.Random(3), 300, 0, "en", "a", 0.22)
    x = np.array([r[3:] for r in rows], float)
    frame = spark.createDataFrame([("g", *map(int, r)) for r in x], "g string, " + ", ".join(f"q{k} long" for k in range(K)))
    det = mcd_model(frame, [f"q{k}" for k in range(K)], WIDE, SHARE, STEPS).first()["det"]
    draw = np.random.default_rng(5)
    best = np.inf
    for _ in range(300):
        part = x[draw.choice(len(x), K + 1, replace=False)]
        best = min(best, concentrate(x, part.mean(0), np.cov(part.T) + np.diag(WIDE**2))[0])
    assert det <= best + 0.05


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_query(spark):
    """op9 over a whole table, statistics included, by plain Python."""
    from .test_operators import stats

    grid, base, total = [], {}, {}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for r in docs:
        n, chars, signs, dup, again = base[r.doc_id] = stats(r.text)
        if n < 20 or 100 * again > 30 * n:
            continue
        lines = sum(1 for x in r.text.split("\n") if x.split())
        x = (log1p(n), min(chars / n, 64), min(sqrt(signs / n), 16), dup / max(lines, 1), again / n)
        grid.append((r.doc_id, r.lang or "", r.source or "", *(floor(v * GRID + 0.5) for v in x)))
    total = verdicts(grid)
    out = queries.op9_quality(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base[r.doc_id]
        assert r.base_failed == (r.doc_id not in total) and r.kept == (not total.get(r.doc_id, True))
