"""License scans against brute force: every window, a recursive patience alignment, no filter."""

import math
import random
import re
from pathlib import Path

import pytest

from foliant.llm import queries
from foliant.llm.license_scan import bundled, license_scan

from .helpers import EDGE, LOW, SF, frame

MIT = next(t for n, t in bundled() if n == "MIT" and len(t) > 500)


def split(text):
    return [w.translate(LOW) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010FFFF]+", text or "")]


def longest_rise(pairs):
    """By dynamic programming; of equal runs the one that a patience sort gives."""
    piles = []
    for n, (_, j) in enumerate(pairs):
        k = next((k for k, p in enumerate(piles) if p[-1][0] >= j), len(piles))
        before = piles[k - 1][-1] if k else None
        if k == len(piles):
            piles.append([])
        piles[k].append((j, n, before))
    out, x = [], piles[-1][-1]
    while x:
        out.append(pairs[x[1]])
        x = x[2]
    return out[::-1]


def align(a, b, i=0, j=0):
    if not a or not b:
        return []
    both = [(n, b.index(w)) for n, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    if both:
        out, x, y = [], 0, 0
        for n, m in longest_rise(both):
            out += align(a[x:n], b[y:m], i + x, j + y) + [(i + n, j + m)]
            x, y = n + 1, m + 1
        return out + align(a[x:], b[y:], i + x, j + y)
    if a[0] == b[0]:
        return [(i, j), *align(a[1:], b[1:], i + 1, j + 1)]
    if a[-1] == b[-1]:
        return [*align(a[:-1], b[:-1], i, j), (i + len(a) - 1, j + len(b) - 1)]
    return []


def brute(rows, templates, least=0.8):
    out = []
    for doc_id, text in rows:
        w, all_found = split(text), []
        for name, template in templates:
            t = split(template)
            needed = {x for y in re.findall(r"\{(.*?)\}", template) for x in split(y)}
            size, step, found = len(t) + max(2, len(t) // 2), max(1, len(t) // 4), set()
            for k in range(max(0, math.ceil((len(w) - size) / step)) + 1):
                pairs = align(w[k * step : k * step + size], t)
                if pairs and len(pairs) >= math.ceil(least * len(t) - 1e-9) and needed <= {t[y] for _, y in pairs}:
                    found.add((k * step + pairs[0][0], k * step + pairs[-1][0], len(pairs)))
            kept = []
            for x in sorted(found, key=lambda x: (-x[2], x[1] - x[0], x[0])):
                if all(x[1] < y[0] or x[0] > y[1] for y in kept):
                    kept.append(x)
                    all_found.append((name, *x, len(t)))
        taken = []
        for name, first, last, matched, m in sorted(all_found, key=lambda x: (-x[3], -x[3] / x[4], x[1], x[0], x[4])):
            best = all(last < y[0] or first > y[1] for y in taken)
            if best:
                taken.append((first, last))
            out.append((doc_id, name, first, last, matched, m, round(matched / m, 9), best))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.license, r.first_word, r.last_word, r.matched, r.template_words, round(r.coverage, 9), r.best) for r in df.collect()), key=repr)


def planted():
    rng = random.Random(5)
    filler = [f"f{k}" for k in range(40)] + "the of license software under version 2 3 mit".split()
    lines = [t.replace("{", "").replace("}", "") for _, t in bundled() if len(t) < 200]
    rows = [(1, MIT), (2, MIT + " " + MIT), (3, " ".join(filler) + "\n" + MIT.upper() + "\n" + " ".join(filler)), (4, "Released under the MIT License. Released under the MIT License."), (5, "Released under the BSD License.")]
    for i in range(60):
        w = [rng.choice(filler) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(lines).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(filler)
        rows.append((100 + i, " ".join(w)))
    for i in range(6):
        w = MIT.split()
        for _ in range(10 * i):
            w[rng.randrange(len(w))] = rng.choice(filler)
        rows.append((200 + i, " ".join(w)))
    return rows


def test_planted(spark):
    templates = [(n, t) for n, t in bundled() if len(t) < 1200]
    assert len(templates) > 20
    rows = planted()
    found = got(license_scan(frame(spark, [(i, t, "en", "a") for i, t in rows]), templates))
    assert found == brute(rows, templates)
    best = {(r[0], r[1]) for r in found if r[7]}
    assert {(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "MIT")} <= best
    assert sum(r[0] == 2 and r[7] and r[5] > 100 for r in found) == 2 and sum(r[0] == 4 and r[7] for r in found) == 2
    assert not any(r[0] == 5 and r[1] == "MIT" for r in found)


def test_edge(spark):
    assert got(license_scan(frame(spark, EDGE))) == []
    assert license_scan(frame(spark, [])).count() == 0
    assert license_scan(frame(spark, [(1, MIT, "en", "a")]), []).count() == 0


def test_whole_texts(spark):
    """Each bundled text is found in itself as a whole, and as the best."""
    rows = [(n, "Foreword here.\n" + t.replace("{", "").replace("}", "") + "\nEnd.") for n, (_, t) in enumerate(bundled())]
    found = got(license_scan(frame(spark, [(i, t, "en", "a") for i, t in rows])))
    for n, (name, t) in enumerate(bundled()):
        assert any(r[0] == n and r[1] == name and r[5] == len(split(t)) and r[6] == 1 and r[7] for r in found), name


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(i, t) for i, t in docs if re.search("licen", t or "", re.I) or i % 20 == 0]
    docs = [(i, t) for i, t in docs if len(split(t)) < 1500]
    want = brute(docs, [(n, t) for n, t in bundled() if len(t) < 200])
    ids = {i for i, _ in docs}
    assert [r for r in got(queries.op3_license_scan(spark, SF)) if r[0] in ids and r[5] < 40] == want and want
