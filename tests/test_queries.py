"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from foliant.plans import casework, commerce, documents, evaluation, intake, monitoring, records, relations  # noqa: F401
from foliant.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(x):
    if x is None or x is pd.NaT:
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else round(float(x), 9)
    if isinstance(x, pd.Timestamp):
        return str(x.tz_localize(None) if x.tz is None else x.tz_convert(None))
    return plain(x.item()) if hasattr(x, "item") else x


def rows(df):
    return sorted(repr(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, oracle, name):
    got, want = QUERIES[name](spark, SF).toPandas(), oracle.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["graph_communities", "topic_clusters"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_fuzzy_matches(spark):
    """All pairs of part names by brute force, with the guard in plain Python."""
    from test_operators import brute_indel

    def apart(a, b):
        p, q = a.lower().split(), b.lower().split()
        rest = [[w for w in x if w not in y] for x, y in ((p, q), (q, p))]
        if len(p) < 2 or len(q) < 2 or not set(p) & set(q) or not all(rest):
            return False
        x, y = (max(w, key=len) for w in rest)
        return min(len(x), len(y)) >= 3 and brute_indel(x, y) < 60

    names = sorted({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()})
    key = lambda n: " ".join(sorted(n.lower().split()))
    want = {(a, b) for a in names for b in names if a < b and brute_indel(key(a), key(b)) >= 85 and not apart(a, b)}
    assert {(r.a, r.b) for r in QUERIES["fuzzy_matches"](spark, SF).collect()} == want and want


def test_graded_relevance(spark):
    from collections import defaultdict

    from foliant.operators.vectors import STOPWORDS

    def keys(t):
        return {w for w in re.findall(r"\b[a-z0-9]+(?:'[a-z]+)?\b", t.lower()) if w not in STOPWORDS and len(w) > 1}

    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text))
    out = {r.conv_id: r for r in QUERIES["graded_relevance"](spark, SF).collect()}
    assert out.keys() == turns.keys()
    for conv, rows_ in turns.items():
        q = keys(min(rows_)[2])
        scores = sorted(0.8 * 0.5 + 0.2 * (len(q & keys(t)) / len(q) if q else 0) for _, _, t in rows_)
        want = round(scores[len(scores) // 2], 6)
        assert abs(out[conv].median - want) < 2e-6 and out[conv].second_tier == (out[conv].median < 0.5)


def test_ocr_correction(spark):
    import hashlib

    from foliant.functions.text import OCR

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["ocr_correction"](spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        text, n = docs[r.doc_id], 0
        for pattern, to in OCR:
            text, k = re.subn(pattern, to.replace("$1", r"\1").replace("$2", r"\2"), text)
            n += k
        assert (r.corrected_sha256, r.corrections) == (hashlib.sha256(text.encode()).hexdigest(), n)


def test_document_chunks(spark):
    import hashlib
    from collections import defaultdict

    from test_operators import greedy, portable

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = defaultdict(list)
    for r in QUERIES["document_chunks"](spark, SF).orderBy("doc_id", "chunk_index").collect():
        got[r.doc_id].append((r.chunk_index, r.section, r.token_count, r.text_sha256))
    for doc, text in docs.items():
        assert got[doc] == [(n, "body", len(portable(c)), hashlib.sha256(c.encode()).hexdigest()) for n, c in enumerate(greedy(text, 512, 64) if text.strip() else [])]


def test_line_differences(spark):
    import difflib
    from collections import defaultdict

    source = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        source[r.source].append((r.doc_id, r.text))
    want = {}
    for rows_ in source.values():
        rows_.sort()
        for (_, a), (i, b) in zip(rows_, rows_[1:]):
            want[i] = len(difflib.SequenceMatcher(None, a.split("\n"), b.split("\n"), False).get_opcodes())
    assert {r.doc_id: r.opcodes for r in QUERIES["line_differences"](spark, SF).collect()} == want


def brandes(edges):
    """Exact betweenness, and each source's part for each node."""
    from collections import defaultdict, deque

    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    total, parts = dict.fromkeys(near, 0.0), {}
    for s in near:
        dist, count, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
        part = defaultdict(float)
        for w in reversed(order):
            part[w] = sum(count[w] / count[x] * (1 + part[x]) for x in near[w] if dist[x] == dist[w] + 1)
            total[w] += part[w] * (w != s) / 2
        parts[s] = part
    return total, parts


def test_betweenness(spark):
    """Brandes' algorithm over the graph that another query gives: all of its nodes are sources there."""
    from foliant.plans.relations import commerce_graph

    total, _ = brandes([(r.src, r.dst) for r in commerce_graph(spark, SF).collect()])
    out = {r.node: (r.betweenness, r.bound) for r in QUERIES["graph_betweenness"](spark, SF).collect()}
    assert out.keys() == total.keys() and all(abs(out[v][0] - total[v]) < 1e-3 and out[v][1] == 0 for v in total)


def test_betweenness_pivots(spark):
    """Estimates are the pivots' parts scaled up; no exact value is further away than its bound."""
    import random

    from pyspark.sql import functions as F

    from foliant.operators.graphs import betweenness

    rng = random.Random(8)
    edges = sorted({(min(p), max(p)) for p in (rng.sample(range(120), 2) for _ in range(260))})
    total, parts = brandes(edges)
    graph = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(v,) for v in total], "node long")
    chosen = [r.node for r in nodes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(60).collect()]
    got = {r.node: (r.betweenness, r.bound) for r in betweenness(graph, pivots=60, seed=3).collect()}
    assert got.keys() == total.keys()
    for v, (value, bound) in got.items():
        assert value == pytest.approx(sum(parts[s][v] for s in chosen if s != v) * len(total) / 60 / 2, rel=1e-9, abs=1e-9)
        assert 0 < bound and abs(value - total[v]) <= bound


def test_communities(spark):
    """Modularity of the communities of customers and suppliers: far above one community, and no worse than any of some moves."""
    from test_operators import modularity

    from foliant.plans.relations import commerce_graph

    edges = [tuple(r) for r in commerce_graph(spark, SF).collect()]
    out = QUERIES["graph_communities"](spark, SF).collect()
    place = {r.member: r.id for r in out if r.level == 0}
    assert len(place) == sum(r.level == 0 for r in out) == len({x for e in edges for x in e[:2]})
    assert modularity(edges, place) > max(0.05, modularity(edges, dict.fromkeys(place, 0)))


def personal(text):
    from foliant.functions.text import DOB, DOB_ISO, EMAIL, MEDICAL, PHONE, SSN

    kinds = [("ssn", SSN), ("phone", PHONE), ("email", EMAIL), ("dob", DOB), ("dob", DOB_ISO), *(("medical", re.escape(k)) for k in MEDICAL)]
    return sorted((m.start(), i, m.end(), kind) for i, (kind, p) in enumerate(kinds) for m in re.finditer(p, text.lower() if kind == "medical" else text))


def test_pii_spans(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r.doc_id, r.start, r.end, r.category, r.confidence) for r in QUERIES["pii_spans"](spark, SF).collect()}
    assert got == {(i, a, b, k, 0.9 if k == "medical" else 1.0) for i, t in docs.items() for a, _, b, k in personal(t)} and got


def test_redacted_documents(spark):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["redacted_documents"](spark, SF).collect():
        text, spans = docs[r.doc_id], personal(docs[r.doc_id])
        merged = []
        for a, _, b, _ in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        clean = text
        for a, b in reversed(merged):
            clean = clean[:a] + "[REDACTED]" + clean[b:]
        assert (r.spans, r.redacted_hash) == (len(spans), hashlib.sha256(clean.encode()).hexdigest()[:16])
        assert r.left == any(text[a:b] in clean for a, _, b, _ in spans)


def test_entity_resolution(spark):
    from collections import Counter

    from test_operators import brute_indel

    rows_ = spark.read.parquet(f"{SF}/part.parquet").collect()
    count = Counter(("person", r.p_name.title() if r.p_partkey % 2 == 0 else r.p_name) for r in rows_) + Counter(("date", r.p_brand.upper() if r.p_partkey % 2 == 0 else r.p_brand) for r in rows_)
    names = sorted(count)
    key = lambda n: " ".join(sorted(n.lower().split()))
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in names:
        for b in names:
            if a < b and a[0] == b[0] and (a[1].lower() == b[1].lower() or a[0] == "person" and brute_indel(key(a[1]), key(b[1])) >= 90):
                root[find(b)] = find(a)
    want = Counter()
    for n in names:
        want[n[0], frozenset(m[1] for m in names if find(m) == find(n))] += count[n]
    assert max(len(g) for _, g in want) <= 50
    got = QUERIES["entity_resolution"](spark, SF).collect()
    assert {(r.kind, frozenset([r.canonical, *r.aliases])): r.mention_count for r in got} == dict(want)


def test_mail_sections(spark):
    import hashlib

    from test_operators import greedy, portable

    text = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        k = r.conv_id * 1000 + r.turn
        text[k] = min(text.get(k, r.text), r.text)
    want = set()
    for k, t in text.items():
        reply = "On Monday A wrote:\n> " + t
        parts = [("body", t.strip()), ("quoted_reply", reply.strip())] if k % 1000 % 2 == 0 else [("body", f"{t}\n\n{reply}")]
        found = [(label, c) for label, s in parts if s for c in greedy(s, 512, 64)]
        want |= {(k, n, label, len(portable(c)), hashlib.sha256(c.encode()).hexdigest()) for n, (label, c) in enumerate(found)}
    assert {tuple(r) for r in QUERIES["mail_sections"](spark, SF).select("doc_id", "chunk_index", "section", "token_count", "text_sha256").collect()} == want


def test_document_versions(spark):
    from test_near_dup import shingles

    docs = {r.doc_id: (r.source, frozenset(shingles(r.text))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    label = {i: ("v1", "draft", None, "final")[i % 4] for i in docs}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i in docs:
        for j in docs:
            if i < j and docs[i][0] == docs[j][0] and (label[i] or label[j]):
                if 0.8 <= len(docs[i][1] & docs[j][1]) / len(docs[i][1] | docs[j][1]) <= 0.95:
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    want = {(i, find(i), label[i], label[i] == "final", 1 + sum(find(j) == find(i) and j < i for j in root)) for i in list(root)}
    got = {tuple(r) for r in QUERIES["document_versions"](spark, SF).select("id", "version_group", "label", "is_final", "version").collect()}
    assert got == want
