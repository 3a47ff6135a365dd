"""near_duplicate_clusters against all pairs, with pairs close to the threshold."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from foliant.operators import near_dup
from foliant.plans.documents import near_duplicate_clusters


def shingles(text):
    t = (text or "").lower().strip()
    return {t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t}


def brute(rows):
    """The class of each text that has a partner, all similarities to partners, and how many pairs are close to the threshold."""
    sets = {i: (s, frozenset(shingles(t))) for i, t, s in rows}
    root, scores, close = {i: i for i in sets}, defaultdict(set), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i][0] == sets[j][0]:
                score = len(sets[i][1] & sets[j][1]) / len(sets[i][1] | sets[j][1])
                if score >= 0.8:
                    close += score < 0.83
                    scores[i].add(round(score, 9))
                    scores[j].add(round(score, 9))
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: find(i) for i in scores}, scores, close


def test_close_pairs(spark, tmp_path):
    rng = random.Random(9)
    rows, k = [], 0
    for base in range(400):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))
        edits = list(text)
        for at in rng.sample(range(5, 295), rng.randrange(5, 9)):
            edits[at] = rng.choice("0123456789")
        for t in (text, "".join(edits)):
            k += 1
            rows.append((k, t, f"s{base % 5}"))
    rows += [(9001, rows[0][1], "s0"), (9002, rows[1][1].upper(), "s0"), (9003, "", "s0"), (9004, None, "s0"), (9005, "abc", "s1"), (9006, rows[0][1], "s3")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want, scores, close = brute(rows)
    assert close > 100
    got = near_duplicate_clusters(spark, str(tmp_path)).collect()
    assert {r.id: r.cluster for r in got} == want
    assert all(round(r.score, 9) in scores[r.id] for r in got)


def template(n, size, rng):
    """n texts of one template, each with a few places changed, so that chains of links join them all."""
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size))
    out = []
    for _ in range(n):
        edits = list(base)
        for at in rng.sample(range(size), rng.randrange(1, 5)):
            edits[at] = rng.choice("0123456789")
        out.append("".join(edits))
    return out


def test_templates_give_stars(spark, monkeypatch):
    """Near copies of one template come as about one link each, also where they are dealt into many blocks; two templates stay apart."""
    rng = random.Random(4)
    texts = template(400, 600, rng) + template(60, 600, rng)
    rows = [(k, t, "m") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, text string, matter string")
    want, _, _ = brute(rows)
    assert len(set(want.values())) == 2
    for block in (near_dup.BLOCK, 30_000):
        monkeypatch.setattr(near_dup, "BLOCK", block)
        links = near_dup.near_duplicates(docs, "id", "text", ["matter"])
        assert len(texts) - 2 <= links.count() <= 4 * len(texts)
        assert {r.id: r.cluster for r in near_dup.duplicate_clusters(links).collect()} == want


def test_scopes_and_nulls(spark):
    """Null scopes are a scope; clashing names, null ids, repeated rows and string ids."""
    rng = random.Random(5)
    a, b = template(2, 900, rng)
    rows = [("x", a, None, 1, 2), ("y", b, None, 1, 2), ("y", b, None, 1, 2), ("z", a, "m", 1, 2), (None, a, None, 1, 2), ("w", None, "m", 1, 2), ("v", "", "m", 1, 2)]
    docs = spark.createDataFrame(rows, "doc string, body string, s string, u int, n int")
    got = {(r.s, r.a, r.b) for r in near_dup.near_duplicates(docs, "doc", "body", ["s"]).collect()}
    assert got == {(None, "x", "y"), ("m", "v", "w")}
    assert near_dup.near_duplicates(docs.filter("n > 5"), "doc", "body", ["s"]).collect() == []


def test_sketches_leave_out_only_pairs_that_are_not_similar(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 400)) for _ in range(12)]
    texts = base + [t[:-20] + "x" * 20 for t in base]
    rows = spark.createDataFrame([(0, i, t, i, True) for i, t in enumerate(texts)], "s long, id long, text string, u long, m boolean")
    sketches = near_dup.signatures(rows, 5).select(F.col("u").alias("gid"), "n", "sketch")
    n = len(texts)
    # A group that has no sketch may hold several sets, and stays.
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(i + 1, n)] + [(0, 99)], "g long, h long")
    sets = [set(near_dup.shingles(t, 5).tolist()) for t in texts]
    similar = {(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    kept = {tuple(r) for r in near_dup.alike(pairs, sketches, 0.8).collect()}
    assert len(similar) == 12 and similar | {(0, 99)} <= kept and len(kept) < pairs.count() / 2
    held = near_dup.SKETCHES
    near_dup.SKETCHES = 32 * n
    try:
        assert similar | {(0, 99)} <= {tuple(r) for r in near_dup.alike(pairs, sketches, 0.8).collect()}
    finally:
        near_dup.SKETCHES = held


def test_sketches_of_groups_and_of_long_sets(spark):
    """A long set's sketch is long enough to tell unlike ones apart, and a group's least and largest counts tell it from sets that none of its own are like."""
    rng = np.random.default_rng(6)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    long, group = [text(9000) for _ in range(6)], [text(500) for _ in range(4)]
    members = [t[:k] + "xyz" + t[k:] for t in group for k in (100, 200, 300)]
    near = [t[:50] + "zyx" + t[50:] for t in group]
    texts = [*long, *members, *near]
    rows = spark.createDataFrame([(0, i, t, i, True) for i, t in enumerate(texts)], "s long, id long, text string, u long, m boolean")
    sketches = near_dup.held_sketches(near_dup.signatures(rows, 5).select(F.col("u").alias("gid"), "n", "sketch"))
    apart = spark.createDataFrame([(i, j) for i in range(6) for j in range(i + 1, 6)], "g long, h long")
    assert near_dup.alike(apart, sketches, 0.8).count() == 0
    gids = [6 + 3 * k for k in range(4)]
    sketches = sketches.with_groups(spark.createDataFrame([(g, g + k) for g in gids for k in range(3)], "gid long, u long"))
    pairs = spark.createDataFrame([(-1 - g, 18 + k) for g in gids for k in range(4)] + [(-1 - 9, -1 - 6), (-1 - 99, 18)], "g long, h long")
    kept = {tuple(r) for r in near_dup.alike(pairs, sketches, 0.8).collect()}
    assert kept == {(-1 - g, 18 + k) for k, g in enumerate(gids)} | {(-1 - 99, 18)}
    # Whole sketches, a part of their counts at a time.
    near_dup_held = near_dup.SKETCHES
    whole = near_dup.signatures(rows, 5).select(F.col("u").alias("gid"), "n", "sketch")
    groups = spark.createDataFrame([(g, g + k) for g in gids for k in range(3)], "gid long, u long")
    try:
        near_dup.SKETCHES = 1500
        kept = {tuple(r) for r in near_dup.finely_alike(pairs.unionByName(apart), whole, groups, 0.8).collect()}
    finally:
        near_dup.SKETCHES = near_dup_held
    assert kept == {(-1 - g, 18 + k) for k, g in enumerate(gids)} | {(-1 - 99, 18)}
