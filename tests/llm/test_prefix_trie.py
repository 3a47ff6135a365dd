"""The trie of prefixes and its rollup against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from foliant.llm import queries
from foliant.llm.prefix_trie import decompose, ordered_turns, own_turns, prefix_trie, regrown

from .helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string, node string, top string, d long, pos long"


def convs(spark, rows):
    """conversations with columns that clash with names inside."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


def plain(seqs):
    """seqs: conversation -> list of (role, text)."""
    members = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        below = [out[x] for x in children[k]]
        ends = ",".join(str(c) for c in m if len(seqs[c]) == len(k))
        parent = members[k[:-1]][0] if k else None
        leaves = sum(b[5] for b in below) if below else 1
        out[k] = (m[0], len(k), parent, len(m), len(below), leaves, own + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def sequences(rows, again=False):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    if not again:
        return own
    keep = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: keep[c]] + own[c][keep[c] :] for c in own}


def rows_of(df):
    return sorted((tuple(r)[:8] for r in df.drop("node").collect()), key=str)


EDGE = [(c, t, "user", w) for c in (3, 4, 40, 41, 42, 59) for t, w in enumerate(["a b", "c", "d e f", "g"][: c % 5 + 1])] + [
    (5, None, None, None),
    (5, 1, "user", "a b"),
    (5, 1, "user", "a b"),
    (5, 2, "", "  "),
    (None, 1, "user", "a b"),
    (7, 0, "assistant", "a b"),
    (7, 0, "user", "word " * 50_000),
    (100, 0, "user", "only"),
    (119, 0, "us", "er only"),
]


def deep(n):
    rng = random.Random(n)
    rows = [(1, t, "user", f"t{t}") for t in range(n)]
    for c in range(2, 30):
        k = rng.randint(0, n)
        rows += [(c, t, "user", f"t{t}") for t in range(k)] + [(c, k + j, "user", f"own {c % 7} {j}") for j in range(rng.randint(1, 4))]
    return rows


@pytest.mark.parametrize("most", [4, 1 << 15])
def test_tries(spark, most):
    """Components beyond `most` nodes are split in Spark; edges, chains, copies and wide roots give the same as plain Python."""
    wide = [(c, t, "user", str(c % 11 * t)) for c in range(60) for t in range(c % 3 + 1)]
    for rows in (EDGE, deep(40), wide):
        turns = ordered_turns(convs(spark, rows))
        assert rows_of(prefix_trie(own_turns(turns), most)) == plain(sequences(rows))


def test_regrown(spark):
    conv = queries.F.col("conv")
    for rows in (EDGE, [(c, t, "user", str(c * t % 5)) for c in range(45) if c != 20 for t in range(c % 6 + 1)]):
        turns = regrown(ordered_turns(convs(spark, rows)), conv - conv % 20, queries.F.crc32(conv.cast("string")) % 4)
        assert rows_of(prefix_trie(turns)) == plain(sequences(rows, again=True))


def test_empty(spark):
    none = convs(spark, EDGE).filter("conv_id > 1000")
    assert prefix_trie(own_turns(ordered_turns(none))).collect() == []


def test_decompose():
    rng = random.Random(2)
    for t in range(200):
        n = rng.randint(1, 50)
        parent = np.array([-1] + [i - 1 if t % 3 == 0 else rng.randint(-1 if t % 3 == 1 else 0, i - 1) for i in range(1, n)])
        shuffled = np.array(rng.sample(range(n), n))
        moved = np.full(n, -1)
        moved[shuffled] = np.where(parent >= 0, shuffled[parent], -1)
        weight = np.array([rng.randint(1, 5) for _ in range(n)])
        values = np.array([[rng.randint(0, 9) for _ in range(n)] for _ in range(2)])
        depth, whole, want = np.zeros(n, int), weight.copy(), values.copy()
        for i in range(n):
            j = moved[i]
            while j >= 0:
                depth[i], whole[j], want[:, j], j = depth[i] + 1, whole[j] + weight[i], want[:, j] + values[:, i], moved[j]
        assert (decompose(moved, depth, whole, values) == want).all()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, SF).collect()), key=str) == plain(sequences(rows, again=True))
