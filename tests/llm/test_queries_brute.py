"""The registered queries of the operators that SQL can't express, over whole tables, by plain Python."""

import unicodedata
import zlib
from collections import Counter, defaultdict
from math import sqrt
from pathlib import Path

import numpy as np
import pytest

from foliant.llm import queries
from foliant.llm.language_id import letter_vectors

from .helpers import SF, words

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_op2_targets(spark, docs):
    """The common unit of all targets is found by bisection."""
    size = Counter()
    for r in docs:
        size[r.source] += len(words(r.text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(size.values())
    low, high = 0.0, float(total)
    for _ in range(200):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(3 * size[s], weight[s] * unit) for s in names) < total else (low, unit)
    out = queries.op2_source_mix(spark, SF).collect()
    assert len(out) == len(docs)
    got, text = Counter(), {r.doc_id: r for r in docs}
    for r in out:
        d = text[r.doc_id]
        assert r["size"] == len(words(d.text)) and r.source_size == size[d.source]
        assert r.target == pytest.approx(min(3 * size[d.source], weight[d.source] * high), rel=1e-9)
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        got[d.source] += r.taken
    largest = {s: max(len(words(r.text)) for r in docs if r.source == s) for s in names}
    for s in names:
        assert -largest[s] <= got[s] - min(3 * size[s], weight[s] * high) <= 1
        # No document that is taken once less than others would still fit.
        mine = [r for r in out if text[r.doc_id].source == s and r["size"]]
        least = min(r.taken // r["size"] for r in mine)
        left = min(3 * size[s], weight[s] * high) - got[s]
        assert left < 1 or all(r["size"] > left - 1 for r in mine if r.taken // r["size"] == least)


def test_op4_counts(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    out = {r.doc_id: r for r in queries.op4_token_counts(spark, SF).collect()}
    assert len(out) == len(docs)
    for d in docs:
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        r = out[d.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 1024)


def test_op5_languages(spark, docs):
    """Profiles and cosines with a dictionary of trigrams for each text."""
    seed, known = 11, {}

    def letter(c):
        if c not in known:
            known[c] = letter_vectors(np.array([c]), seed)[0].astype(float)
        return known[c]

    def grams(text):
        code, gap = [0], True
        for ch in text:
            c = ord(unicodedata.normalize("NFC", ch.lower())[0]) if ch.isalpha() else 0
            if c or not gap:
                code.append(c)
            gap = c == 0
        code.append(0)
        return Counter((code[k - 1], code[k], code[k + 1]) for k in range(1, len(code) - 1) if code[k])

    def bundle(counts):
        total = sum(counts.values())
        return sum((sqrt(n / total) * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for (a, b, c), n in counts.items()), np.zeros(1024))

    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}
    sums = defaultdict(Counter)
    for d in docs:
        if not held[d.doc_id] and d.lang is not None and d.text is not None:
            sums[d.lang] += grams(d.text)
    langs = sorted(sums)
    protos = np.array([bundle(sums[x]) for x in langs])
    centre = protos.mean(0)
    unit = (protos - centre) / np.linalg.norm(protos - centre, axis=1, keepdims=True)
    out = {r.doc_id: r for r in queries.op5_language_id(spark, SF).collect()}
    assert len(out) == len(docs)
    right = []
    for d in docs:
        r, counts = out[d.doc_id], grams(d.text or "")
        assert r.held_out == held[d.doc_id]
        if not counts:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        v = bundle(counts) - centre
        cosine = unit @ v / np.linalg.norm(v)
        assert r.score == pytest.approx(max(cosine.max(), 0), abs=1e-3)
        assert r.lang_pred == langs[cosine.argmax()] or np.sort(cosine)[-1] - np.sort(cosine)[-2] < 1e-3
        if r.held_out and d.lang is not None:
            right.append(r.lang_pred == d.lang)
    assert sum(right) >= 0.95 * len(right) > 0


def test_op10_shards(spark, docs):
    out = {r.doc_id: r for r in queries.op10_ring_sharding(spark, SF).collect()}
    assert len(out) == len(docs)
    load, slots = Counter(), defaultdict(list)
    for d in docs:
        r, raw = out[d.doc_id], (d.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Five rows a shard: none gets more than the mean and one row over it.
    assert max(load.values()) <= sum(load.values()) / 40 + max(r["size"] for r in out.values())


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_op10_balance(spark):
    """With 250 rows a shard loads differ by less than 2 % of their mean."""
    from pyspark.sql import functions as F

    load = [r.load for r in queries.op10_ring_sharding(spark, "/root/testdata/sf0.1").groupBy("shard").agg(F.sum("size").alias("load")).collect()]
    assert len(load) == 40 and max(load) - min(load) < 0.02 * sum(load) / 40


def test_rare_language(spark):
    """A language of a script of its own, 12 of 6,012 training rows, is told from a hot one."""
    import random

    from foliant.llm.language_id import predict, train

    rng = random.Random(1)
    hot, rare = "the and of to in that was for with his".split(), "და არის რომ ეს მისი თბილისი წიგნი სახლი".split()
    say = lambda w: " ".join(rng.choice(w) + (rng.choice("aeiou") if w is hot else "") for _ in range(30))
    rows = [("en", say(hot)) for _ in range(6000)] + [("ka", say(rare)) for _ in range(12)]
    learned = train(spark.createDataFrame(rows, "lang string, text string"))
    asked = spark.createDataFrame([("ka", say(rare)) for _ in range(50)] + [("en", say(hot)) for _ in range(50)], "want string, text string")
    assert all(r.want == r.lang_pred for r in predict(asked, learned).collect())
