"""Topics that separate, with sizes and terms by plain Python; names in texts by plain search."""

import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from foliant.operators import mentions
from foliant.operators.evaluation import known_words, topics
from foliant.operators.graphs import co_occurrence
from foliant.operators.mentions import chunk_graph, names_found
from foliant.plans.evaluation import topic_clusters

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[^\w]|[\d_]", (text or "").lower()) if len(w) > 2]


def check_terms(texts, found, table, k_terms=10):
    """Sizes and class-based TF-IDF terms of the topics that texts were given."""
    df = Counter(w for t in texts.values() for w in set(words(t)))
    known = {w for w, n in df.items() if 2 <= n <= 0.5 * len(texts)}
    per = defaultdict(Counter)
    for i, topic in found.items():
        if topic >= 0:
            per[topic].update(w for w in words(texts[i]) if w in known)
    whole = {c: sum(n.values()) for c, n in per.items()}
    every = sum(per.values(), Counter())
    mean = sum(whole.values()) / len(whole)
    for r in table:
        assert r["size"] == sum(t == r.topic for t in found.values()) >= 5
        n = per[r.topic]
        ranked = sorted(n, key=lambda w: (-round(n[w] / whole[r.topic] * math.log1p(mean / every[w]), 12), w))
        assert list(r.terms) == ranked[:k_terms]
    assert {r.topic for r in table} == set(found.values()) - {-1}


def test_planted_topics(spark):
    rng = random.Random(6)
    vocabulary = [["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7)) for _ in range(40)] for _ in range(4)]
    common = ["".join(rng.choice("uvwxyz") for _ in range(5)) for _ in range(30)]
    texts, planted = {}, {}
    for i in range(160):
        c = i % 4 if i < 130 else 0
        planted[i] = c
        texts[i] = " ".join(rng.choice(vocabulary[c]) if rng.random() < 0.5 else rng.choice(common) for _ in range(rng.randrange(30, 90)))
    texts |= {900: None, 901: "", 902: "zzzzzzzz only here"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found, table = topics(docs, "doc_id", "text", 4, seed=5)
    found = {r.doc_id: r.topic for r in found.collect()}
    assert all(found[i] == -1 for i in (900, 901, 902))
    assert len({(planted[i], found[i]) for i in planted}) == 4 == len({found[i] for i in planted})
    check_terms(texts, found, table.collect())
    none = topics(docs.filter("doc_id >= 900"), "doc_id", "text", 4)
    assert {r.topic for r in none[0].collect()} == {-1} and none[1].collect() == []


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_table_topics(spark):
    """No topic holds over a third of all documents."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found, table = topics(docs, "doc_id", "text", 12)
    found, table = {r.doc_id: r.topic for r in found.collect()}, table.collect()
    assert max(r["size"] for r in table) <= len(texts) / 3
    check_terms(texts, found, table)
    assert {(r.topic, r["size"], tuple(r.terms)) for r in topic_clusters(spark, SF).collect()} == {(r.topic, r["size"], tuple(r.terms)) for r in table}


def plain_mentions(texts, names):
    out = {}
    for i, t in texts:
        for name, kind in set(names):
            if name and len(name) >= 2 and t:
                n = sum(t.lower().startswith(name.lower(), k) for k in range(len(t)))
                if n:
                    out[i, name, kind] = out.get((i, name, kind), 0) + n
    return out


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_names_found(spark, most):
    """Names within names, overlaps, other cases, nulls, repeated keys; the same with names dealt into parts."""
    rng = random.Random(most)
    names = [("".join(rng.choice("abé ") for _ in range(rng.randrange(1, 5))), rng.choice("xy")) for _ in range(40)] + [("AB", "x"), ("ab", "x"), ("ab", "x"), (None, "x"), ("aa", "y")]
    texts = [(i % 25, "".join(rng.choice("abAé ") for _ in range(rng.randrange(0, 60)))) for i in range(30)] + [(99, None), (98, "")]
    got = names_found(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name string, kind string"), "id", "text", "name", most=most)
    assert {(r.id, r.name, r.kind): r.mentions for r in got.collect()} == plain_mentions(texts, names)


def test_chunk_graph(spark):
    texts = [(1, "Anna met Bert and Carla"), (2, "anna and bert"), (3, "nobody")]
    edges, pairs = chunk_graph(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([("Anna",), ("Bert",), ("Carla",)], "name string"), "id", "text", "name")
    assert {tuple(r) for r in pairs.collect()} == {("Anna", "Bert", 2), ("Anna", "Carla", 1), ("Bert", "Carla", 1)} and edges.count() == 5
    empty = spark.createDataFrame([], "name string")
    assert names_found(spark.createDataFrame(texts, "id long, text string"), empty, "id", "text", "name").collect() == []


def test_mentions_are_given_on_by_few_texts():
    """A task holds what a bounded number of texts have, however many rows a batch has."""

    class Texts:
        schema = StructType()

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = mentions.scanned(Texts(), SimpleNamespace(value=["ab", "b"]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1001)), pa.array(["abab" if i % 2 else None for i in range(1001)])], ["k", "text"])
    out = list(run(iter([batch, batch.slice(0, 0)])))
    assert len(out) > 1 and all(len(set(b.column("k").to_pylist())) <= mentions.ROWS for b in out)
    assert [x for b in out for x in zip(*b.to_pydict().values(), strict=True)] == [(i, s, 2) for i in range(1, 1001, 2) for s in ("ab", "b")]


def test_known_words_are_counted_in_place(spark):
    """Words that fit a broadcast are counted where their texts are, without a shuffle, just as by the join beyond it."""
    rng = random.Random(8)
    texts = [(i, [rng.choice(["éa", "ab", "b", "zz", "aé", "none"]) for _ in range(rng.randrange(9))]) for i in range(2500)]
    said = spark.createDataFrame(texts, "row long, words array<string>")
    known = spark.createDataFrame([(w,) for w in ("zz", "ab", "éa", "aé")], "word string")
    want = {i: sorted(Counter(w for w in ws if w not in ("b", "none")).items()) for i, ws in texts}
    for most in (4, 3):
        found = known_words(said, known, most)
        assert {r.row: list(zip(r.words, r.counts, strict=True)) for r in found.collect()} == {i: w for i, w in want.items() if w}
        assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == (most == 3)
    assert known_words(said, known.limit(0)).collect() == []


def test_name_pairs_in_blocks(spark, monkeypatch):
    """Counts by blocks of names equal a join of mentions, whatever the blocks; pairs of a text are never rows of a shuffle."""
    monkeypatch.setattr(mentions, "SENT", 7)
    monkeypatch.setattr(mentions, "CELLS", 9)
    rng = random.Random(3)
    words = [a + b + c for a in "ab" for b in "cd" for c in "efghij"] + ["ACE", "ace", "Ünal", "x"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(60)] + [(3, "ace bdj"), (3, "ace ünal"), (70, None), (None, "ace bdj"), (71, "")]
    texts, names = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in [*words, None]], "name string")
    want = sorted(map(tuple, co_occurrence(mentions.names_found(texts, names, "id", "text", "name"), "name", "id").collect()))
    for options in ({"side": 3}, {"side": 4, "most": 20}, {}):
        found = mentions.name_pairs(texts, names, "id", "text", "name", **options)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 200
    assert mentions.name_pairs(texts, names.filter("name IS NULL"), "id", "text", "name").collect() == []


def test_chunk_graph_makes_no_rows_of_pairs(spark):
    texts = spark.createDataFrame([(1, "anna bert"), (2, "anna bert carla")], "id long, text string")
    pairs = chunk_graph(texts, spark.createDataFrame([("Anna",), ("Bert",), ("Carla",)], "name string"), "id", "text", "name")[1]
    assert "HashAggregate" not in pairs._jdf.queryExecution().executedPlan().toString()
