"""The corpus pipeline, stage by stage against brute force."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from foliant.llm.mixing import water_fill

from .helpers import EDGE, LOW, SF, frame, words
from .test_operators import classes

pytest.importorskip("public_tokenizers")


def run(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, out[-1], SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == docs.columns
        out.append(spark.createDataFrame(found.collect(), found.schema))
    return out


def test_edge(spark):
    start, spoken, unique, apart, mixed, ids = run(spark, frame(spark, EDGE))
    assert Counter(r.doc_id for r in spoken.collect()) == Counter(i for i, t, *_ in EDGE if any(c.isalpha() for c in t or ""))
    assert len({(r.text or "").translate(LOW) for r in spoken.collect()}) == unique.count()
    kept = {c for i, _, c in classes([(r.doc_id, r.text) for r in unique.collect()]) if i is not None}
    assert {r.doc_id for r in apart.collect()} == kept | {None}
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    assert ids.count() == mixed.count() and all(r.n_tokens == len(r.ids) for r in ids.collect())


def test_empty(spark):
    assert run(spark, frame(spark, []))[-1].count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, spoken, unique, apart, mixed, ids = run(spark, docs)
    assert spoken.count() == docs.filter("text RLIKE '\\\\p{L}'").count()
    assert unique.count() == len({r.text.translate(LOW) for r in spoken.collect()})
    kept = {c for _, _, c in classes([(r.doc_id, r.text) for r in unique.collect()])}
    assert sorted(r.doc_id for r in apart.collect()) == sorted(kept)
    size, got, largest = Counter(), Counter(), Counter()
    for r in apart.collect():
        size[r.source] += len(words(r.text))
        largest[r.source] = max(largest[r.source], len(words(r.text)))
    for r in mixed.collect():
        got[r.source] += len(words(r.text))
    names = sorted(size)
    target = water_fill([size[s] for s in names], [i % 3 + 1 for i in range(len(names))], sum(size.values()), 3)
    assert all(t - largest[s] <= got[s] <= t + 1 for s, t in zip(names, target, strict=True))
    assert all(r.round_trip for r in ids.collect())
    assert corpus_pipeline.run(spark, SF).count() == ids.count()
