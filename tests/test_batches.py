"""Batch by batch equals all at once: components and resolved entities."""

import random

from foliant.operators.casework import resolved_batch, resolved_entities
from foliant.operators.components import connected_components, merged_components
from foliant.plans.lineage import cut


def test_merged_components(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(5, 5), (None, 3), (7, 8), (8, 7)]
    stars, seen = spark.createDataFrame([], "node long, component long"), []
    for low in range(0, len(edges), 30):
        batch = edges[low : low + 30]
        seen += batch
        stars = cut(merged_components(stars, spark.createDataFrame(batch, "a long, b long"), "a", "b"), "stars")
        want = connected_components(spark.createDataFrame(seen, "a long, b long"), "a", "b")
        assert {tuple(r) for r in stars.collect()} == {tuple(r) for r in want.collect()}
    again = merged_components(stars, spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in stars.collect()}


def test_resolved_batches(spark):
    names = ["Robert Miller", "Robert  Miller", "robert miller", "Roberta Miller", "Robrt Miller", "Acme Corporation", "ACME corporation", "Acme Corporatio", "Zeta", "Anne Smith", "John Smith"]
    rows = [(k, n, i % 3 + 1) for k in ("person", "organization", "date") for i, n in enumerate(names)] + [(None, "x", 1), ("person", None, 1)]
    random.Random(4).shuffle(rows)
    df = lambda r: spark.createDataFrame(r, "kind string, name string, mention_count long")
    stars, known = spark.createDataFrame([], "node string, component string"), []
    for low in range(0, len(rows), 14):
        stars, resolved = resolved_batch(stars, df(known), df(rows[low : low + 14]), ["date"])
        known += rows[low : low + 14]
    want, _ = resolved_entities(df(rows), ["date"], most=1000)
    key = lambda r: (r.kind, r.canonical, tuple(r.aliases), r.mention_count)
    assert {key(r) for r in resolved.collect()} == {key(r) for r in want.collect()}
