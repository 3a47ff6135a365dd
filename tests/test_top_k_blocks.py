"""Top-k searches in blocks against all pairs scored by the column functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import vectors
from foliant.operators.vectors import cosine, dense_top_k, max_sim, max_sim_top_k, ranked, rounded, sparse_top_k
from foliant.plans.documents import fusion_sweep, hybrid, late_interaction, retrieval_metrics
from foliant.plans.evaluation import relevance_route

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def drawn():
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [1.0]), (2003, [0.0] * 6), (2004, [float("nan")] * 6)]
    return rows, [(i, v) for i, v in rows if i % 40 == 0 or i > 1999]


def test_dense_blocks(spark, drawn, monkeypatch):
    monkeypatch.setattr(vectors, "CELLS", 200)
    points = spark.createDataFrame(drawn[0], "id long, vector array<double>")
    queries = spark.createDataFrame(drawn[1], "query_id long, query_vector array<double>")
    got = dense_top_k(points, queries, 7)
    want = ranked(points.join(queries).select("query_id", "id", cosine(F.col("vector"), F.col("query_vector")).alias("score")), ["query_id"], "score", "id", 7)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "MapInArrow" in plan(got)
    assert dense_top_k(points, queries.limit(0), 7).count() == dense_top_k(points.limit(0), queries, 7).count() == 0


def test_max_sim_blocks(spark, drawn):
    def parts(v):
        return v and ([v[:3], v[3:]] if v[0] != 2 else [v[:3], v[3:], v[1:4]])

    points = spark.createDataFrame([(i, parts(v)) for i, v in drawn[0]], "id long, patches array<array<double>>")
    queries = spark.createDataFrame([(i, parts(v)) for i, v in drawn[1]], "query_id long, query array<array<double>>")
    got = max_sim_top_k(points, queries, 5)
    score = F.round(max_sim(F.col("query"), F.col("patches")), 9).alias("score")
    want = ranked(points.join(queries).select("query_id", "id", score), ["query_id"], "score", "id", 5)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("signed", [False, True])
def test_sparse_blocks(spark, signed):
    rng = np.random.default_rng(5)
    rows = [(f"d{i:03}", f"t{t}", float(rng.integers(1, 4)) * (-1 if signed and t % 3 == 0 else 1)) for i in range(200) for t in rng.integers(0, 90, 6) ** 2 // 90]
    postings = spark.createDataFrame(rows, "id string, token string, weight double")
    asked = postings.filter("id LIKE '%0'").select(F.col("id").alias("query_id"), "token", F.col("weight").alias("query_weight"))
    got = sparse_top_k(postings, asked, 30)
    joined = postings.join(asked, "token").groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("query_weight")), 9).alias("score"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ranked(joined, ["query_id"], "score", "id", 30).collect()))
    assert "Join" not in plan(got)


def test_rounding(spark):
    x = [0.1234567885, 0.1234567895, -0.0000000005, 1 / 3, 2.5e-9, 0.9999999995, -1.0, 0.0]
    want = [r.y for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(F.round("x", 9).alias("y")).collect()]
    assert rounded(np.array(x)).tolist() == want


@pytest.mark.parametrize("query", [hybrid, fusion_sweep, late_interaction, retrieval_metrics, relevance_route])
def test_no_pair_becomes_a_row(spark, query):
    assert "MapInArrow" in plan(query(spark, SF))
