"""Evaluation, case context and access queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.chunks import line_diff
from foliant.operators.evaluation import depth, expanded, failed_gates, flag_impact, grounded, hot_score, import_estimate, judge_score, reflects, relevant_enough, roman, topics
from foliant.operators.filters import open_by_default, token_valid
from foliant.operators.graphs import completed, repaired_scope
from foliant.operators.vectors import dense_top_k, ranked
from foliant.registry import load, query


@query("hot_documents", "SELECT doc_id, round(0.3 * greatest(n_chars % 7, n_chars % 5, n_chars % 3) / 10.0 + 0.4 * greatest(n_chars % 11, n_chars % 2) / 10.0 + 0.3 * greatest(n_chars % 4, n_chars % 6) / 10.0, 6) AS score FROM documents")
def hot_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda m: F.col("n_chars") % m / 10.0
    score = hot_score(part(7), part(5), part(3), part(11), part(2), [part(4), part(6)])
    return load(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query("import_estimates", "SELECT source, greatest(count(*) * 5, sum(n_chars) // 51200)::BIGINT AS pages, (greatest(count(*) * 5, sum(n_chars) // 51200) * 3)::BIGINT AS chunks, round(count(*) * 0.5, 1)::DOUBLE AS minutes, round(sum(n_chars) / 1048576.0 * 1.2, 1)::DOUBLE AS storage_mb FROM documents GROUP BY 1")
def import_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"))
    parts = import_estimate(F.col("files"), F.col("size"))
    return sums.select("source", *(parts[k].alias(k) for k in ("pages", "chunks", "minutes", "storage_mb")))


@query("judge_scores", "SELECT doc_id, round((doc_id % 6) * 0.20 + (doc_id % 5) * 0.15 + (doc_id % 4) * 0.25 + (doc_id % 3) * 0.25 + (doc_id % 2) * 0.15, 2) AS composite FROM documents")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {name: (F.col("doc_id") % m).cast("double") for name, m in zip(("relevance", "completeness", "accuracy", "citation_support", "conciseness"), (6, 5, 4, 3, 2), strict=True)}
    return load(spark, sf_dir, "documents").select("doc_id", judge_score(of).alias("composite"))


@query("quality_gates", "SELECT lang, len(list_filter([f < 0.95, n > 0 AND c < 0.9, n > 0 AND h >= 0.05, n > 0 AND h >= 0.1], lambda x: x)) AS failures FROM (SELECT lang, avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0 END) AS f, avg(CASE WHEN n_chars > 200 THEN 1.0 ELSE 0 END) AS c, avg(CASE WHEN n_chars > 9000 THEN 1.0 ELSE 0 END) AS h, count(*) AS n FROM documents GROUP BY 1)")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    n = F.col("n_chars")
    runs = load(spark, sf_dir, "documents").groupBy("lang").agg(share(n > 500).alias("faithfulness"), share(n > 200).alias("citation_accuracy"), share(n > 9000).alias("hallucination_rate"), F.count("*").alias("claims"))
    names = {k: F.col(k) for k in ("faithfulness", "citation_accuracy", "hallucination_rate")} | {"post_rationalization_rate": F.col("hallucination_rate")}
    return runs.select("lang", F.size(failed_gates(names, F.col("claims"))).cast("long").alias("failures"))


@query("flag_impacts", """WITH r AS (SELECT source AS flag, doc_id % 3 = 0 AS enabled, avg(n_chars % 10) / 10.0 AS mrr, avg(n_chars % 7) / 10.0 AS recall, avg(n_chars % 3) / 10.0 AS ndcg, avg(n_chars % 4) / 10.0 AS prec, avg(n_chars % 2) AS h FROM documents GROUP BY 1, 2),
  d AS (SELECT a.flag, a.mrr - b.mrr AS m, a.recall - b.recall AS r, a.ndcg - b.ndcg AS n, a.prec - b.prec AS p, b.h - a.h AS c FROM r a JOIN r b ON a.flag = b.flag AND a.enabled AND NOT b.enabled)
  SELECT flag, round(m, 6) AS delta_mrr, round(r, 6) AS delta_recall, round(n, 6) AS delta_ndcg, round(p, 6) AS delta_precision, round(c, 6) AS delta_citation, CASE WHEN m + r + n + p > 0.02 OR c > 0.01 THEN 'keep_enabled' WHEN m + r + n + p < -0.02 OR c < -0.01 THEN 'keep_disabled' ELSE 'negligible_impact' END AS recommendation FROM d""")
def flag_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda m, by=10.0: F.avg(F.col("n_chars") % m) / by
    # Documents of one source stand for a flag's runs, every third one for those with the flag on.
    runs = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("flag"), (F.col("doc_id") % 3 == 0).alias("enabled")).agg(mean(10).alias("mrr"), mean(7).alias("recall"), mean(3).alias("ndcg"), mean(4).alias("precision"), mean(2, 1.0).alias("hallucination"))
    return flag_impact(runs)


@query("claim_names", "SELECT o_orderkey, CASE (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' WHEN 7 THEN 'VII' WHEN 8 THEN 'VIII' WHEN 9 THEN 'IX' WHEN 10 THEN 'X' WHEN 11 THEN 'XI' WHEN 12 THEN 'XII' WHEN 13 THEN 'XIII' WHEN 14 THEN 'XIV' WHEN 15 THEN 'XV' WHEN 16 THEN 'XVI' WHEN 17 THEN 'XVII' WHEN 18 THEN 'XVIII' WHEN 19 THEN 'XIX' WHEN 20 THEN 'XX' END AS numeral FROM orders")
def claim_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return load(spark, sf_dir, "orders").select("o_orderkey", number.alias("n")).select("o_orderkey", roman(F.col("n")).alias("numeral"))


@query("reflection_gate", "SELECT conv_id, count(*) AS claims, count(*) FILTER (role = 'user') AS verified, count(*) >= 3 AND count(*) FILTER (role = 'user') / count(*)::DOUBLE < 0.6 AS reflect FROM conversations GROUP BY 1")
def reflection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("claims"), F.count(F.when(F.col("role") == "user", 1)).alias("verified"))
    return sums.withColumn("reflect", reflects(F.col("verified"), F.col("claims"), F.lit(0)))


@query("adaptive_depths", "SELECT lang, CASE lang WHEN 'en' THEN 15 WHEN 'de' THEN 30 WHEN 'fr' THEN 25 ELSE 20 END AS text_depth, CASE lang WHEN 'en' THEN 8 WHEN 'de' THEN 15 WHEN 'fr' THEN 12 ELSE 20 END AS graph_depth, count(*) AS n FROM documents GROUP BY 1")
def adaptive_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "factual").when(F.col("lang") == "de", "analytical").when(F.col("lang") == "fr", "timeline")
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", depth(kind).alias("text_depth"), depth(kind, graph=True).alias("graph_depth"), "n")


@query("relevance_route", "WITH d AS (SELECT b.vec_id AS query_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM d) SELECT query_id, round(avg(score), 6) AS mean, avg(score) >= 0.3 AS relevant FROM t WHERE r <= 5 GROUP BY 1")
def relevance_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = points.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    best = dense_top_k(points, asked, 6, vector="v", query_vector="q").filter("id <> query_id")
    best = ranked(best.drop("rank"), ["query_id"], "score", "id", 5)
    out = relevant_enough(best, "query_id", "score", "rank")
    return out.select("query_id", F.round("mean", 6).alias("mean"), "relevant")


@query("expanded_questions", """WITH t AS (SELECT conv_id, min(lower(regexp_extract(text, '[A-Za-z]{4,}'))) AS term FROM conversations WHERE regexp_extract(text, '[A-Za-z]{4,}') <> '' GROUP BY 1)
  SELECT c.conv_id * 1000 + turn AS id, CASE WHEN contains(lower(text), term) THEN text || chr(10) || chr(10) || '[Case context: "' || term || '" = thread ' || c.conv_id || ']' ELSE text END AS text FROM conversations c LEFT JOIN t ON t.conv_id = c.conv_id""")
def expanded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the definitions of their thread's terms."""
    turns = load(spark, sf_dir, "conversations")
    term = F.regexp_extract("text", "[A-Za-z]{4,}", 0)
    terms = turns.filter(term != "").groupBy("conv_id").agg(F.min(F.lower(term)).alias("term")).withColumn("definition", F.concat(F.lit("thread "), F.col("conv_id")))
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "text")
    return expanded(rows, terms, "id", "text", "conv_id").select("id", "text")


@query("grounding", "WITH n AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE left(p_brand, length(p_brand) - 1) END AS name FROM part), e AS (SELECT DISTINCT p_brand AS other FROM part) SELECT name, name IN (SELECT other FROM e) AS grounded, CASE WHEN name NOT IN (SELECT other FROM e) THEN (SELECT min(other) FROM e WHERE contains(other, name)) END AS closest FROM n")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of an answer against the graph's entities."""
    part = load(spark, sf_dir, "part")
    cutoff = F.expr("left(p_brand, length(p_brand) - 1)")
    names = part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(cutoff).alias("name"))
    return grounded(names, part.select(F.col("p_brand").alias("name")))


@query("dataset_access", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_name LIKE '%1')")
def dataset_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets (nations) are open to all unless grants (suppliers) list someone."""
    grants = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.when(F.col("s_name").endswith("1"), "me").otherwise("other").alias("user"))
    return open_by_default(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), grants, "n_nationkey", "user", "me")


@query("valid_shares", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (o_orderpriority LIKE '1%' OR o_orderdate > TIMESTAMP '1996-01-01')")
def valid_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared links that aren't revoked (status F) and haven't expired; those of priority 1 never do."""
    expires = F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderdate").cast("timestamp"))
    revoked = F.when(F.col("o_orderstatus") == "F", True)
    return load(spark, sf_dir, "orders").filter(token_valid(revoked, expires, "1996-01-01")).select("o_orderkey")


@query("repaired_matters", "SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END, min(o_orderkey)::INT) AS matter_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey")
def repaired_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without a matter take the least one of their documents."""
    nodes = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("matter_id"))
    orders = load(spark, sf_dir, "orders")
    return repaired_scope(nodes, orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("doc_id")), orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").cast("int").alias("matter_id")))


@query("completed_nodes", "SELECT DISTINCT id FROM (SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey FROM nation UNION ALL SELECT n_regionkey FROM nation)")
def completed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    return completed(nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id")), nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")))


@query("line_differences")
def line_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opcodes between each document and the next one of its source; tests hold them against Python's difflib."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("source").orderBy("doc_id"))
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", before.alias("before")).filter("before IS NOT NULL")
    return rows.select("doc_id", F.size(line_diff("before", "text")).cast("long").alias("opcodes"))


@query("topic_clusters")
def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve topics of all documents with their sizes and terms."""
    return topics(load(spark, sf_dir, "documents"), "doc_id", "text", 12)[1].select("topic", "size", "terms")
