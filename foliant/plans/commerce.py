"""Joins, communication pairs and analytics over the order tables, which stand in for correspondents, jobs and productions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.filters import health, page, select_documents, visible
from foliant.operators.rows import first_by, insert_new, overlay, page_numbers, purge, upsert_counts, with_counts
from foliant.plans.lineage import tasks
from foliant.registry import load, query

PAIRS = """pairs AS (
  SELECT c.c_nationkey AS sender, s.s_nationkey AS recipient, count(*) AS message_count, min(l_shipdate) AS earliest, max(l_shipdate) AS latest
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed pairs (customer's nation to supplier's nation) with their counts and first and last dates."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    people = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sender"))
    others = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("recipient"))
    joined = lines.join(others, lines["l_suppkey"] == others["s_suppkey"]).join(orders.join(people, orders["o_custkey"] == people["c_custkey"]), lines["l_orderkey"] == orders["o_orderkey"])
    return joined.groupBy("sender", "recipient").agg(F.count("*").alias("message_count"), F.min("l_shipdate").alias("earliest"), F.max("l_shipdate").alias("latest"))


def hierarchy(found: DataFrame, least: int = 3) -> DataFrame:
    """(subordinate, manager, up, down, confidence): a writes to b over twice as often as b to a, and `least` times or more."""
    up = found.select(F.col("sender").alias("subordinate"), F.col("recipient").alias("manager"), F.col("message_count").alias("up"))
    down = found.select(F.col("sender").alias("manager"), F.col("recipient").alias("subordinate"), F.col("message_count").alias("back"))
    both = up.join(down, ["subordinate", "manager"], "left").withColumn("down", F.coalesce("back", F.lit(0)).cast("long"))
    both = both.filter((F.col("subordinate") != F.col("manager")) & (F.col("up") > 2 * F.col("down")) & (F.col("up") >= least))
    share = F.round((F.col("up") - F.col("down")) / (F.col("up") + F.col("down")), 2)
    return both.select("subordinate", "manager", "up", "down", F.when(F.col("down") == 0, 0.9).otherwise(share).alias("confidence"))


@query("communication_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def communication_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query(
    "org_hierarchy",
    f"""WITH {PAIRS}, h AS (SELECT a.sender AS subordinate, a.recipient AS manager, a.message_count AS up, coalesce(b.message_count, 0) AS down
    FROM pairs a LEFT JOIN pairs b ON a.sender = b.recipient AND a.recipient = b.sender WHERE a.sender <> a.recipient)
    SELECT subordinate, manager, up, down, CASE WHEN down = 0 THEN 0.9 ELSE round((up - down) / (up + down)::DOUBLE, 2) END AS confidence FROM h WHERE up > 2 * down AND up >= 3""",
)
def org_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(pairs(spark, sf_dir))


@query("communication_matrix", f"WITH {PAIRS} SELECT count(DISTINCT sender) AS senders, count(DISTINCT recipient) AS recipients, sum(message_count)::BIGINT AS messages, max(message_count) AS most FROM pairs")
def communication_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).agg(F.countDistinct("sender").alias("senders"), F.countDistinct("recipient").alias("recipients"), F.sum("message_count").alias("messages"), F.max("message_count").alias("most"))


@query("matrix_cells", f"WITH {PAIRS}, a AS (SELECT s.sender, r.recipient, coalesce(sum(message_count), 0)::BIGINT AS n FROM (SELECT DISTINCT sender FROM pairs) s CROSS JOIN (SELECT DISTINCT recipient FROM pairs) r LEFT JOIN pairs p ON p.sender = s.sender AND p.recipient = r.recipient GROUP BY 1, 2) SELECT sender, list(n ORDER BY recipient) AS cells FROM a GROUP BY 1")
def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sender by recipient, as a client draws it: a row for each sender, with a cell for each recipient in order."""
    wide = pairs(spark, sf_dir).groupBy("sender").pivot("recipient").sum("message_count")
    return wide.select("sender", F.array(*(F.coalesce(F.col(c), F.lit(0)).cast("long") for c in wide.columns[1:])).alias("cells"))


@query(
    "upsert_pairs",
    """WITH p AS (SELECT o_custkey AS k, o_orderpriority AS r, count(*) AS n, min(o_orderdate) AS earliest, max(o_orderdate) AS latest FROM orders GROUP BY 1, 2) SELECT * FROM p""",
)
def upsert_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the first half of the orders, then the second half upserted."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("r"), F.lit(1).cast("long").alias("n"), F.col("o_orderdate").alias("earliest"), F.col("o_orderdate").alias("latest"), "o_orderkey")
    half = lambda k: orders.filter(F.col("o_orderkey") % 2 == k).drop("o_orderkey")
    state = half(0).groupBy("k", "r").agg(F.sum("n").alias("n"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))
    return upsert_counts(state, half(1), ["k", "r"], "n", "earliest", "latest")


@query("insert_ignore", "SELECT DISTINCT p_brand, p_type FROM part WHERE (p_brand, p_type) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size < 25)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_brand", "p_type", "p_size")
    return insert_new(part.filter("p_size < 25"), part, ["p_brand", "p_type"]).select("p_brand", "p_type")


@query("bates_numbers", """WITH n AS (SELECT o_custkey, o_orderkey, count(*) AS pages FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
    e AS (SELECT *, sum(pages) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS end_no FROM n)
    SELECT o_custkey, o_orderkey, pages, end_no - pages + 1 AS begin_no, end_no, 'PROD' || lpad((end_no - pages + 1)::VARCHAR, greatest(6, length((end_no - pages + 1)::VARCHAR))::INT, '0') AS bates_begin,
    'PROD' || lpad(end_no::VARCHAR, greatest(6, length(end_no::VARCHAR))::INT, '0') AS bates_end FROM e""")
def bates_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of a customer's production set, line items as their pages."""
    pages = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("pages"))
    docs = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(pages, "o_orderkey")
    return page_numbers(docs, ["o_custkey"], [F.col("o_orderkey")], "pages", "PROD").select("o_custkey", "o_orderkey", "pages", "begin_no", "end_no", "bates_begin", "bates_end")


@query("many_to_many_join", "SELECT p_brand, o_orderpriority, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size >= 10 GROUP BY 1, 2")
def many_to_many_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and datasets through a junction table, scoped before the join.

    Junction rows are counted by order and brand and orders by key and priority, so that what is left to join are distinct orders; a task's part is bounded.
    """
    part = load(spark, sf_dir, "part").filter("p_size >= 10").select("p_partkey", "p_brand")
    line = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    n = tasks(line, 500_000)
    line = line.repartition(n, "p_partkey").join(part, "p_partkey").repartition(n, "o_orderkey").groupBy("o_orderkey", "p_brand").agg(F.count("*").alias("lines"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").repartition(n, "o_orderkey").groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").alias("times"))
    joined = line.join(orders, "o_orderkey")
    return joined.groupBy("p_brand", "o_orderpriority").agg(F.sum(F.col("lines") * F.col("times")).alias("n"), F.count("*").alias("orders"))


@query("left_enrich", "SELECT o_orderkey, o_orderstatus, c_mktsegment, c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def left_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = load(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey").join(rich, "o_custkey", "left").drop("o_custkey")


@query("left_counts", "SELECT c_custkey, c_name, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return with_counts(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "n")


LATERAL = """SELECT n_nationkey, n_name, x.orders, x.total FROM nation LEFT JOIN LATERAL (
    SELECT count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) x ON true"""


@query("lateral_aggregate", LATERAL)
def lateral_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated aggregate for each row; Catalyst turns the lateral join into an aggregate and a join."""
    nation, customer, orders = (load(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    inner = customer.join(orders, F.col("o_custkey") == F.col("c_custkey")).filter(F.col("c_nationkey") == F.col("n_nationkey").outer())
    inner = inner.select(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return nation.select("n_nationkey", "n_name").lateralJoin(inner, how="left").select("n_nationkey", "n_name", "orders", "total")


@query("scalar_subqueries", "SELECT r_regionkey, r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS children, (SELECT count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS documents FROM region")
def scalar_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    mine = F.col("n_regionkey") == F.col("r_regionkey").outer()
    children = nation.filter(mine).select(F.count("*")).scalar()
    documents = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey")).filter(mine).select(F.count("*")).scalar()
    return region.select("r_regionkey", "r_name", children.alias("children"), documents.alias("documents"))


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = load(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_semi")


@query("anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@query("counters_clamped", "SELECT o_orderkey, 4 AS total, least(coalesce(n, 0), 4)::BIGINT AS done FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey")
def counters_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import counters from their parts, never above the total."""
    done = load(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    out = with_counts(load(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey", "done")
    return out.select("o_orderkey", F.lit(4).alias("total"), F.least("done", F.lit(4)).cast("long").alias("done"))


@query("store_health", "SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN n < 3 THEN 'partial' ELSE 'healthy' END AS health FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = load(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    out = with_counts(load(spark, sf_dir, "orders").select("o_orderkey"), indexed, "o_orderkey", "n")
    return out.select("o_orderkey", health(F.lit(3), F.col("n")).alias("health"))


@query("latest_per_group", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")])


@query("version_numbers", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders")
def version_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).cast("long").alias("version"))


@query("overlay_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'privileged' WHEN c_mktsegment = 'BUILDING' THEN 'work_product' END AS status FROM customer")
def overlay_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New statuses over old ones, by key."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", "work_product").alias("status"))
    new = rows.filter("c_acctbal < 0").select("c_custkey", F.lit("privileged").alias("status"))
    return overlay(rows, new, "c_custkey", ["status"]).select("c_custkey", "status")


@query("privilege_filter", "SELECT c_custkey, c_name FROM customer WHERE CASE WHEN c_acctbal < 0 THEN 'privileged' WHEN c_mktsegment = 'BUILDING' THEN 'work_product' WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE 'public' END IS NULL OR NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')")
def privilege_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Privileged rows go, rows without a status stay."""
    seg = F.col("c_mktsegment")
    status: Column = F.when(F.col("c_acctbal") < 0, "privileged").when(seg == "BUILDING", "work_product").when(seg == "MACHINERY", F.lit(None)).otherwise("public")
    return load(spark, sf_dir, "customer").filter(visible(status)).select("c_custkey", "c_name")


@query("filtered_page", "SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type IN (SELECT min(p_type) FROM part UNION SELECT max(p_type) FROM part) AND p_name ILIKE '%a%' AND p_size >= 3 ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20 OFFSET 5")
def filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a conjunctive document filter; the limit is the page."""
    part = load(spark, sf_dir, "part")
    ends = part.agg(F.min("p_type"), F.max("p_type")).first()
    found = select_documents(part, types=list(ends), name_like="a", least=("p_size", 3), type_col="p_type", name_col="p_name")
    return page(found.select("p_partkey", "p_name", "p_retailprice"), [F.desc_nulls_last("p_retailprice"), F.col("p_partkey")], 5, 20)


@query("purge_matter", "SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0 UNION ALL SELECT 'audit', count(*) FROM orders")
def purge_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's rows leave every table but the audit trail."""
    orders = load(spark, sf_dir, "orders").select("o_custkey")
    kept = purge({"orders": orders, "audit": orders}, "o_custkey", orders.filter("o_custkey % 5 = 0"), keep=["audit"])
    return kept["orders"].agg(F.lit("orders").alias("t"), F.count("*").alias("n")).unionByName(kept["audit"].agg(F.lit("audit").alias("t"), F.count("*").alias("n")))


@query("case_context", "SELECT c_custkey, c_name, count(o_orderkey) AS n_claims, min(o_orderkey) AS first_claim FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def case_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row with its children as one nested list."""
    claims = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("claims"))
    whole = load(spark, sf_dir, "customer").select("c_custkey", "c_name").join(claims, "c_custkey", "left")
    n = F.coalesce(F.size(F.coalesce("claims", F.array())), F.lit(0)).cast("long")
    return whole.select("c_custkey", "c_name", n.alias("n_claims"), F.try_element_at("claims", F.lit(1))["o_orderkey"].alias("first_claim"))


@query("sample_by_type", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def sample_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus sample: at most three of each type."""
    return first_by(load(spark, sf_dir, "part").select("p_type", "p_partkey", "p_retailprice"), ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 3).drop("p_retailprice")


@query("settings_overrides", "SELECT n_nationkey, coalesce(s.v, n_name) AS value, s.v IS NOT NULL AS overridden FROM nation LEFT JOIN (SELECT s_nationkey, max(s_name) AS v FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def settings_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults of a registry under the rows that override them."""
    over = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_name").alias("v"))
    return load(spark, sf_dir, "nation").join(over, "n_nationkey", "left").select("n_nationkey", F.coalesce("v", "n_name").alias("value"), F.col("v").isNotNull().alias("overridden"))


@query("rank_list", "SELECT s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier")
def rank_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by score within a scope, from 1."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.row_number().over(w).cast("long").alias("rank"))


@query("first_occurrence", "SELECT l_partkey, l_suppkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the edges with one source, target and relation, in the order of arrival."""
    edges = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")
    return first_by(edges, ["l_partkey", "l_suppkey", "l_returnflag"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query("array_containment", "SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1 HAVING list_contains(list(DISTINCT o_orderpriority), '1-URGENT')")
def array_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose list of values holds one."""
    sets = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))
    return sets.filter(F.array_contains("priorities", "1-URGENT"))


@query("match_union", "SELECT p_partkey AS id, max(score) AS score, max(method) AS method FROM (SELECT p_partkey, 100 AS score, 'exact' AS method FROM part WHERE p_size = 10 UNION ALL SELECT p_partkey, 85, 'fuzzy' FROM part WHERE p_size BETWEEN 8 AND 12) GROUP BY 1 HAVING count(*) >= 1")
def match_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of two methods in one table, the better score of each id."""
    part = load(spark, sf_dir, "part")
    kind = lambda c, score, name: part.filter(c).select(F.col("p_partkey").alias("id"), F.lit(score).alias("score"), F.lit(name).alias("method"))
    both = kind("p_size = 10", 100, "exact").unionByName(kind("p_size BETWEEN 8 AND 12", 85, "fuzzy"))
    return both.groupBy("id").agg(F.max("score").alias("score"), F.max("method").alias("method"))
