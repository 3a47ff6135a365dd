"""Hierarchies and graph analytics: nations, customers and suppliers as a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.names import block_keys, canonical, different_people, first_last, folded, fuzzy_pairs, garbage_category, garbage_name, normal_name, without_title
from foliant.operators.components import connected_components, merged_components
from foliant.operators.graphs import betweenness, co_occurrence, degree, hops_from, merged_nodes, modularity_communities, neighbours, page_rank, reporting_chain, two_tiers
from foliant.operators.rows import thread_depth
from foliant.plans.commerce import PAIRS, pairs
from foliant.plans.lineage import cut, tasks
from foliant.registry import load, query

TREE = """t AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"""

def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        region.select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
        .union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"), "n_name"))
        .union(customer.select(name("c", "c_custkey"), name("n", "c_nationkey"), "c_name"))
    )


#: Customers and suppliers that meet in orders, and in how many: a graph that grows with the tables.
MARKET = "e AS MATERIALIZED (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, count(DISTINCT o_orderkey)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), b AS MATERIALIZED (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


def commerce_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges are made distinct and counted by keys, and get their names at the end: names would be most of what is shuffled."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = tasks(lines)
    lines = lines.repartition(n, "l_orderkey").distinct()
    met = lines.join(orders, "l_orderkey").repartition(n, "o_custkey").groupBy("o_custkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))
    return met.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), "weight")


RECURSIVE = "WITH RECURSIVE {tree}, w AS (SELECT id, parent, name, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, t.name, depth + 1 FROM t JOIN w ON t.parent = w.id WHERE depth < 5) "


@query("folder_tree", RECURSIVE.format(tree=TREE) + ", k AS (SELECT parent, count(*) AS n FROM t WHERE parent IS NOT NULL GROUP BY 1) SELECT w.id, w.parent, w.name, depth, coalesce(n, 0) AS children FROM w LEFT JOIN k ON k.parent = w.id".replace(", k AS", ", k AS"))
def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders from the roots down, five levels at most, by a recursive query; children counted in one aggregate."""
    nodes = tree(spark, sf_dir)
    walked = spark.sql("WITH RECURSIVE w AS (SELECT id, parent, name, 0 AS depth FROM {t} WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, t.name, w.depth + 1 FROM {t} t JOIN w ON t.parent = w.id WHERE w.depth < 5) SELECT * FROM w", t=nodes)
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    return walked.join(children, "id", "left").select("id", "parent", "name", "depth", F.coalesce("children", F.lit(0)).alias("children"))


@query("folder_depths", f"WITH RECURSIVE {TREE}, w AS (SELECT id, parent, 0 AS depth FROM t UNION ALL SELECT w.id, t.parent, depth + 1 FROM w JOIN t ON t.id = w.parent) SELECT id, max(depth) AS depth FROM w GROUP BY 1")
def folder_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each folder's distance from its root, by pointers that double; folders on or below a cycle would get no row."""
    return thread_depth(tree(spark, sf_dir), "id", "parent").select("id", "depth")


@query("graph_stats", f"WITH {MARKET} SELECT 'nodes' AS what, count(DISTINCT src) AS n FROM b UNION ALL SELECT 'edges', count(*) FROM e")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = commerce_graph(spark, sf_dir)
    ends = edges.select("src").union(edges.select("dst"))
    return ends.agg(F.lit("nodes").alias("what"), F.countDistinct("src").alias("n")).union(edges.agg(F.lit("edges").alias("what"), F.count("*").alias("n")))


@query("graph_degree", f"WITH {MARKET} SELECT src AS node, count(*) AS degree FROM b GROUP BY 1")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degree(commerce_graph(spark, sf_dir))


@query("graph_neighbours", f"WITH {MARKET} SELECT src, dst, weight, rank FROM (SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM b WHERE src LIKE 's%') WHERE rank <= 3")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"))
    return neighbours(commerce_graph(spark, sf_dir), suppliers, 3, tasks(load(spark, sf_dir, "lineitem"))).withColumn("rank", F.col("rank").cast("long"))


def rank_sql(rounds: int) -> str:
    out = [f"WITH {MARKET}, d AS MATERIALIZED (SELECT src, count(*) AS n FROM b GROUP BY 1), l AS MATERIALIZED (SELECT b.src, b.dst, n FROM b JOIN d USING (src)), r0 AS (SELECT src AS node, 1.0::DOUBLE AS rank FROM d)"]
    for k in range(rounds):
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT l.dst AS node, 0.15 + 0.85 * sum(rank / n) AS rank FROM l JOIN r{k} ON node = l.src GROUP BY 1)")
    return ", ".join(out) + f" SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query("graph_page_rank", rank_sql(20))
def graph_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rank(commerce_graph(spark, sf_dir)).select("node", F.round("rank", 6).alias("rank"))


@query("graph_shortest_paths", f"""WITH RECURSIVE {MARKET}, w AS (SELECT src AS a, src AS node, 0 AS hops FROM b WHERE src LIKE 's%0' UNION SELECT w.a, b.dst, hops + 1 FROM w JOIN b ON b.src = w.node WHERE hops < 4) SELECT a, node AS b, min(hops) AS hops FROM w WHERE node LIKE 's%' AND node <> a GROUP BY 1, 2""")
def graph_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from each tenth supplier to every other one, four at most: the queries are a stated set of starts."""
    starts = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("a")).filter("a LIKE 's%0'")
    return hops_from(commerce_graph(spark, sf_dir), starts, 4).filter("b LIKE 's%' AND a <> b").select("a", "b", "hops")


@query("graph_betweenness")
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness of customers and suppliers from 200 pivots, with a bound of its error; exact for up to 200 nodes. Tests hold both against Brandes' sums."""
    found = betweenness(commerce_graph(spark, sf_dir), pivots=200)
    return found.select("node", F.round("betweenness", 4).alias("betweenness"), F.round("bound", 4).alias("bound"))


@query("graph_communities")
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity communities of customers and suppliers in two tiers; those under three members share a parent. Tests hold the modularity against brute force."""
    found = modularity_communities(commerce_graph(spark, sf_dir))
    return two_tiers(found.select(F.col("community").alias("id"), F.col("node").alias("member")))


BRANDS = """WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey || ' ' || p_brand AS b FROM lineitem JOIN part ON p_partkey = l_partkey), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  w AS (SELECT a AS node, a AS seen FROM l UNION SELECT w.node, l.b FROM w JOIN l ON l.a = w.seen) SELECT node, min(seen) AS component FROM w GROUP BY 1"""


@query("graph_components", BRANDS)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their suppliers' brand desks (a supplier has one for each brand) as a graph, which falls apart at least by brands. Repeated edges may stay."""
    return connected_components(desks(spark, sf_dir, load(spark, sf_dir, "lineitem").withColumn("year", F.lit(0))), "a", "b")


@query("components_by_batch", BRANDS)
def components_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph, its edges coming in three batches by their first shipment, each merged into the stars of those before."""
    first = load(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.coalesce(F.year(F.min("l_shipdate")), F.lit(0)).alias("year"))
    edges = cut(desks(spark, sf_dir, first), "desks")
    stars = spark.createDataFrame([], "node string, component string")
    for low, high in ((0, 1994), (1994, 1996), (1996, 9999)):
        stars = cut(merged_components(stars, edges.filter(F.col("year").between(low, high - 1)), "a", "b"), "stars")
    return stars


def desks(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(part, "l_partkey").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey", F.lit(" "), "p_brand").alias("b"), "year")


@query("co_purchase", "SELECT a, b, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_suppkey AS a FROM lineitem) x JOIN (SELECT DISTINCT l_orderkey, l_suppkey AS b FROM lineitem) y USING (l_orderkey) WHERE a < b GROUP BY 1, 2")
def co_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that meet in orders; a place holds a few items, so pairs grow with the places."""
    return co_occurrence(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), "l_suppkey", "l_orderkey")


@query("reporting_chains", f"""WITH RECURSIVE {PAIRS}, h AS (SELECT a.sender AS src, a.recipient AS dst FROM pairs a LEFT JOIN pairs b ON a.sender = b.recipient AND a.recipient = b.sender WHERE a.sender < a.recipient AND a.message_count > coalesce(b.message_count, 0) AND a.earliest <= TIMESTAMP '1998-01-01'),
  w AS (SELECT src AS start, dst AS manager, 1 AS depth FROM h UNION SELECT w.start, h.dst, depth + 1 FROM w JOIN h ON h.src = w.manager WHERE depth < 10) SELECT start, manager, min(depth) AS depth FROM w GROUP BY 1, 2""")
def reporting_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    back = p.select(F.col("sender").alias("recipient"), F.col("recipient").alias("sender"), F.col("message_count").alias("back"))
    up = p.join(back, ["sender", "recipient"], "left").filter((F.col("sender") < F.col("recipient")) & (F.col("message_count") > F.coalesce("back", F.lit(0))))
    edges = up.select(F.col("sender").alias("src"), F.col("recipient").alias("dst"), F.col("earliest").cast("timestamp").alias("since"), F.lit(None).cast("timestamp").alias("until"))
    return reporting_chain(edges, edges.select(F.col("src").alias("node")).distinct(), "1998-01-01")


ALIASED = "CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_brand || ' ' || p_partkey % 3 END"


def aliased() -> tuple[Column, Column]:
    """A part's brand, written in one of four ways, and the brand that an alias table gives for it."""
    k = F.col("p_partkey")
    return F.when(k % 4 == 0, F.col("p_brand")).otherwise(F.concat_ws(" ", "p_brand", (k % 3).cast("string"))), F.regexp_replace("name", " [0-9]$", "")


@query("merged_entities", f"WITH n AS (SELECT {ALIASED} AS name FROM part) SELECT regexp_replace(name, ' [0-9]$', '') AS name, count(*) AS mention_count, list_sort(list_filter(list(DISTINCT name), lambda x: regexp_matches(x, ' [0-9]$'))) AS aliases FROM n GROUP BY 1")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that an alias table maps to their canonical ones, counts added up."""
    return merged(spark, sf_dir)[0].select("name", "mention_count", "aliases")


@query("merged_edges", f"""WITH n AS (SELECT DISTINCT l_orderkey, {ALIASED} AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
  e AS (SELECT regexp_replace(x.name, ' [0-9]$', '') AS src, regexp_replace(y.name, ' [0-9]$', '') AS dst FROM n x JOIN n y ON x.l_orderkey = y.l_orderkey AND x.name < y.name) SELECT src, dst, count(*)::DOUBLE AS weight FROM e WHERE src <> dst GROUP BY 1, 2""")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the merged names: moved to the canonical ones, weights added up, loops gone."""
    return merged(spark, sf_dir)[1]


def merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name, canonical_name = aliased()
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), name.alias("name"))
    nodes = part.groupBy("name").agg(F.count("*").alias("mention_count"))
    mapping = nodes.filter(F.col("name").rlike(" [0-9]$")).select(F.col("name").alias("alias"), canonical_name.alias("canonical"))
    met = co_occurrence(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey"), "name", "l_orderkey")
    return merged_nodes(nodes, met.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").cast("double").alias("weight")), mapping)


@query("mention_counts", "SELECT p_brand AS name, p_type AS type, count(*) AS mention_count, min(p_partkey) AS first_seen, max(p_partkey) AS last_seen FROM part GROUP BY 1, 2")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities merged by name and type, as a graph upsert counts them."""
    return load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("type")).agg(F.count("*").alias("mention_count"), F.min("p_partkey").alias("first_seen"), F.max("p_partkey").alias("last_seen"))


@query("witness_stats", "SELECT c_nationkey AS person, count(DISTINCT o_orderkey) AS documents, count(DISTINCT l_suppkey) AS connected FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def witness_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("person"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("person").agg(F.countDistinct("o_orderkey").alias("documents"), F.countDistinct("l_suppkey").alias("connected"))


@query("common_emails", "SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b, a.l_orderkey AS email FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey WHERE a.l_shipdate >= TIMESTAMP '1997-01-01' AND b.l_shipdate >= TIMESTAMP '1997-01-01'")
def common_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two correspondents and the messages that both took part in."""
    parts = load(spark, sf_dir, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '1997-01-01'").select("l_orderkey", "l_suppkey").distinct()
    a, b = parts.select("l_orderkey", F.col("l_suppkey").alias("a")), parts.select("l_orderkey", F.col("l_suppkey").alias("b"))
    return a.join(b, "l_orderkey").filter("a < b").select("a", "b", F.col("l_orderkey").alias("email"))


@query("name_normalisation", r"SELECT c_custkey, trim(regexp_replace(regexp_replace(c_name, '[\r\n]+', ' ', 'g'), '\s+', ' ', 'g')) AS name, lower(c_name) AS folded, false AS garbage FROM customer")
def name_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = normal_name(F.col("c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), folded(F.col("c_name")).alias("folded"), garbage_name(F.col("c_name")).alias("garbage"))


@query("canonical_names", "SELECT lower(p_brand) AS key, count(*) AS n, max(p_brand) AS canonical FROM part GROUP BY 1")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ by case, upper-cased for every third part, and the one that stands for each group."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand"))
    return load(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("key")).agg(F.count("*").alias("n"), canonical(name).alias("canonical"))


WORDS_SQL = "list_sort(list_filter(regexp_split_to_array(lower(trim(p_name)), '\\s+'), lambda x: x <> ''))"


@query("fuzzy_matches")
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that are 85 % alike or more by their sorted words, guarded against different first names; tests compare all pairs by brute force."""
    cleaned = first_last(without_title(normal_name(F.col("p_name"))))
    found = fuzzy_pairs(load(spark, sf_dir, "part").select(cleaned.alias("name")), "name")
    return found.filter(~different_people(F.col("a"), F.col("b"))).select("a", "b", F.round("score", 6).alias("score"))


@query("name_blocks", f"""WITH w AS (SELECT p_partkey, {WORDS_SQL} AS w, regexp_split_to_array(lower(trim(p_name)), '\\s+') AS o FROM part),
  l AS (SELECT *, list_filter(o, lambda x: length(x) = list_max(list_transform(o, lambda y: length(y))))[1] AS longest FROM w),
  r AS (SELECT *, regexp_replace(longest, '[aeiou]', '', 'g') AS bones, CASE WHEN list_position(o, longest) = 1 THEN o[2] ELSE o[1] END AS second FROM l),
  k AS (SELECT p_partkey, unnest([CASE WHEN len(list_filter(w, lambda x: length(x) >= 2)) > 0 THEN 'starts=' || array_to_string(list_sort(list_transform(list_filter(w, lambda x: length(x) >= 2), lambda x: x[1:3]))[1:3], ' ') END,
    CASE WHEN length(longest) >= 3 THEN 'longest=' || longest[1:4] END, CASE WHEN length(bones) >= 3 THEN 'bones=' || bones[1:4] END, CASE WHEN length(second) >= 3 THEN 'second=' || second[1:4] END]) AS key FROM r)
  SELECT key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY 1""")
def name_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names share each rough key."""
    return load(spark, sf_dir, "part").select(F.explode(block_keys(F.col("p_name"), F.lit("person"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("garbage_categories", "SELECT category, tier, count(*) AS n FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'email-persons' WHEN 1 THEN 'bare-suffixes' WHEN 2 THEN 'numeric-only' WHEN 3 THEN 'org-as-person' WHEN 4 THEN 'short-persons' END AS category, CASE WHEN p_partkey % 6 = 3 THEN 2 WHEN p_partkey % 6 < 5 THEN 1 END AS tier FROM part) WHERE category IS NOT NULL GROUP BY 1, 2")
def garbage_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "a@b.com").when(k == 1, "LLC").when(k == 2, "12.5").when(k == 3, F.concat("p_brand", F.lit(" Foundation"))).when(k == 4, "Al").otherwise("Anna Bell")
    kind = F.when(k == 1, "organization").otherwise("person")
    found = load(spark, sf_dir, "part").select(garbage_category(name, kind).alias("g")).filter("g IS NOT NULL")
    return found.groupBy(F.col("g.category").alias("category"), F.col("g.tier").alias("tier")).agg(F.count("*").alias("n"))
