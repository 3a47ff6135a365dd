"""Case work queries: the order tables stand in for documents, jobs, memos and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.names import EXACT_TYPES
from foliant.functions.text import citation_rates, citations, numbered_citations, pii_spans, with_context
from foliant.operators.casework import (
    OVERRIDES, accepted_overrides, backfilled, best_above, finalised, found_document, kept_polls, matches_any, metadata_totals, privilege_suggestions,
    rates, replaced_children, resolved_entities, settled_jobs, worth_context,
)
from foliant.operators.chunks import redacted, still_there
from foliant.operators.graphs import edited, entity_connections, plain_neighbours, temporal_edges
from foliant.operators.mail import assign_threads, communication_pairs
from foliant.operators.mentions import chunk_graph, names_found
from foliant.operators.rows import first_by, insert_new, with_counts
from foliant.registry import load, load_spread, query

#: People, companies and places with what joins them, from the order tables; names are those of the tables.
NODES = """nodes AS (SELECT c_name AS name, 'person' AS type FROM customer UNION ALL SELECT s_name, 'organization' FROM supplier UNION ALL SELECT n_name, 'location' FROM nation UNION ALL SELECT r_name, 'region' FROM region)"""
LINKS = """links AS (SELECT c_name AS src, n_name AS dst, 'LIVES_IN' AS relation FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT s_name, n_name, 'BASED_IN' FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT n_name, r_name, 'PART_OF' FROM nation JOIN region ON r_regionkey = n_regionkey)"""
EITHER = "either AS (SELECT src, dst, relation FROM links UNION ALL SELECT dst, src, relation FROM links)"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    region, nation, customer, supplier = (load(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    named = lambda df, c, kind: df.select(F.col(c).alias("name"), F.lit(kind).alias("type"))
    nodes = named(customer, "c_name", "person").union(named(supplier, "s_name", "organization")).union(named(nation, "n_name", "location")).union(named(region, "r_name", "region"))
    places = nation.select("n_nationkey", "n_name", "n_regionkey")
    link = lambda df, key, at, src, dst, kind: df.join(places if at == "n_nationkey" else region, F.col(key) == F.col(at)).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("relation"))
    links = link(customer, "c_nationkey", "n_nationkey", "c_name", "n_name", "LIVES_IN").union(link(supplier, "s_nationkey", "n_nationkey", "s_name", "n_name", "BASED_IN")).union(link(nation, "n_regionkey", "r_regionkey", "n_name", "r_name", "PART_OF"))
    return nodes, links


@query("graph_labels", f"WITH {NODES}, {LINKS} SELECT 'node' AS what, coalesce(type, 'all') AS kind, count(*) AS n FROM nodes GROUP BY ROLLUP (type) UNION ALL SELECT 'edge', coalesce(relation, 'all'), count(*) FROM links GROUP BY ROLLUP (relation)")
def graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by label and edges by type, with totals."""
    nodes, links = graph(spark, sf_dir)
    count = lambda df, c, what: df.rollup(c).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.coalesce(c, F.lit("all")).alias("kind"), "n")
    return count(nodes, "type", "node").union(count(links, "relation", "edge"))


@query("plain_neighbours", f"WITH {NODES}, {LINKS}, {EITHER} SELECT DISTINCT e.src AS name, e.dst AS other, relation FROM either e JOIN nodes s ON s.name = e.src AND s.type = 'location' JOIN nodes n ON n.name = e.dst AND n.type IN ('person', 'organization', 'location', 'monetary_amount') AND length(n.name) >= 5 WHERE e.src <> e.dst")
def neighbours_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is joined to each nation, but for regions, short names and itself."""
    nodes, links = graph(spark, sf_dir)
    return plain_neighbours(links, nodes, nodes.filter("type = 'location'").select("name"))


ASKED = "asked AS (SELECT s_suppkey AS id, 'What does ' || s_name || ' sell in ' || n_name || '?' AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


@query("entity_retrieval", f"WITH {NODES}, {LINKS}, {EITHER}, {ASKED}, said AS (SELECT id, name FROM asked JOIN nodes ON contains(lower(' ' || regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '), lower(' ' || regexp_replace(name, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '))) SELECT DISTINCT id, said.name, e.dst AS other, relation FROM said JOIN either e ON e.src = said.name JOIN nodes n ON n.name = e.dst AND n.type IN ('person', 'organization', 'location', 'monetary_amount') AND length(n.name) >= 5 WHERE e.src <> e.dst")
def entity_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about suppliers and nations, and the graph's connections of what they name."""
    nodes, links = graph(spark, sf_dir)
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    asked = load(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("What does "), "s_name", F.lit(" sell in "), "n_name", F.lit("?")).alias("text"))
    return entity_connections(asked, links, nodes, "id", "text")


@query("edited_graph", f"""WITH {NODES}, {LINKS}, n AS (SELECT CASE WHEN type = 'location' THEN lower(name) ELSE name END AS name, CASE WHEN type = 'organization' THEN 'company' ELSE type END AS type FROM nodes WHERE type <> 'region'),
  e AS (SELECT CASE WHEN relation = 'PART_OF' THEN lower(src) ELSE src END AS src, CASE WHEN relation <> 'PART_OF' THEN lower(dst) ELSE dst END AS dst, relation FROM links WHERE dst NOT IN (SELECT r_name FROM region))
  SELECT 'node' AS what, name AS a, type AS b, NULL AS c FROM n UNION ALL SELECT 'edge', src, dst, relation FROM e""")
def edited_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations renamed, suppliers retyped, regions deleted with their edges."""
    nodes, links = graph(spark, sf_dir)
    kind = F.col("type")
    changes = nodes.filter("type <> 'person'").select("name", F.when(kind == "location", F.lower("name")).alias("new_name"), F.when(kind == "organization", "company").alias("new_type"), (kind == "region").alias("gone"))
    n, e = edited(nodes, links, changes)
    return n.select(F.lit("node").alias("what"), F.col("name").alias("a"), F.col("type").alias("b"), F.lit(None).cast("string").alias("c")).union(e.select(F.lit("edge"), "src", "dst", "relation"))


@query("temporal_edges", """WITH o AS (SELECT o_custkey AS src, o_custkey % 10 AS dst, CASE o_orderpriority WHEN '1-URGENT' THEN 'MANAGES' WHEN '2-HIGH' THEN 'REPORTS_TO' WHEN '3-MEDIUM' THEN 'KNOWS' WHEN '5-LOW' THEN 'HAS_ROLE' ELSE 'PAYS' END AS relation, o_orderdate AS since, o_orderkey % 2 AS new FROM orders),
  old AS (SELECT src, dst, relation, min(since) AS since FROM o WHERE new = 0 AND relation IN ('MANAGES', 'HAS_ROLE', 'REPORTS_TO') GROUP BY 1, 2, 3), n AS (SELECT src, dst, relation, max(since) AS since FROM o WHERE new = 1 AND relation IN ('MANAGES', 'HAS_ROLE', 'REPORTS_TO') GROUP BY 1, 2, 3)
  SELECT * FROM n UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.src = old.src AND n.dst = old.dst AND n.relation = old.relation)""")
def temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated relations of customers: odd orders' are merged into even orders', others than the allowed ones don't come in."""
    p = F.col("o_orderpriority")
    relation = F.when(p == "1-URGENT", "MANAGES").when(p == "2-HIGH", "REPORTS_TO").when(p == "3-MEDIUM", "KNOWS").when(p == "5-LOW", "HAS_ROLE").otherwise("PAYS")
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") % 10).alias("dst"), relation.alias("relation"), F.col("o_orderdate").alias("since"), F.lit(None).cast("timestamp_ntz").alias("until"), (F.col("o_orderkey") % 2).alias("new"))
    none = rows.limit(0).drop("new")
    old = temporal_edges(none, rows.filter("new = 0").groupBy("src", "dst", "relation").agg(F.min("since").alias("since"), F.min("until").alias("until")))
    return temporal_edges(old, rows.filter("new = 1").drop("new")).select("src", "dst", "relation", "since")


@query("any_of_four", "SELECT c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE lower(c_name) = 'asia' OR lower(c_mktsegment) = 'asia' OR lower(n_name) = 'asia' OR lower(r_name) = 'asia'")
def any_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A participant by any of four columns, in any case."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    rows = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.filter(matches_any(["c_name", "c_mktsegment", "n_name", "r_name"], F.lit("Asia"))).select("c_custkey", "c_name")


@query("object_containment", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def object_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose array of objects holds one with two given values; the children of a row are a bounded list here, as they are where they are stored."""
    lists = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderstatus", "o_orderpriority")).alias("claims"))
    hit = F.exists("claims", lambda c: (c["o_orderstatus"] == "F") & (c["o_orderpriority"] == "1-URGENT"))
    return lists.filter(hit).select("o_custkey", F.size("claims").cast("long").alias("n"))


@query("score_search", "SELECT event_id, value FROM events WHERE value >= 50 ORDER BY value DESC, event_id LIMIT 20")
def score_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best scores over a threshold: the limit is the search's."""
    return best_above(load(spark, sf_dir, "events").select("event_id", "value"), "value", 50, "event_id", 20)


@query("document_lifecycle", "SELECT o_orderkey, CASE WHEN n IS NULL THEN 'pending' ELSE 'complete' END AS status, coalesce(n, 0) AS chunks FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1) ON l_orderkey = o_orderkey")
def document_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders inserted early, finalised by what has been shipped."""
    early = load(spark, sf_dir, "orders").select("o_orderkey", F.lit(0).cast("long").alias("chunks"))
    results = load(spark, sf_dir, "lineitem").filter("l_shipdate < TIMESTAMP_NTZ '1996-01-01'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("chunks"))
    return finalised(early, results, "o_orderkey", ["chunks"])


@query("insert_folders", "WITH f AS (SELECT DISTINCT CASE WHEN p_size > 25 THEN p_brand END AS parent, p_type AS name, p_size % 2 AS new FROM part) SELECT DISTINCT parent, name FROM f WHERE new = 1 AND NOT EXISTS (SELECT 1 FROM f o WHERE o.new = 0 AND o.name = f.name AND o.parent IS NOT DISTINCT FROM f.parent)")
def insert_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that aren't there yet, unique by parent and name, roots (no parent) included."""
    rows = load(spark, sf_dir, "part").select(F.when(F.col("p_size") > 25, F.col("p_brand")).alias("parent"), F.col("p_type").alias("name"), (F.col("p_size") % 2).alias("new"))
    return insert_new(rows.filter("new = 0"), rows.filter("new = 1"), ["parent", "name"]).select("parent", "name")


@query("mention_edges", "SELECT p_brand AS name, p_type AS type, l_orderkey AS doc, min(l_linenumber) AS page, count(*) AS mentions FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3")
def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MENTIONED_IN edges of entities merged by name and type: one for each document, with the first page and the mentions."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name"), F.col("p_type").alias("type"))
    lines = load(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber").join(part, "l_partkey")
    return lines.groupBy("name", "type", F.col("l_orderkey").alias("doc")).agg(F.min("l_linenumber").alias("page"), F.count("*").alias("mentions"))


SAID = "n AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{6,}')) AS name FROM conversations WHERE regexp_extract(text, '[A-Za-z]{6,}') <> ''), m AS (SELECT doc_id, name FROM documents JOIN n ON contains(lower(text), name))"


def spoken_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first long word of each message, as names that extraction found."""
    name = F.regexp_extract("text", "[A-Za-z]{6,}", 0)
    return load(spark, sf_dir, "conversations").filter(name != "").select(F.lower(name).alias("name")).distinct()


@query("chunk_mentions", f"WITH {SAID} SELECT doc_id, name FROM m")
def chunk_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXTRACTED_FROM edges: names to the texts that contain them."""
    return names_found(load_spread(spark, sf_dir, "documents"), spoken_names(spark, sf_dir), "doc_id", "text", "name").drop("mentions")


@query("chunk_pairs", f"WITH {SAID} SELECT a.name AS a, b.name AS b, count(*) AS weight FROM m AS a JOIN m AS b ON a.doc_id = b.doc_id AND a.name < b.name GROUP BY 1, 2")
def chunk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CO_OCCURS edges of the names that share texts."""
    return chunk_graph(load_spread(spark, sf_dir, "documents"), spoken_names(spark, sf_dir), "doc_id", "text", "name")[1]


@query("replaced_claims", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')")
def replaced_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of a case replaced as a whole by later ones."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    late = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    return replaced_children(orders.filter(~late), orders.filter(late), "o_custkey").select("o_custkey", "o_orderkey")


@query("memo_sections", "SELECT event_id, unnest(range(2)) AS place, unnest(['Event', 'Props']) AS title, unnest([event_type, props]) AS body FROM events")
def memo_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memos whose sections are stored as JSON, as rows again."""
    memo = F.to_json(F.array(F.struct(F.lit("Event").alias("title"), F.col("event_type").alias("body")), F.struct(F.lit("Props").alias("title"), F.col("props").alias("body"))))
    stored = load(spark, sf_dir, "events").select("event_id", memo.alias("sections"))
    rows = stored.select("event_id", F.posexplode(F.from_json("sections", "array<struct<title:string,body:string>>")).alias("place", "s"))
    return rows.select("event_id", F.col("place").cast("long").alias("place"), "s.title", "s.body")


@query("settled_jobs", "SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 2 = 0 AND event_id % 5 = 0 THEN 'pending' WHEN event_type = 'error' AND user_id % 2 = 0 AND event_id % 5 = 1 THEN 'dismissed' WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END AS status, CASE WHEN event_type = 'error' AND NOT (user_id % 2 = 0 AND event_id % 5 = 0) THEN props END AS error FROM events")
def jobs_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed jobs of a scope retried or dismissed."""
    failed = F.col("event_type") == "error"
    jobs = load(spark, sf_dir, "events").select("event_id", "user_id", F.when(failed, "failed").otherwise("complete").alias("status"), F.when(failed, F.col("props")).alias("error"))
    out = settled_jobs(jobs, jobs.filter("event_id % 5 = 0"), jobs.filter("event_id % 5 IN (0, 1)"), "event_id", F.col("user_id") % 2 == 0)
    return out.select("event_id", "status", "error")


@query("cluster_members", "WITH d AS (SELECT l_orderkey AS thread, l_linenumber AS doc, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linenumber % 3 END AS place FROM lineitem) SELECT thread, doc, row_number() OVER (PARTITION BY thread ORDER BY place DESC NULLS LAST, doc) AS at FROM d")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each thread in the order of a list, those without a place at the end."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("thread"), F.col("l_linenumber").alias("doc"), F.when(F.col("l_returnflag") != "N", F.col("l_linenumber") % 3).alias("place"))
    w = Window.partitionBy("thread").orderBy(F.desc_nulls_last("place"), "doc")
    return rows.select("thread", "doc", F.row_number().over(w).cast("long").alias("at"))


@query("recovered_document", "SELECT o_orderkey FROM orders WHERE (o_orderkey = 37 OR o_custkey = 37 OR o_orderpriority = '37') AND o_orderstatus <> 'P'")
def recovered_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document by its id, its job or its file name, if it isn't privileged."""
    docs = load(spark, sf_dir, "orders").withColumn("privilege_status", F.when(F.col("o_orderstatus") == "P", "privileged"))
    return found_document(docs, "o_orderkey", "o_custkey", "o_orderpriority", F.lit(37)).select("o_orderkey")


@query("backfilled_links", "SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS dataset, user_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def backfilled_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of users and datasets that JSON metadata names, added to those of the purchases."""
    events = load(spark, sf_dir, "events").select("user_id", "props", "event_type")
    links = events.filter("event_type = 'purchase'").select(F.get_json_object("props", "$.k").alias("dataset"), "user_id").filter("dataset IS NOT NULL").distinct()
    return backfilled(links, events, "user_id", "props", "k")


@query("unread_documents", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def unread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worklist: documents in which no entity was found yet."""
    found = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return with_counts(load(spark, sf_dir, "orders").select("o_orderkey"), found, "o_orderkey", "n").filter("n = 0").select("o_orderkey")


@query("top_entities", "SELECT type, name, n FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, name) AS r FROM (SELECT p_type AS type, p_brand AS name, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE r <= 5")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent entities of each type: the limit is the report."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("type"), F.col("p_brand").alias("name"))
    counts = load(spark, sf_dir, "lineitem").select("l_partkey").join(part, "l_partkey").groupBy("type", "name").agg(F.count("*").alias("n"))
    return first_by(counts, ["type"], [F.desc("n"), F.col("name")], 5)


@query("import_queues", "SELECT coalesce(sum(event_id), 0)::BIGINT AS queued, coalesce(sum(user_id), 0)::BIGINT AS active, max(value) AS eta FROM events WHERE event_type = 'view'")
def import_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "processing").otherwise("complete")
    rows = load(spark, sf_dir, "events").select(status.alias("status"), F.col("event_id").alias("queued"), F.col("user_id").alias("active"), F.col("value").alias("eta"))
    return metadata_totals(rows, ["queued", "active"], "eta")


@query("health_polls", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-02-20' - INTERVAL 31 DAY")
def health_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of two rounds, without those of more than 31 days ago."""
    polls = load(spark, sf_dir, "events").select("event_id", "ts")
    return kept_polls(polls.filter("event_id % 2 = 0"), polls.filter("event_id % 2 = 1"), "ts", "2024-02-20")


CASES = " ".join(f"WHEN param = '{k}' AND {'whole AND ' if kind == 'int' else ''}v BETWEEN {low} AND {high} THEN v" for k, (kind, low, high) in OVERRIDES.items())


@query("query_overrides", f"WITH a AS (SELECT event_id, (['{"', '".join([*OVERRIDES, 'unknown'])}'])[(event_id % 8 + 1)::INT] AS param, CASE WHEN event_id % 3 = 0 THEN (value / 40)::VARCHAR WHEN event_id % 3 = 1 THEN (user_id % 120)::VARCHAR ELSE event_type END AS value FROM events), b AS (SELECT *, try_cast(value AS DOUBLE) AS v, regexp_matches(value, '^\\s*[-+]?[0-9]+\\s*$') AS whole FROM a) SELECT event_id, param, CASE {CASES} END AS accepted FROM b")
def query_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that questions override, where type and range allow it."""
    k = F.col("event_id")
    value = F.when(k % 3 == 0, (F.col("value") / 40).cast("string")).when(k % 3 == 1, (F.col("user_id") % 120).cast("string")).otherwise(F.col("event_type"))
    param = F.element_at(F.array(*(F.lit(p) for p in (*OVERRIDES, "unknown"))), (k % 8 + 1).cast("int"))
    return accepted_overrides(load(spark, sf_dir, "events").select("event_id", param.alias("param"), value.alias("value"))).select("event_id", "param", "accepted")


@query("privilege_suggestions", "SELECT o_orderkey, 0 AS start, 0 AS end, 1.0::DOUBLE AS confidence, '[Full document — privilege-protected]' AS text FROM orders WHERE o_orderstatus IN ('P', 'F')")
def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A redaction of the whole document where it is privileged (P) or work product (F)."""
    status = F.when(F.col("o_orderstatus") == "P", "privileged").when(F.col("o_orderstatus") == "F", "work_product")
    return privilege_suggestions(load(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")), "o_orderkey", "status")


@query("enriched_chunks", "SELECT doc_id, left(sha256(CASE WHEN quality IS NULL OR quality >= 0.2 THEN 'From ' || source || chr(10) || chr(10) || text ELSE text END), 16) AS embedded FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def enriched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of each text: low-quality ones get no context before them."""
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = load(spark, sf_dir, "documents").select("doc_id", "source", "text").join(labels, "doc_id", "left")
    context = F.when(worth_context(F.col("quality")), F.concat(F.lit("From "), "source"))
    return rows.select("doc_id", F.substring(F.sha2(with_context(F.col("text"), context), 256), 1, 16).alias("embedded"))


ANSWERS = "SELECT l_orderkey, 'As [Source: s' || min(l_suppkey) || ', page ' || max(l_linenumber) || '] and [Source: s' || max(l_suppkey) || '.pdf, Page 1] say [2], [9].' AS answer, min(l_suppkey) AS a, max(l_suppkey) AS b, max(l_linenumber) AS p FROM lineitem GROUP BY 1"


@query("answer_citations", f"""WITH x AS ({ANSWERS}) SELECT l_orderkey, 2::BIGINT AS cited, round(((p <= 4)::INT + (starts_with('s' || a || '.', 's' || b || '.') OR contains('s' || b || '.pdf', 's' || a))::INT) / 2.0, 6)::DOUBLE AS accuracy,
  round((1 - (contains('s' || a, 's' || b || '.pdf') OR contains('s' || b || '.pdf', 's' || a))::INT) / 2.0, 6)::DOUBLE AS hallucination, round((contains('s' || b || '.pdf', 's' || a) = false)::INT / 2.0, 6)::DOUBLE AS post_rationalization, 's' || b AS second FROM x""")
def answer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite two suppliers' files each, of which the first one is expected (pages 1 to 4), found and read."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"), F.max("l_linenumber").alias("p"))
    name = lambda c: F.concat(F.lit("s"), c)
    answer = F.concat(F.lit("As [Source: "), name("a"), F.lit(", page "), "p", F.lit("] and [Source: "), name("b"), F.lit(".pdf, Page 1] say [2], [9]."))
    first = F.array(F.struct(name("a").alias("document_id"), F.lit(1).alias("page_start"), F.lit(4).alias("page_end")))
    found = rows.select("l_orderkey", answer.alias("answer"), first.alias("expected"), F.array(name("a")).alias("retrieved"), F.array(name("a"), name("b")).alias("sources"))
    shares = citation_rates(F.col("answer"), F.col("expected"), F.col("retrieved"), F.col("retrieved"))
    return found.select("l_orderkey", F.size(citations(F.col("answer"))).cast("long").alias("cited"), *rates(shares), numbered_citations(F.col("answer"), F.col("sources"))[0].alias("second"))


@query("pii_spans")
def spans_of_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of personal data in all documents; tests find them by Python's re."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(pii_spans(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.category", "s.confidence")


@query("redacted_documents")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their personal data, and whether any of it is left; tests redact them in plain Python."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", pii_spans(F.col("text")).alias("spans"))
    out = rows.withColumn("clean", redacted(F.col("text"), F.col("spans"), F.lit("[REDACTED]")))
    left = still_there(F.col("clean"), F.transform("spans", lambda s: s["text"]))
    return out.select("doc_id", F.size("spans").cast("long").alias("spans"), F.substring(F.sha2("clean", 256), 1, 16).alias("redacted_hash"), left.alias("left"))


MAILS = """m AS (SELECT o_orderkey AS doc, 'C ' || o_custkey AS from_name, 'c' || o_custkey || '@x.org' AS from_email, o_orderdate AS sent FROM orders),
  r AS (SELECT DISTINCT l_orderkey AS doc, CASE WHEN l_linenumber % 3 = 1 THEN 'to' WHEN l_linenumber % 3 = 2 THEN 'cc' ELSE 'bcc' END AS kind, l_suppkey AS s FROM lineitem)"""


@query("mail_pairs", f"WITH {MAILS} SELECT from_email AS sender_email, 's' || s || '@y.org' AS recipient_email, kind AS relationship_type, 'S ' || s AS recipient_name, from_name AS sender_name, count(*) AS message_count, min(sent) AS earliest, max(sent) AS latest FROM m JOIN r USING (doc) GROUP BY ALL")
def mail_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mails of a customer to suppliers, in lists as headers have them; directed pairs with their counts and dates."""
    kind = F.when(F.col("l_linenumber") % 3 == 1, "to").when(F.col("l_linenumber") % 3 == 2, "cc").otherwise("bcc")
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct(kind.alias("kind"), "l_suppkey").alias("r"))
    heads = rows.groupBy("o_orderkey").agg(F.array_sort(F.collect_set("r")).alias("all"))
    address = lambda r: F.concat(F.lit('"S '), r["l_suppkey"], F.lit('" <s'), r["l_suppkey"], F.lit("@y.org>"))
    line = lambda k: F.array_join(F.transform(F.filter("all", lambda r: r["kind"] == k), address), ", ").alias(k)
    heads = heads.select("o_orderkey", *(line(k) for k in ("to", "cc", "bcc")))
    mails = load(spark, sf_dir, "orders").join(heads, "o_orderkey").select(F.lit(1).alias("matter"), F.concat(F.lit("C "), "o_custkey").alias("from_name"), F.concat(F.lit("c"), "o_custkey", F.lit("@x.org")).alias("from_email"), "to", "cc", "bcc", F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss").alias("date"))
    out = communication_pairs(mails, "matter", 2024)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("earliest", "latest")}).drop("matter")


@query("mail_threads", """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM (SELECT DISTINCT conv_id, turn FROM conversations)), f AS (SELECT conv_id, min(turn) AS first FROM t GROUP BY 1)
  SELECT conv_id * 1000 + turn AS doc_id, left(sha256(CASE WHEN conv_id % 3 = 2 THEN 'thread ' || conv_id % 4 ELSE '<' || conv_id || '-' || first || '>' END), 16) AS thread_id,
  (CASE WHEN conv_id % 3 = 2 THEN 0 ELSE k END)::INT AS position FROM t JOIN f USING (conv_id)""")
def mail_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as mails of three kinds: with references from the root on, with replies alone, and with subjects alone, which are shared."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    w = Window.partitionBy("conv_id").orderBy("turn")
    name = F.concat(F.lit("<"), "conv_id", F.lit("-"), "turn", F.lit(">"))
    before = F.lag(name).over(w)
    references = F.array_join(F.collect_list(name).over(w.rowsBetween(Window.unboundedPreceding, -1)), " ")
    kind, subject = F.col("conv_id") % 3, F.concat(F.lit("Re: Thread "), F.col("conv_id") % 4)
    mails = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.when(kind != 2, name).alias("message_id"),
        F.when(kind == 1, before).alias("in_reply_to"),
        F.when(kind == 0, references).alias("references"),
        F.when(kind == 2, subject).alias("subject"),
    )
    return assign_threads(mails)


@query("entity_resolution")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and brands as entities of two kinds, merged where they match for certain; tests resolve them by brute force."""
    part = load(spark, sf_dir, "part")
    people = part.select(F.lit("person").alias("kind"), F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_name")).otherwise(F.col("p_name")).alias("name"))
    dates = part.select(F.lit("date").alias("kind"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("name"))
    return resolved_entities(people.union(dates).withColumn("mention_count", F.lit(1).cast("long")), EXACT_TYPES)[0]
