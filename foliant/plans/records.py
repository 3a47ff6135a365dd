"""Stored records: dates, addresses, names, logs, grants, tiers and lists over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.names import STOPWORDS, garbage_name, normal_name
from foliant.functions.text import addresses, document_date
from foliant.operators.casework import best_above
from foliant.operators.chunks import chunk
from foliant.operators.datasets import annotated, annotation_page, granted, tag_counts, tagged, with_edges
from foliant.operators.filters import in_dates, page, select_documents, token_valid, within
from foliant.operators.near_dup import version_groups
from foliant.operators.rows import insert_new, overlay, upsert_counts
from foliant.operators.vectors import visual_blend
from foliant.registry import load, load_spread, query
from foliant.sources.sinks import privilege_log

AS_OF = "1996-06-30 00:00:00"


@query("document_dates", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 0 THEN date_trunc('second', o_orderdate) ELSE date_trunc('day', o_orderdate) END AS at FROM orders")
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as headers write them (RFC 2822, ISO, American), without a year, and in a year that can't be."""
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(at, "EEE, d MMM yyyy HH:mm:ss '+0000'")).when(k == 1, F.date_format(at, "yyyy-MM-dd")).when(k == 2, F.date_format(at, "M/d/yyyy")).when(k == 3, F.date_format(at, "MMMM d, yyyy"))
    raw = raw.when(k == 4, F.date_format(at, "MMMM d")).otherwise(F.date_format(at, "'2999'-MM-dd"))
    return load(spark, sf_dir, "orders").select("o_orderkey", document_date(raw, 2024).cast("timestamp_ntz").alias("at"))


@query("mail_addresses", "SELECT c_custkey, unnest([c_name, '']) AS name, unnest(['c' || c_custkey || '@x.org', 'n' || c_nationkey || '@y.org']) AS email FROM customer")
def mail_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lists of a named and a bare address, and of something that is none."""
    line = F.concat(F.lit('"'), "c_name", F.lit('" <c'), "c_custkey", F.lit("@x.org>; n"), "c_nationkey", F.lit("@y.org, nobody"))
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.explode(addresses(line)).alias("a"))
    return rows.select("c_custkey", F.col("a.name").alias("name"), F.col("a.email").alias("email"))


@query("mail_sections")
def mail_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of messages that quote the text before them: body and quoted reply apart; tests cut them in plain Python."""
    turns = load_spread(spark, sf_dir, "conversations")
    mail = F.concat("text", F.lit("\n\nOn Monday A wrote:\n> "), "text")
    rows = turns.groupBy("conv_id", "turn").agg(F.min("text").alias("text")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), mail.alias("text"), F.when(F.col("turn") % 2 == 0, "email").otherwise("note").alias("kind"))
    return chunk(rows, kind=F.col("kind")).select("doc_id", "chunk_index", "section", "token_count", F.sha2("text", 256).alias("text_sha256"))


@query("document_versions")
def document_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions among near duplicates of a source, by file names that say so; tests find them by brute force."""
    mark = F.element_at(F.array(*(F.lit(x) for x in ("_v1", "_draft", "", " FINAL"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = load_spread(spark, sf_dir, "documents").select("doc_id", "text", "source", F.concat(F.lit("file"), mark, F.lit(".doc")).alias("name"))
    return version_groups(docs, "doc_id", "text", "name", "doc_id", ["source"])


NAMES = "CASE p_partkey % 9 WHEN 0 THEN 'it' WHEN 1 THEN (p_partkey % 1500)::VARCHAR WHEN 2 THEN 'www.' || p_name WHEN 3 THEN '#' || p_name WHEN 4 THEN p_name || chr(10) || p_name WHEN 5 THEN repeat(p_name, 9) WHEN 6 THEN 'PAwER ' || p_name WHEN 7 THEN replace(p_name, ' ', '-') || '-a-b' ELSE p_name END"


@query("garbage_names", f"""WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace({NAMES}, '[\\r\\n]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part)
  SELECT p_partkey, name, length(name) < 2 OR length(name) > 60 OR lower(name) IN ({', '.join(f"'{w}'" for w in STOPWORDS)}) OR regexp_matches(name, '^[0-9]{{1,3}}$') OR regexp_matches(lower(name), '^[a-z]+-[a-z]+-[a-z]+-') OR contains(lower(name), 'http')
    OR contains(lower(name), 'www.') OR contains(lower(name), 'mailto:') OR starts_with(name, '#') OR starts_with(name, '@') OR regexp_matches(name, '[A-Z]{{2}}[a-z][A-Z]{{2}}') AS garbage FROM n""")
def garbage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as extraction gives them, cleaned, and which of them are none."""
    k, name = F.col("p_partkey") % 9, F.col("p_name")
    raw = F.when(k == 0, "it").when(k == 1, (F.col("p_partkey") % 1500).cast("string")).when(k == 2, F.concat(F.lit("www."), name)).when(k == 3, F.concat(F.lit("#"), name)).when(k == 4, F.concat(name, F.lit("\n"), name))
    raw = raw.when(k == 5, F.repeat(name, 9)).when(k == 6, F.concat(F.lit("PAwER "), name)).when(k == 7, F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("-a-b"))).otherwise(name)
    return load(spark, sf_dir, "part").select("p_partkey", normal_name(raw).alias("name"), garbage_name(raw).alias("garbage"))


@query("privilege_log", """SELECT o_orderkey AS doc_id, 'B' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' - B' || (o_orderkey + 1) END AS bates_range, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey ELSE o_orderpriority END AS author,
  'a; b' AS recipients, o_orderstatus AS type, CASE o_orderstatus WHEN 'P' THEN 'Attorney-Client Privilege' ELSE 'Work Product Doctrine' END AS privilege, '' AS basis FROM orders WHERE o_orderstatus IN ('P', 'F')""")
def log_of_privilege(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of what is held back."""
    key = F.col("o_orderkey")
    docs = load(spark, sf_dir, "orders").select(
        key.alias("doc_id"), F.concat(F.lit("B"), key).alias("bates_begin"), F.concat(F.lit("B"), key + key % 2).alias("bates_end"), F.col("o_orderdate").alias("document_date"), F.when(key % 3 != 0, F.col("o_orderpriority")).otherwise("").alias("author"),
        F.concat(F.lit("c"), "o_custkey").alias("sender"), F.array(F.lit("a"), F.lit("b")).alias("recipients"), F.col("o_orderstatus").alias("document_type"), F.when(F.col("o_orderstatus") == "P", "privileged").when(F.col("o_orderstatus") == "F", "work_product").otherwise("public").alias("privilege_status"), F.lit(None).cast("string").alias("basis"),
    )
    return privilege_log(docs)


@query("entity_search", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'o') AND p_type IN (SELECT min(p_type) FROM part UNION SELECT max(p_type) FROM part)")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a string in any case, of a list of types, which beats the single type that is asked for as well."""
    part = load(spark, sf_dir, "part")
    low, high = part.agg(F.min("p_type"), F.max("p_type")).first()
    return select_documents(part, types=[low, high], single_type="none", name_like="O", type_col="p_type", name_col="p_name").select("p_partkey", "p_name", "p_type")


@query("witness_documents", "SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size = 7)")
def witness_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which one of some names occurs, in any case."""
    part = load(spark, sf_dir, "part")
    asked = part.filter("p_size = 7").select(F.lower(F.upper("p_name")).alias("key"))
    named = part.withColumn("key", F.lower("p_name")).join(asked, "key", "left_semi").select(F.col("p_partkey").alias("l_partkey"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(named, "l_partkey", "left_semi").select("l_orderkey").distinct()


@query("visual_scores", "SELECT vec_id, round(CASE WHEN label % 3 = 0 THEN embedding[1]::DOUBLE ELSE 0.7 * embedding[1]::DOUBLE + 0.3 * embedding[2]::DOUBLE END, 6) AS score FROM embeddings")
def visual_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text scores blended with visual ones where there are any."""
    entry = lambda i: F.element_at("embedding", i).cast("double")
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(visual_blend(entry(1), F.when(F.col("label") % 3 != 0, entry(2))), 6).alias("score"))


@query("reranked", "SELECT event_id, value FROM events WHERE event_type = 'view' ORDER BY value DESC, event_id LIMIT 10")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of the candidates by a score that comes with them: the limit is the reranker's."""
    return best_above(load(spark, sf_dir, "events").filter("event_type = 'view'").select("event_id", "value"), "value", float("-inf"), "event_id", 10)


@query("retention_due", f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '{AS_OF}'")
def retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active policies whose day has come."""
    return load(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate").cast("timestamp") <= F.lit(AS_OF).cast("timestamp"))).select("o_orderkey")


@query("stale_tasks", "SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 30 MINUTE THEN 'stale' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status FROM events")
def stale_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running tasks that have given no sign for half an hour."""
    running = F.col("event_type") == "click"
    idle = ~within(F.col("ts").cast("timestamp"), "2024-01-20", mins=30)
    return load(spark, sf_dir, "events").select("event_id", F.when(running & idle, "stale").when(running, "running").otherwise("done").alias("status"))


@query("model_tiers", "SELECT s_suppkey AS provider, n_nationkey AS tier, n_name AS model FROM nation JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def model_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers with the provider that each is set to."""
    chosen = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("provider"))
    return load(spark, sf_dir, "nation").join(chosen, "n_nationkey").select("provider", F.col("n_nationkey").alias("tier"), F.col("n_name").alias("model"))


@query("sync_state", "SELECT l_suppkey AS connection, l_partkey AS file, count(*) AS syncs, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1, 2")
def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of connections with their times, upserted in two rounds."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("connection"), F.col("l_partkey").alias("file"), F.lit(1).cast("long").alias("syncs"), F.col("l_shipdate").alias("first_at"), F.col("l_shipdate").alias("last_at"), "l_linenumber")
    keys = ["connection", "file"]
    old = upsert_counts(rows.limit(0), rows.filter("l_linenumber <= 2"), keys, "syncs", "first_at", "last_at")
    return upsert_counts(old, rows.filter("l_linenumber > 2"), keys, "syncs", "first_at", "last_at")


@query("shared_threads", "SELECT o_custkey AS thread, CASE WHEN bool_or(o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1996-06-30') THEN 'reused' ELSE 'new' END AS link FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1")
def shared_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads that have messages, and whether a live link to each can be used again."""
    live = token_valid(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp"), AS_OF)
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("thread"), "o_orderstatus", "o_orderdate")
    known = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("thread"))
    links = orders.join(known, "thread", "left_semi").groupBy("thread").agg(F.bool_or(live).alias("live"))
    return links.select("thread", F.when(F.col("live"), "reused").otherwise("new").alias("link"))


@query("moved_links", "SELECT DISTINCT CASE WHEN l_suppkey % 10 = 3 THEN l_suppkey + 1 ELSE l_suppkey END AS dataset, l_partkey AS doc FROM lineitem")
def moved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents moved from a dataset to the next one: taken out there, put in here unless they are in already."""
    links = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("dataset"), F.col("l_partkey").alias("doc")).distinct()
    leaves = F.col("dataset") % 10 == 3
    stay = links.filter(~leaves)
    return stay.unionByName(insert_new(stay, links.filter(leaves).withColumn("dataset", F.col("dataset") + 1), ["dataset", "doc"]))


@query("bates_import", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'OLD' || o_orderkey WHEN n IS NOT NULL THEN 'NEW' || n END AS bates FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def bates_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a load file for documents that have none yet."""
    docs = load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("OLD"), "o_orderkey")).alias("bates"))
    file = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat(F.lit("NEW"), F.min("l_partkey")).alias("bates"))
    open_ = docs.filter("bates IS NULL").select("o_orderkey")
    return overlay(docs, file.join(open_, "o_orderkey", "left_semi"), "o_orderkey", ["bates"])


@query("whole_edges", "SELECT n_nationkey AS src, n_regionkey AS dst FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0)")
def whole_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which both ends are among the nodes."""
    nation = load(spark, sf_dir, "nation")
    nodes = nation.filter("n_nationkey % 2 = 0").select("n_nationkey")
    edges = nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").cast("int").alias("dst"))
    return edges.join(nodes.withColumnRenamed("n_nationkey", "src"), "src", "left_semi").join(nodes.withColumnRenamed("n_nationkey", "dst"), "dst", "left_semi").select("src", "dst")


@query("event_durations", "SELECT event_id, user_id, round(coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0), 3) AS seconds FROM events")
def event_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with the seconds since each job's last event."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    before = F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.coalesce(at - before, F.lit(0.0)), 3).alias("seconds"))


@query("import_jobs", "SELECT c_custkey, count(o_orderkey) AS jobs, count(o_orderkey) FILTER (o_orderstatus = 'F') AS failed, max(o_orderdate) AS last_at FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def import_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports with their jobs, those that failed, and the last one's time."""
    jobs = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("jobs"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("failed"), F.max("o_orderdate").alias("last_at"))
    out = load(spark, sf_dir, "customer").select("c_custkey").join(jobs, "c_custkey", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("jobs", "failed")})


@query("audit_list", "SELECT event_id FROM events WHERE user_id >= 5 AND event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-02-01' AND contains(lower(props), 'k') AND value >= 1 ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10")
def audit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the audit trail under all of its optional filters, the newest first: the limit is the page."""
    events = load(spark, sf_dir, "events")
    found = select_documents(events, types=["click", "error"], name_like="K", least=("value", 1), type_col="event_type", name_col="props")
    found = found.filter((F.col("user_id") >= 5) & in_dates(F.col("ts").cast("timestamp"), "2024-01-03", "2024-01-31"))
    return page(found, [F.desc("ts"), F.col("event_id")], 10, 50).select("event_id")


@query("dataset_tags", """WITH old AS (SELECT DISTINCT l_partkey AS doc, l_shipmode AS tag FROM (SELECT l_partkey, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS l_shipmode FROM lineitem)),
  stay AS (SELECT doc, tag FROM old WHERE NOT (tag = 'small' AND doc % 3 = 0)), added AS (SELECT DISTINCT l_partkey AS doc, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'large' END AS tag FROM lineitem),
  t AS (SELECT doc, tag FROM stay UNION SELECT doc, tag FROM added) SELECT tag, count(DISTINCT doc) AS documents FROM t JOIN part ON p_partkey = doc GROUP BY tag""")
def dataset_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of parts after some were removed and others added, counted over all parts."""
    lines = load(spark, sf_dir, "lineitem")
    old = lines.select(F.col("l_partkey").alias("doc"), F.when(F.col("l_quantity") > 25, "large").otherwise("small").alias("tag")).distinct()
    added = lines.select(F.col("l_partkey").alias("doc"), F.when(F.col("l_returnflag") == "R", " returned ").otherwise("large").alias("tag"))
    now = tagged(old, added, old.filter("tag = 'small' AND doc % 3 = 0"))
    return tag_counts(now, load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc")))


@query("dataset_grants", """WITH g AS (SELECT o_custkey AS dataset, o_orderkey % 7 AS u, o_orderpriority AS role, o_orderdate AS moment FROM orders),
  r AS (SELECT DISTINCT o_custkey AS dataset, o_orderkey % 7 AS u FROM orders WHERE o_orderstatus = 'P')
  SELECT dataset, u AS user, role FROM (SELECT *, row_number() OVER (PARTITION BY dataset, u ORDER BY moment DESC, role) AS k FROM g) AS x WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.dataset = x.dataset AND r.u = x.u)""")
def dataset_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants of customers' datasets: early ones, later ones over them, and those revoked."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dataset"), (F.col("o_orderkey") % 7).alias("user"), F.col("o_orderpriority").alias("role"), F.col("o_orderdate").alias("at"), "o_orderstatus")
    early = F.col("at") < F.lit("1996-01-01").cast("timestamp_ntz")
    return granted(orders.filter(early), orders.filter(~early), orders.filter("o_orderstatus = 'P'")).select("dataset", "user", "role")


@query("annotations", """WITH n AS (SELECT event_id AS id, user_id AS u, event_type AS content FROM events WHERE event_id % 3 > 0),
  c AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE user_id END AS u, 'edited' AS content, event_id % 7 = 0 AS gone FROM events WHERE event_id % 2 = 0)
  SELECT n.id, n.u AS user, CASE WHEN c.u = n.u THEN c.content ELSE n.content END AS content FROM n LEFT JOIN c ON c.id = n.id WHERE NOT coalesce(c.u = n.u AND c.gone, false)
  UNION ALL SELECT c.id, c.u, c.content FROM c WHERE NOT gone AND c.id NOT IN (SELECT id FROM n)""")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes after edits, deletions and new ones; another user's notes stay as they are."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("content"), F.col("ts").alias("at"))
    by = F.when(F.col("id") % 5 == 0, F.lit(-1)).otherwise(F.col("user"))
    changes = e.filter("id % 2 = 0").select("id", by.cast("long").alias("user"), F.lit("edited").alias("content"), (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("at"), (F.col("id") % 7 == 0).alias("gone"))
    return annotated(e.filter("id % 3 > 0"), changes).select("id", "user", "content")


@query("annotation_page", "SELECT event_id AS id, ts AS noted FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of one kind's notes, newest first: the limit is the page."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    return annotation_page(e, {"kind": "click", "user": None}, "at", "id", 40, 20).select("id", F.col("at").alias("noted"))


@query("edited_edges", """WITH e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst, 'BUYS' AS relation FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
  c AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, 'SELLS' AS relation FROM lineitem UNION SELECT o_custkey, o_orderkey, 'BUYS' FROM orders), n AS (SELECT s_suppkey AS name FROM supplier UNION SELECT c_custkey FROM customer)
  SELECT src, dst, relation FROM e WHERE src % 4 > 0 UNION SELECT src, dst, relation FROM c WHERE src IN (SELECT name FROM n) AND dst IN (SELECT name FROM n)""")
def edited_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges created between nodes that exist and deleted from others."""
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    edges = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("BUYS").alias("relation")).distinct()
    created = lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("SELLS").alias("relation")).union(orders.select("o_custkey", "o_orderkey", F.lit("BUYS")))
    nodes = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name")).union(load(spark, sf_dir, "customer").select("c_custkey"))
    return with_edges(edges, nodes, created, edges.filter("src % 4 = 0"))
