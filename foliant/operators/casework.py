"""Case work: stored records that are replaced, retried, validated, resolved and gathered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.names import canonical, different_people, fuzzy_pairs
from foliant.operators.components import connected_components, merged_components
from foliant.operators.filters import RESTRICTED, visible
from foliant.operators.graphs import split_oversized
from foliant.operators.rows import overlay
from foliant.plans.lineage import cut

# Parameters that a question may override, with their type and range.
OVERRIDES = {
    "retrieval_text_limit": ("int", 5, 100),
    "retrieval_graph_limit": ("int", 5, 50),
    "multi_query_count": ("int", 1, 10),
    "hyde_blend_ratio": ("float", 0.0, 1.0),
    "reranker_top_n": ("int", 3, 50),
    "query_entity_threshold": ("float", 0.0, 1.0),
    "self_reflection_faithfulness_threshold": ("float", 0.0, 1.0),
}
# The text of a suggestion for a whole document.
WHOLE_DOCUMENT = "[Full document — privilege-protected]"


def matches_any(columns: Sequence[str], value: Column) -> Column:
    """Is one of the columns equal to value in any case?"""
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(c) == F.lower(value), F.lit(False)) for c in columns))


def best_above(rows: DataFrame, score: str, least: float, tie: str, limit: int) -> DataFrame:
    """The `limit` rows of the best scores that reach `least`; ties by `tie`. Spark keeps that many a task."""
    return rows.filter(F.col(score) >= least).orderBy(F.desc(score), tie).limit(limit)


def finalised(early: DataFrame, results: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Records inserted early, with the columns that their results bring, and `status`: complete with a result, else pending."""
    done = results.select(key).distinct().withColumn("_done", F.lit(True))
    out = overlay(early, results, key, columns).join(done, key, "left")
    return out.withColumn("status", F.when(F.col("_done"), "complete").otherwise("pending")).drop("_done")


def replaced_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of old whose parent has none in new, and all children of new: a parent's children are replaced as a whole."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def kept_polls(old: DataFrame, new: DataFrame, at: str, as_of: str, days: int = 31) -> DataFrame:
    """Health polls after an append, without those older than `days`."""
    return old.unionByName(new).filter(F.col(at) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def settled_jobs(jobs: DataFrame, retry: DataFrame, dismiss: DataFrame, key: str, scope: Column) -> DataFrame:
    """jobs with failed ones of the scope set to pending (error cleared) where retry names them, else to dismissed where dismiss does."""
    asked = retry.select(key).distinct().withColumn("_to", F.lit("pending")).unionByName(dismiss.select(key).distinct().join(retry.select(key), key, "left_anti").withColumn("_to", F.lit("dismissed")))
    hit = (F.col("status") == "failed") & scope & F.col("_to").isNotNull()
    out = jobs.join(asked, key, "left")
    return out.withColumns({"status": F.when(hit, F.col("_to")).otherwise(F.col("status")), "error": F.when(hit & (F.col("_to") == "pending"), F.lit(None)).otherwise(F.col("error"))}).drop("_to")


def found_document(docs: DataFrame, key: str, job: str, name: str, asked: Column, counsel: bool = False) -> DataFrame:
    """docs that `asked` names by id, by job or by file name, without those that only counsel may see."""
    value = asked.cast("string")
    return docs.filter(((F.col(key).cast("string") == value) | (F.col(job).cast("string") == value) | (F.col(name) == value)) & visible(F.col("privilege_status"), counsel))


def backfilled(links: DataFrame, docs: DataFrame, key: str, metadata: str, field: str) -> DataFrame:
    """links (dataset, key) with those that a field of the documents' JSON metadata adds; links that are there already stay as they are."""
    found = docs.select(F.get_json_object(metadata, f"$.{field}").alias("dataset"), key).filter("dataset IS NOT NULL").distinct()
    return links.unionByName(found.join(links, ["dataset", key], "left_anti"))


def accepted_overrides(asked: DataFrame, param: str = "param", value: str = "value") -> DataFrame:
    """asked (param, value as string) with `accepted` (double) where the parameter may be overridden and the value is of its type and in its range, else null."""
    out = F.lit(None).cast("double")
    for name, (kind, low, high) in OVERRIDES.items():
        number = F.col(value).try_cast("double")
        whole = F.col(value).rlike(r"^\s*[-+]?\d+\s*$") if kind == "int" else F.lit(True)
        out = F.when((F.col(param) == name) & whole & number.between(low, high), number).otherwise(out)
    return asked.withColumn("accepted", out)


def privilege_suggestions(docs: DataFrame, key: str, status: str) -> DataFrame:
    """(key, start, end, confidence, text): a suggestion that covers the whole document, for those that are privileged or work product."""
    return docs.filter(F.col(status).isin(*RESTRICTED)).select(key, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(1.0).alias("confidence"), F.lit(WHOLE_DOCUMENT).alias("text"))


def worth_context(quality: Column, least: float = 0.2) -> Column:
    """Chunks that get a context: those without a quality score, or with one that reaches `least`."""
    return quality.isNull() | (quality >= least)


def merge_groups(matches: DataFrame, kind: str, most: int = 50) -> DataFrame:
    """(kind, name, canonical) of matches (kind, a, b, score): names that matches join within a kind, in groups of `most` at most.

    Larger groups lose their weakest matches one after the other. The canonical name is the longest, of those the one in proper case, then the least.
    """
    ends = matches.select(*(F.struct(F.col(kind).alias("kind"), F.col(c).alias("name")).alias(c) for c in "ab"), "score")
    named = ends.select(*(F.to_json(c).alias(c) for c in "ab"), "score")
    parts = connected_components(split_oversized(named, most), "a", "b")
    rows = parts.select(F.from_json("node", "kind string, name string").alias("n"), "component").select("n.kind", "n.name", "component")
    chosen = rows.groupBy("component").agg(canonical(F.col("name")).alias("canonical"))
    return rows.join(chosen, "component").select(F.col("kind").alias(kind), "name", "canonical")


def confident_matches(rows: DataFrame, exact_kinds: Sequence[str], least: float) -> DataFrame:
    """(kind, a, b, score) of rows (kind, name): names of a kind that differ in case and spaces alone, and in kinds that aren't exact those of `least` or more but different people."""
    key = F.regexp_replace(F.lower(F.trim("name")), r"\s+", " ")
    same = rows.select("kind", "name", key.alias("key"))
    first = same.groupBy("kind", "key").agg(F.min("name").alias("a"))
    matches = same.join(first, ["kind", "key"]).filter("name <> a").select("kind", "a", F.col("name").alias("b"), F.lit(100.0).alias("score"))
    found = fuzzy_pairs(rows.filter(~F.col("kind").isin(*exact_kinds)), "name", least, "kind")
    matches = matches.unionByName(found.filter((F.col("kind") != "person") | ~different_people(F.col("a"), F.col("b"))))
    return matches.groupBy("kind", "a", "b").agg(F.max("score").alias("score"))


def resolved_entities(entities: DataFrame, exact_kinds: Sequence[str], confident: float = 90, least: float = 85, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(resolved, uncertain) of entities (kind, name, mention_count).

    Names that differ in case and spaces alone match with 100 in every kind; in kinds that aren't exact, fuzzy matches of `least` or more count unless they
    are different people. Those of `confident` or more are merged; the rest is uncertain (kind, a, b, score), for a person to decide.
    resolved: kind, canonical, aliases (sorted), mention_count, one row for each group and for each name that joined none. All kinds are resolved at once.
    """
    rows = entities.groupBy("kind", "name").agg(F.sum("mention_count").alias("mention_count")).filter("kind IS NOT NULL AND name IS NOT NULL")
    matches = confident_matches(rows, exact_kinds, least)
    groups = merge_groups(matches.filter(F.col("score") >= confident), "kind", most)
    placed = rows.join(groups, ["kind", "name"], "left").withColumn("canonical", F.coalesce("canonical", "name"))
    alias = F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical"), F.col("name"))))
    resolved = placed.groupBy("kind", "canonical").agg(alias.alias("aliases"), F.sum("mention_count").alias("mention_count"))
    return resolved, matches.filter(F.col("score") < confident)


def resolved_batch(stars: DataFrame, known: DataFrame, batch: DataFrame, exact_kinds: Sequence[str], confident: float = 90) -> tuple[DataFrame, DataFrame]:
    """(stars, resolved) after a batch of entities (kind, name, mention_count) came to those known, which have the same columns.

    stars: (node, component) of earlier batches, node being the JSON of kind and name; empty at first. Names of the batch are matched with each other and
    with all known names, as resolved_entities() does; the stars then take in the new matches alone (merged_components()), so groups of
    earlier batches are not solved anew. resolved: kind, canonical, aliases, mention_count over all entities so far. Groups are not
    split by their size here.
    """
    rows = known.unionByName(batch).filter("kind IS NOT NULL AND name IS NOT NULL").groupBy("kind", "name").agg(F.sum("mention_count").alias("mention_count"))
    fresh = batch.select("kind", "name").distinct()
    matches = confident_matches(rows, exact_kinds, confident)
    new = [matches.join(fresh.withColumnRenamed("name", end), ["kind", end], "left_semi") for end in "ab"]
    node = lambda end: F.to_json(F.struct("kind", F.col(end).alias("name")))
    links = new[0].unionByName(new[1]).distinct().select(node("a").alias("a"), node("b").alias("b"))
    stars = cut(merged_components(stars, links, "a", "b"), "stars")
    placed = rows.withColumn("node", node("name")).join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    chosen = placed.groupBy("component").agg(canonical(F.col("name")).alias("canonical"))
    named = placed.join(chosen, "component")
    alias = F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical"), F.col("name"))))
    return stars, named.groupBy("component", "kind", "canonical").agg(alias.alias("aliases"), F.sum("mention_count").alias("mention_count")).drop("component")


def metadata_totals(imports: DataFrame, sums: Sequence[str], eta: str, status: str = "status") -> DataFrame:
    """One row: queue sums and the longest time left over the imports that are processing."""
    return imports.filter(F.col(status) == "processing").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), F.max(eta).alias(eta))


def rates(parts: Mapping[str, Column]) -> list[Column]:
    return [F.round(c, 6).alias(k) for k, c in parts.items()]
