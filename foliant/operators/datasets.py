"""Datasets, their tags and grants, and annotations, as tables that are rewritten."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.filters import every, page
from foliant.operators.rows import first_by, insert_new


def tagged(tags: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """tags (doc, tag) after tags were removed and then added; a tag that a document has already stays once. Null documents and blank tags are passed over."""
    clean = added.select("doc", F.trim("tag").alias("tag")).filter("doc IS NOT NULL AND tag <> ''")
    stay = tags.join(removed.select("doc", "tag").distinct(), ["doc", "tag"], "left_anti").select("doc", "tag")
    return stay.unionByName(insert_new(stay, clean, ["doc", "tag"]))


def tag_counts(tags: DataFrame, docs: DataFrame) -> DataFrame:
    """(tag, documents): how many of the documents (doc) have each tag, for tags that any of them has."""
    return tags.join(docs.select("doc").distinct(), "doc", "left_semi").groupBy("tag").agg(F.count_distinct("doc").alias("documents"))


def granted(grants: DataFrame, new: DataFrame, revoked: DataFrame) -> DataFrame:
    """grants (dataset, user, role, at) after new ones, of which the latest holds where a user has one already, and after those revoked (dataset, user) went."""
    keys = ["dataset", "user"]
    columns = [*keys, "role", "at"]
    both = grants.select(*columns).unionByName(new.select(*columns)).filter("dataset IS NOT NULL AND user IS NOT NULL")
    return first_by(both, keys, [F.desc_nulls_last("at"), F.col("role")]).join(revoked.select(*keys).distinct(), keys, "left_anti")


def annotated(notes: DataFrame, changes: DataFrame, key: str = "id", owner: str = "user") -> DataFrame:
    """notes after changes (key, owner, content, at, gone), the last of each key: content and time replaced where the owner is the same, deleted where gone, and
    added where the key is new. Changes to another user's notes do nothing."""
    last = first_by(changes, [key], [F.desc_nulls_last("at"), F.col("content")])
    c = last.select(F.col(key), F.col(owner).alias("_by"), F.col("content").alias("_content"), F.col("at").alias("_at"), F.coalesce("gone", F.lit(False)).alias("_gone"))
    mine = F.coalesce(F.col("_by") == F.col(owner), F.lit(False))
    old = notes.join(c, key, "left").filter(~(mine & F.coalesce("_gone", F.lit(False))))
    old = old.withColumns({"content": F.when(mine, F.col("_content")).otherwise(F.col("content")), "at": F.when(mine, F.col("_at")).otherwise(F.col("at"))})
    fresh = last.filter(~F.coalesce("gone", F.lit(False))).join(notes.select(key), key, "left_anti")
    return old.select(notes.columns).unionByName(fresh.select(notes.columns))


def annotation_page(notes: DataFrame, filters: Mapping[str, object], at: str, tie: str, offset: int, limit: int) -> DataFrame:
    """A page of annotations, newest first, of those whose columns equal the filters that are given (None: any)."""
    conditions: list[Column | None] = [None if v is None else F.col(c) == F.lit(v) for c, v in filters.items()]
    return page(notes.filter(every(conditions)), [F.desc(at), F.col(tie)], offset, limit)


def with_edges(edges: DataFrame, nodes: DataFrame, created: DataFrame, deleted: DataFrame) -> DataFrame:
    """edges (src, dst, relation) after some were deleted and others created, once each, between nodes (name) that exist."""
    keys = ["src", "dst", "relation"]
    known = nodes.select(F.col("name")).distinct()
    valid = created.join(known.withColumnRenamed("name", "src"), "src", "left_semi").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
    stay = edges.select(*keys).join(deleted.select(*keys).distinct(), keys, "left_anti")
    return stay.unionByName(insert_new(stay, valid.select(*keys), keys))
