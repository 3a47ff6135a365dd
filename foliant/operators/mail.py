"""Email threads and communication pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import address, document_date, subject_key
from foliant.operators.rows import thread_depth


def thread_key(seed: Column) -> Column:
    return F.substring(F.sha2(seed, 256), 1, 16)


def assign_threads(mails: DataFrame) -> DataFrame:
    """(doc_id, thread_id, position) of mails (doc_id, message_id, in_reply_to, references, subject).

    References name the root and the position; else the reply's parent does, over chains of any length; else mails of one subject share a
    thread, and one without any of these stands alone. Blank headers count as missing. Thread ids don't depend on the order of arrival.
    """
    clean = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    m = mails.select("doc_id", clean("message_id").alias("mid"), clean("in_reply_to").alias("reply"), clean("references").alias("refs"), F.nullif(subject_key(F.coalesce("subject", F.lit(""))), F.lit("")).alias("key"), "subject")
    refs = F.split("refs", r"\s+")
    alone = F.coalesce("mid", F.concat_ws("_", F.col("doc_id").cast("string"), F.coalesce("subject", F.lit(""))))
    direct = m.withColumn("seed", F.when(F.col("refs").isNotNull(), refs[0]).when(F.col("reply").isNull(), F.coalesce("key", alone)))
    direct = direct.withColumn("place", F.when(F.col("refs").isNotNull(), F.size(refs)).when(F.col("reply").isNull(), F.lit(0)))
    # A chain ends at a mail that has a thread of its own, or at a parent that isn't there, whose id is the seed then.
    chain = thread_depth(direct.filter("mid IS NOT NULL").select("mid", F.when(F.col("seed").isNull(), F.col("reply")).alias("up")).dropDuplicates(["mid"]), "mid", "up")
    tops = direct.filter("mid IS NOT NULL AND seed IS NOT NULL").groupBy(F.col("mid").alias("root")).agg(F.min(F.struct("seed", "place")).alias("top"))
    chain = chain.join(tops, "root", "left").select(F.col("id").alias("mid"), F.coalesce("top.seed", "root").alias("chain_seed"), (F.coalesce("top.place", F.lit(0)) + F.col("depth")).alias("chain_place"))
    # A mail without an id of its own still has a parent.
    parent = chain.select(F.col("mid").alias("reply"), F.col("chain_seed").alias("up_seed"), (F.col("chain_place") + 1).alias("up_place"))
    out = direct.join(chain, "mid", "left").join(parent, "reply", "left")
    seed = F.coalesce("seed", "chain_seed", "up_seed", "reply")
    place = F.coalesce("place", F.when(F.col("chain_seed").isNotNull(), F.col("chain_place")), "up_place", F.lit(1))
    return out.select("doc_id", thread_key(seed).alias("thread_id"), place.cast("int").alias("position"))


def tagged(kind: str) -> Callable[[Column], Column]:
    return lambda a: F.struct(F.lit(kind).alias("kind"), F.trim(a).alias("raw"))


def communication_pairs(mails: DataFrame, scope: str, as_of_year: int) -> DataFrame:
    """(scope, sender_name, sender_email, recipient_name, recipient_email, relationship_type, message_count, earliest, latest).

    mails: scope and from_name, from_email, to, cc, bcc (lists divided by commas) and date, as strings. A recount: reruns agree.
    """
    parts = F.flatten(F.array(*(F.transform(F.split(F.coalesce(F.col(k), F.lit("")), r"\s*,\s*"), tagged(k)) for k in ("to", "cc", "bcc"))))
    # Dates are read before lists are taken apart: once a mail, not once a recipient.
    rows = mails.filter(F.coalesce("from_email", F.lit("")) != "").select(scope, F.coalesce("from_name", F.lit("")).alias("sender_name"), F.col("from_email").alias("sender_email"), document_date(F.col("date"), as_of_year).alias("at"), parts.alias("parts"))
    rows = rows.select(scope, "sender_name", "sender_email", "at", F.explode(F.filter("parts", lambda p: p["raw"] != "")).alias("p"))
    rows = rows.withColumn("who", address(F.col("p.raw")))
    who = F.col("who")
    rows = rows.select(scope, "sender_name", "sender_email", who["name"].alias("recipient_name"), F.when(who["email"] == "", F.col("p.raw")).otherwise(who["email"]).alias("recipient_email"), F.col("p.kind").alias("relationship_type"), "at")
    keys = [scope, "sender_email", "recipient_email", "relationship_type"]
    return rows.groupBy(*keys).agg(F.max("sender_name").alias("sender_name"), F.max("recipient_name").alias("recipient_name"), F.count("*").alias("message_count"), F.min("at").alias("earliest"), F.max("at").alias("latest"))
