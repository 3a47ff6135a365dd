"""Exact dedup: a tree of merges over sorted digest runs, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_IDS, cut, fold_case, restrict

KEY = ["sha", "bytes", "check"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Column | None = None, runs: int = 64, fan_in: int = 2) -> DataFrame:
    """Groups of equal texts, found by a tree merge of sorted digest runs.

    Every row goes to one of `runs` runs by a hash of its id. A run holds one entry for each digest: the id that it keeps
    so far and the rows seen; it is reduced on the map side first, then sorted. In binomial rounds two runs (`fan_in`) then become one: they meet in
    one partition, where their sorted entries are merged, until one run is left. Entries merge only if SHA-256, byte length and a second, independent hash agree at every
    level. The verdicts go down the same tree, so a group that holds a third of all rows is spread over `runs` keys.

    keep: "min" or "max", the id of the row that stays. normalise: what is compared, the text with A-Z lower-cased by default.
    Returns a row for each input row: id_col, keep_id, group_size (long), kept (boolean), text_sha256, and `first`, true for one
    row of each group (repeated rows with the kept id are all `kept`, one of them is `first`).

    Null text counts as empty text. Null ids are never preferred; if all ids of a group are null, keep_id is null and no row is
    `kept`, but one is `first`. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = fold_case(text) if normalise is None else normalise
    rows = docs.select(F.col(id_col).alias("id"), same.alias("t")).select(
        "id",
        F.sha2("t", 256).alias("sha"),
        F.octet_length("t").cast("long").alias("bytes"),
        F.xxhash64("t").alias("check"),
        F.pmod(F.xxhash64("id", F.octet_length("t")), F.lit(runs)).cast("int").alias("run"),
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    # The flag puts null ids last for either choice; the row number breaks ties of repeated rows.
    pick = (F.min, F.col("id").isNull()) if keep == "min" else (F.max, F.col("id").isNotNull())
    level = rows.groupBy("run", *KEY).agg(pick[0](F.struct(pick[1].alias("flag"), "id", "row")).alias("best"), F.count("*").alias("n"))
    levels = []
    while True:
        levels.append(cut(level.sortWithinPartitions("run", *KEY), f"run{len(levels)}"))
        if runs <= 1:
            break
        runs = -(-runs // fan_in)
        level = levels[-1].withColumn("run", up(fan_in)).groupBy("run", *KEY).agg(pick[0]("best").alias("best"), F.sum("n").alias("n"))
    verdict = levels.pop().select("run", *KEY, "best", F.col("n").alias("group_size"))
    while levels:
        below = levels.pop().select("run", *KEY, up(fan_in).alias("up"))
        verdict = below.join(verdict.withColumnRenamed("run", "up"), ["up", *KEY]).drop("up")
    out = rows.join(verdict, ["run", *KEY])
    return out.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        F.coalesce(F.col("id") == F.col("best.id"), F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        (F.col("row") == F.col("best.row")).alias("first"),
    )


def up(fan_in: int) -> Column:
    return F.floor(F.col("run") / fan_in).cast("int")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs, all columns, that exact_dedup() keeps: one of each group of equal texts. Columns of any name pass through."""

    def key(of: Column, sha: Column) -> Column:
        return F.unhex(F.md5(F.concat_ws(":", of.cast("string"), sha)))

    rows = exact_dedup(docs, id_col, text_col, keep).select(key(F.col(id_col), F.col("text_sha256")).alias("key"), "first")
    keys = cut(rows.groupBy("key").agg(F.bool_or("first").alias("stays"), F.count("*").alias("n")), "keys")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key(F.col(id_col), F.sha2(fold_case(F.coalesce(F.col(text_col), F.lit(""))), 256)).alias("key"))
    # Rows that go are told by their keys, which are few enough to broadcast unless much of the input is copies; texts stay where they are.
    found = restrict(keyed, keys.filter("NOT stays").select("key"), ["key"], "left_anti", BROADCAST_IDS // 4)
    # Only repeated rows, the same id and text, are left; those go through a distinct.
    again = keys.filter("stays AND n > 1").select("key")
    if again.isEmpty():
        return found.select("row.*")
    once = found.join(again, "key", "left_anti")
    return once.unionByName(found.join(again, "key", "left_semi").dropDuplicates(["key"])).select("row.*")
