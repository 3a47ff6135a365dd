"""Scores, gates and routes of retrieval and generation runs."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.rows import first_by
from foliant.plans.lineage import cut

# Retrieval depths by question type (text, graph), judge weights, quality gates, warnings of an estimate.
DEPTHS = {"factual": (15, 8), "analytical": (30, 15), "comparative": (35, 20), "timeline": (25, 12), "procedural": (20, 10), "exploratory": (40, 20)}
JUDGE = {"relevance": 0.20, "completeness": 0.15, "accuracy": 0.25, "citation_support": 0.25, "conciseness": 0.15}
GATES = {"faithfulness": (">=", 0.95), "citation_accuracy": (">=", 0.90), "hallucination_rate": ("<", 0.05), "post_rationalization_rate": ("<", 0.10)}
#: Words that a broadcast may hold.
TERMS = 500_000
WARNINGS = ["Large import: consider batching in groups of 500", "Import exceeds 10 GB: ensure sufficient storage"]


def hot_score(pressure: Column, opportunity: Column, rationalization: Column, intent: Column, concealment: Column, signals: list[Column]) -> Column:
    """0.3 of the fraud triangle's largest, 0.4 of intent or concealment, 0.3 of the largest signal."""
    return 0.3 * F.greatest(pressure, opportunity, rationalization) + 0.4 * F.greatest(intent, concealment) + 0.3 * F.greatest(*signals)


def import_estimate(files: Column, size: Column) -> dict[str, Column]:
    pages = F.greatest(files * 5, F.floor(size / (50 * 1024)))
    warnings = F.filter(F.array(F.when(files > 1000, WARNINGS[0]), F.when(size > 10 * 1024**3, WARNINGS[1])), lambda w: w.isNotNull())
    return {"pages": pages.cast("long"), "chunks": (pages * 3).cast("long"), "minutes": F.round(files * 0.5, 1), "storage_mb": F.round(size / (1024 * 1024) * 1.2, 1), "warnings": warnings}


def judge_score(scores: Mapping[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in JUDGE.items():
        total = total + scores[name] * weight
    return F.round(total, 2)


def failed_gates(scores: Mapping[str, Column], claims: Column) -> Column:
    """Names of the gates that fail; those of citations count only where there are claims."""
    out = []
    for name, (sign, limit) in GATES.items():
        bad = scores[name] < limit if sign == ">=" else scores[name] >= limit
        out.append(F.when(bad & (F.lit(True) if name == "faithfulness" else claims > 0), name))
    return F.filter(F.array(*out), lambda n: n.isNotNull())


def flag_impact(runs: DataFrame) -> DataFrame:
    """(flag, delta of each metric, recommendation) from runs (flag, enabled, mrr, recall, ndcg, precision, hallucination)."""
    metrics = ["mrr", "recall", "ndcg", "precision", "hallucination"]
    side = lambda on, p: runs.filter(F.col("enabled") == on).select("flag", *(F.col(m).alias(f"{p}_{m}") for m in metrics))
    both = side(True, "on").join(side(False, "off"), "flag")
    both = both.withColumns({f"d_{m}": F.col(f"on_{m}") - F.col(f"off_{m}") for m in metrics[:4]} | {"d_citation": F.col("off_hallucination") - F.col("on_hallucination")})
    total = F.col("d_mrr") + F.col("d_recall") + F.col("d_ndcg") + F.col("d_precision")
    advice = F.when((total > 0.02) | (F.col("d_citation") > 0.01), "keep_enabled").when((total < -0.02) | (F.col("d_citation") < -0.01), "keep_disabled").otherwise("negligible_impact")
    return both.select("flag", *(F.round(f"d_{m}", 6).alias(f"delta_{m}") for m in (*metrics[:4], "citation")), advice.alias("recommendation"))


def roman(n: Column) -> Column:
    """Numerals of 1 to 20; null beyond."""
    tens = F.repeat(F.lit("X"), F.floor(n / 10).cast("int"))
    unit = F.element_at(F.array(*(F.lit(x) for x in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))), (n % 10 + 1).cast("int"))
    return F.when(n.between(1, 20), F.concat(tens, unit))


def reflects(verified: Column, total: Column, retries: Column, threshold: float = 0.6, least: int = 3, most: int = 1) -> Column:
    """Is another round due: enough claims, too few of them verified, and retries left?"""
    return (total >= least) & (F.try_divide(verified, total) < threshold) & (retries < most)


def depth(kind: Column, graph: bool = False, default: int = 20) -> Column:
    out = None
    for name, pair in DEPTHS.items():
        out = F.when(kind == name, pair[graph]) if out is None else out.when(kind == name, pair[graph])
    return out.otherwise(default)


def relevant_enough(hits: DataFrame, query: str, score: str, rank: str, k: int = 5, threshold: float = 0.3) -> DataFrame:
    """(query, mean, relevant): the mean of the k best scores against a threshold."""
    top = hits.filter(F.col(rank) <= k).groupBy(query).agg(F.avg(score).alias("mean"))
    return top.withColumn("relevant", F.col("mean") >= threshold)


def expanded(questions: DataFrame, terms: DataFrame, key: str, text: str, scope: str) -> DataFrame:
    """questions with the definitions of the scope's terms that they contain appended; terms: scope, term (lower case), definition."""
    found = questions.select(key, scope, text).join(terms, scope).filter(F.lower(text).contains(F.col("term")))
    notes = found.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("term", "definition"))), lambda t: F.concat(F.lit('"'), t["term"], F.lit('" = '), t["definition"])), "; ").alias("note"))
    out = questions.join(notes, key, "left")
    return out.withColumn(text, F.when(F.col("note").isNull(), F.col(text)).otherwise(F.concat(F.col(text), F.lit("\n\n[Case context: "), F.col("note"), F.lit("]")))).drop("note")


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text; none of a shorter one."""
    return F.array_distinct(F.transform(F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(n))))


def grounded(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, grounded, closest): is there an entity of that name; if not, the least entity that contains it.

    Only names without an exact match are looked for, each once: of its runs of three characters (of all its characters, if it has fewer) the one that the fewest
    entities hold meets the entities that hold it, and is compared as a substring there. A name without characters is in the least entity of all.
    """
    known = cut(entities.select(F.col("name").alias("other")).distinct(), "entities")
    exact = names.select("name").distinct().join(known.select(F.col("other").alias("name"), F.lit(True).alias("hit")), "name", "left")
    open_ = cut(exact.filter("hit IS NULL AND name IS NOT NULL").select("name"), "open")
    size = F.least(F.length("name"), F.lit(3))
    asked = open_.filter("name <> ''").select("name", F.explode(F.when(size == 3, grams(F.col("name"), 3)).otherwise(F.array("name"))).alias("gram"))
    index = known.select("other", F.explode(F.array_union(F.array_union(grams(F.col("other"), 1), grams(F.col("other"), 2)), grams(F.col("other"), 3))).alias("gram"))
    index = index.join(asked.select("gram").distinct(), "gram", "left_semi")
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).select("name", "best.gram")
    near = rarest.join(index, "gram").filter(F.col("other").contains(F.col("name"))).groupBy("name").agg(F.min("other").alias("closest"))
    empty = open_.filter("name = ''").join(known.agg(F.min("other").alias("closest")))
    return exact.join(near.unionByName(empty), "name", "left").select("name", F.coalesce("hit", F.lit(False)).alias("grounded"), "closest")


def topics(docs: DataFrame, key: str, text: str, k: int, least: int = 5, terms: int = 10, seed: int = 1, features: int = 1 << 16, rare: int = 2, common: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(key, topic) and (topic, size, terms) of at most k topics: spherical k-means over TF-IDF vectors.

    Words are runs of letters, three or more, in lower case; those of fewer than `rare` texts or more than `common` of all say nothing of a topic and are
    passed over. A text's vector has the inverse document frequency of each of its words, in hashed places, and unit length; seeds are drawn far apart
    (k-means||), and a text goes to the centre of the largest cosine. Texts without such a word, and those of topics under `least` texts, are outliers
    (-1), which the second table leaves out. terms: the words of most class-based TF-IDF, the share of a topic's words that a word is times
    log(1 + mean words of a topic / the word's count in all topics); ties go to the first word.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, VectorAssembler

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    said = cut(docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), words.alias("words")), "words")
    total = said.count()
    seen = said.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    known = cut(seen.filter((F.col("df") >= rare) & (F.col("df") <= common * total)).select("word"), "known")
    each = cut(known_words(said.select("row", "words"), known), "said")
    rows = cut(each.select("row", "words").repartition("row").sortWithinPartitions("row"), "rows")
    if rows.isEmpty():
        placed = said.select("row", "key", F.lit(-1).alias("topic"))
    else:
        counted = HashingTF(inputCol="words", outputCol="tf", numFeatures=features, binary=True).transform(rows)
        weighed = IDF(inputCol="tf", outputCol="idf").fit(counted).transform(counted)
        # A small constant keeps a vector whose words all share places with words of all texts from being zero.
        whole = VectorAssembler(inputCols=["idf", "one"], outputCol="raw").transform(weighed.withColumn("one", F.lit(1e-6)))
        vectors = Normalizer(inputCol="raw", outputCol="features").transform(whole).select("row", "features")
        model = KMeans(k=k, seed=seed, maxIter=30, distanceMeasure="cosine").fit(vectors)
        placed = said.select("row", "key").join(model.transform(vectors).select("row", F.col("prediction").alias("topic")), "row", "left")
    placed = cut(placed, "placed")
    sizes = placed.filter("topic >= 0").groupBy("topic").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    found = cut(placed.join(F.broadcast(sizes.select("topic", F.lit(True).alias("large"))), "topic", "left").select("row", "key", F.when(F.col("large"), F.col("topic")).otherwise(-1).alias("topic")), "topics")
    said_in = each.join(found.filter("topic >= 0").select("row", "topic"), "row").select("topic", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    classes = cut(said_in.groupBy("topic", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n")), "classes")
    by_word, by_topic = classes.groupBy("word").agg(F.sum("n").alias("all")), classes.groupBy("topic").agg(F.sum("n").alias("whole"))
    mean = by_topic.agg(F.avg("whole").alias("mean"))
    scored = classes.join(by_word, "word").join(F.broadcast(by_topic), "topic").join(F.broadcast(mean))
    scored = scored.withColumn("weight", F.round(F.col("n") / F.col("whole") * F.log1p(F.col("mean") / F.col("all")), 12))
    top = first_by(scored, ["topic"], [F.desc("weight"), F.col("word")], terms)
    best = top.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("less"), "word"))), lambda t: t["word"]).alias("terms"))
    return found.select(F.col("key").alias(key), "topic"), sizes.join(best, "topic", "left")


def known_words(said: DataFrame, known: DataFrame, most: int = TERMS) -> DataFrame:
    """(row, words, counts) of said (row, words): each text's distinct known words in order and how often it has them; texts without any are left out.

    Up to `most` known words reach the tasks as a broadcast, and no word is shuffled; more of them meet the words of the texts in a join.
    """
    if known.limit(most + 1).count() > most:
        each = said.select("row", F.explode("words").alias("word")).join(known, "word", "left_semi").groupBy("row", "word").agg(F.count("*").alias("n"))
        listed = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("w"))
        return listed.select("row", F.col("w.word").alias("words"), F.col("w.n").alias("counts"))
    terms = said.sparkSession.sparkContext.broadcast(sorted(r[0] for r in known.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set, size = pa.array(terms.value, pa.string()), max(1, len(terms.value))
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            column = batch.column("words")
            place = pc.index_in(column.flatten(), value_set=value_set)
            row = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy())
            there = place.is_valid().to_numpy(zero_copy_only=False)
            pair, count = np.unique(row[there] * size + place.fill_null(0).to_numpy()[there], return_counts=True)
            rows, first = np.unique(pair // size, return_index=True)
            at = pa.array(np.append(first, len(pair)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, values) for values in (value_set.take(pa.array(pair % size)), pa.array(count.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows)), *lists], ["row", "words", "counts"])

    return said.mapInArrow(run, "row long, words array<string>, counts array<long>")
