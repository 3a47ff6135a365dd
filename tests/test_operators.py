"""Operators, readers and streams on literal examples."""

import io
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions.names import block_keys, canonical, different_people, first_last, fuzzy_pairs, garbage_name, likeness, normal_name, token_sort_ratio, without_title
from foliant.functions.text import DOB, DOB_ISO, EMAIL, MEDICAL, OCR, PHONE, SSN, addresses, chunk_quality, citation_rates, citations, document_date, numbered_citations, ocr_corrected, pii_counts, pii_spans, sanitised, subject_key, with_context
from foliant.operators.chunks import chunk, line_diff, long_block, pack, portable, redacted, still_there, text_blocks
from foliant.operators.components import connected_components
from foliant.operators.evaluation import grounded
from foliant.operators.filters import file_type, in_dates, question_tier, visible
from foliant.operators.graphs import betweenness, edited, entity_connections, modularity_communities, page_rank, shortest_paths, split_oversized, two_tiers
from foliant.operators.mail import assign_threads, communication_pairs
from foliant.operators.near_dup import duplicate_clusters, near_duplicates, version_groups, version_label
from foliant.operators.rows import best_per_cluster, page_numbers
from foliant.operators.vectors import dense_top_k, meetings, ranking_metrics, similar_pairs, units
from foliant.sources.readers import changed_files, csv_table, expand_zips, import_documents, parse_eml, parser_of, read_dat, read_edrm, read_email_corpus, read_ocr_corpus, read_opticon, read_text, resume, rtf_text
from foliant.sources.sinks import append_audit, court_package, privilege_log, write_csv, write_edrm, write_points
from foliant.streaming.jobs import job_states, keep_counts, read_counts, stream


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def strings(spark, column, values):
    return [r["x"] for r in spark.createDataFrame([(v,) for v in values], "s string").select(column.alias("x")).collect()]


def test_versions(spark):
    got = strings(spark, version_label(F.col("s")), ["contract_v1.docx", "brief-draft.pdf", "Report FINAL.pdf", "letter.pdf"])
    assert [(r.label, r.is_final) for r in got] == [("v1", False), ("draft", False), ("final", True), (None, False)]


def test_subjects_and_tiers(spark):
    assert strings(spark, subject_key(F.col("s")), ["Re: FW: Fwd: Budget ", "re : x", "Reply", ""]) == ["budget", "x", "reply", ""]
    assert strings(spark, question_tier(F.col("s")), ["Who is A?", "Compare a and b", "Tell me things", "x " * 31]) == ["fast", "deep", "standard", "deep"]
    assert strings(spark, file_type(F.col("s")), ["a.PDF", "b.eml", "c.tar.gz", ".csv", "x/y.tsv", "none"]) == ["document", "email", "other", "other", "data", "other"]


def test_ocr(spark):
    df = spark.createDataFrame([("The ﬁrst 1O2 and 4l5, docu-\n ment  Plaintitf",), ("clean text",), (None,)], "s string")
    assert [tuple(r) for r in ocr_corrected(df, "s").select("corrected", "corrections").collect()] == [("The first 102 and 415, document Plaintiff", 6), ("clean text", 0), (None, 0)]


def test_ocr_equals_re(spark):
    rng = random.Random(3)
    bits = ["ﬁ", "ﬂ", "ﬃ", "l", "1", "0", "O", "S", "5", "-\n", " \n ", "  ", "\t", " ", "Attomey", "Exhibii", "ab", "l2", "Judgrnent"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(400)]
    got = ocr_corrected(spark.createDataFrame([(t,) for t in texts], "s string").repartition(1), "s").collect()
    for r in got:
        text, n = r.s, 0
        for pattern, to in OCR:
            text, k = re.subn(pattern, to.replace("$1", r"\1").replace("$2", r"\2"), text, flags=re.ASCII)
            n += k
        assert (r.corrected, r.corrections) == (text, n)


def test_pii_and_sanitising(spark):
    t = "SSN 123-45-6789, call (555) 123-4567 or mail a.b@c.org, born 01/31/1980 and 1980-01-31; patient diagnosis"
    counts = pii_counts(F.col("s"))
    row = spark.createDataFrame([(t,)], "s string").select(*(c.alias(k) for k, c in counts.items())).first()
    assert (row.ssn, row.email, row.dob, row.medical) == (1, 1, 2, 2) and row.phone >= 1
    spans = one(spark, pii_spans(F.col("s")), s=t)
    want = sorted((m.start(), i, m.end(), kind, m[0]) for i, (kind, p, low) in enumerate([("ssn", SSN, 0), ("phone", PHONE, 0), ("email", EMAIL, 0), ("dob", DOB, 0), ("dob", DOB_ISO, 0), *(("medical", re.escape(k), 1) for k in MEDICAL)]) for m in re.finditer(p, t.lower() if low else t, re.ASCII))
    assert [(x.start, x.end, x.category, x.text) for x in spans] == [(a, b, k, x) for a, _, b, k, x in want] and all(x.confidence == (0.9 if x.category == "medical" else 1.0) for x in spans)
    assert one(spark, pii_spans(F.col("s")), s="nothing here") == one(spark, pii_spans(F.col("s")), s=None) == []
    assert one(spark, sanitised(F.col("s")), s="bad \"secret\" at 'x' by a@b.org") == "bad [REDACTED] at [REDACTED] by [EMAIL]"


def test_addresses_dates_citations(spark):
    got = one(spark, addresses(F.col("s")), s='"Ann B" <a@b.org>; c@d.com, Eve <e@f.net>, nothing')
    assert [(r["name"], r.email) for r in got] == [("Ann B", "a@b.org"), ("", "c@d.com"), ("Eve", "e@f.net")]
    raw = ["Wed, 12 Feb 2025 16:10:00 +0000", "12 Feb 2025 16:10:00 -0500", "2025-02-12T16:10:00Z", "2025-02-12", "02/12/2025", "July 17", "5:47 PM", "DEC-30-2036", "2111-03-29", "", "junk"]
    got = strings(spark, F.date_format(document_date(F.col("s"), 2026), "yyyy-MM-dd HH:mm"), raw)
    assert got == ["2025-02-12 16:10", "2025-02-12 21:10", "2025-02-12 16:10", "2025-02-12 00:00", "2025-02-12 00:00", None, None, None, None, None, None]
    got = one(spark, citations(F.col("s")), s="As [Source: a.pdf, page 3] and [Source: b.pdf, Page 12].")
    assert [(c.filename, c.page) for c in got] == [("a.pdf", 3), ("b.pdf", 12)]


def test_citation_rates(spark):
    rows = [
        ("[Source: a.pdf, page 3] [Source: b.pdf, page 9]", [("in/a.pdf", 1, 4), ("b", 1, 8)], ["a.pdf"], ["x/b.pdf", "a"]),
        ("none", [("a", 1, 2)], ["a"], []),
        ("[Source: c, page 1]", [], [], None),
    ]
    df = spark.createDataFrame(rows, "s string, expected array<struct<document_id:string,page_start:int,page_end:int>>, retrieved array<string>, fused array<string>")
    rates = citation_rates(*(F.col(c) for c in df.columns))
    assert [tuple(r) for r in df.select(*(rates[k] for k in ("accuracy", "hallucination", "post_rationalization"))).collect()] == [(0.5, 0.5, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 1.0)]
    df = spark.createDataFrame([("as [2] and [1], [9] [0] [99999999999]", ["x", "y"]), ("no marks", ["x"])], "s string, sources array<string>")
    assert [r[0] for r in df.select(numbered_citations(F.col("s"), F.col("sources"))).collect()] == [["y", "x"], []]
    assert one(spark, with_context(F.col("s"), F.lit("about")), s="x") == "about\n\nx" and one(spark, with_context(F.col("s"), F.lit(None)), s="x") == "x"


def test_quality_order(spark):
    prose = "The court heard the motion on Monday. Counsel argued for an hour. The judge asked many questions. A ruling will follow. All parties agreed to wait."
    plate = "CONFIDENTIAL Page 1 of 9 DO NOT DISTRIBUTE"
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([prose, plate, "", "| a | b |\n| c | d |"])], "i int, s string")
    got = [r.overall for r in chunk_quality(rows, "s", F.lit(120)).orderBy("i").collect()]
    assert got[0] > got[3] > got[2] == 0 and got[0] > got[1] and all(0 <= x <= 1 for x in got)


def test_names(spark):
    assert strings(spark, normal_name(F.col("s")), ["Feld- mann\nX", "a  b", "MÃ¼ller &amp; Co", "â€œDéjÃ\u00a0â€\u009d", "naïve Ã", "Ã©ä¸\u00ad", "â€œxâ€\u009d"]) == ["Feldmann X", "a b", "Müller & Co", "â€œDéjÃ\u00a0â€\u009d", "naïve Ã", "é中", "“x”"]
    assert strings(spark, garbage_name(F.col("s")), ["it", "12", "2024", "www.x.org", "#tag", "Jane Roe", "one-two-three-four", "PAwEr", "ABcDE"]) == [True, True, False, True, True, False, True, False, True]
    assert strings(spark, without_title(F.col("s")), ["Mr. Smith", "judge Roe", "Dr. ", "Sirius"]) == ["Smith", "Roe", "Dr. ", "Sirius"]
    assert strings(spark, first_last(F.col("s")), ["Doe, Jane", "10 Main, X", "Jane"]) == ["Jane Doe", "10 Main, X", "Jane"]
    df = spark.createDataFrame([("jane roe",), ("JANE ROE",), ("Jane Roe",), ("J Roe",)], "s string")
    assert df.select(canonical(F.col("s"))).first()[0] == "Jane Roe"
    assert strings(spark, block_keys(F.col("s"), F.lit("person")), ["Jeffrey Smith", "", "a"]) == [["starts=jef smi", "longest=jeff", "bones=jffr", "second=smit"], ["short"], ["short"]]


def brute_indel(a, b):
    import functools

    @functools.cache
    def lcs(i, j):
        return 0 if i == len(a) or j == len(b) else lcs(i + 1, j + 1) + 1 if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

    return 200 * lcs(0, 0) / (len(a) + len(b)) if a or b else 100.0


def test_fuzzy(spark):
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abc é\U0001f600") for _ in range(rng.randrange(12))) for _ in range(2)) for _ in range(300)] + [("x" * 3000, "xy" * 1500), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").repartition(1).select("a", "b", likeness("a", "b").alias("s")).collect()
    for r in got:
        want = 200 * 1500 / 6000 if r.a and len(r.a) > 999 else brute_indel(r.a or "", r.b or "")
        assert r.s == pytest.approx(want)
    df = spark.createDataFrame([("Jane Roe", "roe  JANE"), ("Amy Stone", "Jeffrey Stone"), ("Jon Stone", "John Stone"), ("Amy", "Jeffrey"), (None, "Al Roe")], "a string, b string")
    got = df.select(token_sort_ratio(F.col("a"), F.col("b")).alias("s"), different_people(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [False, True, False, False, False] and got[0].s == 100


def test_fuzzy_pairs_lose_none(spark):
    rng = random.Random(9)
    first, last = "kathrine catherine katherine john jon johann anna hanna al".split(), "kline cline klein smith smyth smithe roe row wu".split()
    names = {f"{rng.choice(first)} {rng.choice(last)}" + rng.choice(["", " jr", "s", "-x"]) for _ in range(150)} | {"roe anna", "Anna  Roe", "a", "b", "aa", "katherine kline", "catherine cline"}
    rows = [(n,) for n in names] + [("anna roe",), (None,), ("",), ("  ",)]
    key = lambda n: " ".join(sorted(n.lower().split()))
    all_names = sorted(names | {"anna roe"})
    want = {(a, b) for a in all_names for b in all_names if a < b and brute_indel(key(a), key(b)) >= 85}
    got = fuzzy_pairs(spark.createDataFrame(rows, "name string"), "name").collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 50
    assert all(r.score == pytest.approx(brute_indel(key(r.a), key(r.b))) for r in got)


def test_long_threads(spark):
    """A chain of 500 mails is one thread; a cycle has none; a missing parent is the root."""
    from foliant.operators.rows import thread_depth

    links = [(k, k - 1 if k else None) for k in range(500)] + [(1000, 1001), (1001, 1002), (1002, 1001), (2000, 7777), (2001, 2000)]
    out = {r.id: (r.root, r.depth) for r in thread_depth(spark.createDataFrame(links, "id long, up long"), "id", "up").collect()}
    assert out == {**{k: (0, k) for k in range(500)}, 2000: (7777, 1), 2001: (7777, 2)}


def test_order_statistics(spark):
    from foliant.operators.rows import order_statistics

    rng = random.Random(4)
    groups = {"a": [rng.lognormvariate(0, 9) for _ in range(700)], "b": [1.5] * 40 + [-1e300, 1e300, 1e-300], "c": [float(rng.randrange(5)) for _ in range(99)], "d": [2.0]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("e", None)]
    out = {r.g: r for r in order_statistics(spark.createDataFrame(rows, "g string, x double"), "g", "x", {"mid": F.floor(F.col("n") / 2), "p95": F.floor((F.col("n") - 1) * 0.95), "top": F.col("n") - 1}).collect()}
    assert out.keys() == groups.keys()
    for g, xs in groups.items():
        xs, n = sorted(xs), len(xs)
        assert (out[g].n, out[g].mid, out[g].p95, out[g].top) == (n, xs[n // 2], xs[int((n - 1) * 0.95)], xs[-1])


def test_chunks(spark):
    assert pack("") == [] and pack("short text") == ["short text"]
    text = "Para one.\n\n| a | b |\n| - | - |\n| 1 | 2 |\nPara two\nof two lines.\n\n\nEnd"
    assert text_blocks(text) == ["Para one.", "| a | b |\n| - | - |\n| 1 | 2 |", "Para two\nof two lines.", "End"]
    long = "\n\n".join(f"Block {k} " + "word " * 90 for k in range(20))
    parts = pack(long, 200, 20)
    assert all(len(portable(p)) <= 225 for p in parts) and all(f"Block {k} " in " ".join(parts) for k in range(20))
    assert "".join(portable(long)) == long
    cut = pack("A sentence of six small words. " * 100, 50, 10)
    assert all(p.endswith(".") for p in cut)


def greedy(text, most, overlap):
    """Chunks by trying block after block on the joined text."""
    size = lambda x: len(portable(x))
    out, now = [], []
    for block in text_blocks(text):
        if size(block) > most:
            out += ["\n\n".join(now)] * bool(now) + list(long_block(block, most))
            now = []
        elif now and size("\n\n".join([*now, block])) > most:
            out.append("\n\n".join(now))
            now = ["".join(portable(out[-1])[-overlap:]), block] if overlap else [block]
        else:
            now.append(block)
    return out + ["\n\n".join(now)] * bool(now)


def test_pack_is_greedy():
    rng = random.Random(21)
    for _ in range(300):
        text = "\n\n".join(" ".join("w" * rng.randint(1, 3) + rng.choice(["", ".", "."]) for _ in range(rng.randint(1, rng.choice([4, 12, 60])))) for _ in range(rng.randrange(14)))
        most, overlap = rng.randint(5, 40), rng.randrange(6)
        assert pack(text, most, overlap) == greedy(text, most, overlap)


def test_chunk_sections(spark):
    rows = [(1, "Hi\n\nOn Monday A wrote:\n> old", "email"), (2, "Hi\n> quoted", "note"), (3, "> only a reply", "email"), (4, None, "email"), (5, " \n ", "note"), (6, "x\ny -----Original Message-----", "email")]
    out = chunk(spark.createDataFrame(rows, "doc_id long, text string, kind string"), kind=F.col("kind")).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.section, r.text) for r in out] == [(1, 0, "body", "Hi"), (1, 1, "quoted_reply", "On Monday A wrote:\n> old"), (2, 0, "body", "Hi\n> quoted"), (3, 0, "quoted_reply", "> only a reply"), (6, 0, "body", "x\ny -----Original Message-----")]


def test_redaction_merges_spans(spark):
    df = spark.createDataFrame([("0123456789", [(6, 8), (0, 2), (1, 4), (4, 5), (9, 9)]), ("abc", []), ("abc", None), (None, [(0, 1)])], "t string, spans array<struct<start:int,end:int>>")
    assert [r[0] for r in df.select(redacted(F.col("t"), F.col("spans"), F.lit("#"))).collect()] == ["#5#89", "abc", "abc", None]


def test_query_blocks(spark):
    """More queries than may be broadcast at once give what one broadcast gives."""
    rng = random.Random(8)
    points = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)], "id long, vector array<double>")
    queries = points.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    one, many = (sorted(map(tuple, dense_top_k(points, queries, 3, most=m).collect())) for m in (1000, 50))
    assert one == many and len(one) == 360


def test_similar_pairs(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, [rng.gauss(0, 1) for _ in range(3)]) for i in range(90)] + [(90, 0, [0.0] * 3), (91, 0, None), (92, None, [1.0] * 3)]
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / ((sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5 or 1)
    want = {(a, b) for a, k, x in rows for b, m, y in rows if a < b and k == m and x and y and k is not None and cos(x, y) >= 0.6}
    for block in (4096, 10):
        got = similar_pairs(spark.createDataFrame(rows, "id long, kind int, vector array<double>"), "kind", 0.6, block=block).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_similar_pairs_meet_only_near(spark):
    """Vectors in groups: blocks of far groups never meet, and the pairs are those of brute force, at a threshold that cuts through the groups as well."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    v = np.concatenate([centres[rng.integers(12, size=500)] + 0.15 * rng.normal(size=(500, 16)), rng.normal(size=(20, 16)), np.zeros((2, 16))])
    rows = [(i, "x" if i % 9 else "y", x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, kind string, vector array<double>")
    u = units(v)
    for threshold in (0.95, 0.98, -0.5):
        near = u @ u.T >= threshold
        want = {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j and (i % 9 == 0) == (j % 9 == 0)}
        got = similar_pairs(df, "kind", threshold, block=30, pivots=12).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    dealt, pairs = meetings(df.filter("id < 520").select("kind", "id", F.col("vector").alias("v")), 0.95, 30, 12)
    blocks = dealt.groupBy("kind").agg(F.countDistinct("own").alias("n")).collect()
    assert pairs.count() * 2 < sum(r.n * (r.n + 1) // 2 for r in blocks)


def test_redaction_and_diff(spark):
    df = spark.createDataFrame([("a secret b", [(2, 8)], ["secret"])], "t string, spans array<struct<start:int,end:int>>, gone array<string>")
    out = df.withColumn("r", redacted(F.col("t"), F.col("spans"), F.lit("[X]"))).withColumn("bad", still_there(F.col("r"), F.col("gone")))
    assert tuple(out.select("r", "bad").first()) == ("a [X] b", False)
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd")], "a string, b string")
    assert [r.op for r in df.select(line_diff("a", "b")).first()[0]] == ["equal", "replace", "equal", "insert"]


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120))
    rows = [(1, base, "m"), (2, base.upper(), "m"), (3, base.replace(base[100:106], "zzzzzz"), "m"), (4, base, "n"), (5, "something else entirely " * 5, "m"), (6, "", "m"), (7, None, "m")]
    found = near_duplicates(spark.createDataFrame(rows, "id long, text string, scope string"), "id", "text", ["scope"])
    pairs = {(r.a, r.b): r.score for r in found.collect()}
    assert pairs[1, 2] == 1.0 and 0.8 <= pairs[1, 3] < 1 and not any(4 in p or 5 in p for p in pairs)
    clusters = {r.id: r.cluster for r in duplicate_clusters(found).collect()}
    assert clusters[1] == clusters[2] == clusters[3] == 1
    far = base.replace(base[100:106], "zzzzzz").replace(base[300:306], "yyyyyy")
    named = [(1, base, "m", "x_v1.doc", 1), (2, base, "m", "x.doc", 5), (3, far, "m", "x_v2.doc", 2), (4, far[:-1], "m", "copy.doc", 3), (5, base, "n", "x_v3.doc", 4)]
    got = version_groups(spark.createDataFrame(named, "id long, text string, scope string, name string, at int"), "id", "text", "name", "at", ["scope"])
    assert [(r.id, r.version_group, r.label, r.version) for r in got.orderBy("version").collect()] == [(1, 1, "v1", 1), (3, 1, "v2", 2), (4, 1, None, 3), (2, 1, None, 4)]


def test_components_and_paths(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(None, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root}
    assert len(got) == len(root)
    line = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (4, 5)], "src int, dst int")
    paths = shortest_paths(line, spark.createDataFrame([(1, 5), (2, 5), (1, 9)], "a int, b int"))
    assert {(r.a, r.b): list(r.path) for r in paths.collect()} == {(1, 5): [1, 4, 5], (2, 5): [2, 1, 4, 5]}
    star = spark.createDataFrame([(0, k) for k in range(1, 5)], "src int, dst int")
    assert {r.node: r.betweenness for r in betweenness(star).collect()} == {0: 6.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0}
    ranks = {r.node: r["rank"] for r in page_rank(star).collect()}
    assert ranks[0] > ranks[1] == pytest.approx(ranks[4])


def test_split_and_tiers(spark):
    chain = [(k, k + 1, 90.0 + k % 7) for k in range(60)]
    def brute(edges, most):
        while True:
            near = {}
            for _, a, b in edges:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
            seen, large = set(), []
            for v in near:
                if v not in seen:
                    part, todo = {v}, [v]
                    while todo:
                        todo += [w for w in near[todo.pop()] if w not in part and not part.add(w)]
                    seen |= part
                    large += [part] * (len(part) > most)
            if not large:
                return set(edges)
            for part in large:
                edges.remove(min(e for e in edges if e[1] in part))

    left = split_oversized(spark.createDataFrame(chain, "a int, b int, score double"), most=50).collect()
    assert {(r.score, r.a, r.b) for r in left} == brute([(s, a, b) for a, b, s in chain], 50) and len(left) < 60
    rng = random.Random(7)
    web = list({(a, b): (a, b, float(rng.randrange(9))) for a, b in ((rng.randrange(40), rng.randrange(40, 80)) for _ in range(90))}.values())
    left = split_oversized(spark.createDataFrame(web, "a int, b int, score double"), most=12).collect()
    assert {(r.score, r.a, r.b) for r in left} == brute([(s, a, b) for a, b, s in web], 12)
    rows = two_tiers(spark.createDataFrame([("a", x) for x in "xyz"] + [("b", "p"), ("c", "q"), ("c", "p")], "id string, member string")).collect()
    assert {(r.id, r.member, r.level, r.parent_id) for r in rows} == {("a", x, 0, None) for x in "xyz"} | {("b", "p", 0, "small"), ("c", "q", 0, "small"), ("c", "p", 0, "small"), ("small", "p", 1, None), ("small", "q", 1, None)}


def modularity(edges, place):
    from collections import Counter

    total, inside, degree = 0.0, Counter(), Counter()
    for a, b, w in edges:
        total += w
        inside[place[a]] += w * (place[a] == place[b])
        degree[place[a]] += w
        degree[place[b]] += w
    return sum(inside[c] / total - (degree[c] / 2 / total) ** 2 for c in degree)


def test_modularity_communities(spark):
    """Four dense groups with few edges between them are found; no single move of a node raises the modularity."""
    rng = random.Random(5)
    group = {v: v // 12 for v in range(48)}
    edges = [(a, b, 1.0) for a in group for b in group if a < b and rng.random() < (0.6 if group[a] == group[b] else 0.02)]
    place = {r.node: r.community for r in modularity_communities(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    assert len({(group[v], c) for v, c in place.items()}) == len(set(place.values())) == 4
    best = modularity(edges, place)
    assert all(modularity(edges, place | {v: c}) <= best + 1e-9 for v in place for c in set(place.values()))


def test_graph_edits(spark):
    nodes = spark.createDataFrame([("Ann Roe", "person"), ("Acme", "organization"), ("Springfield", "location"), ("Bo", "person"), ("1/2/2020", "date")], "name string, type string")
    edges = spark.createDataFrame([("Ann Roe", "Springfield", "IN"), ("Acme", "Ann Roe", "PAYS"), ("Ann Roe", "Bo", "KNOWS"), ("Ann Roe", "1/2/2020", "BORN"), ("Ann Roe", "Ann Roe", "IS")], "src string, dst string, relation string")
    asked = spark.createDataFrame([(1, "Did ann roe pay?"), (2, "nobody"), (3, "Springfield or Acme")], "q int, text string")
    got = {tuple(r) for r in entity_connections(asked, edges, nodes, "q", "text").collect()}
    assert got == {(1, "Ann Roe", "Springfield", "IN"), (3, "Springfield", "Ann Roe", "IN"), (3, "Acme", "Ann Roe", "PAYS")}
    changes = spark.createDataFrame([("Ann Roe", "Ann B. Roe", None, None), ("Bo", None, "organization", False), ("Acme", None, None, True)], "name string, new_name string, new_type string, gone boolean")
    n, e = edited(nodes, edges, changes)
    assert {tuple(r) for r in n.collect()} == {("Ann B. Roe", "person"), ("Springfield", "location"), ("Bo", "organization"), ("1/2/2020", "date")}
    assert {tuple(r) for r in e.collect()} == {("Ann B. Roe", "Springfield", "IN"), ("Ann B. Roe", "Bo", "KNOWS"), ("Ann B. Roe", "1/2/2020", "BORN"), ("Ann B. Roe", "Ann B. Roe", "IS")}
    paths = shortest_paths(edges, spark.createDataFrame([("Acme", "Springfield")], "a string, b string")).first()
    assert (paths.path, paths.names) == (["Acme", "Ann Roe", "Springfield"], ["PAYS", "IN"])
    assert shortest_paths(edges, spark.createDataFrame([("Acme", "Springfield")], "a string, b string"), relations=["IN"]).count() == 0


def test_threads(spark):
    rows = [
        (1, "<a>", "", "", "Plan"), (2, "<b>", "<a>", "<a>", "Re: Plan"), (3, "<c>", "<b>", "<a> <b>", "Re: Plan"), (4, "<d>", "<c>", "", "Re: Plan"),
        (5, "<e>", "<d>", "", ""), (6, "<f>", "<gone>", "", ""), (7, "", "", "", "re: plan"), (8, "<h>", "", "", ""), (9, None, None, None, None), (10, "", "<f>", "", ""),
    ]
    got = {r.doc_id: (r.thread_id, r.position) for r in assign_threads(spark.createDataFrame(rows, "doc_id long, message_id string, in_reply_to string, references string, subject string")).collect()}
    assert len(got) == 10
    assert got[2][0] == got[3][0] == got[4][0] == got[5][0] and [got[k][1] for k in (2, 3, 4, 5)] == [1, 2, 3, 4]
    assert got[1][0] == got[7][0] and got[6][1] == 1 and got[10] == (got[6][0], 2) and got[8][1] == got[9][1] == 0


def test_pairs(spark):
    rows = [("m", "Ann", "ann@x.org", 'Bob <bob@x.org>, "Cy" <cy@x.org>', "dan@x.org", "", "Wed, 12 Feb 2025 16:10:00 +0000"), ("m", "Ann", "ann@x.org", "bob@x.org", None, None, "2025-03-01"), ("m", "", "", "bob@x.org", "", "", "")]
    got = communication_pairs(spark.createDataFrame(rows, "matter_id string, from_name string, from_email string, to string, cc string, bcc string, date string"), "matter_id", 2026).collect()
    assert sorted((r.recipient_email, r.relationship_type, r.message_count) for r in got) == [("bob@x.org", "to", 2), ("cy@x.org", "to", 1), ("dan@x.org", "cc", 1)]
    bob = next(r for r in got if r.recipient_email == "bob@x.org")
    assert bob.recipient_name == "Bob" and bob.earliest < bob.latest


def test_rows(spark):
    hits = spark.createDataFrame([(1, "c", False, 0.9), (2, "c", True, 0.5), (3, None, None, 0.4), (4, None, None, 0.7)], "id int, cluster string, final boolean, score double")
    assert sorted(r.id for r in best_per_cluster(hits, "cluster", "final", "score", "id").collect()) == [2, 3, 4]
    items = spark.createDataFrame([(1, "s", 3), (2, "s", 999_999), (3, "s", 1)], "id int, scope string, pages int")
    got = [(r.bates_begin, r.bates_end) for r in page_numbers(items, ["scope"], [F.col("id")], "pages", "P").orderBy("id").collect()]
    assert got == [("P000001", "P000003"), ("P000004", "P1000002"), ("P1000003", "P1000003")]
    assert strings(spark, visible(F.col("s")), ["privileged", None, "public", "work_product"]) == [False, True, True, False]
    got = strings(spark, in_dates(F.col("s").cast("timestamp"), "2024-01-05", "2024-01-10"), ["2024-01-10 23:59:59", "2024-01-11", None, "2024-01-05"])
    assert got == [True, False, False, True]


def test_page_numbers_over_ranges(spark):
    rng = random.Random(2)
    rows = [(k, "big" if k % 10 else "small", rng.randint(1, 9)) for k in range(2000)]
    out = page_numbers(spark.createDataFrame(rows, "id int, scope string, pages int"), ["scope"], [F.desc("id")], "pages", "P").collect()
    at = {"big": 0, "small": 0}
    got = {r.id: (r.begin_no, r.end_no) for r in out}
    for k, scope, pages in sorted(rows, reverse=True):
        assert got[k] == (at[scope] + 1, at[scope] + pages)
        at[scope] += pages
    assert len(got) == len(out) == 2000


def test_grounded(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(7)))
    names, others = {word() for _ in range(200)}, {word() for _ in range(60)}
    got = {r.name: (r.grounded, r.closest) for r in grounded(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), spark.createDataFrame([(n,) for n in others], "name string")).collect()}
    assert got == {None: (False, None), **{n: (n in others, None if n in others else min((o for o in others if n in o), default=None)) for n in names}}


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "c", 2), (3, "y", 1)], "query_id int, id string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "z")], "query_id int, id string")
    got = {r.query_id: r for r in ranking_metrics(hits, relevant, 2).collect()}
    assert (got[1].mrr, got[1].recall, got[1].precision, got[1].ndcg) == (1, 1, 1, pytest.approx(1))
    assert (got[2].mrr, got[2].precision, got[3].mrr, got[3].ndcg) == (0.5, 0.5, 0, 0)


def test_readers(spark, tmp_path):
    dat = tmp_path / "a.dat"
    dat.write_text("þDOCIDþ\x14þTITLEþ\x14þDATEþ\nþD1þ\x14þOneþ\x14þ2020þ\nþD2þ\x14þTwoþ\n", encoding="utf-8")
    got = {r.doc_id: r.fields for r in read_dat(spark, str(dat)).collect()}
    assert got == {"D1": {"DOCID": "D1", "TITLE": "One", "DATE": "2020"}, "D2": {"DOCID": "D2", "TITLE": "Two", "DATE": ""}}
    (tmp_path / "dats").mkdir()
    (tmp_path / "dats" / "1.dat").write_text("\ufeffþDOCIDþ\x14þTITLEþ\nþD1þ\x14þa þ bþ\n", encoding="utf-8")
    (tmp_path / "dats" / "2.dat").write_text("þAUTHORþ\x14þDOCIDþ\nþAnnþ\x14þD2þ\nþBoþ\n", encoding="utf-8")
    assert {r.doc_id: r.fields for r in read_dat(spark, str(tmp_path / "dats")).collect()} == {"D1": {"DOCID": "D1", "TITLE": "a þ b"}, "D2": {"AUTHOR": "Ann", "DOCID": "D2"}}
    (tmp_path / "x.xml").write_text('<R><Document DocID="7" MimeType="m" Custodian="Ann"><Tags><Tag TagName="T" TagValue="v"/></Tags></Document></R>')
    assert read_edrm(spark, str(tmp_path / "x.xml")).first().fields == {"MimeType": "m", "Custodian": "Ann", "T": "v"}
    opt = tmp_path / "a.opt"
    opt.write_text("P1,V,img1.tif,Y,,2\n,V,x,,,\nP2,V,img2.tif\n")
    assert [(r.page_id, r.page_count) for r in read_opticon(spark, str(opt)).orderBy("page_id").collect()] == [("P1", "2"), ("P2", "")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("héllo")
    (tmp_path / "t" / "y.txt").write_bytes(b"caf\xe9")
    assert sorted(r.text for r in import_documents(spark, "directory", str(tmp_path / "t")).collect()) == ["café", "héllo"]
    for name in ("t/.hidden.txt", "t/__MACOSX/z.txt", "t/blank.md", "t/Thumbs.db", "t/deep/a.CSV"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("  \n" if "blank" in name else "a,b")
    assert sorted(r.filename for r in import_documents(spark, "directory", str(tmp_path / "t")).collect()) == ["a.CSV", "x.txt", "y.txt"]
    assert [r.filename for r in read_text(spark, str(tmp_path / "t"), limit=2).collect()] == ["a.CSV", "x.txt"]
    with pytest.raises(ValueError):
        import_documents(spark, "none", "x")
    docs = spark.createDataFrame([("D1", "a.pdf", "p/a.pdf", "application/pdf", "hot")], "doc_id string, filename string, path string, mime_type string, Issue string")
    write_edrm(docs, str(tmp_path / "edrm"), ["Issue"])
    (row,) = read_edrm(spark, str(tmp_path / "edrm")).collect()
    assert row.doc_id == "D1" and row.fields["Issue"] == "hot" and row.fields["FileName"] == "a.pdf"


def test_corpora(spark):
    df = spark.createDataFrame([("IMAGES/1.jpg", "x" * 80), ("TEXT/ABC_000123.txt", "word " * 20 + "\x07"), ("TEXT/short.txt", "tiny"), ("TEXT/n.txt", None)], "filename string, text string")
    (row,) = read_ocr_corpus(df).collect()
    assert row.filename == "ABC_000123.txt" and row.metadata["bates_prefix"] == "ABC" and row.metadata["bates_number"] == "000123"
    flat = spark.createDataFrame([("d", "f", 1, "a@b", "c@d", "e@f", "S", "2020", "<p>Hello there, this is text</p>"), ("d", "f", 2, "a", "b", "", "S", "2020", "<b>x</b>")], "document_id string, source_filename string, message_order int, from_address string, to_address string, other_recipients string, subject string, timestamp_iso string, message_html string")
    (row,) = read_email_corpus(flat).collect()
    assert row.text == "Hello there, this is text" and row.recipients == "c@d, e@f"
    threaded = spark.createDataFrame([("t", "f", "S", '[{"sender":"a","recipients":["b"],"body":"A body that is long enough"},{"body":"x"}]'), ("u", "f", "S", "broken")], "thread_id string, source_file string, subject string, messages string")
    assert [r.doc_id for r in read_email_corpus(threaded).collect()] == ["t-0"]
    done = spark.createDataFrame([("m", "h1")], "matter_id string, content_hash string")
    new = spark.createDataFrame([("m", "h1", "t"), ("m", "h2", "t"), ("m", "h2", "t"), ("n", "h1", "t"), ("m", "h3", " ")], "matter_id string, content_hash string, text string")
    assert sorted((r.matter_id, r.content_hash) for r in resume(new, done, ["matter_id"]).collect()) == [("m", "h2"), ("n", "h1")]
    state = spark.createDataFrame([("f", "1")], "file_id string, modified_time string")
    assert [r.file_id for r in changed_files(spark.createDataFrame([("f", "1"), ("g", "1")], "file_id string, modified_time string"), state).collect()] == ["g"]


def test_parsers(spark, tmp_path):
    mail = b"From: Ann <ann@x.org>\r\nTo: bob@x.org\r\nSubject: Hi\r\nMessage-ID: <1>\r\nReferences: <0>\r\n <9>\r\nContent-Type: text/html\r\n\r\n<p>Hello <b>you</b></p>"
    got = parse_eml(mail)
    assert got["references"] == "<0> <9>" and got["text"].endswith("Hello you") and got["sender"] == "Ann <ann@x.org>"
    text, rows, columns, more = csv_table(b"a,b\n1,2\n3\n")
    assert (rows, columns, more) == (2, 2, False) and text.splitlines()[-1] == "| 3 |  |"
    assert rtf_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}\b Caf\'e9\b0\par Two}") == "Café\nTwo"
    assert rtf_text(rb"{\rtf1{\stylesheet{\s1{\f0{\b x}}}}{\*\gen{a{b{c}}}}{\b One {\i two {\ul three}}}\par\u233?\u8364\'80 \{x\}\tab y}") == "One two three\né€ {x}\ty"
    assert strings(spark, parser_of(F.col("s")), ["a.EML", "b.doc", "c.xyz"]) == ["eml", "unsupported", None]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("a.txt", "d/b.csv", ".hidden", "__MACOSX/x", "in.zip"):
            z.writestr(name, name)
    (tmp_path / "x.zip").write_bytes(buffer.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no")
    assert sorted((r.member, r.parser) for r in expand_zips(spark, str(tmp_path)).collect()) == [("a.txt", "plaintext"), ("d/b.csv", "csv")]


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([("1", "A1", "A2", None, "", "s@x", ["r1", "r2"], "email", "privileged", None), ("2", "B", "B", None, "w", "s", None, None, "public", "b")], "doc_id string, bates_begin string, bates_end string, document_date date, author string, sender string, recipients array<string>, document_type string, privilege_status string, basis string")
    log = privilege_log(docs)
    row = log.first()
    assert log.count() == 1 and (row.bates_range, row.author, row.recipients, row.privilege) == ("A1 - A2", "s@x", "r1; r2", "Attorney-Client Privilege")
    write_csv(docs.select("doc_id", "basis"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    court_package(docs.select("doc_id"), log, str(tmp_path / "court"), "2024-01-31")
    assert spark.read.json(str(tmp_path / "court" / "manifest")).first().privileged == 1
    for k in range(2):
        append_audit(docs.select("doc_id", F.lit(k).alias("round")), str(tmp_path / "audit"))
    assert sorted((r.doc_id, r["round"]) for r in spark.read.parquet(str(tmp_path / "audit")).collect()) == [("1", 0), ("1", 1), ("2", 0), ("2", 1)]
    write_points(docs.select("doc_id", F.array(F.lit(1.0)).alias("vector"), F.concat(F.lit("m"), "doc_id").alias("matter_id")), str(tmp_path / "points"))
    assert spark.read.parquet(str(tmp_path / "points" / "matter_id=m2")).first().doc_id == "2"


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "2024-01-01 10:00:00", "processing"), (1, 2, "2024-01-01 10:01:00", "complete"), (1, 3, "2024-01-01 10:02:00", "failed"), (2, 4, "2024-01-01 10:00:00", "processing"), (3, 5, "2024-01-01 12:00:00", "pending")], "job_id long, event_id long, t string, status string").selectExpr("job_id", "event_id", "CAST(t AS timestamp) AS ts", "status")
    path = str(tmp_path / "events")
    events.write.parquet(path)
    q = job_states(stream(spark, path, events.schema)).writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.job_id: r.status for r in spark.sql("SELECT job_id, max_by(status, tries) AS status FROM jobs GROUP BY 1").collect()}
    assert last[1] == "complete" and last[2] in ("pending", "processing")
    keep_counts(stream(spark, path, events.schema, files=1), ["status"], str(tmp_path / "state"), str(tmp_path / "c2")).awaitTermination()
    assert {r.status: r.n for r in read_counts(spark, ["status"], str(tmp_path / "state")).collect()} == {"processing": 2, "complete": 1, "failed": 1, "pending": 1}
    # Sixty files in batches of one pass a compaction on their way.
    for k in range(60):
        events.filter(f"event_id = {k % 5 + 1}").coalesce(1).write.mode("append").parquet(str(tmp_path / "more"))
    keep_counts(stream(spark, str(tmp_path / "more"), events.schema, files=1), ["status"], str(tmp_path / "state2"), str(tmp_path / "c3")).awaitTermination()
    assert (tmp_path / "state2" / "kind=base" / "number=49").exists()
    assert {r.status: r.n for r in read_counts(spark, ["status"], str(tmp_path / "state2")).collect()} == {"processing": 24, "complete": 12, "failed": 12, "pending": 12}


def test_quality_goes_through_sentences_once(spark):
    """The sentences of a text, and their words, are made once; texts without a boilerplate pattern's words are not searched for it."""
    text = "This is CONFIDENTIAL. Page 3 of 12\nPlain words follow here! attorney-client privilege; Exhibit A and EXHIBIT B2.\n----------\nDo not distribute"
    docs = spark.createDataFrame([(1, text), (2, None), (3, " \n"), (4, "plain")], "id long, text string")
    out = chunk_quality(docs, "text", F.lit(30))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[.!?]\\s") == 1
    rows = {r.id: r for r in out.collect()}
    plate = len("CONFIDENTIAL" + "Page 3 of 12" + "attorney-client privilege" + "EXHIBIT B2" + "----------" + "Do not distribute")
    # The line of dashes takes the line breaks that its pattern's white space covers.
    assert any(abs(rows[1].information_density - round(1 - (plate + k) / len(text), 4)) < 1e-9 for k in (0, 1))
    assert rows[2].overall == rows[3].overall == 0 and rows[4].information_density == 1


def test_dates_of_mails_are_read_once_a_mail(spark):
    """Dates are read below what takes the lists apart; an address and what its parts need are looked for once a recipient."""
    rows = [(1, "A", "a@x.org", '"B C" <b@x.org>, d@x.org, nobody', "", "b@x.org", "Tue, 5 Mar 2019 10:00:00 +0200"), (1, "", "a@x.org", "b@x.org", None, None, "5 Mar 2018 10:00:00"), (1, "A", None, "b@x.org", None, None, None)]
    mails = spark.createDataFrame(rows, "m int, from_name string, from_email string, to string, cc string, bcc string, date string")
    out = communication_pairs(mails, "m", 2024)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("d MMM yyyy HH:mm") and plan.count("<([^>]+)>") == 1
    found = {(r.recipient_email, r.relationship_type): (r.recipient_name, r.message_count, str(r.earliest), str(r.latest)) for r in out.collect()}
    assert found == {
        ("b@x.org", "to"): ("B C", 2, "2018-03-05 10:00:00", "2019-03-05 08:00:00"),
        ("d@x.org", "to"): ("", 1, "2019-03-05 08:00:00", "2019-03-05 08:00:00"),
        ("nobody", "to"): ("", 1, "2019-03-05 08:00:00", "2019-03-05 08:00:00"),
        ("b@x.org", "bcc"): ("", 1, "2019-03-05 08:00:00", "2019-03-05 08:00:00"),
    }
