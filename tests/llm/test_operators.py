"""The operators of foliant.llm against brute force, on edge cases and on the smallest tables."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import queries
from foliant.llm.exact_dedup import drop_copies, exact_dedup
from foliant.llm.html_text import extract, main_text
from foliant.llm.language_id import predict, train
from foliant.llm.mixing import mix, mixed_rows, route, water_fill, word_count
from foliant.llm.ngram_join import clusters, drop_near_copies, ngram_components
from foliant.llm.piece_bpe import PieceBPE, encode
from foliant.llm.quality import chi2_quantile, quality
from foliant.llm.sharding import shard
from foliant.llm.token_cache import count_tokens

from .helpers import BASE, EDGE, LOW, SF, frame, words

tokenizers = pytest.importorskip("public_tokenizers")
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def edge(spark):
    return frame(spark, EDGE)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def documents():
    return duckdb.execute(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


# Exact dedup


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, edge, none, keep):
    groups = defaultdict(list)
    for i, t, *_ in EDGE:
        groups[(t or "").translate(LOW)].append(i)
    pick = min if keep == "min" else max
    for runs, fan_in in ((64, 8), (4, 2), (1, 2)):
        got = exact_dedup(edge, keep=keep, runs=runs, fan_in=fan_in).collect()
        assert len(got) == len(EDGE)
        by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        for r in got:
            ids = by_sha[r.text_sha256]
            known = [i for i in ids if i is not None]
            assert r.group_size == len(ids)
            assert r.keep_id == (pick(known) if known else None)
            assert r.kept == (r.doc_id is not None and r.doc_id == r.keep_id)
        assert sum(r["first"] for r in got) == len(groups)
    assert exact_dedup(none).count() == 0
    kept = drop_copies(edge)
    assert kept.columns == edge.columns and kept.count() == len(groups)


@tables
def test_exact_dedup_tables(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT * FROM ({queries.ORACLE['op6_exact_dedup']}) ORDER BY doc_id").fetchall()
    got = queries.op6_exact_dedup(spark, SF).orderBy("doc_id")
    assert [tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()] == [tuple(r) for r in want]


# N-gram Jaccard join


def classes(docs, size=5):
    sets = {}
    for n, (i, t) in enumerate(docs):
        w = words((t or "").translate(LOW))
        sets[n] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, _) in enumerate(docs):
        for m, (j, _) in enumerate(docs[:n]):
            a, b = sets[n], sets[m]
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(sets[n]), find(i) if i is not None else None) for n, (i, _) in enumerate(docs)]


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def compare(spark, rows):
    got = ngram_components(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted_rows([tuple(r) for r in got]) == sorted_rows(classes([(i, t) for i, t, *_ in rows]))


def test_ngram_edge(spark, edge, none):
    compare(spark, EDGE)
    assert ngram_components(none).count() == 0
    kept = drop_near_copies(edge)
    assert kept.columns == edge.columns
    assert sorted_rows([(r.doc_id,) for r in kept.collect()]) == sorted_rows([(1,), (2,), (3,), (4,), (6,), (9,), (10,), (11,), (None,)])


def test_ngram_near_copies(spark):
    """Chains of edits, a passage that many texts share, texts around the threshold, and copies."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(60))
    rows, text = [], [f"v{k}" for k in range(150)]
    for i in range(60):
        if i % 3 == 0:
            text = list(text)
            text[rng.randrange(len(text))] = f"e{i}"
        rows.append((1000 - i, " ".join(text), "en", "a"))
    for i in range(60):
        rows.append((2000 + i, passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 30))), "en", "b"))
    for i in range(40):
        w = [f"z{k}" for k in range(50)]
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(50)] = f"y{rng.randrange(10**6)}"
        rows.append((3000 + i, " ".join(w), "en", "c"))
    compare(spark, rows)


@tables
def test_ngram_tables(spark):
    docs = [(i, t) for i, t, *_ in documents()]
    got = queries.op1_ngram_join(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(classes(docs))


def test_clusters_are_components():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 200, np.uint64)
    sets = []
    for _ in range(40):
        s = base.copy()
        s[rng.integers(0, 200, rng.integers(0, 30))] = rng.integers(0, 1 << 60)
        sets.append(np.unique(s))
    found = clusters(sets)
    root = list(range(40))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert [find(i) for i in range(40)] == found.tolist()


# Mixing


def test_water_fill():
    assert water_fill([10, 10], [1, 3], 20, 3) == [5, 15]
    assert water_fill([1, 100], [1, 1], 101, 3) == [3, 98]
    assert water_fill([], [], 0, 3) == []


def test_route_prefers_first_passes():
    flow = route([10, 10], [[0], [0, 1]], [15, 5], 3)
    assert flow[0, 0] == 10 and flow[1, 0] == 5 and flow[1, 1] == 5
    flow = route([10], [[0]], [25], 3)
    assert flow == {(0, 0): 25}
    # A repetition is used only where nothing else is left.
    flow = route([10, 30], [[0], [0, 1]], [20, 20], 3)
    assert sum(v for (p, _), v in flow.items() if p == 0) == 10


def test_mix(spark, edge, none):
    out = mix(edge, F.array("source"), word_count(F.col("text"))).collect()
    assert len(out) == len(EDGE)
    size, got, target = Counter(), Counter(), {}
    for r in out:
        s = r.targets[0]
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.times * r["size"]
        size[s.source] += r["size"]
        got[s.source] += r.taken
        target[s.source] = s.target
        assert s.source_size == sum(len(words(t)) for _, t, _, x in EDGE if x == s.source)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        largest = max(len(words(t)) for _, t, _, x in EDGE if x == s)
        assert target[s] - largest - 1 <= got[s] <= target[s] + 1
    assert sorted(map(repr, out)) == sorted(map(repr, mix(edge, F.array("source"), word_count(F.col("text"))).collect()))
    assert mix(none, F.array("source"), word_count(F.col("text"))).count() == 0
    taken = Counter(r.doc_id for r in mixed_rows(edge, F.array("source"), word_count(F.col("text"))).collect())
    assert taken == Counter({k: v for k, v in sum((Counter({r.doc_id: r.times}) for r in out), Counter()).items() if v})


def test_mix_overlapping(spark):
    rows = [(i, "w " * 10, None, None) for i in range(300)]
    of = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    out = mix(frame(spark, rows), of, word_count(F.col("text")), weights={"a": 1, "b": 1}, budget=2000).collect()
    assert sum(r.taken for r in out) == pytest.approx(2000, abs=40) and max(r.times for r in out) == 1


@tables
def test_mix_tables(spark):
    out = queries.op2_source_mix(spark, SF).toPandas()
    by = out.groupby("source").agg(t=("target", "first"), k=("taken", "sum"), m=("size", "max"))
    assert (by.k <= by.t + 1).all() and (by.k >= by.t - by.m).all()
    assert (out.taken <= 3 * out["size"]).all()


# Token counts


def test_token_counts(spark, edge, none, tmp_path):
    from tokenizers import Tokenizer

    file, cache = tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    t = Tokenizer.from_file(file)
    want = sorted((repr(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in EDGE)
    for again in (False, True):
        out = count_tokens(edge, file, cache).collect()
        assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == want
        assert all(r.cached == again for r in out)
    assert spark.read.parquet(cache).select("digest").distinct().count() == len({t or "" for _, t, *_ in EDGE})
    assert count_tokens(none, file).count() == 0
    # Another tokenizer doesn't see these counts.
    assert not any(r.cached for r in count_tokens(edge, tokenizers.path("word_bpe_49k.json"), cache).collect())


# Language ID


def test_language_id(spark, none):
    rng = random.Random(2)
    voice = {"x": "abcde", "y": "vwxyz"}
    text = lambda k: " ".join("".join(rng.choice(voice[k]) for _ in range(5)) for _ in range(30))
    docs = frame(spark, [(i, text("xy"[i % 2]), "xy"[i % 2], "s") for i in range(40)] + EDGE)
    learned = train(docs.filter("doc_id >= 20 OR lang IN ('x', 'y')").filter("lang IN ('x', 'y')"))
    out = {r.doc_id: r for r in predict(docs.filter("lang IN ('x', 'y')"), learned).collect()}
    assert all(r.lang_pred == "xy"[i % 2] and 0 < r.score <= 1 for i, r in out.items())
    edge = predict(frame(spark, EDGE), learned).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in edge)
    assert all(r.lang_pred in ("x", "y", "und") and 0 <= r.score <= 1 for r in edge)
    assert predict(none, learned).count() == 0
    assert all(r.lang_pred == "und" for r in predict(frame(spark, EDGE), train(none)).collect())


@tables
def test_language_accuracy(spark):
    out = queries.op5_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    right = [r.lang == r.lang_pred for r in out.filter("held_out").join(truth, "doc_id").collect()]
    assert sum(right) >= 0.95 * len(right) > 0


# SentencePiece


def test_piece_bpe_equals_library():
    from sentencepiece import SentencePieceProcessor

    file = tokenizers.path("piece_bpe_32k.model")
    own, library = PieceBPE(file), SentencePieceProcessor(model_file=file)
    rng = random.Random(4)
    letters = " " * 6 + "ab\n\tthe1234é中\U0001f600▁\x00<s>.,!?"
    texts = [t or "" for _, t, *_ in EDGE] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), np.uint16).tolist()
        assert ids == library.encode(t)
        assert own.decode(ids) == library.decode(ids)


def test_encode(spark, edge, none):
    file = tokenizers.path("piece_bpe_32k.model")
    out = encode(edge, file).collect()
    assert len(out) == len(EDGE)
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in out)
    assert encode(none, file).count() == 0


@tables
def test_piece_tables(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.op7_piece_bpe(spark, SF).collect()}
    for i, t, *_ in documents():
        ids = library.encode(t or "")
        r = got[i]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# HTML


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div class="menu"><a href=a>x</a></div><div class="cookie-notice">We use cookies on this site, and this is a long notice.</div>
<div class="content"><h1>Title &amp; more</h1><div><p>Para one is long enough to be text, and it has <a href=x>a link</a> inside.</p><p>Para
two &nbsp; goes<br>on<ul><li>Item one<li>Item two</ul></div></div>
<div id="comments"><p>First! A reader comment which is long enough to look like text of an article.</p></div>
<aside>side text</aside><form><p>Sign up</p></form><footer>c</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more\n\nPara one is long enough to be text, and it has a link inside.\n\nPara two goes on\n\nItem one\n\nItem two"
    assert main_text(None) == main_text("") == main_text("<div>") == main_text("<nav>menu</nav>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<p>a<p>b &lt;c") == "a\n\nb <c"
    assert main_text("<article><p>one two</p><p>cut off &am") == "one two\n\ncut off &am"
    assert main_text("<div>" * 5000 + "deep") == "deep"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    out = extract(pages).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)
    assert sum(r.text == main_text(PAGE) for r in out) == 2
    assert extract(pages.limit(0)).count() == 0


# Quality


def stats(t):
    w = words(t)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = [False] * len(w)
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            again[i : i + 8] = [True] * 8
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), sum(again)


def test_quality_stats(spark, none):
    extra = [(20 + i, t, "en", "a") for i, t in enumerate(["a\na\n\na", "\n\nx\n", " ".join("abcdefgh") * 3, "1 2 3 4 5 6 7 8 9 " * 4, "x # |\r\n#", "é\né\n é"])]
    out = quality(frame(spark, EDGE + extra)).collect()
    assert len(out) == len(EDGE + extra)
    want = sorted((repr(i), *stats(t)) for i, t, *_ in EDGE + extra)
    assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality(none).count() == 0


def test_quality_outliers(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(i, say(rng.randint(50, 400)), "en", "a") for i in range(200)] + [(900 + i, say(100).replace(" ", "### $$$"), "en", "a") for i in range(10)]
    out = {r.doc_id: r.kept for r in quality(frame(spark, rows)).collect()}
    assert all(out[i] for i in range(200)) and not any(out[900 + i] for i in range(10))


def test_chi2():
    assert chi2_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3)
    assert chi2_quantile(0.99, 5) == pytest.approx(15.086, abs=1e-3)


@tables
def test_quality_keeps_clean(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.op9_quality(spark, SF).join(labels, "doc_id").filter("quality = 1 AND NOT base_failed").collect()
    assert sum(r.kept for r in out) >= 0.98 * len(out) > 0


# Sharding


def check_shards(out, shards):
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards(spark, edge, none):
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16
    out = shard(edge, size, shards=3, extra={"crc": F.crc32(F.coalesce("text", F.lit("")))}).collect()
    assert len(out) == len(EDGE)
    check_shards(out, 3)
    assert shard(none, size).count() == 0
    rows = [(i, "x" * (i % 97), "en", "a") for i in range(4000)]
    out = shard(frame(spark, rows), size, shards=7).collect()
    check_shards(out, 7)
    load = Counter()
    for r in out:
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 7
    assert sorted(map(tuple, out)) == sorted(map(tuple, shard(frame(spark, rows), size, shards=7).collect()))


@tables
def test_shard_tables(spark):
    out = queries.op10_ring_sharding(spark, SF).collect()
    check_shards(out, 40)
    assert len(out) == len(documents()) and {r.law for r in out} == {"bytes"}


def test_ring_moves_little(spark):
    """One more shard moves about its own share of the rows, not most of them."""
    rows = [(i, BASE[: i % 50], "en", "a") for i in range(5000)]
    size = F.lit(16)
    a = {r.doc_id: r.shard for r in shard(frame(spark, rows), size, shards=9, slack=0.05).collect()}
    b = {r.doc_id: r.shard for r in shard(frame(spark, rows), size, shards=10, slack=0.05).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.35 * len(a)
