"""DuckDB SQL of the training-data queries that need more than a few lines of it."""

from __future__ import annotations


def crc32(number: str) -> str:
    """The unsigned CRC-32 of an integer's decimal digits."""
    step = "CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END"
    byte = f"list_reduce(list_prepend(xor(x, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, k: {step})"
    digits = f"[ascii(c)::BIGINT FOR c IN string_split({number}::VARCHAR, '')]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda x, b: {byte}), 4294967295)"


WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

PERIODIC_RUNS = f"""
    WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w, {crc32("doc_id")} AS h FROM documents),
    e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
    f AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS made, g % greatest(n, 1) AS a, g FROM e),
    s AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
    t AS (SELECT doc_id, made, a, p, unnest(range(n)) AS i, unnest(w) AS word FROM s),
    u AS (SELECT t.doc_id, t.i, o.word FROM t JOIN t AS o ON o.doc_id = t.doc_id AND o.i = CASE WHEN t.made AND t.i >= t.a THEN t.a + (t.i - t.a) % t.p ELSE t.i END),
    same AS (SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
             FROM u AS x JOIN u AS y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
    stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
    found AS (SELECT doc_id, count(*) AS n_runs, min((-length, start, period)) AS best, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed
              FROM runs GROUP BY doc_id),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS line FROM u
             WHERE NOT EXISTS (FROM runs AS r WHERE r.doc_id = u.doc_id AND u.i >= r.start + r.period AND u.i < r.start + r.length) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[2] AS start, -best[1] AS length, best[3] AS period, -1000 * best[1] // best[3] AS exponent_milli,
        sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
    FROM documents LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

PREFIX_TRIE = f"""
    WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT conv_id, {crc32("conv_id")} % 4 AS h FROM c GROUP BY conv_id),
    turns AS (SELECT i.conv_id, 0 AS part, c.pos, c.role, c.text FROM ids AS i JOIN c ON c.conv_id = i.conv_id - i.conv_id % 20 AND c.pos <= i.h
              UNION ALL SELECT i.conv_id, 1, c.pos, c.role, c.text FROM ids AS i JOIN c ON c.conv_id = i.conv_id AND c.pos > i.h),
    listed AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, pos) AS s FROM turns GROUP BY conv_id),
    seqs AS (SELECT conv_id, coalesce(s, []) AS s FROM ids LEFT JOIN listed USING (conv_id)),
    prefixes AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM seqs),
    named AS (SELECT conv_id, d, len(s) AS n, to_json(s[1:d]) AS node, CASE WHEN d > 0 THEN to_json(s[1:d - 1]) END AS parent,
                  CASE WHEN d > 0 THEN len({WORDS.format("s[d].text")}) ELSE 0 END AS words FROM prefixes),
    nodes AS (SELECT node, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM named GROUP BY node, d),
    children AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent),
    whole AS (SELECT n.*, coalesce(c.n, 0) AS n_children, p.conv_id AS parent_conv_id
              FROM nodes AS n LEFT JOIN children AS c ON c.parent = n.node LEFT JOIN nodes AS p ON p.node = n.parent),
    above AS (SELECT DISTINCT w.node AS below, a.node FROM whole AS w JOIN named AS x ON x.node = w.node AND x.conv_id = w.conv_id JOIN named AS a ON a.conv_id = w.conv_id AND a.d <= w.d),
    sums AS (SELECT a.node, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens FROM above AS a JOIN whole AS w ON w.node = a.below GROUP BY a.node)
    SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM whole JOIN sums USING (node)
"""

BYTE_REPEATS = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, unnest(range(length(h) // 2 - 399)) AS i, h FROM d WHERE length(h) >= 800),
    c AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS code FROM w),
    many AS (SELECT code FROM c GROUP BY code HAVING count(*) > 1),
    hit AS (SELECT doc_id, i FROM c SEMI JOIN many USING (code)),
    step AS (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit),
    numbered AS (SELECT *, sum((p IS NULL OR i > p + 400)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM step),
    spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY ALL),
    gone AS (SELECT doc_id, count(*) AS n, sum(b - a)::BIGINT AS removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
        sha256(unhex(CASE WHEN n IS NULL THEN h ELSE list_reduce(list_prepend('', list_transform(range(n + 1),
            lambda k: substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE ends[k] END) + 1, 2 * ((CASE WHEN k = n THEN length(h) // 2 ELSE starts[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE ends[k] END))))),
            lambda x, y: x || y) END)) AS kept_sha256
    FROM d LEFT JOIN gone USING (doc_id)
"""
