"""Small fixtures for the training-data operators."""

import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, run int, id int, tokens string, shard int, targets string, rest int, whole int, end0 int, _times int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows):
    """documents with columns that clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1, 2, "y", 3, "z", 4, 5, 6, 7) for i, t, lang, source in rows], SCHEMA)


BASE = " ".join(f"w{k}" for k in range(120))
EDGE = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, "One two THREE", "en", "a"),
    (5, "one TWO three", "de", None),
    (5, "one TWO three", "de", None),
    (6, BASE, "en", "b"),
    (7, BASE.replace("w60", "other"), "en", "b"),
    (8, BASE + " tail", "fr", "b"),
    (9, "é ▁   中文 \U0001f600 <s> </s> <|endoftext|>", None, "c"),
    (10, "long " * 50_000, "en", "c"),
    (11, "12345 ---", "en", ""),
    (None, "One two three four five six", "en", "a"),
]
