"""The pipeline's language stage rejects by the model, and keeps all where nothing is labelled."""

import random

import corpus_pipeline

from .helpers import SF, frame


def texts(rng, words, n):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 60))) for _ in range(n)]


def test_rejects_by_model(spark):
    rng = random.Random(8)
    english = "the house and water that people should remember when walking through every green valley together".split()
    german = "das wasser und haus welches menschen niemals vergessen wenn sie durch jedes grüne tal zusammen gehen".split()
    rows = [(n, t, lang, "a") for n, (t, lang) in enumerate([(t, "en") for t in texts(rng, english, 1100)] + [(t, "de") for t in texts(rng, german, 1100)])]
    strange = [(5000, "Ωμέγα άλφα βήτα γάμμα", None, "a"), (5001, "123 --", None, "a")]
    strange += [(6000 + k, " ".join("".join(rng.choice("qxzjkvwpfyb") for _ in range(7)) for _ in range(40)), None, "a") for k in range(20)]
    docs = frame(spark, rows + strange)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert kept == set(range(2200))


def test_nothing_labelled(spark):
    rows = [(1, "One two three", None, "a"), (2, "12 --", None, "a"), (3, None, None, "a"), (4, "中文", None, "a")]
    out = corpus_pipeline.language(spark, frame(spark, rows), SF)
    assert {r.doc_id for r in out.collect()} == {1, 4}
