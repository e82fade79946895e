"""Classifiers: held-out accuracy on the driver's tables, awkward rows."""

import numpy as np
import pytest

from lodestone.llm import op2_quality, op4_language, op10_toxicity

D = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "  12 !! "), (4, "é" * 50_000), (None, "words of some kind"), (None, "words of some kind")]


def odd(spark):
    return spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, score string")


def test_language(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = op4_language.query(spark, D).join(docs, "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()
    model = op4_language.fit(spark, docs)
    rows = op4_language.identify(spark, odd(spark), model).collect()
    assert [r["lang_pred"] == "und" for r in rows] == [True, True, True, False, False, False]
    assert rows[4]["lang_score"] == rows[5]["lang_score"]
    assert all(0 <= r["lang_score"] <= 1 for r in rows)
    assert op4_language.identify(spark, odd(spark).limit(0), model).collect() == []


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = op4_language.fit(spark, docs)
    assert {r["lang_pred"] for r in op4_language.identify(spark, docs, model).collect()} == {"und"}


@pytest.mark.parametrize(("text", "some"), [("😀 😀!", False), ("𐐀", True), ("1 2", False), (None, False), ("é", True)])
def test_letters(text, some):
    assert bool(len(op4_language.trigrams(text))) is some


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9])
def test_codewords_differ(n):
    code = op4_language.codewords(n)
    assert len({tuple(r) for r in code}) == n


def test_quality(spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    got = op2_quality.query(spark, D).join(labels, "doc_id").where("held_out")
    assert got.where("quality = predicted").count() >= 0.95 * got.count()
    stats = op2_quality.document_statistics(spark, odd(spark))
    none = op2_quality.fit(stats, labels.limit(0), "quality")
    assert {r["score"] for r in op2_quality.score(spark, stats, none).collect()} == {0.5}
    model = op2_quality.fit(op2_quality.document_statistics(spark, spark.read.parquet(f"{D}/documents.parquet")), labels, "quality")
    scores = [r["score"] for r in op2_quality.score(spark, stats, model).collect()]
    assert len(scores) == len(ODD)
    assert all(0 <= s <= 1 for s in scores)


def test_isotonic_rises():
    rng = np.random.default_rng(1)
    s = rng.random(500)
    at, level = op2_quality.isotonic(s, (rng.random(500) < s).astype(float))
    assert (np.diff(at) > 0).all()
    assert (np.diff(level) > 0).all()


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{D}/labels.parquet")
    model = op10_toxicity.learn(spark, docs, labels, "toxic")
    got = op10_toxicity.score(spark, docs, model).join(labels, "doc_id")
    assert got.where("(toxicity >= 0.5) = (toxic = 1)").count() >= 0.95 * got.count()
    rows = op10_toxicity.score(spark, odd(spark), model).collect()
    assert all(r["toxicity"] < 0.5 for r in rows)
    base = op10_toxicity.learn(spark, docs, labels.limit(0), "toxic")
    assert base.terms == op10_toxicity.Model({f" {w} ": v for w, v in op10_toxicity.LEXICON.items()}).terms


@pytest.mark.parametrize(("text", "hits"), [("You 1d10t!", 1), ("ｉｄｉｏｔ", 1), ("іdіоt", 1), ("id​iot", 1), ("m0r0n and l0ser", 2), ("idiotic", 0), ("a trash can", 0), ("trash, can", 0), ("trash", 1), ("$tupid $$$ 100$", 1), ("", 0), (None, 0)])
def test_folding_and_exceptions(text, hits):
    m = op10_toxicity.Model({f" {w} ": v for w, v in op10_toxicity.LEXICON.items()})
    assert len(m.matches(op10_toxicity.folded(text))) == hits


def test_matches_like_a_plain_search():
    m = op10_toxicity.Model({" ab ": 1.0, " abc": 1.0, " abcd ": 1.0, " b ": 1.0}, exceptions=("x ab y",))
    assert [x[2] for x in sorted(m.matches(" ab abcd abcz x ab y b b "))] == [" ab ", " abcd ", " abc", " b ", " b "]
