import numpy as np
from pyspark.sql import functions as F

from assaylake.llm import language_id
from assaylake.llm.common import is_held_out


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = language_id.codewords(n)
        apart = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert code.shape[0] == n and apart >= (1 if n == 2 else 2)
    assert language_id.codewords(1).shape == (1, 1)


def test_decoding_corrects_a_wrong_bit():
    code = language_id.codewords(4)
    model = language_id.Model(list("abcd"), code, np.eye(code.shape[1]), np.zeros(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    for i, word in enumerate(code):
        for bit in range(len(word)):
            margins = 3 * word.copy()
            margins[bit] *= -0.5
            best, _, _ = model.decode(margins[None])
            assert best[0] == i


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, ~is_held_out(F.col("doc_id")), rows_per_language=120)
    found = language_id.predict(docs.select("doc_id", "text", F.col("lang").alias("truth"), is_held_out(F.col("doc_id")).alias("h")), model).where("h").collect()
    assert len(found) > 200
    assert np.mean([r.truth == r.lang_pred for r in found]) > 0.95


def test_a_copied_text_costs_no_language(spark):
    """400,000 copies of one French text beside the table: every language is still learned, and known."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("lang = 'fr' and length(text) > 200").orderBy("doc_id").first()
    copies = spark.range(10**6, 10**6 + 400_000).select(F.col("id").alias("doc_id"), F.lit(one["text"]).alias("text"), F.lit("fr").alias("lang"))
    model = language_id.train(docs.unionByName(copies), ~is_held_out(F.col("doc_id")))
    assert model.languages == sorted(r[0] for r in docs.where("lang is not null").select("lang").distinct().collect())
    found = language_id.predict(docs.where(is_held_out(F.col("doc_id"))).select("text", "lang"), model)
    for r in found.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).where("lang is not null").collect():
        assert r["right"] > 0.95, r


def test_dirty_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [(lang, f"{word} {k}") for lang, word in (("a", "alpha"), ("b", "beta")) for k in range(5)] + [(f"x{k}", "rare") for k in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))
    assert model.languages == ["a", "b"]


def test_odd_rows(odd_docs, no_docs):
    model = language_id.train(odd_docs, F.lit(True))
    rows = language_id.predict(odd_docs, model).collect()
    assert len(rows) == 12 and rows[0].asDict().keys() >= {"label", "lang_pred", "score", "ambiguous"}
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in {"en", "de", "fr", "la"} and 0 <= r.score <= 1
    assert language_id.train(no_docs, F.lit(True)) is None
    assert {r.lang_pred for r in language_id.predict(odd_docs, None).collect()} == {"und"}


def test_marks_alone_are_no_letter(spark):
    docs = spark.createDataFrame([(1, "\u0301\u0308 \u0301", None), (2, "ein Satz", "de"), (3, "a sentence", "en")], "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert language_id.predict(docs, model).where("doc_id = 1").first().lang_pred == "und"


def test_copies_do_not_crowd_the_sample(spark):
    """One text holds nearly all rows; the model still knows the others."""
    words = {"en": "the of and to in is that", "de": "der die und zu den ist das"}
    rows = [(lang, " ".join([w.split()[i % 7], w.split()[i % 5], w, str(i)])) for lang, w in words.items() for i in range(40)]
    rows += [("en", "one text that comes again")] * 5000
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.train(docs, F.lit(True), rows_per_language=6000)
    got = language_id.predict(spark.createDataFrame([("der die das",), ("the of that",)], "text string"), model)
    assert [r.lang_pred for r in got.collect()] == ["de", "en"]
