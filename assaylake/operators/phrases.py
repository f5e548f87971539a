"""Phrases of stemmed words: where they stand, and their BM25 weight as terms of their own.

``rows``: rowid, text. ``phrases``: phrase_id, text. Repeated words of a
phrase keep their places; a phrase without a word is nowhere. Words are stemmed
and matched where they stand, in one pass over the rows; every task holds the
phrases, and neither a word nor a run of words is exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.stems import porter
from assaylake.operators import matching
from assaylake.operators.retrieval import B, K1, bm25_idf, tokens
from assaylake.session import cut


def _held(phrases: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, matching.Forms]:
    """Rows with the forms that they hold, and (phrase_id, form)."""
    asked = phrases.select("phrase_id", tokens(F.col("text")).alias("words")).where("size(words) > 0").collect()
    runs = [tuple(map(porter, r["words"])) for r in asked]
    forms = matching.Forms(runs)
    kind = phrases.select("phrase_id", F.lit(0).alias("form")).schema
    known = phrases.sparkSession.createDataFrame([(r["phrase_id"], forms.form[run]) for r, run in zip(asked, runs, strict=True)], kind)
    return matching.held_forms(rows, forms, {"text": 1.0}, stem=porter), known, forms


def _hits(held: DataFrame, known: DataFrame) -> DataFrame:
    entries = held.select("rowid", "length", F.explode(F.arrays_zip("forms", "uses")).alias("x"))
    return entries.select("rowid", "length", F.col("x.forms").alias("form"), F.col("x.uses").cast("long").alias("n")).join(known, "form")


def phrase_hits(phrases: DataFrame, rows: DataFrame) -> DataFrame:
    """(phrase_id, rowid, n): how often the stems of a phrase follow each other in a row."""
    held, known, _ = _held(phrases, rows)
    return _hits(held, known).select("phrase_id", "rowid", "n")


def phrase_scores(phrases: DataFrame, rows: DataFrame) -> DataFrame:
    """(phrase_id, rowid, n, score): BM25 with the phrase as one term over rows of their own length in words."""
    held, known, forms = _held(phrases, rows)
    held = cut(held, "held-phrases")
    df, _, total, mean = matching.counted(held, len(forms.form))
    frequency = phrases.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(df)], "form int, df long")
    joined = _hits(held, known.join(frequency, "form"))
    part = bm25_idf(F.lit(total), F.col("df")) * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    return joined.select("phrase_id", "rowid", "n", part.alias("score"))
