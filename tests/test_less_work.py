"""Candidates of spelling meet by hashes of shortened words and carry nothing else."""

from pyspark.sql import functions as F

from assaylake.operators import spelling


def test_words_meet_by_hashes(spark):
    words = spark.createDataFrame([("guidlines",)], "word string")
    known = spark.createDataFrame([("guidelines", 5), ("guidelined", 2), ("giudelines", 9)], "word string, uses long")
    found = spelling.proposals(words, known)
    assert "hashpartitioning(form" not in found._jdf.queryExecution().executedPlan().toString()  # pairs are written once
    assert [tuple(r) for r in found.collect()] == [("guidlines", "guidelines", 1, 5)]
    assert spelling.swap_distance("abxcd", "abyxcd") == 1 and spelling.swap_distance("", "ab") == 2 and spelling.swap_distance("banana", "banaan") == 1
    form = spark.createDataFrame([("tier", 1)], "word string, k int").select(F.size(spelling.shortened(F.substring("word", 2, 9), F.col("k")))).first()[0]
    assert form == 4
