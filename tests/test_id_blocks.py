"""Blocks of one lab id are matched without Python; the others one id after another."""

from pyspark.sql import functions as F

from assaylake.operators import reconcile


def test_single_pairs_need_no_python(spark, monkeypatch):
    rows = [("L 1", "water", 1), ("L 2", "water", 2), ("l-2", "water", 3), ("L 3", None, 4), ("L 4", "soil", 5), ("L 5", "soil", 6), ("L 6", "soil", 7)]
    coc = [("l1", "water", None, 1), ("l2", "water", None, 2), ("l3", None, None, 3), ("l4", "water", None, 4), ("l5", "soil", 7, 5), ("l_6", "soil", None, 6), ("l__6", "soil", None, 7)]
    stamp = lambda minute: F.struct(F.lit(None).cast("date").alias("d"), minute.cast("int").alias("minute")).alias("sampled")
    lab = spark.createDataFrame(rows, "sample_id string, matrix string, row int").select("sample_id", stamp(F.when(F.col("sample_id") == "L 5", 8)), "matrix", F.lit("f").alias("file"), "row")
    held = spark.createDataFrame(coc, "sample_id string, matrix string, minute int, row int").select("sample_id", stamp(F.col("minute")), "matrix", "row", F.lit(False).alias("hold"))
    kept = []
    apply = type(lab.groupBy("row")).applyInPandas
    monkeypatch.setattr(type(lab.groupBy("row")), "applyInPandas", lambda self, *a: kept.append(self._df.count()) or apply(self, *a))
    got = sorted(map(tuple, reconcile.suggestions(lab, held).collect()))
    assert got == [("L 1", "l1"), ("L 2", "l2"), ("L 3", "l3")]
    assert kept == [3]  # the ids of block l2, which has two lab ids
