"""Site files are read in one plan: nothing is computed once for good records and again for broken ones."""

from pyspark.sql import functions as F

from assaylake.functions import exact
from assaylake.sources import site_files

HEAD = ",".join(site_files.REQUIRED["coc"])


def test_records_are_read_once(spark):
    lines = spark.createDataFrame([("a", 1, HEAD), ("a", 2, "C1,S1,2024-01-02,S,all,Y,")], "file string, row int, text string")
    typed = site_files.coc_rows(site_files.cells_of(lines, "coc"))
    plan = typed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Union" not in plan


def test_broken_records_and_files(spark):
    files = {
        "good": [HEAD, "C1,S1,2024-02-30,S,all,Y,", "C1,S1,2 Jan 2024 01:40 PM,W,all,,x", "too,few", "", "C1,S2,02/01/24,air,all,N,\"open"],
        "none": ["# only", "", "# comments"],
        "short": ["coc_number,sample_id", "1,2"],
        "twice": [HEAD + ",hold,hold", "1"],
        "bare": ["# a: b", HEAD],
    }
    lines = [(f, i, t) for f, texts in files.items() for i, t in enumerate(texts, 1)]
    typed = site_files.coc_rows(site_files.cells_of(spark.createDataFrame(lines, "file string, row int, text string"), "coc"))
    got = {(r["file"], r["row"]): (r["sample_id"], r["sampled"] and str(r["sampled"]["d"]), r["matrix"], sorted(r["problems"])) for r in typed.collect()}
    twice = "the sample is listed twice"
    assert got == {
        ("good", 2): ("S1", None, "soil", [twice, "the sampling date can't be read"]),
        ("good", 3): ("S1", "2024-01-02", "water", [twice]),
        ("good", 4): (None, None, None, ["it holds 2 of the 7 cells of the header"]),
        ("good", 6): (None, None, None, ["a quote is not closed"]),
        ("none", None): (None, None, None, ["it has no header row"]),
        ("short", 1): (None, None, None, ["columns are missing: sampled, matrix, analyses, hold, comments"]),
        ("twice", 1): (None, None, None, ["columns are repeated: hold"]),
        ("bare", 2): (None, None, None, ["no data rows follow its header"]),
    }


def test_lines_and_preambles_exchange_little(spark, tmp_path):
    texts = {"a.csv": "# Site: north\n\n#Note : x: y \nhead,er\n# not: this\n", "b.csv": "", "c.csv": "﻿# Site: south\r\n# End: 1", "d +%41.csv": "x\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    above = site_files.preamble(spark, str(tmp_path))
    got = sorted((r["file"].rsplit("/", 1)[1], r["row"], r["key"], r["value"]) for r in above.collect())
    assert got == [("a.csv", 1, "Site", "north"), ("a.csv", 3, "Note", "x: y"), ("c.csv", 1, "Site", "south"), ("c.csv", 2, "End", "1")]
    (tmp_path / "b.csv").unlink()
    rows = site_files.raw_lines(spark, str(tmp_path))
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    lines = sorted((r["file"].rsplit("/", 1)[1], r["row"], r["text"]) for r in rows.collect())
    assert lines == [("a.csv", 1, "# Site: north"), ("a.csv", 2, ""), ("a.csv", 3, "#Note : x: y "), ("a.csv", 4, "head,er"), ("a.csv", 5, "# not: this"), ("c.csv", 1, "# Site: south"), ("c.csv", 2, "# End: 1"), ("d +%41.csv", 1, "x")]


def test_unit_keys(spark):
    cases = {"µg / L": "ug/l", "ΜG/L": "ug/l", "μg/l": "ug/l", "MCG/L": "ug/l", "mg/KG": "mg/kg", "É": "é"}
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", exact.unit_key(F.col("u")).alias("k")).collect()
    assert {r["u"]: r["k"] for r in rows} == cases
