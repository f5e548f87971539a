"""A site folder reviewed in one call."""

import pytest

from assaylake.operators import site_review as sr

HERE = __file__.rsplit("/", 1)[0] + "/data/site"


@pytest.fixture(scope="module")
def found(spark):
    findings, files = sr.review_folder(spark, HERE)
    return findings.orderBy("number").collect(), {r["kind"]: r for r in files.collect()}, findings


def test_findings_are_numbered_with_their_words(found):
    rows, files, _ = found
    assert [r["number"] for r in rows] == list(range(1, len(rows) + 1))
    assert [sr.CHECKS.index(r["check"]) for r in rows] == sorted(sr.CHECKS.index(r["check"]) for r in rows)
    by = {(r["check"], r["kind"], tuple(r["samples"])): r for r in rows}
    assert by["sample ids", "near", ("A2-15", "A2-1.5")]["title"] == "A2-15 may be A2-1.5"
    assert by["sample ids", "missing", ("A2-15",)]["found"] == "The lab file lists A2-15; the chain of custody does not."
    assert by["dates", "conflict", ("GW2",)]["found"].startswith("The files give ")
    assert "ng/l" in by["units", "other unit", ("GW1",)]["found"]
    assert by["holding times", "over", ("A1-0.5",)]["found"].startswith("Extracted after 30 days; due by ")
    pair = next(r for r in rows if r["kind"] == "pair")
    assert pair["title"].startswith("Lead differs") and pair["found"].endswith("% apart: investigate.")
    assert files["lab"]["n_rows"] == 8 and files["lab"]["header_row"] == 3


def test_findings_of_one_sample_are_related(found):
    rows, _, _ = found
    for r in rows:
        share = [o["number"] for o in rows if o["number"] != r["number"] and set(o["samples"]) & set(r["samples"])]
        assert list(r["related"]) == share


def test_summary_in_words(found):
    rows, _, findings = found
    one = sr.summary(findings).first()
    assert one["n_findings"] == len(rows) and one["sentence"].startswith(f"{len(rows)} findings (") and "sample ids: " in one["sentence"]
    assert sr.summary(findings.where("false")).first()["n_findings"] == 0


def test_limits_are_validated():
    sr.Limits(10, 20, 3)
    for bad in ((0, 50, 10), (50, 30, 10), (30, 201, 10), (30, 50, 0)):
        with pytest.raises(ValueError):
            sr.Limits(*bad)
