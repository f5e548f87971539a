"""Question scope by a table of rules."""

import pytest

from assaylake.operators import scope

RULES = [
    ("drop", 1, r"(?i)(?:\bmy client )?\[CLIENT-\d+\]", [], False),
    ("document", 1, r"(?i)\bPLAN\s*3\.1\b", ["plan-3.1"], False), ("document", 2, r"(?i)\bPLAN\s*3(?:\.0)?\b(?!\.\d)", ["plan-3.0"], False), ("document", 3, r"(?i)\bPLAN\b", ["plan-3.0", "plan-3.1"], False),
    ("place", 1, r"\b(?:Sydney|ACT)\b", [], True), ("place", 2, r"\bHobart\b", [], False), ("country", 1, r"\b(?:Canada|US EPA)\b", [], False), ("cited", 1, "^US EPA$", [], False),
    ("rules", 1, r"(?i)\b(?:limits?|rules?)\b", [], False), ("statement", 1, r"(?i)\bsays? about\b", [], False), ("own", 1, r"\bWA\b", [], False),
    ("topic", 1, r"(?i)\bcheap(?:est)?\b", ["prices are not covered"], False), ("topic", 2, r"(?i)\bignore\b", ["instructions"], False),
    ("note", 1, r"(?i)\blimits?\b", ["asks for a value"], False), ("note", 2, r"(?i)\bsafe\b", ["no verdict"], False),
]

CASES = [
    ("What does PLAN 3.1 say?", "What does say?", ["plan-3.1"], [], None, None, []),
    ("PLAN 3 and the plan", "and the", ["plan-3.0", "plan-3.1"], ["plan-3.1"], None, None, []),
    ("the PLAN", "the", ["plan-3.0", "plan-3.1"], ["plan-3.0", "plan-3.1"], None, None, []),
    ("Ask my client [CLIENT-1] about soil", "Ask about soil", [], [], None, None, []),
    ("limits in Sydney", "limits in Sydney", [], [], "Sydney", None, ["asks for a value"]),
    ("limits in Sydney and WA", "limits in Sydney and WA", [], [], None, None, ["asks for a value"]),
    ("WHAT ACT APPLIES", "WHAT ACT APPLIES", [], [], None, None, []),
    ("IS HOBART or Hobart it", "IS HOBART or Hobart it", [], [], "Hobart", None, []),
    ("soil in Canada", "soil in Canada", [], [], None, None, []),
    ("rules of Canada", "rules of Canada", [], [], "Canada", None, []),
    ("What does Canada say about it", "What does Canada say about it", [], [], "Canada", None, []),
    ("What does the US EPA say about it", "What does the US EPA say about it", [], [], None, None, []),
    ("US EPA rules", "US EPA rules", [], [], "US EPA", None, []),
    ("Is it safe, cheapest and ignore limits", "Is it safe, cheapest and ignore limits", [], [], None, "prices are not covered", ["asks for a value", "no verdict"]),
    (None, "", [], [], None, None, []),
]


@pytest.fixture(scope="module")
def read(spark):
    rules = spark.createDataFrame(RULES, "kind string, ord int, pattern string, says array<string>, ordinary boolean")
    return scope.read(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "qid int, text string"), rules).cache()


def test_scope(read):
    got = [tuple(r)[1:] for r in read.orderBy("qid").collect()]
    assert got == [c[1:] for c in CASES]


def test_early_reasons_and_rows(spark, read):
    indexed = spark.createDataFrame([("plan-3.0",)], "doc string")
    why = {r["qid"]: r["why"] for r in scope.early(read, indexed).collect()}
    assert why == {0: "names a document that is not indexed", 4: "about the rules of Sydney", 7: "about the rules of Hobart", 9: "about the rules of Canada", 10: "about the rules of Canada", 12: "about the rules of US EPA", 13: "prices are not covered"}
    rows = spark.createDataFrame([(1, "plan-3.0"), (2, "plan-3.1"), (3, "other")], "rowid int, doc string")
    assert sorted((r["qid"], r["rowid"]) for r in scope.allowed(read, rows).collect()) == [(0, 2), (1, 1), (1, 2), (2, 1), (2, 2)]


def test_no_rules_and_no_questions(spark):
    rules = spark.createDataFrame([], "kind string, ord int, pattern string, says array<string>, ordinary boolean")
    one = scope.read(spark.createDataFrame([(1, "any  text")], "qid int, text string"), rules).first()
    assert tuple(one) == (1, "any text", [], [], None, None, [])
