import json
import sqlite3
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaylake.functions import prose, stems
from assaylake.operators import accuracy, drafting, pages, phrases, spelling
from assaylake.sources import rules
from assaylake.sources.site_files import BadInput


def test_page_labels(spark):
    texts = {1: "Cover", 2: "Intro\n3", 3: "PAGE 4", 4: "nothing", 5: "Report 6", 6: "a 99", 7: "page 8 of 40", 8: None}
    rows = spark.createDataFrame([("d", p, t) for p, t in texts.items()] + [("e", 1, "1"), ("e", 9, "9")], "doc string, page int, text string")
    got = {(r.doc, r.page): (r.label, r.basis.split()[0]) for r in pages.page_labels(rows).collect()}
    want = {1: (None, "not"), 2: ("3", "printed"), 3: ("4", "printed"), 4: ("5", "inferred"), 5: ("6", "printed"), 6: ("7", "inferred"), 7: ("8", "printed"), 8: (None, "not")}
    assert {p: got["d", p] for p in texts} == want
    assert got["e", 1] == got["e", 9] == (None, "not")


def test_gap_of_forty_pages_is_filled_and_not_more(spark):
    def book(gap):
        held = [1, 2, 3 + gap, 4 + gap]
        rows = spark.createDataFrame([(1, p, str(p) if p in held else "text") for p in range(1, 5 + gap)], "doc int, page int, text string")
        return pages.page_labels(rows).where("basis like 'inferred%'").count()

    assert (book(40), book(41)) == (40, 0)


def test_contents_page(spark):
    contents = "\n".join(f"Chapter title .... {i * 3}" for i in range(1, 10))
    table = "\n".join(f"{i} {9 - i}" for i in range(1, 10))
    falling = "\n".join(f"Chapter title {90 - i}" for i in range(1, 10))
    df = spark.createDataFrame([(1, contents), (2, table), (3, falling), (4, None), (5, "")], "doc_id int, text string")
    got = {r.doc_id: r.m.is_contents for r in df.select("doc_id", pages.contents_marks(df["text"]).alias("m")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_markdown_passages(spark):
    long = " ".join(f"w{i}" for i in range(400))
    half = " ".join(f"h{i}" for i in range(200))
    text = f"# Title\n> quoted line of many words here\nOpening words of the page *here*.\n\n## Health\n\n### PFOS\n\nSee [the list](http://x.y) of all values now.\n\n## Methods\n{long}\n\n## Sizes\n{half}\n\n{half}\n\n## References\nA very long list of references here"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no heading but five words")], "doc_id int, text string")
    got = [(r.doc_id, r.ordinal, r.section, len(r.text.split()), r.text[:20]) for r in pages.markdown_passages(docs).orderBy("doc_id", "ordinal").collect()]
    assert got == [
        (1, 0, "Title", 6, "Opening words of the"),
        (1, 1, "Health > PFOS", 7, "See the list of all "),
        (1, 2, "Methods", 220, "w0 w1 w2 w3 w4 w5 w6"),
        (1, 3, "Methods", 240, "w160 w161 w162 w163 "),
        (1, 4, "Sizes", 200, "h0 h1 h2 h3 h4 h5 h6"),
        (1, 5, "Sizes", 200, "h0 h1 h2 h3 h4 h5 h6"),
        (4, 0, None, 5, "no heading but five "),
    ]


def test_stems_equal_those_of_sqlite():
    words = "caresses ponies ties caress cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll a be yes".split()
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(w, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text search")
    db.executemany("insert into t(rowid, w) values (?, ?)", enumerate(words))
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    assert {words[d]: t for t, d in db.execute("select term, doc from v")} == {w: stems.porter(w) for w in words}


def test_phrase_scores_equal_those_of_sqlite(spark):
    texts = ["site assessments and site assessment", "the assessed site", "soil sampling of the site", "sampled soils", "site assessment here", "nothing at all", "other words", "more of them"]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(w, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text search")
    db.executemany("insert into t(rowid, w) values (?, ?)", enumerate(texts, 1))
    asked = ["site assessment", "soil samples", "words", "assessment of"]
    want = {(p, r): round(-s, 9) for p in asked for r, s in db.execute(f"select rowid, bm25(t) from t where t match '\"{p}\"'")}
    rows = spark.createDataFrame(list(enumerate(texts, 1)) + [(99, None)], "rowid int, text string").where("text is not null")
    got = phrases.phrase_scores(spark.createDataFrame([(p, p) for p in [*asked, "", None]], "phrase_id string, text string"), rows).collect()
    assert {(r.phrase_id, r.rowid): round(r.score, 9) for r in got} == want
    assert {(r.phrase_id, r.rowid): r.n for r in got}["site assessment", 1] == 2


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_swap_distance(a, b):
    def slow(x, y):
        if not x or not y:
            return len(x) + len(y)
        best = min(slow(x[1:], y) + 1, slow(x, y[1:]) + 1, slow(x[1:], y[1:]) + (x[0] != y[0]))
        return min(best, slow(x[2:], y[2:]) + 1) if len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] else best

    assert spelling.swap_distance(a, b) == slow(a, b)


def test_spelling_equals_brute_force(spark):
    known = {"tier": 9, "their": 2, "lead": 4, "land": 9, "criteria": 5, "sampling": 8, "samplings": 6, "guideline": 3, "rare": 1, "abcdefgh": 3, "abdcegh": 2}
    typed = ["teir", "laed", "critreia", "samplingg", "samplin", "guidlin", "rare", "tir", "xier", "badcefgh", "abcdfegh", "lande", None, "Tier", "teir"]
    got = spelling.proposals(spark.createDataFrame([(w,) for w in typed], "word string"), spark.createDataFrame(list(known.items()), "word string, uses long"))
    want = {}
    for w in {w for w in typed if w and w.islower() and len(w) >= 4 and w not in known}:
        k = 2 if len(w) >= 7 else 1
        near = sorted((d, sorted(v) != sorted(w), -n, v) for v, n in known.items() if n >= 2 and v[0] == w[0] and (d := spelling.swap_distance(w, v)) <= k)
        if near and not any(-n[2] * 1.5 > -near[0][2] for n in near[1:2] if n[:2] == near[0][:2]):
            want[w] = (near[0][3], near[0][0], -near[0][2])
    assert {r.word: (r.proposal, r.distance, r.uses) for r in got.collect()} == want and want["laed"][0] == "lead" and want["teir"][0] == "tier"
    fixed = spelling.corrected(spark.createDataFrame([(1, "Teir 1, laed?"), (2, "")], "qid int, text string"), got).collect()
    assert [(r.text, r.n_changed) for r in fixed if r.qid == 1] == [("Tier 1, lead?", 2)]


def test_retrieval_rates(spark):
    q = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False), (4, "b", False), (5, "b", True)], "qid int, grp string, in_scope boolean")
    t = spark.createDataFrame([(1, "d", 3, None), (1, "d", 4, None), (2, "d", None, "S")], "qid int, doc string, page int, section string")
    f = spark.createDataFrame([(1, 1, "d", 9, None), (1, 3, "d", 4, None), (2, 1, "d", 1, "S > T"), (3, 1, "d", 1, None), (5, 1, "d", 1, None)], "qid int, rank int, doc string, page int, section string")
    got = {r.grp or "all": tuple(r)[2:] for r in accuracy.retrieval_rates(q, t, f).collect()}
    assert got == {"all": (3, 1, 2, 2, 0.5, 2, 1), "a": (2, 1, 2, 2, 0.75, 0, 0), "b": (1, 0, 0, 0, 0.0, 2, 1)}


def test_passes_and_areas(spark, tmp_path):
    values = spark.createDataFrame([("k1", "5"), ("k2", "6"), ("k3", "7")], "key string, value string")
    p = [("A", "k1", "confirmed", "5"), ("B", "k1", "confirmed", "5"), ("A", "k2", "confirmed", "6"), ("B", "k2", "mismatch", "9"), ("A", "k3", "confirmed", "7"), ("B", "kx", "confirmed", "1")]
    passes = spark.createDataFrame(p, "pass string, key string, verdict string, reading string")
    compared = accuracy.compare_passes(values, passes)
    assert tuple(accuracy.pass_counts(compared).first()) == (3, 1, 2, 2)
    assert {r.key: [v.verdict for v in r.verdicts] for r in compared.collect()}["k3"] == ["confirmed", "not checked"]
    assert [tuple(r) for r in accuracy.unplaced(values, passes).collect()] == [("B", "kx", "not a value on file")]
    xml = '<testsuite><testcase classname="tests.test_a" name="x"/><testcase classname="tests.test_a" name="y"><failure message="m">t</failure></testcase><testcase classname="tests.test_a" name="z"><skipped type="pytest.skip" message="s"/></testcase><testcase classname="tests.test_b" name="w"><skipped type="pytest.xfail" message="s"/></testcase></testsuite>'
    (tmp_path / "report.xml").write_text(xml)
    areas = spark.createDataFrame([("test_a", "first")], "module string, area string")
    got = {tuple(r) for r in accuracy.test_areas(rules.read_test_report(spark, str(tmp_path / "report.xml")), areas).collect()}
    assert got == {("first", 1, 1, 1), ("other", 0, 1, 0)}


def test_rule_readers(spark, tmp_path):
    limit = {"key": "A+B", "applies_to": "sum", "members": ["A", "B"], "value": "70", "unit": "ng/L", "scenario": "drinking water", "note": ""}
    rule = {"id": "r", "name": "R", "document": "Doc", "table": "T4", "page": "p. 2", "page_basis": "printed", "wa_status": "in force", "limits": [limit, limit | {"key": "C", "applies_to": "single", "members": ["C"], "value": 0.56, "unit": "ug/L"}]}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": [rule]}))
    limits = rules.read_limits(spark, str(path))
    assert [(r.ordinal, r.key, r.value) for r in limits.orderBy("ordinal").collect()] == [(0, "A+B", D("0.07")), (1, "C", D("0.56"))]
    assert [(r.id, r.each_member_too, r.scenario, r.citation) for r in rules.water_criteria(limits).orderBy("id").collect()][0] == ("r:A+B", True, "drinking-water", "Doc, T4, p. 2")
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"rules": [rule | {"limits": [limit | {"applies_to": "most"}, limit | {"unit": "mg/kg"}]}]}))
    with pytest.raises(BadInput, match="single or sum.*concentration in water"):
        rules.read_limits(spark, str(bad))
    soil = tmp_path / "soil.json"
    soil.write_text(json.dumps({"scenario": "s", "scenario_short": "res", "criteria": [{"id": "c", "label": "C", "members": ["C"], "each_member_too": False, "value": "10", "unit": "ug/kg", "document": "D", "table": "T", "page": "1", "note": "n"}]}))
    assert rules.read_soil_criteria(spark, str(soil)).first().value == D("0.01")
    doc = {k: "x" for k in rules.REQUIRED_TEXT} | {"format": "pdf", "licence_lane": "A", "fetch_urls": ["u"], "available": True}
    listed = tmp_path / "corpus.json"
    listed.write_text(json.dumps({"documents": [doc, doc | {"id": "y", "format": "markdown"}]}))
    assert sorted(r.filename for r in rules.read_corpus(spark, str(listed)).collect()) == ["x.pdf", "y.md"]
    listed.write_text(json.dumps({"documents": [doc, doc, doc | {"id": "z", "licence_lane": "D"}]}))
    with pytest.raises(BadInput, match="x: the id is repeated.*z: the licence lane"):
        rules.read_corpus(spark, str(listed))
    listed.write_text("{}")
    with pytest.raises(BadInput, match="list of documents"):
        rules.read_corpus(spark, str(listed))


def test_redacted_fill_and_sources(spark):
    import datetime as dt

    lab = spark.createDataFrame([("W", dt.date(2025, 9, 16), "PFOS", D("0.038"), D("0.001"))], "well string, date date, analyte string, value decimal(18,9), lor decimal(18,9)")
    limits = spark.createDataFrame([("old", "PFOS", D("0.07"))], "rule string, key string, value decimal(18,9)")
    text = "Harbour Line: {PFOS|W|Sep 2025} by a.b@example.com, {limit|PFOS|old}, {PFOS|W|Sep 2025} harbour-line"
    templates = spark.createDataFrame([(1, "W", text)], "text_id int, well string, text string")
    got = drafting.fill_redacted(templates, lab, limits, prose.redactor({"client": ["Harbour Line"]})).first()
    assert got.text == "[CLIENT-1]: 0.038 ug/L by [EMAIL-1], 0.07 ug/L, 0.038 ug/L [CLIENT-1]" and got.counts == {"CLIENT": 2, "EMAIL": 1}
    numbered = drafting.numbered_sources(drafting.resolve(drafting.placeholders(templates), lab, limits)).orderBy("pos").collect()
    assert [(r.source, r.kind) for r in numbered] == [(1, "laboratory"), (2, "guideline"), (1, "laboratory")]


def test_rechecks_beside_notes(spark):
    """A variable number of re-checks: what they left out, earlier wordings, keys of no note, and two records."""
    notes = spark.createDataFrame([(1, "a"), (2, "b new"), (3, "c"), (4, "d")], "key int, note string")
    passes = spark.createDataFrame([("A", 1, "mismatch", "a"), ("B", 1, "confirmed", None), ("A", 2, "confirmed", "b"), ("A", 3, "confirmed", "c"), ("B", 4, None, None)], "pass string, key int, verdict string, checked_note string")
    rechecks = spark.createDataFrame(
        [("x", 1, "mismatch", "r", "a"), ("y", 2, "confirmed", "r", "b new"), ("x", 3, "confirmed", "r", "c old"), ("y", 4, "mismatch", "r", "d"), ("y", 9, "confirmed", "r", "z"), ("x", 2, "confirmed", "r", "b new"), ("x", 2, "confirmed", "r", "b new")],
        "recheck string, key int, verdict string, reason string, checked_note string",
    )
    doubted = accuracy.doubted_notes(notes, passes)
    assert sorted((r["key"], r["changed"]) for r in doubted.collect()) == [(1, False), (2, True)]
    got = {(r["key"], r["recheck"]): (r["verdict"], r["current"], r["confirmed_by_all"]) for r in accuracy.recheck_verdicts(doubted, rechecks).collect()}
    assert got == {(1, "x"): ("mismatch", True, False), (1, "y"): ("not checked", False, False), (2, "x"): ("confirmed", True, True), (2, "y"): ("confirmed", True, True)}
    none = spark.createDataFrame([], "key int")
    problems = sorted((r["key"], r["recheck"], r["problem"]) for r in accuracy.recheck_problems(notes, passes, rechecks, none).collect())
    assert problems == [
        (1, "x", "mismatch in a doubted note"), (2, "x", "two records"), (3, "x", "judged an earlier wording"), (4, "y", "mismatch without a resolution"), (9, "y", "no such note"),
    ]
    done = accuracy.recheck_problems(notes, passes, rechecks.where("key = 4"), none.union(spark.createDataFrame([(4,)], "key int")))
    assert [(r["key"], r["recheck"]) for r in done.collect()] == [(2, None)]
    assert accuracy.recheck_verdicts(doubted, rechecks.where("false")).count() == 0


def test_verdicts_on_the_note_alone(spark):
    rows = [("mismatch", True, "only the note is off", None), ("mismatch", None, "only the note is off", "unclear"), ("mismatch", True, "the value", None), ("confirmed", None, None, "confirmed")]
    frame = spark.createDataFrame(rows, "v string, ok boolean, reason string, note string")
    got = [tuple(r["s"]) for r in frame.select(accuracy.split_verdict(F.col("v"), F.col("ok"), F.col("reason"), F.col("note"), "only the note").alias("s")).collect()]
    assert got == [("confirmed", "mismatch"), ("mismatch", "unclear"), ("mismatch", None), ("confirmed", "confirmed")]
