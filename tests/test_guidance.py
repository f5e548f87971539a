"""Concepts against a plain longest match, ranking over fields against SQLite's full-text search, answers and excerpts."""

import itertools
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from assaylake.functions.stems import porter
from assaylake.operators import concepts as cs
from assaylake.operators import fields as fs
from assaylake.session import Tables

GROUPS = {
    1: ("drinking water", ["drinking water", "potable water", "potable"], []),
    2: ("limit of reporting", ["limit of reporting", "lor", "detection limit"], []),
    3: ("sample container", ["sample container", "bottle"], ["container", "samples stored"]),
    4: ("water", ["water"], []),
    5: ("soil", ["soil", "dirt"], ["limit of soil"]),
}
STOP = ["what", "is", "the", "of", "in", "a", "be", "how", "for", "to", "about", "must", "should", "my"]


def wordings(spark):
    rows = [(g, label, w, s) for g, (label, searched, led) in GROUPS.items() for s, ws in ((True, searched), (False, led)) for w in ws]
    return spark.createDataFrame(rows, "group_id long, label string, wording string, searched boolean")


def plural(word):
    return word[:-1] if len(word) > 3 and word.endswith("s") and not re.search("(ss|us|is)$", word) else word


def plain(text, ignored=cs.FRAMING + cs.PLACES):
    """(label, expanded) in order, and pairs, by scanning for one wording after another."""
    words = re.findall("[a-z0-9]+", (text or "").lower())
    folded, used, inside = [plural(w) for w in words], set(), set()

    def scan(places, known, found):
        for size, group, run in sorted(known, key=lambda x: (-x[0], x[1], x[2])):
            for at in range(len(places) - size + 1):
                span = places[at : at + size]
                if not used.intersection(span) and [folded[p] for p in span] == run:
                    used.update(span)
                    inside.update(span if size > 1 or known is framing else ())
                    found.append((span[0], group))

    def folds(w):
        return [plural(x) for x in w.split()]

    framing = [(len(folds(w)), 0, folds(w)) for w in set(ignored)]
    known = [(len(folds(w)), g, folds(w)) for g, (_, a, b) in GROUPS.items() for w in a + b]
    scan(list(range(len(words))), framing, [])
    found: list = []
    scan([p for p in range(len(words)) if p not in used], known, found)
    edge = set(inside)
    scan([p for p in range(len(words)) if p not in used and words[p] not in STOP], known, found)
    first = {}
    for at, group in found:
        first.setdefault(group, at)
    out = [(at, GROUPS[g][0], True) for g, at in first.items()]
    seen = set()
    for p, w in enumerate(words):
        if p not in used and w not in STOP and len(w) > 1 and w not in seen:
            seen.add(w)
            out.append((p, w, False))
    pairs = []
    for p in range(len(words) - 1):
        a, b = words[p], words[p + 1]
        if not {p, p + 1} & edge and not {a, b} & set(STOP) and min(len(a), len(b)) > 1 and f"{a} {b}" not in pairs:
            pairs.append(f"{a} {b}")
    return [(label, wide) for _, label, wide in sorted(out)], pairs


def test_longest_wordings_equal_a_plain_scan(spark):
    rng = random.Random(3)
    pool = [w for _, a, b in GROUPS.values() for x in a + b for w in x.split()] + STOP + ["levels", "glass", "PFAS", "bus", "storage", "x", "tell me about", "perth", "waters", "LORs"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    texts += ["Can you tell me the limit, in Perth, of reporting?", "", None, "water water", "How should samples be stored?", "potable waters of the LOR"]
    asked = cs.read(spark.createDataFrame(list(enumerate(texts)), "qid long, text string"), wordings(spark), STOP).cache()
    got = {}
    for r in cs.concepts(asked, wordings(spark), STOP).orderBy("qid", "n").collect():
        got.setdefault(r["qid"], []).append((r["label"], r["expanded"]))
    pairs = {r["qid"]: r["pairs"] for r in asked.select("qid", "pairs").collect()}
    for qid, text in enumerate(texts):
        assert (got.get(qid, []), pairs[qid]) == plain(text), text


def test_no_wordings_and_no_questions(spark):
    none = wordings(spark).where("false")
    asked = cs.read(spark.createDataFrame([(1, "water limits")], "qid long, text string"), none, [])
    assert [r["label"] for r in cs.concepts(asked, none).orderBy("n").collect()] == ["water", "limits"]
    empty = cs.read(spark.createDataFrame([], "qid long, text string"), wordings(spark), STOP)
    assert cs.concepts(empty, wordings(spark), STOP).count() == 0


def test_words_written_as_names(spark):
    cases = [
        ("raaf", "What did RAAF Base do?", True), ("pearce", "the base at Pearce today", True), ("what", "What is it?", False),
        ("soil", "Is it safe? Soil is brown.", False), ("soil", "(Soil) and more", False), ("pearce", "near, Pearce", True),
        ("pearce", "WHAT ABOUT PEARCE", False), ("base", "Baseline at Basel", False), ("x1", "see X1 here", True), ("1x", "see 1X here", False), ("soil", None, False),
    ]
    rows = spark.createDataFrame([(i, w, t) for i, (w, t, _) in enumerate(cases)], "i int, w string, t string")
    got = [r["n"] for r in rows.select("i", cs.written_as_name(F.col("w"), F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


WORDS = ["water", "waters", "sample", "samples", "sampling", "soil", "limit", "limits", "report", "reporting", "plan", "site", "of", "the", "générale", "bottle"]


@pytest.fixture(scope="module")
def sections():
    rng = random.Random(9)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, n)))
    return [(k, some(5), some(4), some(60)) for k in range(1, 161)]


@pytest.fixture(scope="module")
def rows(spark, sections):
    return spark.createDataFrame(sections, "rowid long, headings string, captions string, text string").cache()


def test_scores_equal_full_text_search(spark, sections, rows):
    """BM25 of phrases over three weighted fields, by SQLite, whose tokenizer stems and drops marks."""
    phrases = ["water", "soil samples", "limit of reporting", "sampling", "generale", "site plan", "site site", "absent", "plan of the site"]
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table t using fts5(headings, captions, text, tokenize=\"porter unicode61 remove_diacritics 2\")")
    base.executemany("insert into t(rowid, headings, captions, text) values (?, ?, ?, ?)", sections)
    tables = Tables(spark)
    index = fs.Index(rows, spark.createDataFrame([(p,) for p in phrases], "phrase string"), tables)
    got = {(r["phrase"], r["rowid"]): (r["score"], r["in_heading"]) for r in index.scored().collect()}
    want = {}
    for p in phrases:
        headed = {r[0] for r in base.execute("select rowid from t where t match ?", (f'{{headings captions}} : "{p}"',))}
        for rowid, score in base.execute("select rowid, bm25(t, 2.0, 2.0, 1.0) from t where t match ?", (f'"{p}"',)):
            want[p, rowid] = (-score, rowid in headed)
    tables.clear()
    assert got.keys() == want.keys() and len(got) > 200
    for key, (score, headed) in want.items():
        assert got[key][0] == pytest.approx(score, rel=1e-9) and got[key][1] == headed


def test_best_rows_equal_full_text_search(spark, sections, rows):
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table t using fts5(headings, captions, text, tokenize=\"porter unicode61 remove_diacritics 2\")")
    base.executemany("insert into t(rowid, headings, captions, text) values (?, ?, ?, ?)", sections)
    asked = {1: ["soil samples", "limit of reporting"], 2: ["bottle", "water", "site plan"]}
    tables = Tables(spark)
    pairs = spark.createDataFrame([(q, p) for q, ps in asked.items() for p in ps], "qid long, phrase string")
    index = fs.Index(rows, pairs.select("phrase"), tables)
    got = fs.best(pairs, index.scored(), 20).orderBy("qid", "place").collect()
    for q, ps in asked.items():
        match = " OR ".join(f'"{p}"' for p in ps)
        want = base.execute("select -bm25(t, 2.0, 2.0, 1.0) as s, rowid from t where t match ? order by round(s, 9) desc, rowid limit 20", (match,)).fetchall()
        mine = [(r["score"], r["rowid"]) for r in got if r["qid"] == q]
        assert [r for _, r in mine] == [r for _, r in want] and [s for s, _ in mine] == pytest.approx([s for s, _ in want])
    tables.clear()


def answered(spark, rows, texts, allowed=None, k=5):
    tables = Tables(spark)
    questions = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    asked = cs.read(questions, wordings(spark), STOP).cache()
    found = cs.concepts(asked, wordings(spark), STOP).cache()
    pairs = asked.select("qid", F.explode("pairs").alias("phrase"))
    index = fs.Index(rows, found.select(F.explode("phrases").alias("phrase")).union(pairs.select("phrase")), tables)
    pages = rows.select("rowid", (F.col("rowid") % 7).alias("page"))
    status, passages = fs.search(index, questions, found, pairs, pages, k, allowed)
    out = [r.asDict() for r in status.orderBy("qid").collect()], [r.asDict() for r in passages.orderBy("qid", "rank").collect()]
    tables.clear()
    return out


def test_answers_and_early_exits(spark, rows):
    texts = ["soil samples in the site plan", "what is the", "unheard things", "soil jacket trousers hat", "the site of RAAF Base", None, "soil jacket sampling report"]
    status, passages = answered(spark, rows, texts)
    assert [s["why"] for s in status][:4] == [None, "no searchable words", "no term is known", "most terms are unknown"]
    assert status[5]["why"] == "no searchable words" and status[0]["status"] == "passages found"
    assert status[4]["n_names"] == 2 and status[4]["status"] != "near"
    assert status[6]["n_terms"] == 4 and status[6]["n_known"] == 3
    mine = [p for p in passages if p["qid"] == 0]
    assert len({p["rowid"] % 7 for p in mine}) == len(mine) <= 5 and all(p["strong"] and p["coverage"] >= 0.45 for p in mine)
    assert [p["relevance"] for p in mine] == sorted((p["relevance"] for p in mine), reverse=True)


def test_named_documents_limit_the_rows(spark, rows):
    allowed = rows.where("rowid <= 20").select(F.lit(0).cast("long").alias("qid"), "rowid")
    _, passages = answered(spark, rows, ["soil samples in the site plan", "soil samples in the site plan"], allowed)
    assert {p["qid"] for p in passages} == {0, 1} and all(p["rowid"] <= 20 for p in passages if p["qid"] == 0)
    assert any(p["rowid"] > 20 for p in passages if p["qid"] == 1)


def test_best_fragments_equal_brute_force(spark, sections, rows):
    phrases, size = ["soil samples", "limit", "water", "site plan", "bottle"], 12
    tables = Tables(spark)
    index = fs.Index(rows, spark.createDataFrame([(p,) for p in phrases], "phrase string"), tables)
    wanted = rows.select(F.lit(1).alias("qid"), "rowid").crossJoin(spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    got = {r["rowid"]: (r["start"], r["n_phrases"], r["excerpt"]) for r in fs.best_fragments(index.uses(), wanted, rows, size).collect()}
    tables.clear()
    stems = {p: [porter(w) for w in p.split()] for p in phrases}
    n = 0
    for rowid, _, _, text in sections:
        words = text.split()
        own = [porter(w.replace("é", "e")) for w in words]
        best = None
        for at in range(len(words)):
            held = sum(any(own[i : i + len(s)] == s for i in range(at, min(at + size, len(words)) - len(s) + 1)) for s in stems.values())
            starts = any(own[at : at + len(s)] == s for s in stems.values())
            if held and starts and (best is None or held > best[1]):
                best = (at, held)
        if best is None:
            assert rowid not in got
            continue
        n += 1
        cut = ("... " if best[0] else "") + " ".join(words[best[0] : best[0] + size]) + (" ..." if best[0] + size < len(words) else "")
        assert got[rowid] == (*best, cut)
    assert n > 100


def test_citations(spark):
    rows = [
        (1, "pdf", "u", 3, "7", "printed on the page", "2 Soil", "A"), (2, "pdf", "u", 4, "8", "inferred from neighbouring pages", None, "B"),
        (3, "pdf", "u", 5, None, None, "3 Water", "A"), (4, "web", "w", None, None, None, "Rules", "C"), (5, "web", "w", None, None, None, None, "A"),
    ]
    frame = spark.createDataFrame(rows, "rowid long, format string, url string, page int, label string, label_basis string, section string, lane string")
    got = {r["rowid"]: r for r in fs.citations(frame.select("rowid"), frame).collect()}
    assert got[1]["location"] == "p. 7 (PDF p. 3), 2 Soil" and got[1]["link"] == "u#page=3"
    assert got[2]["location"] == "p. 8 (PDF p. 4) (printed page inferred)" and "short excerpt" in got[2]["note"]
    assert got[3]["location"] == "PDF p. 5 (printed page number not derived), 3 Water" and got[3]["basis"] == "not derived"
    assert got[4]["location"] == "section 'Rules' (web page, no page numbers)" and got[5]["location"] == "web page" and got[5]["link"] == "w"


def test_words_and_pieces_go_together(spark):
    texts = ["Générale µg/L, 5K x", " - lead", "", "a1b2 c", "Ünder-Öl"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(fs.words(F.col("t")).alias("w"), fs.pieces(F.col("t")).alias("p"))
    for r in frame.collect():
        assert len(r["w"]) == len(r["p"])
    assert list(itertools.chain(*(r["w"] for r in frame.collect())))[:5] == ["generale", "ug", "l", "5k", "x"]


def test_passages_find_their_chunk(spark):
    """The only chunk of a page, else of its section, else the one that holds the longest part of the excerpt."""
    chunks = [
        (1, "a", 1, "s", "alone on its page"), (2, "a", 2, "s", "first of two"), (3, "a", 2, "t", "second of two"), (4, "a", 3, "s", "long shared words and one apple"), (5, "a", 3, "s", "long shared words and 3 – 4 pears"),
        (6, "a", 3, None, "no section — here"), (7, "b", None, "s", "a web page"), (8, "c", 4, "s", "twin text"), (9, "c", 4, "s", "twin text"),
    ]
    asked = [
        (1, "a", 1, "other", "..."), (2, "a", 2, "t", ""), (3, "a", 3, "s", "... and 3 – 4 pears ..."), (4, "a", 3, "s", "long shared words"), (5, "a", 3, "u", "one apple ...\nand"),
        (6, "a", 3, None, "x"), (7, "b", None, "q", None), (8, "c", 4, "s", "twin text"), (9, "z", 1, "s", "nothing"), (10, "a", 2, "u", ""),
    ]
    held = spark.createDataFrame(chunks, "chunk_id int, doc string, page int, section string, text string")
    passages = spark.createDataFrame(asked, "pid int, doc string, page int, section string, excerpt string")
    got = {r["pid"]: r["chunk_id"] for r in fs.located(passages, held).collect()}
    assert got == {1: 1, 2: 3, 3: 5, 4: None, 5: 4, 6: 6, 7: 7, 8: None, 9: None, 10: None}
    shown = passages.selectExpr("*", "pid as number", "'Plan' as title", "'v1' as edition", "'p. 2–3' as location", "if(pid = 3, 'A > B > C', 'A') as path", "if(pid = 3, 'A', 'B') as lane", "'CC BY 4.0' as licence")
    rows = {r["pid"]: r for r in fs.context(shown, held, 4).collect()}
    assert rows[3]["header"] == "[3] Plan, v1. p. 2 to 3. Part of: A > B." and rows[3]["body"] == "long shared words and ..." and rows[3]["reusable"]
    assert rows[8]["body"] == "twin text" and rows[1]["header"] == "[1] Plan, v1. p. 2 to 3." and not rows[1]["reusable"] and rows[6]["body"] == "no section, here"
