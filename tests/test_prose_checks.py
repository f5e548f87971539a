import datetime as dt
from decimal import Decimal as D

import pytest

from assaylake.functions import prose
from assaylake.operators import answers, claims, drafting, screening
from assaylake.streaming import limits as limiter

R = "well string, date date, analyte string, value decimal(18,9), lor decimal(18,9), file string, row int"
DAYS = [dt.date(2024, 3, 12), dt.date(2024, 11, 19), dt.date(2025, 9, 16)]


@pytest.fixture(scope="module")
def lab(spark):
    table = {"PFOS": ["0.062", "0.041", "0.038"], "PFHxS": ["0.021", "0.018", "0.019"], "PFOA": [None, None, None]}
    rows = [("MB2", day, name, D(v) if v else None, D("0.001"), "f.csv", 10 + i) for name, vs in table.items() for i, (day, v) in enumerate(zip(DAYS, vs, strict=True))]
    return spark.createDataFrame(rows, R).cache()


@pytest.fixture(scope="module")
def limits(spark):
    rows = [("old", 0, "PFOS+PFHxS", "sum", ["PFOS", "PFHxS"], D("0.07")), ("old", 1, "PFOA", "single", ["PFOA"], D("0.56")), ("new", 0, "PFOS", "single", ["PFOS"], D("0.008")), ("new", 1, "PFHxS", "single", ["PFHxS"], D("0.03"))]
    return spark.createDataFrame(rows, "rule string, ordinal int, key string, applies_to string, members array<string>, value decimal(18,9)").cache()


def test_rules_differ_and_are_both_shown(lab, limits):
    got = {(r.date, r.rule): r.overall for r in screening.compare_rules(screening.screen_rounds(lab, limits)).collect()}
    assert [got[d, "old"] for d in DAYS] == ["above", "not above", "not above"]
    assert [got[d, "new"] for d in DAYS] == ["above", "above", "above"]


def test_equal_is_not_above_and_bounds(spark, limits):
    rows = [("W", DAYS[0], "PFOS", D("0.008"), D("0.001"), "f", 1), ("W", DAYS[0], "PFHxS", D("0.062"), D("0.001"), "f", 2), ("W", DAYS[1], "PFOS", D("0.069"), D("0.001"), "f", 3), ("W", DAYS[1], "PFHxS", None, D("0.002"), "f", 4), ("W", DAYS[2], "PFOS", D("0.5"), D("0.1"), "f", 5)]
    s = {(r.date, r.rule, r.key, r.alone): (r.status, r.low, r.high) for r in screening.screen_rounds(spark.createDataFrame(rows, R), limits).collect()}
    assert s[DAYS[0], "old", "PFOS+PFHxS", None][0] == "not above" and s[DAYS[0], "new", "PFOS", None][0] == "not above"
    assert s[DAYS[1], "old", "PFOS+PFHxS", None] == ("not confirmed", D("0.069"), D("0.071"))
    assert s[DAYS[2], "old", "PFOS+PFHxS", None][0] == "not analysed" and s[DAYS[2], "old", "PFOS+PFHxS", "PFOS"][0] == "above"


def test_fill(spark, lab, limits):
    texts = [
        "{PFOS|MB2|Sep 2025} and {sum PFOS+PFHxS|MB2|2025-09-16}; LOR {lor|PFOA|MB2|Sep 2025}; {limit|PFOA|old}; {PFOA|MB2|Sep 2025}",
        "{change|PFOS|MB2|Nov 2024|Sep 2025}",
        "{PFOS|MB2|Jan 2020} stays {PFOS|MB2|Sep 2025}",
        "no placeholder",
        "{PFOS|MB3|Sep 2025}",
        "{limit|PFOS|old}",
        "{change|PFOS|MB2|Sep 2025|Nov 2024}",
        "{sum PFOS+PFOA|MB2|Sep 2025}",
        "stray } {PFOS|MB2|Sep 2025}",
        "{PFOS|MB2}",
    ]
    templates = spark.createDataFrame([(i, "MB2", t) for i, t in enumerate(texts)], "text_id int, well string, text string")
    got = {r.text_id: r for r in drafting.fill(templates, lab, limits).collect()}
    assert got[0].text == "0.038 ug/L and 0.057 ug/L; LOR 0.001 ug/L; 0.56 ug/L; <0.001 ug/L" and got[0].n_values == 5
    assert got[1].text == "a fall of 0.003 ug/L (7.3%)"
    assert not any(got[i].ok for i in range(2, 10)) and all(got[i].text is None and got[i].problems for i in range(2, 10))
    where = drafting.offsets(drafting.resolve(drafting.placeholders(templates.where("text_id = 0")), lab, limits), templates.where("text_id = 0")).collect()
    assert [got[0].text[r.start : r.end] for r in sorted(where, key=lambda r: r.pos)] == ["0.038 ug/L", "0.057 ug/L", "0.001 ug/L", "0.56 ug/L", "<0.001 ug/L"]


CLAIMS = [
    ("PFOS was 0.038 ug/L in September 2025.", {"result": "consistent"}),
    ("PFOS was 38 ng/L on 16 September 2025.", {"result": "consistent"}),
    ("PFOS was 0.062 ug/L in September 2025.", {"result": "inconsistent"}),
    ("PFOS was 0.5 ug/L in September 2025.", {"result": "untraced"}),
    ("The sum of PFOS and PFHxS was 0.057 ug/L in Sep 2025.", {"result": "consistent"}),
    ("PFOA was not detected in September 2025.", {"detection": "consistent"}),
    ("PFOA was detected in September 2025.", {"detection": "inconsistent"}),
    ("PFOS was above the guideline in September 2025.", {"guideline": "depends on rule"}),
    ("PFOS was above the new rule limit in September 2025.", {"guideline": "consistent"}),
    ("PFOS was above 0.03 ug/L in September 2025.", {"threshold": "consistent"}),
    ("PFOS was below 0.03 ug/L in September 2025.", {"threshold": "inconsistent"}),
    ("PFOS fell from November 2024 to September 2025.", {"change": "consistent"}),
    ("PFOS rose between November 2024 and September 2025.", {"change": "inconsistent"}),
    ("PFOS was lower in September 2025 than in November 2024.", {"change": "consistent"}),
    ("The groundwater is contaminated.", {"judgement": "not checked"}),
]


def test_claims(spark, lab, limits):
    paragraphs = spark.createDataFrame([(i, "MB2", t) for i, (t, _) in enumerate(CLAIMS)], "paragraph_id int, well string, text string")
    screened = screening.screen_rounds(lab, limits)
    checked = claims.check(paragraphs, lab, screened, ["PFOS", "PFHxS", "PFOA"], {"old": "old rule", "new": "new rule"})
    got = {}
    for r in checked.collect():
        got.setdefault(r.paragraph_id, {})[r.kind] = r.status
    assert got == {i: want for i, (_, want) in enumerate(CLAIMS)}
    counts = claims.report(checked).agg({"n_consistent": "sum", "n_attention": "sum"}).first()
    assert sum(counts) == len(CLAIMS)


def test_answers(spark):
    body = "The value for PFOS in drinking water is 0.008 ug/L and applies from the day the guideline was published by the council."
    texts = [
        (1, "The limit is 0.008 ug/L [1]."),
        (2, "The limit is 0.009 ug/L [1]."),
        (3, "The limit is low."),
        (4, "See this [7]. And this [1-3]."),
        (5, "Easy words [1].\nThe value for PFOS in drinking water is 0.008 ug/L and applies from the day the guideline was published [1]."),
        (6, "The value for PFOS in drinking water is 0.008 ug/L and applies from the day the guideline was published [1]."),
        (7, "It is 8 ng/L [G1] — as shown [1]."),
        (8, ""),
    ]
    a = spark.createDataFrame(texts, "answer_id int, text string")
    p = spark.createDataFrame([(i, 1, body, True) for i, _ in texts], "answer_id int, number int, body string, reusable boolean")
    v = spark.createDataFrame([(7, "G1", "new", D("0.008"))], "answer_id int, marker string, rule string, value decimal(18,9)")
    failed = {}
    for r in answers.verify(a, p, v).where("not passed").collect():
        failed.setdefault(r.answer_id, set()).add(r.name)
    assert failed == {2: {"numbers traced"}, 3: {"every sentence cited"}, 4: {"citations exist", "every sentence cited"}, 6: {"no long quotes"}, 7: {"no dashes"}, 8: {"has sentences"}}


def test_redaction_round_trip(spark):
    text = "Mail a.b@example.com or A.B@example.com, call 0412 345 678 or +61 412 345 678. Lot 12 on DP 3456 of Harbour-Line; harbour line again."
    redact = prose.redactor({"client": ["Harbour Line"]})
    df = spark.createDataFrame([(text,), (None,)], "text string").select("text", redact("text").alias("r"))
    row, empty = df.select("r", prose.restore(df["r"]).alias("back")).collect()
    assert row.r.text == "Mail [EMAIL-1] or [EMAIL-1], call [PHONE-1] or [PHONE-1]. [LOT-1] of [CLIENT-1]; [CLIENT-1] again."
    assert row.r.counts == {"EMAIL": 2, "PHONE": 2, "LOT": 1, "CLIENT": 2} and empty.r.text is None
    assert row.back.startswith("Mail a.b@example.com or a.b@example.com")


def test_number_kinds():
    got = {(m["kind"], m["number"], m["exponent"]) for m in prose.number_mentions("5 ug/L, 1,000 ng per litre, 3 mg/kg, 7 ppb, 12%, 4 mg, version 3.1.2, plain 9 [4] [SITE-1]")}
    assert got == {("water", "5", 0), ("water", "1000", -3), ("soil", "3", 0), ("water", "7", 0), ("percent", "12", 0), ("unknown", "4", 0), ("label", "3.1.2", 0), ("plain", "9", 0)}


def test_refused_requests_do_not_count(spark):
    base = dt.datetime(2025, 1, 1)
    windows = ((2, 10, "short"), (3, 100, "long"))
    rows = [("k", base + dt.timedelta(seconds=s)) for s in (0, 1, 2, 10, 11, 12, 99, 101, 111)]
    got = [(r.allowed, r.window, r.retry_after) for r in limiter.limit_batch(spark.createDataFrame(rows, "key string, ts timestamp"), windows).orderBy("ts").collect()]
    assert got == [(True, None, None), (True, None, None), (False, "short", 9), (True, None, None), (False, "long", 90), (False, "long", 89), (False, "long", 2), (True, None, None), (True, None, None)]


def test_stream_agrees_with_batch(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    rows = [(f"k{i % 3}", base + dt.timedelta(seconds=i * 2)) for i in range(60)]
    requests = spark.createDataFrame(rows, "key string, ts timestamp")
    requests.coalesce(1).write.parquet(str(tmp_path / "in"))
    windows = ((3, 15, "short"),)
    stream = spark.readStream.schema(requests.schema).parquet(str(tmp_path / "in"))
    query = limiter.limit_stream(stream, windows).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limited").collect()), key=str) == sorted(map(tuple, limiter.limit_batch(requests, windows).collect()), key=str)
