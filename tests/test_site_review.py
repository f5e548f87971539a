import csv
import datetime as dt
import io
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from assaylake.functions import exact
from assaylake.operators import reconcile, screening
from assaylake.sources import site_files as sf

HERE = __file__.rsplit("/", 1)[0] + "/data/site"


@pytest.fixture(scope="module")
def site(spark):
    files = {"lab": "lab_results", "coc": "chain_of_custody", "field": "field_sheet"}
    typed = {"lab": sf.lab_rows, "coc": sf.coc_rows, "field": sf.field_rows}
    return {k: sf.checked(typed[k](sf.raw_cells(spark, f"{HERE}/{name}.csv", k))).cache() for k, name in files.items()}


def test_rows_keep_physical_lines(spark, site):
    rows = [r.row for r in site["lab"].orderBy("row").collect()]
    assert rows == [4, 6, 7, 8, 9, 10, 11, 12]
    assert [r.row for r in site["field"].orderBy("row").collect()] == list(range(4, 11))
    lines = {r.row: r.text for r in sf.raw_lines(spark, f"{HERE}/lab_results.csv").collect()}
    assert lines[9].startswith("R-1,4,GW1") and lines[1].startswith("#")


def test_typed_values(site):
    by = {(r.sample_id, r.analyte): r for r in site["lab"].collect()}
    assert by["GW1", "PFOS"].value == Decimal("0.038") and by["GW1", "PFOS"].unit_key == "ng/l"
    assert by["GW2", "PFOS"].value is None and by["GW2", "PFOS"].lor == Decimal("0.01") and by["GW2", "PFHxS"].unit_key == "ug/l"
    assert by["GW1", "PFOS"].sampled.d == dt.date(2025, 9, 16) and by["GW1", "PFOS"].sampled.minute == 820
    assert by["RB1", "PFOS"].sampled.minute is None and by["DUP1", "Lead"].sampled.d == dt.date(2025, 9, 12)


def test_sample_ids(site):
    lab, coc, field = site["lab"], site["coc"], site["field"]
    missing = {tuple(r) for r in reconcile.missing_ids(lab, coc, field).collect()}
    assert missing == {("A2-15", "lab file", "chain of custody"), ("A2-1.5", "chain of custody", "lab file")}
    assert [tuple(r) for r in reconcile.suggestions(lab, coc).collect()] == [("A2-15", "A2-1.5")]
    assert [r.sample_id for r in reconcile.date_conflicts(lab, coc, field).collect()] == ["GW2"]
    matched = {r.sample_id: r.match for r in reconcile.three_way(lab, coc, field).collect()}
    assert matched["A2-15"] == "lab only" and matched["GW1"] == "matched"


def test_units_duplicates_holding(spark, site):
    lab, field = site["lab"], site["field"]
    assert {(r.matrix, r.unit_key) for r in reconcile.majority_units(lab).collect()} == {("soil", "mg/kg"), ("water", "ug/l")}
    assert [(r.sample_id, r.n) for r in reconcile.unit_outliers(lab).collect()] == [("GW1", 1)]
    pairs = reconcile.duplicates(lab, field).collect()
    assert [(p.analyte, p.verdict, str(p.rpd)[:4]) for p in pairs] == [("Lead", "investigate", "61.8")]
    assert [(r.analyte, r.has) for r in reconcile.unpaired(lab, field).collect()] == [("Mercury", "A1-0.5")]
    held = {(r.sample_id, r.analyte): (r.outcome, r.days_held) for r in reconcile.holding(lab, reconcile.holding_rules(spark)).collect()}
    assert held["A1-0.5", "Mercury"] == ("over", 30) and held["A2-15", "Mercury"] == ("within", 28)
    assert held["RB1", "PFOS"][0] == "no extraction date" and held["A1-0.5", "Lead"][0] == "within"


def test_blanks_and_limits(spark, site):
    lab, field = site["lab"], site["field"]
    assert {r.sample_id for r in reconcile.linked_samples(field).collect()} == {"A1-0.5", "DUP1", "A2-1.5"}
    found = reconcile.blank_detections(lab, field).collect()
    assert [(r.sample_id, str(r.times_lor)) for r in found] == [("RB1", "4.00")]
    criteria = spark.createDataFrame([("pair", "water", ["PFOS", "PFHxS"], True, Decimal("0.025"))], "id string, matrix string, members array<string>, each_member_too boolean, value decimal(18,9)")
    compared = screening.criteria_comparisons(lab, criteria)
    got = {r.alone: (r.status, float(r.low), float(r.high)) for r in reconcile.unconfirmed_limits(compared, field).collect()}
    assert got == {None: ("not confirmed", 0.02, 0.03), "PFOS": ("not above", 0.0, 0.01)}


def test_numbering_and_related(spark):
    findings = spark.createDataFrame([(1, 0, ["a", "b"]), (0, 0, ["c"]), (0, 1, ["b"])], "check_order int, draft_order int, samples array<string>")
    numbered = reconcile.number_findings(findings)
    assert [(r.number, r.samples) for r in numbered.orderBy("number").collect()] == [(1, ["c"]), (2, ["b"]), (3, ["a", "b"])]
    assert {r.number: r.related for r in reconcile.related(numbered).collect()} == {2: [3], 3: [2]}


HEADER = ",".join(sf.REQUIRED["lab"])
GOOD = "R,1,S1,2025-09-12,Soil,Lead,,5,mg/kg,1,mg/kg,2025-09-20"


@pytest.mark.parametrize(
    ("row", "problem"),
    [
        ("R,1,S1,09/13/25,Soil,Lead,,5,mg/kg,1,mg/kg,", "the sampling date can't be read"),
        ("R,1,S1,2025-02-30,Soil,Lead,,5,mg/kg,1,mg/kg,", "the sampling date can't be read"),
        ("R,1,S1,2025-09-12,Air,Lead,,5,mg/kg,1,mg/kg,", "unknown matrix"),
        ("R,1,S1,2025-09-12,Soil,Lead,,5,ug/L,1,ug/L,", "the unit does not go with the matrix"),
        ("R,1,S1,2025-09-12,Soil,Lead,,5,oz,1,oz,", "unknown unit"),
        ("R,1,S1,2025-09-12,Soil,Lead,>,5,mg/kg,1,mg/kg,", "the prefix is neither empty nor <"),
        ("R,1,S1,2025-09-12,Soil,Lead,,5,mg/kg,0,mg/kg,", "the LOR is not above zero"),
        ("R,1,S1,2025-09-12,Soil,Lead,,0,mg/kg,1,mg/kg,", "a detected result is zero"),
        ("R,1,S1,2025-09-12,Soil,Lead,<,2,mg/kg,1,mg/kg,", "a result below the LOR is not equal to it"),
        ("R,1,S1,2025-09-12,Soil,Lead,,1e3,mg/kg,1,mg/kg,", "the result is not a plain number, or has more than 9 places"),
        ("R,1,S1,2025-09-12,Soil,Lead,,0.0000000001,mg/kg,1,mg/kg,", "the result is not a plain number, or has more than 9 places"),
        ("R,1,S1,2025-09-12,Soil", "it holds 5 of the 12 cells of the header"),
        (GOOD, "the sample has two results for this analyte"),
    ],
)
def test_bad_rows_name_file_and_row(spark, tmp_path, row, problem):
    (tmp_path / "lab.csv").write_text(f"{HEADER}\n{GOOD}\n{row}\n")
    with pytest.raises(sf.BadInput, match="lab.csv row 3") as error:
        sf.checked(sf.lab_rows(sf.raw_cells(spark, str(tmp_path / "lab.csv"), "lab")))
    assert problem in str(error.value)


@pytest.mark.parametrize(("text", "problem"), [("", "no header"), ("a,b\n1,2\n", "missing"), (f"{HEADER},matrix\nx\n", "repeated"), (f"{HEADER}\n\n", "no data rows")])
def test_bad_files(spark, tmp_path, text, problem):
    (tmp_path / "f.csv").write_text(text)
    ((_, _, _, cells, found),) = sf.raw_cells(spark, str(tmp_path / "f.csv"), "lab").collect()
    assert cells is None and problem in found


def test_records_follow_the_format(spark, tmp_path):
    """Cells as the csv module reads them; a form feed or line separator in a cell ends no line, and rows stay physical."""
    cells = [["a, b", 'say ""x""', "two\nlines", "\x0cfeed\u2028sep", "", "z"], ["1", "2", "", " 4 ", "5", "6"], ["q", "", "", "", "", ""]]
    written = [",".join(f'"{c}"' if any(x in c for x in ',"\n') else c for c in row) for row in cells]
    names = "coc_number,sample_id,sampled,matrix,analyses,hold,comments"
    (tmp_path / "a b+c.csv").write_text("\ufeff# Project: one\n#Lab : two\n\n" + names + "\r\n" + "\n".join(f"{r},x" for r in written) + "\n,,,,,,\nlast,1,2\n", newline="")
    got = sf.raw_cells(spark, str(tmp_path), "coc").orderBy("row").collect()
    assert [r.row for r in got] == [5, 7, 8, 10] and {r.header_row for r in got} == {4} and got[0].file.endswith("/a b+c.csv")
    want = list(csv.reader(io.StringIO("\n".join(written))))
    assert [[r.cells[n] for n in names.split(",")[:6]] for r in got[:3]] == [[c.strip() for c in row] for row in want]
    assert got[3].problem == "it holds 3 of the 7 cells of the header"
    assert [(r.row, r.key, r.value) for r in sf.preamble(spark, str(tmp_path)).orderBy("row").collect()] == [(1, "Project", "one"), (2, "Lab", "two")]
    (tmp_path / "open.csv").write_text(f'{names}\n1,2,3,4,5,6,"never\nends\n')
    assert [(r.row, r.problem) for r in sf.raw_cells(spark, str(tmp_path / "open.csv"), "coc").collect()] == [(2, "a quote is not closed")]


def test_sites_stay_apart(spark, tmp_path):
    names = "sample_id,date,time,location,matrix,equipment,qa_type,parent_sample,notes"
    for site, rows in (("one", ["S1,2025-09-12,,L,Soil,,primary,,", "D1,2025-09-12,,L,Soil,,field_duplicate,S2,"]), ("two", ["S1,2025-09-12,,L,Soil,,primary,,", "S2,2025-09-12,,L,Soil,,primary,,"])):
        (tmp_path / site).mkdir()
        (tmp_path / site / "field.csv").write_text("\n".join([names, *rows]))
    typed = sf.field_rows(sf.raw_cells(spark, f"{tmp_path}/*/field.csv", "field"))
    assert [(r.file.split("/")[-2], r.row, r.problem) for r in sf.violations(typed).collect()] == [("one", 3, "the parent sample is not on the field sheet")]


def test_exact_expressions(spark):
    D = Decimal
    df = spark.createDataFrame([(D("180"), D("95")), (D("0.07"), D("0.07")), (D("100"), D("0"))], "a decimal(18,9), b decimal(18,9)")
    rows = df.select(exact.shown(F.col("a")).alias("s"), exact.rpd_shown(F.col("a"), F.col("b"), 50).alias("r"), exact.above_bounds(F.col("b"), F.col("a"), F.lit(D("0.07"))).alias("x"), exact.percent_change_half_even(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.s for r in rows] == ["180", "0.07", "100"] and rows[0].r == "61.8"
    assert [r.x for r in rows] == [True, False, None]
    assert [str(r.p) for r in rows] == ["-47.2", "0.0", "-100.0"]
    words = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],)], "w array<string>")
    assert [r[0] for r in words.select(exact.listed(F.col("w"))).collect()] == ["a", "a and b", "a, b and c"]


def test_adaptive_places_never_hide_a_breach(spark):
    D = Decimal
    df = spark.createDataFrame([(D("1.6667"), D("1"))], "a decimal(18,9), b decimal(18,9)")
    row = df.select(exact.exceeds_rpd(F.col("a"), F.col("b"), 50).alias("over"), exact.rpd_shown(F.col("a"), F.col("b"), 50).alias("r")).first()
    assert row.over and D(row.r) > 50


FIELD = "sample_id,date,time,location,matrix,equipment,qa_type,parent_sample,notes"


def _records(spark, texts):
    """(row, cells, open) of the records of each text, all read as files of one table."""
    rows = [(f"{k}", i + 1, t) for k, text in enumerate(texts) for i, t in enumerate(text.split("\n"))]
    lines = spark.createDataFrame(rows, "file string, row int, text string")
    out = [[] for _ in texts]
    for r in sf.records(lines).select("file", "row", "open", sf._cut(F.col("text")).alias("cells")).collect():
        out[int(r.file)].append((r.row, r.cells, r.open))
    return [sorted(x) for x in out]


def test_a_quote_opens_only_at_the_start_of_a_cell(spark):
    """Inch marks in notes are text: all four samples come back."""
    notes = ['5" casing', "plain", '6" casing, reamed', 'hole of 2"']
    text = FIELD + "".join(f"\nS{k},2025-09-12,,MW1,water,,primary,,{n.split(',')[0]}" for k, n in enumerate(notes))
    got = _records(spark, [text])[0]
    assert [c[0] for _, c, _ in got] == ["sample_id", "S0", "S1", "S2", "S3"] and got[1][1][-1] == '5" casing'
    assert not any(o for _, _, o in got)


def test_records_equal_the_csv_module(spark):
    """Cells, first lines and open quotes of random lines."""
    import random

    rng = random.Random(11)
    pieces = ['"', '""', ",", "a", " b", '"x"', '"y, z"', 'k"', "\n", "\n", '"q\nr"', "#"]
    texts = ["h1,h2\n" + "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(200)]
    for text, got in zip(texts, _records(spark, texts), strict=True):
        reader = csv.reader(io.StringIO(text, newline=""))
        want, at = [], 1
        for cells in reader:
            want.append((at, [c.strip() for c in cells] or [""]))
            at = reader.line_num + 1
        if text.endswith("\n") and not got[-1][2]:
            got = [g for g in got if g[0] != text.count("\n") + 1]
        closed = [(r, c) for r, c, o in got if not o]
        assert closed == want[: len(closed)], text
        assert len(want) - len(closed) in (0, 1) and [r for r, _, o in got if o] == [r for r, _ in want[len(closed) :]], text


def test_lines_of_files_in_blocks(spark, tmp_path):
    """Lines keep their numbers where Spark cuts a file into blocks; empty files and odd names are listed."""
    (tmp_path / "a b+c%.csv").write_bytes("\ufeffone\r\ntwo\rthree\n\nfive".encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "long.csv").write_text("".join(f"line {k}\n" for k in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = {}
    for r in sf.raw_lines(spark, str(tmp_path)).collect():
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.row, r.text))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got["a b+c%.csv"]) == [(1, "one"), (2, "two"), (3, "three"), (4, ""), (5, "five")]
    assert got["empty.csv"] == [(1, "")] and sorted(got["long.csv"]) == [(k, f"line {k}") for k in range(1, 3001)]
