"""A site's files reviewed in one call: a table of numbered findings with their words, and what was read.

``review`` takes typed laboratory, custody and field rows and writes the
findings of all checks to one table: check, kind, samples, rows, title, found
and decides. ``review_folder`` reads the three files of a folder first. Every
word comes from a template over columns; amounts are printed exactly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.functions import exact
from assaylake.operators import reconcile
from assaylake.session import Tables, cut
from assaylake.sources import site_files

FILES = {"lab": "lab_results.csv", "coc": "chain_of_custody.csv", "field": "field_sheet.csv"}

#: Findings of one check that may begin at one row.
MOST_AT_ROW = 1_000_000

#: Order of the checks in a review.
CHECKS = ("sample ids", "dates", "units", "duplicates", "holding times", "blanks")


@dataclass(frozen=True)
class Limits:
    """Thresholds of a review, in percent and in multiples of the limit of reporting."""

    review: int = reconcile.RPD_REVIEW
    investigate: int = reconcile.RPD_INVESTIGATE
    lor_multiple: int = reconcile.LOR_MULTIPLE

    def __post_init__(self) -> None:
        if not 0 < self.review < self.investigate <= 200:
            raise ValueError("differences are above 0 and at most 200 percent, and the one to investigate is the larger")
        if self.lor_multiple < 1:
            raise ValueError("a multiple of the limit of reporting is 1 or more")


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts))


def _amount(value: Column) -> Column:
    return exact.shown(value)


def _result(value: Column, lor: Column) -> Column:
    return F.when(value.isNull(), _text("below ", _amount(lor))).otherwise(_amount(value))


def _drafts(rows: DataFrame, check: str, kind: str, order: Column, samples: list[Column], title: Column, found: Column, decides: Column) -> DataFrame:
    return rows.select(
        F.lit(CHECKS.index(check) + 1).alias("check_order"), F.lit(check).alias("check"), F.lit(kind).alias("kind"), order.cast("long").alias("at"), F.array(*samples).alias("samples"),
        title.alias("title"), found.alias("found"), decides.alias("decides"),
    )


def _first_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample_id").agg(F.min("row").alias("at"))


def drafts(lab: DataFrame, coc: DataFrame, field: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The findings of all checks, not yet numbered; ``at`` is the first row that a finding is about."""
    seen = reduce(DataFrame.unionByName, (_first_rows(rows).withColumn("present_in", F.lit(name)) for rows, name in ((lab, "lab file"), (coc, "chain of custody"), (field, "field sheet"))))
    ids = reconcile.missing_ids(lab, coc, field).join(seen, ["sample_id", "present_in"])
    near = reconcile.suggestions(lab, coc).join(_first_rows(lab).withColumnRenamed("sample_id", "lab_id"), "lab_id")
    dates = reconcile.date_conflicts(lab, coc, field).join(_first_rows(coc), "sample_id")
    units = reconcile.unit_outliers(lab)
    pairs = reconcile.duplicates(lab, field)
    a, b = F.coalesce("p_value", "p_lor"), F.coalesce("d_value", "d_lor")
    verdict = reconcile.pair_verdict(a, b, F.col("p_value").isNull(), F.col("d_value").isNull(), F.greatest("p_lor", "d_lor"), limits.review, limits.investigate, limits.lor_multiple)
    far = pairs.withColumn("verdict", verdict).where(F.col("verdict").isin("investigate", "review"))
    single = reconcile.unpaired(lab, field)
    held = reconcile.holding(lab, reconcile.holding_rules(lab.sparkSession))
    over, early = held.where("outcome = 'over'"), held.where("outcome = 'extracted before sampling'")
    blanks = reconcile.blank_detections(lab, field)
    c = F.col
    return reduce(
        DataFrame.unionByName,
        (
            _drafts(ids, "sample ids", "missing", c("at"), [c("sample_id")], _text(c("sample_id"), " is not in every file"), _text("The ", c("present_in"), " lists ", c("sample_id"), "; the ", c("missing_from"), " does not."), F.lit("Which file is right, and whether the sample was renamed.")),
            _drafts(near, "sample ids", "near", c("at"), [c("lab_id"), c("coc_id")], _text(c("lab_id"), " may be ", c("coc_id")), _text("Both ids agree in all but punctuation, and in matrix and day."), F.lit("Whether the two names are one sample.")),
            _drafts(dates, "dates", "conflict", c("at"), [c("sample_id")], _text("Sampling times of ", c("sample_id"), " differ"), _text("The files give ", exact.plural(c("n_days"), "day"), " and ", exact.plural(c("n_minutes"), "time"), "."), F.lit("Which record of the sampling is right.")),
            _drafts(units, "units", "other unit", c("first_row"), [c("sample_id")], _text(c("sample_id"), " is reported in another unit"), _text(exact.plural(c("n"), "result"), " in ", c("unit_key"), " where most of ", c("matrix"), " is in ", c("majority"), "."), F.lit("Whether the values were converted.")),
            _drafts(far, "duplicates", "pair", c("d_row"), [c("parent"), c("duplicate")], _text(c("analyte"), " differs between ", c("parent"), " and its duplicate"), _text(_result(c("p_value"), c("p_lor")), " and ", _result(c("d_value"), c("d_lor")), ", ", c("rpd"), " % apart: ", c("verdict"), "."), F.lit("Whether the pair is fit for use.")),
            _drafts(single, "duplicates", "unpaired", c("row"), [c("parent"), c("duplicate")], _text(c("analyte"), " has no pair"), _text("Only ", c("has"), " was analysed for ", c("analyte"), "."), F.lit("Whether the other result is missing.")),
            _drafts(over, "holding times", "over", c("row"), [c("sample_id")], _text(c("analyte"), " in ", c("sample_id"), " waited too long"), _text("Extracted after ", exact.plural(c("days_held"), "day"), "; due by ", c("deadline"), "."), F.lit("Whether the result may be used.")),
            _drafts(early, "holding times", "before sampling", c("row"), [c("sample_id")], _text(c("sample_id"), " was extracted before it was taken"), _text("Sampled ", c("sampled.d"), ", extracted ", c("extracted"), "."), F.lit("Which of the two dates is wrong.")),
            _drafts(blanks, "blanks", "detected", c("row"), [c("sample_id")], _text(c("analyte"), " was found in blank ", c("sample_id")), _text(_amount(c("value")), ", ", c("times_lor"), " times the limit of reporting."), F.lit("Whether results of the same day are affected.")),
        ),
    )


def review(lab: DataFrame, coc: DataFrame, field: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(number, check, kind, samples, rows_from, title, found, decides, related): all findings, numbered by check, first row and kind.

    Findings that share a sample are related. Of findings at one row the kind
    and then the title decide the order. Files without a finding give none.
    """
    tables = Tables(lab.sparkSession)
    try:
        found = tables.cut(drafts(lab, coc, field, limits), "drafts")
        at_row = F.row_number().over(Window.partitionBy("check_order", "at").orderBy("kind", "title", "samples")) - 1
        numbered = tables.cut(reconcile.number_findings(found.withColumn("draft_order", F.col("at") * MOST_AT_ROW + at_row)), "numbered")
        out = numbered.join(reconcile.related(numbered), "number", "left")
        related = F.coalesce("related", F.array().cast("array<bigint>")).alias("related")
        return cut(out.select("number", "check", "kind", "samples", F.col("at").alias("rows_from"), "title", "found", "decides", related), "findings")
    finally:
        tables.clear()


def inventory(raw: dict[str, DataFrame]) -> DataFrame:
    """(kind, file, header_row, n_rows) of the files that were read (cells by kind, as ``raw_cells`` gives them)."""
    each = (rows.groupBy("file").agg(F.max("header_row").alias("header_row"), F.count("cells").alias("n_rows")).select(F.lit(kind).alias("kind"), "file", "header_row", "n_rows") for kind, rows in raw.items())
    return reduce(DataFrame.unionByName, each)


def summary(found: DataFrame) -> DataFrame:
    """(n_findings, by_check, sentence) of a review, one row."""
    counted = found.groupBy("check").agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"), F.array_sort(F.collect_list(F.concat_ws(": ", "check", F.col("n").cast("string")))).alias("by_check"))
    sentence = F.when(F.col("n_findings") == 0, "No check found anything; what was not checked is not covered.").otherwise(F.concat(exact.plural(F.col("n_findings"), "finding"), F.lit(" ("), F.array_join("by_check", ", "), F.lit(").")))
    return total.withColumn("sentence", sentence)


def review_folder(spark: SparkSession, folder: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """The findings and the inventory of a folder with the three files; bad rows raise with their file and row."""
    typed = {"lab": site_files.lab_rows, "coc": site_files.coc_rows, "field": site_files.field_rows}
    tables = Tables(spark)
    try:
        raw = {kind: tables.cut(site_files.raw_cells(spark, f"{folder}/{name}", kind), f"{kind}-cells") for kind, name in FILES.items()}
        lab, coc, field = (tables.cut(site_files.checked(typed[kind](raw[kind])), f"{kind}-rows") for kind in FILES)
        return review(lab, coc, field, limits), cut(inventory(raw), "inventory")
    finally:
        tables.clear()
