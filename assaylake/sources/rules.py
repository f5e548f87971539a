"""Readers of guideline rules, soil criteria, the corpus list and test reports.

JSON is read with a stated schema, so nothing is inferred; numbers are read as
text and become exact decimals in canonical units. Violations are collected
for all entries before :class:`BadInput` is raised with each of them. These
files are documents of a few dozen entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions import exact
from assaylake.sources.site_files import BadInput

RULES = (
    "rules array<struct<id:string,name:string,document:string,table:string,page:string,page_basis:string,wa_status:string,"
    "limits:array<struct<key:string,applies_to:string,members:array<string>,value:string,unit:string,scenario:string,note:string>>>>"
)
CRITERIA = "scenario string, scenario_short string, criteria array<struct<id:string,label:string,members:array<string>,each_member_too:boolean,value:string,unit:string,document:string,table:string,page:string,note:string>>"
MANIFEST = (
    "documents array<struct<id:string,title:string,short_title:string,issuer:string,edition:string,publication_date:string,wa_status:string,format:string,official_url:string,"
    "fetch_urls:array<string>,licence_lane:string,licence:string,notice:string,available:boolean,availability_note:string,sha256:string,retrieved:string>>"
)

#: Text that each entry of the corpus list must have (fixed values).
REQUIRED_TEXT = ("id", "title", "short_title", "issuer", "edition", "publication_date", "wa_status", "format", "official_url", "licence_lane", "licence", "notice", "availability_note")
LANES, FORMATS = ("A", "B", "C"), ("pdf", "markdown")


def _json(spark: SparkSession, path: str, schema: str, list_name: str) -> DataFrame:
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    if whole.where(F.col(list_name).isNotNull()).limit(1).count() == 0:
        raise BadInput(f"{path}: it is not an object with a list of {list_name}")
    return whole


def _checked(rows: DataFrame, problem: Column, name: str) -> DataFrame:
    marked = rows.withColumn("problem", problem)
    bad = [f"{r[name]}: {r.problem}" for r in marked.where("problem is not null").select(name, "problem").orderBy(name, "problem").collect()]
    if bad:
        raise BadInput("; ".join(bad))
    return marked.drop("problem")


def canonical(value: Column, unit: Column) -> Column:
    """The exact number in the canonical unit of its matrix; null if either can't be read."""
    return (exact.plain_decimal(value) * exact.unit_factor(exact.unit_key(unit))).try_cast(exact.AMOUNT)


def read_limits(spark: SparkSession, path: str) -> DataFrame:
    """(rule, rule_name, citation, status, ordinal, key, applies_to, members, value, scenario, note): limits in ug/L."""
    rules = _json(spark, path, RULES, "rules").select(F.explode("rules").alias("r"))
    flat = rules.select(F.col("r.id").alias("rule"), F.col("r.name").alias("rule_name"), F.concat_ws(", ", "r.document", "r.table", "r.page").alias("citation"), F.col("r.wa_status").alias("status"), F.posexplode("r.limits").alias("ordinal", "l"))
    rows = flat.select("rule", "rule_name", "citation", "status", "ordinal", "l.key", "l.applies_to", "l.members", canonical(F.col("l.value"), F.col("l.unit")).alias("value"), exact.unit_matrix(exact.unit_key(F.col("l.unit"))).alias("matrix"), "l.scenario", "l.note")
    problem = (
        F.when(~F.coalesce(F.col("applies_to").isin("single", "sum"), F.lit(False)), "applies_to must be single or sum")
        .when(F.coalesce(F.size("members"), F.lit(0)) < 1, "a limit needs members")
        .when(F.col("value").isNull() | (F.coalesce("matrix", F.lit("")) != "water"), "the value can't be read as a concentration in water")
    )
    return _checked(rows, problem, "rule").drop("matrix")


def water_criteria(limits: DataFrame) -> DataFrame:
    """Limits as criteria; a sum's value also holds for each member alone."""
    return limits.select(
        F.concat_ws(":", "rule", "key").alias("id"), F.lit("water").alias("matrix"), F.replace("scenario", F.lit(" "), F.lit("-")).alias("scenario"), F.col("key").alias("label"), "members", (F.col("applies_to") == "sum").alias("each_member_too"), "value", "rule", "citation", F.col("status").alias("note")
    )


def read_soil_criteria(spark: SparkSession, path: str) -> DataFrame:
    """Soil criteria in mg/kg, in the columns of :func:`water_criteria`."""
    whole = _json(spark, path, CRITERIA, "criteria").select("scenario_short", F.explode("criteria").alias("c"))
    rows = whole.select(
        "c.id", F.lit("soil").alias("matrix"), F.col("scenario_short").alias("scenario"), "c.label", "c.members", F.coalesce("c.each_member_too", F.lit(False)).alias("each_member_too"), canonical(F.col("c.value"), F.col("c.unit")).alias("value"),
        F.lit(None).cast("string").alias("rule"), F.concat_ws(", ", "c.document", "c.table", "c.page").alias("citation"), "c.note", exact.unit_matrix(exact.unit_key(F.col("c.unit"))).alias("unit_of"),
    )
    problem = F.when(F.col("value").isNull() | (F.coalesce("unit_of", F.lit("")) != "soil"), "the value can't be read as a concentration in soil").when(F.coalesce(F.size("members"), F.lit(0)) < 1, "a criterion needs members")
    return _checked(rows, problem, "id").drop("unit_of")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the corpus list with their file names; ids are unique, lanes and formats known."""
    docs = _json(spark, path, MANIFEST, "documents").select(F.explode("documents").alias("d")).select("d.*")
    gone = [F.when(F.col(c).isNull(), F.lit(f"{c} must be text")) for c in REQUIRED_TEXT]
    urls = F.coalesce(F.col("fetch_urls"), F.array().cast("array<string>"))
    problem = F.coalesce(
        *gone,
        F.when(~F.col("licence_lane").isin(*LANES), F.lit("the licence lane must be A, B or C")),
        F.when(~F.col("format").isin(*FORMATS), F.lit("the format must be pdf or markdown")),
        F.when((F.size(urls) == 0) | F.exists(urls, lambda u: u.isNull()), F.lit("fetch_urls must be a list of addresses")),
        F.when(F.col("available").isNull(), F.lit("available must be true or false")),
    )
    twice = docs.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("twice"))
    rows = docs.join(twice, "id", "left")
    rows = _checked(rows, F.when(F.col("twice"), F.lit("the id is repeated")).otherwise(problem), "id").drop("twice")
    return rows.withColumn("filename", F.concat("id", F.when(F.col("format") == "pdf", ".pdf").otherwise(".md")))


def read_test_report(spark: SparkSession, path: str) -> DataFrame:
    """(classname, name, failed, errored, skipped_type) of the test cases of JUnit XML files."""
    outcome = "struct<_message:string,_type:string,_VALUE:string>"
    schema = f"_classname string, _name string, failure {outcome}, error {outcome}, skipped {outcome}"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    skipped = F.when(F.col("skipped").isNotNull(), F.coalesce("skipped._type", F.lit("")))
    return cases.select(F.col("_classname").alias("classname"), F.col("_name").alias("name"), F.col("failure").isNotNull().alias("failed"), F.col("error").isNotNull().alias("errored"), skipped.alias("skipped_type"))
