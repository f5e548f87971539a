"""Site-file queries over the driver's tables, with their DuckDB SQL.

The tables hold no files, so each query turns a table's rows into the lines of
many small CSV files (preamble, header, records with quoted cells, dates in
several forms, and some rows with faults) and reads them with the readers of
``sources.site_files``. Most hand the numbered lines over as they are;
``written_lab_rows`` and ``written_preambles`` write them as files and read
those. The SQL derives the same rows from the table's values, without any CSV.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.plans import monitoring
from assaylake.session import Tables, cut, table
from assaylake.sources import site_files


def _lines(rows: DataFrame, kind: str, order: list[str], cells: list[Column]) -> DataFrame:
    """(file, row, text): a preamble line, the header, and one line for each row of a file."""
    at = F.row_number().over(Window.partitionBy("file").orderBy(*order)) + 2
    data = rows.select("file", at.alias("row"), F.array_join(F.array(*[F.coalesce(c, F.lit("")) for c in cells]), ",").alias("text"))
    header = F.array(F.lit("# Site: north"), F.lit(",".join(site_files.REQUIRED[kind])))
    heads = rows.select("file").distinct().select("file", F.posexplode(header).alias("p", "text")).select("file", (F.col("p") + 1).alias("row"), "text")
    return heads.unionByName(data)


def _written(day: Column, form: Column) -> Column:
    """A day as ISO, as dd/MM/yy, or with the month's name and a time."""
    return F.when(form == 0, F.date_format(day, "yyyy-MM-dd")).when(form == 1, F.date_format(day, "dd/MM/yy")).otherwise(F.date_format(day, "d MMM yyyy '01:40 PM'"))


_PROBLEMS = "array_join(array_sort(problems), '; ') as problems"


def _lab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a supplier are the results of one laboratory file."""
    rows = table(spark, sf_dir, "lineitem").withColumn("file", F.concat(F.lit("lab-"), F.col("l_suppkey").cast("string")))
    water, n, low = F.col("l_returnflag") == "R", F.col("l_linenumber"), F.col("l_quantity") < 10
    unit = F.when((n == 7) & ~water, "ng/L").when(water, F.when(n % 2 == 0, "mg/L").otherwise("µg / L")).otherwise("mg/kg")
    cells = [
        F.lit("R1"), F.lit("L1"), F.concat(F.lit("S"), F.col("l_orderkey").cast("string")), _written(F.col("l_shipdate"), n % 3), F.when(water, "W").otherwise("Soil"),
        F.concat(F.lit('"Metal, ""'), n.cast("string"), F.lit('"""')), F.when(low, "<").otherwise(""), F.when(low, "10").otherwise(F.col("l_quantity").cast("decimal(12,2)").cast("string")),
        unit, F.lit("10"), F.lit(""), F.date_format("l_shipdate", "yyyy-MM-dd"),
    ]
    return _lines(rows, "lab", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag"], cells)


def _lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_files.lab_rows(site_files.cells_of(_lab_lines(spark, sf_dir), "lab"))


def _lab_columns(typed: DataFrame) -> DataFrame:
    return typed.select(
        "file", "row", "sample_id", F.col("sampled.d").alias("sampled_on"), F.col("sampled.minute").alias("minute"), "matrix", "analyte", "reported",
        F.col("value").cast("double").alias("value"), F.col("lor").cast("double").alias("lor"), "unit_key", "extracted", F.expr(_PROBLEMS),
    )


def lab_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed laboratory row with its file, row and violations."""
    return _lab_columns(_lab(spark, sf_dir))


def _written_files(spark: SparkSession, sf_dir: str, tables: Tables) -> str:
    """The folder of the laboratory files, one for each supplier, as text files in the shared folder."""
    path = tables.folder("lab-files")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"])
    _lab_lines(spark, sf_dir).groupBy("file").agg(F.array_join(lines, "\n").alias("value")).write.partitionBy("file").text(path)
    return path


def _file_name(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.regexp_extract("file", "/file=([^/]+)/", 1))


def written_lab_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lab_file_rows`` from files that are written and read again."""
    tables = Tables(spark)
    try:
        typed = _file_name(site_files.lab_rows(site_files.raw_cells(spark, _written_files(spark, sf_dir, tables), "lab")))
        return cut(_lab_columns(typed), "written-lab-rows")
    finally:
        tables.clear()


def written_preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands above the header of each written file."""
    tables = Tables(spark)
    try:
        return cut(_file_name(site_files.preamble(spark, _written_files(spark, sf_dir, tables))), "written-preambles")
    finally:
        tables.clear()


def problem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each violation of the laboratory files with the physical line that it names."""
    return site_files.source_lines(site_files.violations(_lab(spark, sf_dir)), _lab_lines(spark, sf_dir)).select("file", "row", "problem", "text")


def coc_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer are one chain of custody; a few holds can't be read and a few matrices are unknown."""
    rows = table(spark, sf_dir, "orders").withColumn("file", F.concat(F.lit("coc-"), F.col("o_custkey").cast("string")))
    key = F.col("o_orderkey")
    hold = F.when(key % 97 == 0, "maybe").when(F.col("o_orderstatus") == "P", "y").when(F.col("o_orderstatus") == "O", "N").otherwise("")
    matrix = F.when(key % 89 == 0, "air").when(key % 2 == 0, "groundwater").otherwise("S")
    cells = [F.lit("C1"), F.concat(F.lit("S"), key.cast("string")), _written(F.col("o_orderdate"), key % 3), matrix, F.lit("all"), hold, F.concat(F.lit('"kept cold, '), F.col("o_orderpriority"), F.lit('"'))]
    found = site_files.coc_rows(site_files.cells_of(_lines(rows, "coc", ["o_orderkey"], cells), "coc"))
    return found.select("file", "row", "sample_id", F.col("sampled.d").alias("sampled_on"), F.col("sampled.minute").alias("minute"), "matrix", "hold", "comments", F.expr(_PROBLEMS))


def field_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer are one field sheet; every fifth is the duplicate of the order before it, or of none."""
    of_file = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("file", F.concat(F.lit("field-"), F.col("o_custkey").cast("string"))).withColumn("before", F.lag("o_orderkey").over(of_file))
    key = F.col("o_orderkey")
    parent = F.when(key % 5 == 0, F.concat(F.lit("S"), F.coalesce(F.col("before").cast("string"), F.lit("-none"))))
    time = F.when(key % 11 == 0, "25:00").when(key % 3 == 0, "09:10").when(key % 3 == 1, "12:05 am").otherwise("")
    cells = [F.concat(F.lit("S"), key.cast("string")), _written(F.col("o_orderdate"), key % 3), time, F.lit("MW1"), F.lit("water"), F.col("o_orderstatus"), F.when(key % 5 == 0, "Field_Duplicate").otherwise("primary"), parent, F.lit("")]
    found = site_files.field_rows(site_files.cells_of(_lines(rows, "field", ["o_orderkey"], cells), "field"))
    return found.select("file", "row", "sample_id", F.col("sampled.d").alias("sampled_on"), F.col("sampled.minute").alias("minute"), "equipment", "qa_type", "parent_sample", F.expr(_PROBLEMS))


def round_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a well are one round file; every thirteenth date is not an ISO date."""
    rows = monitoring.results(spark, sf_dir).withColumn("file", F.concat(F.lit("well-"), F.col("well").cast("string")))
    value = F.col("value").cast("decimal(18,2)").cast("string")
    day = F.when(F.col("event_id") % 13 == 0, F.date_format("date", "d MMM yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    cells = [F.lit("R1"), F.lit("north"), F.col("well").cast("string"), F.concat_ws("-", "well", "date"), day, F.lit("water"), F.col("analyte"), F.when(F.col("value").isNull(), F.concat(F.lit("<"), F.lit(str(monitoring.LOR)))).otherwise(value), F.lit("mcg/L"), F.lit(str(monitoring.LOR))]
    found = site_files.round_rows(site_files.cells_of(_lines(rows, "round", ["date", "analyte"], cells), "round"))
    return found.select("file", "row", "well", "sample_id", "date", "analyte", "reported", F.col("value").cast("double").alias("value"), F.col("lor").cast("double").alias("lor"), F.expr(_PROBLEMS))


QUERIES = {
    "lab_file_rows": lab_file_rows,
    "written_lab_rows": written_lab_rows,
    "written_preambles": written_preambles,
    "problem_lines": problem_lines,
    "coc_file_rows": coc_file_rows,
    "field_file_rows": field_file_rows,
    "round_file_rows": round_file_rows,
}

#: A day as the reader must see it: years of two digits are 20xx.
_READ = "case when {form} = 1 then make_date(2000 + year({day}) % 100, month({day}), day({day})) else cast({day} as date) end"
_JOINED = "array_to_string(list_sort(list_filter([{}], lambda x: x is not null)), '; ')"

_LAB = f"""
n as (
  select *, l_linenumber as k, l_quantity < 10 as low, l_returnflag = 'R' as water,
         2 + row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag) as row,
         count(*) over (partition by l_suppkey, l_orderkey, l_linenumber) > 1 as twice
  from lineitem),
u as (select *, case when k = 7 and not water then 'ng/l' when water and k % 2 = 0 then 'mg/l' when water then 'ug/l' else 'mg/kg' end as unit_key from n),
f as (select *, case unit_key when 'mg/l' then 1000 when 'ng/l' then 0.001 else 1 end as factor, {_READ.format(form='k % 3', day='l_shipdate')} as d from u),
lab as (
  select 'lab-' || l_suppkey as file, cast(row as integer) as row, 'S' || l_orderkey as sample_id, d as sampled_on, cast(case when k % 3 = 2 then 820 end as integer) as minute,
         case when water then 'water' else 'soil' end as matrix, 'Metal, "' || k || '"' as analyte, case when low then '<10' else cast(cast(l_quantity as decimal(12,2)) as varchar) end as reported,
         cast(case when not low then cast(l_quantity as decimal(12,2)) * factor end as double) as value, cast(10 * factor as double) as lor, unit_key, cast(l_shipdate as date) as extracted,
         {_JOINED.format("case when k = 7 and not water then 'the unit does not go with the matrix' end, case when twice then 'the sample has two results for this analyte' end")} as problems,
         k, low, water, l_shipdate
  from f)"""

SQL = {
    "lab_file_rows": f"with {_LAB} select file, row, sample_id, sampled_on, minute, matrix, analyte, reported, value, lor, unit_key, extracted, problems from lab",
    "written_preambles": "select distinct 'lab-' || l_suppkey as file, 1 as row, 'Site' as key, 'north' as value from lineitem",
    "problem_lines": f"""
with {_LAB}, p as (select *, unnest(string_split(problems, '; ')) as problem from lab where problems <> '')
select file, row, problem,
       'R1,L1,' || sample_id || ',' || case k % 3 when 0 then strftime(l_shipdate, '%Y-%m-%d') when 1 then strftime(l_shipdate, '%d/%m/%y') else strftime(l_shipdate, '%-d %b %Y') || ' 01:40 PM' end || ','
       || case when water then 'W' else 'Soil' end || ',"Metal, ""' || k || '""' || chr(34) || ',' || case when low then '<,10' else ',' || reported end || ','
       || case unit_key when 'ng/l' then 'ng/L' when 'mg/l' then 'mg/L' when 'ug/l' then 'µg / L' else 'mg/kg' end || ',10,,' || strftime(l_shipdate, '%Y-%m-%d') as text
from p""",
    "coc_file_rows": f"""
select 'coc-' || o_custkey as file, cast(2 + row_number() over (partition by o_custkey order by o_orderkey) as integer) as row, 'S' || o_orderkey as sample_id,
       {_READ.format(form='o_orderkey % 3', day='o_orderdate')} as sampled_on, cast(case when o_orderkey % 3 = 2 then 820 end as integer) as minute,
       case when o_orderkey % 89 = 0 then null when o_orderkey % 2 = 0 then 'water' else 'soil' end as matrix,
       o_orderkey % 97 <> 0 and o_orderstatus = 'P' as hold, 'kept cold, ' || o_orderpriority as comments,
       {_JOINED.format("case when o_orderkey % 97 = 0 then 'hold is neither Y nor N' end, case when o_orderkey % 89 = 0 then 'unknown matrix' end")} as problems
from orders""",
    "field_file_rows": f"""
with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as r, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from orders)
select 'field-' || o_custkey as file, cast(2 + r as integer) as row, 'S' || o_orderkey as sample_id, {_READ.format(form='o_orderkey % 3', day='o_orderdate')} as sampled_on,
       cast(case when o_orderkey % 11 <> 0 and o_orderkey % 3 = 0 then 550 when o_orderkey % 11 <> 0 and o_orderkey % 3 = 1 then 5 when o_orderkey % 3 = 2 then 820 end as integer) as minute,
       o_orderstatus as equipment, case when o_orderkey % 5 = 0 then 'field_duplicate' else 'primary' end as qa_type,
       case when o_orderkey % 5 = 0 then 'S' || coalesce(cast(before as varchar), '-none') else '' end as parent_sample,
       {_JOINED.format("case when o_orderkey % 11 = 0 then 'the time can' || chr(39) || 't be read' end, case when o_orderkey % 5 = 0 and before is null then 'the parent sample is not on the field sheet' end")} as problems
from o""",
    "round_file_rows": f"""
with results as ({monitoring.RESULTS.replace('select well, date, analyte, value, lor from', 'select well, date, analyte, value, lor, event_id from').replace('select user_id as well', 'select event_id, user_id as well')})
select 'well-' || well as file, cast(2 + row_number() over (partition by well order by date, analyte) as integer) as row, cast(well as varchar) as well, well || '-' || date as sample_id,
       case when event_id % 13 <> 0 then date end as date, analyte, case when value is null then '<{monitoring.LOR}' else cast(cast(value as decimal(18,2)) as varchar) end as reported,
       cast(cast(value as decimal(18,2)) as double) as value, cast(lor as double) as lor, case when event_id % 13 = 0 then 'the date is not an ISO date' else '' end as problems
from results""",
}
SQL["written_lab_rows"] = SQL["lab_file_rows"]
