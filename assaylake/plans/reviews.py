"""Queries on duplicates, blanks, findings, claims and shown values over the driver's tables, with their DuckDB SQL.

Adapter: each round of a well in ``monitoring.results`` is one water sample,
``well/date``. Rounds of even wells are field duplicates of the round before;
wells that end in 0 or 1 are rinsate and field blanks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions import exact
from assaylake.operators import claims, drafting, reconcile, retrieval, screening
from assaylake.plans import monitoring
from assaylake.session import ship, table

_DAY = "struct(date as d, cast(null as int) as minute) as sampled"
_SAMPLE = "concat_ws('/', well, date) as sample_id"


def _lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monitoring.results(spark, sf_dir)
    return found.select(F.lit("events").alias("file"), F.col("event_id").alias("row"), "well", "date", F.expr(_SAMPLE), F.expr(_DAY), F.lit("water").alias("matrix"), "analyte", "value", "lor")


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = monitoring.results(spark, sf_dir).select("well", "date").distinct()
    before = F.lag("date").over(Window.partitionBy("well").orderBy("date"))
    kind = F.when(F.col("well") % 10 == 0, "rinsate_blank").when(F.col("well") % 10 == 1, "field_blank").when((F.col("well") % 2 == 0) & F.col("before").isNotNull(), "field_duplicate").otherwise("primary")
    return rounds.withColumn("before", before).select(F.expr(_SAMPLE), F.expr(_DAY), kind.alias("qa_type"), F.when(F.col("before").isNotNull(), F.concat_ws("/", "well", "before")).alias("parent_sample"))


def duplicate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each analyte of a sample and its duplicate, with the difference to one place and as it is shown against 30 %."""
    pairs = reconcile.duplicates(_lab(spark, sf_dir), _field(spark, sf_dir))
    a, b = F.coalesce("p_value", "p_lor"), F.coalesce("d_value", "d_lor")
    return pairs.select("parent", "duplicate", "analyte", "verdict", F.col("rpd").cast("double").alias("rpd"), exact.rpd_shown(a, b, reconcile.RPD_REVIEW).alias("shown"))


def unpaired_analytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.unpaired(_lab(spark, sf_dir), _field(spark, sf_dir)).select("parent", "duplicate", "analyte", "has", "row")


def blank_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.blank_detections(_lab(spark, sf_dir), _field(spark, sf_dir))
    return found.select("sample_id", "qa_type", "analyte", F.col("value").cast("double").alias("value"), F.col("times_lor").cast("double").alias("times_lor"), "row")


def unconfirmed_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open bounds of the criteria in samples that aren't blanks."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("members", T.ArrayType(T.StringType())), T.StructField("each_member_too", T.BooleanType()), T.StructField("value", exact.AMOUNT)])
    criteria = spark.createDataFrame([(i, list(m), e, Decimal(v)) for i, m, e, v in monitoring.CRITERIA], schema).withColumn("matrix", F.lit("water"))
    found = reconcile.unconfirmed_limits(screening.criteria_comparisons(_lab(spark, sf_dir), criteria), _field(spark, sf_dir))
    return found.select("id", "sample_id", "alone", "n_open", "status")


def date_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are custody and field rows, line items lab rows with a time on even lines; the field sheet is a day late for every seventh."""
    orders = table(spark, sf_dir, "orders")
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    stamp = lambda d, minute: F.struct(d.alias("d"), minute.cast("int").alias("minute")).alias("sampled")
    coc = orders.select(key.alias("sample_id"), stamp(day, F.when(key % 4 == 0, 600)))
    field = orders.select(key.alias("sample_id"), stamp(F.when(key % 7 == 0, F.date_add(day, 1)).otherwise(day), F.lit(None)))
    n = F.col("l_linenumber")
    lab = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == key).select(
        F.lit("lab").alias("file"), (n * 1000 + F.col("l_quantity").cast("int")).alias("row"), key.alias("sample_id"), stamp(day, F.when(n % 2 == 0, 600 + F.when(key % 3 == 0, n).otherwise(0)))
    )
    return reconcile.date_conflicts(lab, coc, field)


def longest_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items held longest from order to shipment, by order priority; equal waits go to the first order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("analyte"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("extracted"))
    lab = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("sample_id"), F.col("l_orderkey").alias("row"), F.lit("soil").alias("matrix"), "analyte", F.struct("d").alias("sampled"), "extracted")
    rules = spark.createDataFrame([(0, "soil", "1-URGENT", 28, None), (1, "soil", "2-HIGH", None, 6), (2, "soil", "3-MEDIUM", 14, None)], "ordinal int, matrix string, analyte string, days int, months int")
    return reconcile.longest_held(reconcile.holding(lab, rules)).select("analyte", "n_over", "sample_id", F.col("days_held").cast("long").alias("days_held"), "deadline")


def numbered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in blanks, then pairs to investigate, numbered as one list with those that share a sample."""
    lab, field = _lab(spark, sf_dir), _field(spark, sf_dir)
    blanks = reconcile.blank_detections(lab, field).select(F.lit(1).alias("check_order"), F.col("row").alias("draft_order"), F.array("sample_id").alias("samples"))
    pairs = reconcile.duplicates(lab, field).where("verdict = 'investigate'").select(F.lit(2).alias("check_order"), F.col("d_row").alias("draft_order"), F.array("parent", "duplicate").alias("samples"))
    numbered = reconcile.number_findings(blanks.unionByName(pairs))
    with_related = numbered.join(reconcile.related(numbered), "number", "left")
    return with_related.select("number", "check_order", "draft_order", exact.listed(F.col("samples")).alias("samples"), F.coalesce(F.array_join(F.col("related").cast("array<string>"), ","), F.lit("")).alias("related"))


def round_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds in words: the day in full, how many results, the analytes, and whether their sum is at or below 300."""
    found = monitoring.results(spark, sf_dir)
    low, high = F.sum(F.coalesce("value", F.lit(0).cast(exact.AMOUNT))), F.sum(F.coalesce("value", "lor"))
    limit = F.lit(300)
    rounds = found.groupBy("well", "date").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("analyte")).alias("names"), low.alias("low"), high.alias("high"))
    return rounds.select(
        "well", "date", exact.long_date(F.col("date")).alias("day"), exact.plural(F.col("n"), "result").alias("results"), exact.listed(F.col("names")).alias("analytes"),
        exact.compare_bounds(F.col("low"), F.col("high"), "<=", limit).alias("within"), exact.compare_bounds(F.col("low"), F.col("high"), ">=", limit).alias("reaches"),
    )


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each sample in file order, as text."""
    found = screening.samples_in_order(_lab(spark, sf_dir))
    return found.select("sample_id", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["row"], r["analyte"])), ",").alias("rows"))


def analyte_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.first_seen(_lab(spark, sf_dir))


def well_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of well 8, asked for in another case."""
    found = screening.results_of(_lab(spark, sf_dir), 8, "CLICK")
    return found.select(exact.iso_stamp(F.col("sampled")).alias("day"), "analyte", F.col("value").cast("double").alias("value"), "row")


def detection_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screening.detection_limits(_lab(spark, sf_dir))
    return found.select("well", "date", exact.shown(F.col("lor")).alias("lor"), F.array_join("analytes", ",").alias("analytes"), F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


def change_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change between two rounds in percent, to one place with ties to even: the extremes of each well and analyte."""
    pairs = screening.round_changes(monitoring.results(spark, sf_dir))
    return pairs.groupBy("well", "analyte").agg(F.max("percent").cast("double").alias("most"), F.min("percent").cast("double").alias("least"), F.count_distinct("percent").alias("n_distinct"))


def change_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each well: the change of views between its last two rounds, and the sum of clicks and views in the last."""
    found = monitoring.results(spark, sf_dir)
    rounds = found.select("well", "date").distinct()
    newest = F.row_number().over(Window.partitionBy("well").orderBy(F.desc("date")))
    ends = rounds.withColumn("k", newest).where("k <= 2").groupBy("well").agg(F.max("date").alias("d1"), F.min("date").alias("d0")).where("d0 < d1")
    day = lambda c: F.date_format(c, "d MMM yyyy")
    text = F.concat(F.lit("Views saw {change|view|"), F.col("well").cast("string"), F.lit("|"), day("d0"), F.lit("|"), day("d1"), F.lit("}; with clicks {sum click+view|"), F.col("well").cast("string"), F.lit("|"), day("d1"), F.lit("}."))
    templates = ends.select(F.col("well").alias("text_id"), F.col("well").cast("string").alias("well"), text.alias("text"))
    filled = drafting.fill(templates, found, monitoring.limits(spark))
    return filled.select("text_id", "ok", "text", "n_values", F.size("problems").alias("n_problems"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection, a threshold, a guideline and a change stated of each well's last two rounds with views."""
    ship(spark)
    found = monitoring.results(spark, sf_dir)
    newest = F.row_number().over(Window.partitionBy("well").orderBy(F.desc("date")))
    ends = found.where("analyte = 'view'").withColumn("k", newest).where("k <= 2").groupBy("well").agg(F.max("date").alias("d1"), F.min("date").alias("d0")).where("d0 < d1")
    said = F.concat(
        F.lit("View was not detected on "), F.col("d1").cast("string"), F.lit(". View was below 100 ug/L on "), F.col("d1").cast("string"),
        F.lit(". View exceeded the guideline on "), F.col("d1").cast("string"), F.lit(". View rose from "), F.col("d0").cast("string"), F.lit(" to "), F.col("d1").cast("string"), F.lit("."),
    )
    screened = screening.screen_rounds(found, monitoring.limits(spark))
    return claims.check(ends.select(F.col("well").alias("paragraph_id"), "well", said.alias("text")), found, screened, ["click", "view", "error", "purchase", "signup"], {"two-part": "two-part rule", "single": "single rule"})


def claim_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("paragraph_id", "sentence", "kind", "quote", "status")


def claim_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.report(_claims(spark, sf_dir))


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 words of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", exact.first_words(F.col("text"), 40).alias("excerpt"))


def repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines on as many pages as the rule asks, with the documents of one language and source as the pages of one document."""
    pages = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("doc"), F.col("doc_id").alias("page"), "text")
    return retrieval.boilerplate(pages)


QUERIES = {
    "duplicate_samples": duplicate_samples,
    "unpaired_analytes": unpaired_analytes,
    "blank_detections": blank_detections,
    "unconfirmed_limits": unconfirmed_limits,
    "date_conflicts": date_conflicts,
    "longest_held": longest_held,
    "numbered_findings": numbered_findings,
    "round_summary": round_summary,
    "sample_rows": sample_rows,
    "analyte_order": analyte_order,
    "well_results": well_results,
    "detection_limits": detection_limits,
    "change_percent": change_percent,
    "change_templates": change_templates,
    "claim_kinds": claim_kinds,
    "claim_report": claim_report,
    "excerpts": excerpts,
    "repeated_edges": repeated_edges,
}

#: Amounts as whole numbers of 1e-9, so that quotients are exact.
_WHOLE = "cast(replace(cast({} as varchar), '.', '') as hugeint)"

_ROWS = monitoring.RESULTS.replace("select well, date, analyte, value, lor from", "select well, date, analyte, value, lor, event_id as row from").replace("select user_id as well", "select event_id, user_id as well")

_SITE = f"""
results as ({_ROWS}),
lab as (select *, well || '/' || date as sample_id from results),
rounds as (select well, date, lag(date) over (partition by well order by date) as before from (select distinct well, date from results)),
field as (
  select well || '/' || date as sample_id, case when before is not null then well || '/' || before end as parent,
         case when well % 10 = 0 then 'rinsate_blank' when well % 10 = 1 then 'field_blank' when well % 2 = 0 and before is not null then 'field_duplicate' else 'primary' end as qa_type
  from rounds)"""

_PAIRS = f"""
{_SITE},
pairs as (
  select f.parent, f.sample_id as duplicate, p.analyte, p.value is null and d.value is null as open, coalesce(p.value, p.lor) as a, coalesce(d.value, d.lor) as b, d.row as d_row
  from field f join lab p on p.sample_id = f.parent join lab d on d.sample_id = f.sample_id and d.analyte = p.analyte where f.qa_type = 'field_duplicate'),
whole as (select *, abs({_WHOLE.format('a')} - {_WHOLE.format('b')}) * 200 as num, {_WHOLE.format('a')} + {_WHOLE.format('b')} as den from pairs),
judged as (
  select *, case when open then 'both not detected' when a + b < 20 * {monitoring.LOR} then 'no limit' when num > 50 * den then 'investigate' when num > 30 * den then 'review' else 'acceptable' end as verdict from whole)"""

#: The difference to some places, half up, as a whole number of the last place.
_UP = "((2 * num * {scale} + den) // (2 * den))"
_TEXT = "case when contains({0}, '.') then rtrim(rtrim({0}, '0'), '.') else {0} end"
_AT = [f"cast({_UP.format(scale=10**p)} as double) / {10**p}" for p in range(1, 7)]
_PLACES = "case " + " ".join(f"when num <= 30 * den or {_UP.format(scale=10**p)} > 30 * {10**p} then {p}" for p in range(1, 6)) + " else 6 end"

_SHOWN = monitoring._SHOWN
_CHANGES = f"""
results as ({monitoring.RESULTS}),
moved as (
  select a.well, a.analyte, {_WHOLE.format('a.value')} as u, {_WHOLE.format('b.value')} as v
  from results a join results b on a.well = b.well and a.analyte = b.analyte and a.date < b.date and a.value <> b.value),
parted as (select *, (1000 * abs(v - u)) // u as q, (1000 * abs(v - u)) % u as r from moved),
percents as (select well, analyte, (case when v < u then -1 else 1 end) * (q + case when 2 * r > u or (2 * r = u and q % 2 = 1) then 1 else 0 end) as tenths from parted)"""

_STATED = f"""
results as ({monitoring.RESULTS}),
views as (select *, row_number() over (partition by well order by date desc) as k from results where analyte = 'view'),
ends as (
  select n.well, n.value as v1, n.lor as h1, o.value as v0, o.lor as h0 from views n join views o on n.well = o.well and n.k = 1 and o.k = 2),
b as (select well, v1, coalesce(v1, 0) as l1, coalesce(v1, h1) as h1, coalesce(v0, 0) as l0, coalesce(v0, h0) as h0 from ends),
said as (
  select well as paragraph_id, 0 as sentence, 'detection' as kind, 'detected' as quote, case when v1 is null then 'consistent' else 'inconsistent' end as status from b
  union all select well, 1, 'threshold', 'below', case when h1 < 100 then 'consistent' when l1 >= 100 then 'inconsistent' else 'not confirmed' end from b
  union all select well, 2, 'guideline', 'exceeded', case when (l1 > 70) and (l1 > 60) then 'consistent' when h1 <= 60 then 'inconsistent' when l1 > 60 and h1 <= 70 then 'depends on rule' else 'not confirmed' end from b
  union all select well, 3, 'change', 'rose', case when l1 > h0 then 'consistent' when h1 <= l0 then 'inconsistent' else 'not confirmed' end from b)"""

SQL = {
    "duplicate_samples": f"""
with {_PAIRS}, p as (select *, {_PLACES} as places from judged),
s as (select *, case places {' '.join(f"when {p} then cast(cast({_UP.format(scale=10**p)} as decimal(30,0)) / 1{'0' * p}.0 as decimal(20,6))" for p in range(1, 7))} end as digits from p)
select parent, duplicate, analyte, verdict, {_AT[0]} as rpd, rtrim(rtrim(cast(digits as varchar), '0'), '.') as shown from s""",
    "unpaired_analytes": f"""
with {_SITE}, pairs as (select parent, sample_id as duplicate from field where qa_type = 'field_duplicate')
select parent, duplicate, analyte, parent as has, row from pairs p join lab l on l.sample_id = p.parent where not exists (select 1 from lab o where o.sample_id = p.duplicate and o.analyte = l.analyte)
union all
select parent, duplicate, analyte, duplicate, row from pairs p join lab l on l.sample_id = p.duplicate where not exists (select 1 from lab o where o.sample_id = p.parent and o.analyte = l.analyte)""",
    "blank_detections": f"""
with {_SITE}
select sample_id, qa_type, analyte, cast(value as double) as value, cast((2 * 100 * {_WHOLE.format('value')} + {_WHOLE.format('lor')}) // (2 * {_WHOLE.format('lor')}) as double) / 100 as times_lor, row
from lab join field using (sample_id) where value is not null and qa_type in ('rinsate_blank', 'field_blank')""",
    "unconfirmed_limits": f"""
with {_SITE}, compared as ({monitoring.SQL['criteria_bounds']})
select id, sample_id, alone, n_open, status from compared where n_open > 0 and sample_id not in (select sample_id from field where qa_type like '%blank')""",
    "date_conflicts": """
with o as (select o_orderkey as s, cast(o_orderdate as date) as d from orders),
l as (select s, d, cast(case when l_linenumber % 2 = 0 then 600 + case when s % 3 = 0 then l_linenumber else 0 end end as integer) as minute, l_linenumber * 1000 + cast(l_quantity as integer) as row from lineitem join o on l_orderkey = s),
k as (select s, d, minute, arg_min(coalesce(minute, -1), row) over (partition by s) as first, row_number() over (partition by s order by row) as n from l),
stamps as (
  select s, d, case when s % 4 = 0 then 600 end as minute from o
  union all select s, case when s % 7 = 0 then d + 1 else d end, null from o
  union all select s, d, minute from k where n = 1 or (first >= 0 and minute is not null and minute <> first)),
c as (select s as sample_id, count(distinct d) as n_days, count(distinct minute) as n_minutes from stamps group by s)
select * from c where n_days > 1 or n_minutes > 1""",
    "longest_held": """
with j as (
  select o_orderpriority as analyte, l_orderkey as s, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as held, cast(l_shipdate as date) as e,
         case o_orderpriority when '1-URGENT' then cast(o_orderdate as date) + 28 when '2-HIGH' then cast(cast(o_orderdate as date) + interval 6 month as date) when '3-MEDIUM' then cast(o_orderdate as date) + 14 end as deadline
  from lineitem join orders on l_orderkey = o_orderkey),
r as (select *, row_number() over (partition by analyte order by held desc, s) as k, count(*) over (partition by analyte) as n from j where held >= 0 and e > deadline)
select analyte, n as n_over, s as sample_id, held as days_held, deadline from r where k = 1""",
    "numbered_findings": f"""
with {_PAIRS},
drafts as (
  select 1 as check_order, row as draft_order, [sample_id] as samples from lab join field using (sample_id) where value is not null and qa_type in ('rinsate_blank', 'field_blank')
  union all select 2, d_row, [parent, duplicate] from judged where verdict = 'investigate'),
numbered as (select *, row_number() over (order by check_order, draft_order) as number from drafts),
each as (select number, unnest(samples) as sample from numbered),
shared as (select distinct a.number, b.number as other from each a join each b on a.sample = b.sample and a.number <> b.number),
near as (select number, string_agg(cast(other as varchar), ',' order by other) as related from shared group by number)
select number, check_order, draft_order, array_to_string(samples, ' and ') as samples, coalesce(related, '') as related from numbered left join near using (number)""",
    "round_summary": f"""
with results as ({monitoring.RESULTS}),
r as (select well, date, count(*) as n, list_sort(list(distinct analyte)) as a, sum(coalesce(value, 0)) as low, sum(coalesce(value, lor)) as high from results group by all)
select well, date, strftime(date, '%-d %B %Y') as day, n || case when n = 1 then ' result' else ' results' end as results,
       case when len(a) = 1 then a[1] else array_to_string(list_slice(a, 1, len(a) - 1), ', ') || ' and ' || a[len(a)] end as analytes,
       case when high <= 300 then true when low > 300 then false end as within, case when low >= 300 then true when high < 300 then false end as reaches
from r""",
    "sample_rows": f"with {_SITE} select sample_id, string_agg(row || ':' || analyte, ',' order by row) as rows from lab group by sample_id",
    "analyte_order": f"with {_SITE} select analyte, min(row) as first_row from lab group by analyte",
    "well_results": f"with {_SITE} select strftime(date, '%Y-%m-%d') as day, analyte, cast(value as double) as value, row from lab where well = 8 and analyte = 'click'",
    "detection_limits": f"with {_SITE} select well, date, '{monitoring.LOR}' as lor, string_agg(analyte, ',' order by analyte) as analytes, string_agg(cast(row as varchar), ',' order by row) as rows from lab group by well, date, lor",
    "change_percent": f"with {_CHANGES} select well, analyte, cast(max(tenths) as double) / 10 as most, cast(min(tenths) as double) / 10 as least, count(distinct tenths) as n_distinct from percents group by all",
    "change_templates": f"""
with results as ({monitoring.RESULTS}),
rounds as (select well, date, row_number() over (partition by well order by date desc) as k from (select distinct well, date from results)),
ends as (select n.well, o.date as d0, n.date as d1 from rounds n join rounds o on n.well = o.well and n.k = 1 and o.k = 2),
v as (
  select e.well, a.value as v0, b.value as v1, c.value as c1, cast(b.value + c.value as decimal(18,9)) as total
  from ends e left join results a on a.well = e.well and a.date = e.d0 and a.analyte = 'view' left join results b on b.well = e.well and b.date = e.d1 and b.analyte = 'view'
  left join results c on c.well = e.well and c.date = e.d1 and c.analyte = 'click'),
w as (select *, cast(abs(v1 - v0) as decimal(18,9)) as moved, {_WHOLE.format('v0')} as u, abs({_WHOLE.format('v1')} - {_WHOLE.format('v0')}) as x from v),
p as (select *, (1000 * x) // u as q, (1000 * x) % u as r from w),
t as (select *, q + case when 2 * r > u or (2 * r = u and q % 2 = 1) then 1 else 0 end as tenths from p)
select well as text_id, v0 is not null and v1 is not null and c1 is not null as ok,
       case when v0 is not null and v1 is not null and c1 is not null then 'Views saw ' || case when v1 = v0 then 'no change (' || {_SHOWN.format('v0')} || ' ug/L in both rounds)'
            else case when v1 > v0 then 'a rise of ' else 'a fall of ' end || {_SHOWN.format('moved')} || ' ug/L (' || (tenths // 10) || '.' || (tenths % 10) || '%)' end
            || '; with clicks ' || {_SHOWN.format('total')} || ' ug/L.' end as text,
       cast(case when v0 is not null and v1 is not null and c1 is not null then 2 else 0 end as bigint) as n_values,
       cast((v0 is null or v1 is null)::int + (v1 is null or c1 is null)::int as integer) as n_problems
from t""",
    "claim_kinds": f"with {_STATED} select * from said",
    "claim_report": f"""
with {_STATED}
select paragraph_id, count(*) filter (status = 'consistent') as n_consistent, count(*) filter (status = 'inconsistent') as n_inconsistent, count(*) filter (status = 'untraced') as n_untraced,
       count(*) filter (status = 'not confirmed') as n_not_confirmed, count(*) filter (status = 'depends on rule') as n_depends_on_rule, count(*) filter (status = 'not checked') as n_not_checked,
       count(*) filter (status <> 'consistent') as n_attention
from said group by paragraph_id""",
    "excerpts": r"""
with w as (select doc_id, regexp_extract_all(text, '[^\x09-\x0D\x20]+') as w from documents)
select doc_id, array_to_string(list_slice(w, 1, 40), ' ') || case when len(w) > 40 then ' ...' else '' end as excerpt from w""",
    "repeated_edges": r"""
with l as (select concat_ws('/', source, lang) as doc, doc_id as page, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as lines from documents),
e as (select doc, page, unnest(list_concat(list_slice(lines, 1, 3), list_slice(lines, greatest(len(lines) - 2, 1), len(lines)))) as line from l),
k as (select doc, page, lower(regexp_replace(trim(line), '[0-9]+', '#', 'g')) as key from e),
c as (select doc, key, count(distinct page) as n_pages from k where trim(translate(key, '#.', '')) <> '' group by all),
t as (select concat_ws('/', source, lang) as doc, count(*) as pages from documents group by all having count(*) >= 5)
select doc, key, n_pages from c join t using (doc) where n_pages >= greatest(2, cast(floor(0.3 * pages) as bigint))""",
}
