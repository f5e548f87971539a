"""Screening and reconciliation queries over the driver's tables, with their DuckDB SQL.

The tables hold no laboratory data, so each query names an adapter: ``events``
are measurements (user = well, day = round, event type = analyte, value = ug/L,
not detected below 5), ``orders`` and ``lineitem`` are custody and lab rows.
Limits and units of the adapters are choices made here, not published values.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions import exact
from assaylake.operators import claims, drafting, reconcile, screening
from assaylake.session import ship, table

LOR = 5

#: rule, ordinal, key, applies_to, members, value of the adapter's two rules.
LIMITS = (
    ("two-part", 0, "click+view", "sum", ("click", "view"), "70"),
    ("two-part", 1, "purchase", "single", ("purchase",), "115"),
    ("single", 0, "click", "single", ("click",), "35"),
    ("single", 1, "view", "single", ("view",), "60"),
    ("single", 2, "error", "single", ("error",), "100"),
)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results, the last of repeats in each round."""
    value = F.col("value").cast(exact.AMOUNT)
    rows = table(spark, sf_dir, "events").where("user_id is not null and ts is not null and event_type is not null and value is not null").select(
        F.col("user_id").alias("well"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("analyte"),
        F.when(value >= LOR, value).alias("value"),
        F.lit(LOR).cast(exact.AMOUNT).alias("lor"),
        "ts",
        "event_id",
    )
    return screening.last_of_repeats(rows, "ts", "event_id")


RESULTS = f"""
  select well, date, analyte, value, lor from (
    select user_id as well, cast(ts as date) as date, event_type as analyte,
           case when cast(value as decimal(18,9)) >= {LOR} then cast(value as decimal(18,9)) end as value,
           cast({LOR} as decimal(18,9)) as lor,
           row_number() over (partition by user_id, cast(ts as date), event_type order by ts desc, event_id desc) as k
    from events where user_id is not null and ts is not null and event_type is not null and value is not null)
  where k = 1"""


def limits(spark: SparkSession) -> DataFrame:
    schema = T.StructType(
        [T.StructField("rule", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("applies_to", T.StringType()), T.StructField("members", T.ArrayType(T.StringType())), T.StructField("value", exact.AMOUNT)]
    )
    return spark.createDataFrame([(r, o, k, a, list(m), Decimal(v)) for r, o, k, a, m, v in LIMITS], schema)


_SCREENS = ",\n    ".join(
    f"('{rule}', '{key}', {f'{chr(39)}{alone}{chr(39)}' if alone else 'null'}, [{', '.join(repr(m) for m in members)}], {value})"
    for rule, key, alone, members, value in [(r, k, None, m, v) for r, _, k, _, m, v in LIMITS] + [(r, k, one, (one,), v) for r, _, k, a, m, v in LIMITS if a == "sum" for one in m]
)

SCREENED = f"""
results as ({RESULTS}),
screens(rule, key, alone, members, lim) as (values
    {_SCREENS}),
rounds as (select distinct well, date from results),
parts as (select rule, key, alone, lim, len(members) as n_members, unnest(members) as analyte from screens),
bounds as (
  select r.well, r.date, p.rule, p.key, p.alone, p.lim, p.n_members, count(x.lor) as n,
         sum(coalesce(x.value, 0)) as low, sum(coalesce(x.value, x.lor)) as high
  from rounds r cross join parts p left join results x on x.well = r.well and x.date = r.date and x.analyte = p.analyte
  group by all),
screened as (
  select well, date, rule, key, alone,
         case when n = n_members then cast(low as double) end as low, case when n = n_members then cast(high as double) end as high,
         case when n < n_members then 'not analysed' when low > lim then 'above' when high <= lim then 'not above' else 'not confirmed' end as status
  from bounds)"""


def screen_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = screening.screen_rounds(results(spark, sf_dir), limits(spark))
    return found.select("well", "date", "rule", "key", "alone", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "status")


def screen_two_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.compare_rules(screening.screen_rounds(results(spark, sf_dir), limits(spark)))


def rules_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.rules_agree(screen_two_rules(spark, sf_dir))


_COMPARED = """
compared as (
  select well, date, rule, count(*) filter (status <> 'not analysed') as n_screens, count(*) filter (status = 'not analysed') as n_missing,
         count(*) filter (status = 'above') as n_above,
         case when count(*) filter (status = 'above') > 0 then 'above'
              when count(*) filter (status <> 'not analysed') > 0 and count(*) filter (status = 'not confirmed') = 0 then 'not above'
              else 'not confirmed' end as overall
  from screened group by all)"""


def detected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = results(spark, sf_dir).select(F.lit("water").alias("matrix"), "analyte", "value", F.col("event_id").alias("row"))
    return screening.counts_by_analyte(lab)


def latest_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.latest_round(results(spark, sf_dir)).groupBy("well", "date").agg(F.count("*").alias("n_results"), F.count("value").alias("n_detected"))


def round_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises and falls between all rounds of each well and analyte."""
    pairs = screening.round_changes(results(spark, sf_dir))
    return pairs.groupBy("well", "analyte").agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("direction") == "rise").alias("n_rises"),
        F.max((F.col("value_to") - F.col("value_from")).cast("double")).alias("largest_rise"),
        F.count_if(F.abs(F.col("value_to") - F.col("value_from")) * 2 >= F.col("value_from")).alias("n_half_or_more"),
    )


def kleene_all_by_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results(spark, sf_dir)
    below = F.when(F.col("value").isNull(), F.lit(None)).otherwise(F.col("value") < 200)
    return found.groupBy("well").agg(exact.all_three_valued(below).alias("all_below"))


#: Stated numbers: id, analyte, number.
STATED = ((1, "click", "12.5"), (2, "click", "90"), (3, "view", "0.07"), (4, "error", "250"), (5, "signup", "33.333"))


def nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = spark.createDataFrame([(i, a, Decimal(n)) for i, a, n in STATED], T.StructType([T.StructField("id", T.IntegerType()), T.StructField("analyte", T.StringType()), T.StructField("number", exact.AMOUNT)]))
    found = screening.nearest_value(stated, results(spark, sf_dir))
    return found.select("id", "analyte", F.col("number").cast("double").alias("number"), "well", "date", F.col("value").cast("double").alias("value"))


#: id, members, each member too, value of the adapter's criteria.
CRITERIA = (("pair", ("click", "view"), True, "60"), ("purchase", ("purchase",), False, "80"))


def criteria_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("members", T.ArrayType(T.StringType())), T.StructField("each_member_too", T.BooleanType()), T.StructField("value", exact.AMOUNT)])
    criteria = spark.createDataFrame([(i, list(m), e, Decimal(v)) for i, m, e, v in CRITERIA], schema).withColumn("matrix", F.lit("water"))
    lab = results(spark, sf_dir).select(F.concat_ws("/", "well", "date").alias("sample_id"), F.lit("water").alias("matrix"), "analyte", "value", "lor")
    found = reconcile.marginal(screening.criteria_comparisons(lab, criteria))
    return found.select("id", "sample_id", "alone", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "n_open", "status", "marginal")


# --- orders as custody, lineitem as lab ------------------------------------


def three_way_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are custody rows, their even customers a field sheet, line items lab rows; counts by match and hold."""
    lab = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("row"))
    coc = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderkey").alias("row"), (F.col("o_orderstatus") == "P").alias("hold"))
    field = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("row"), F.lit("primary").alias("qa_type"))
    return reconcile.three_way(lab, coc, field).groupBy("match", "hold").agg(F.count("*").alias("n_rows"), F.count_distinct("sample_id").alias("n_samples"))


def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"))
    orders = table(spark, sf_dir, "orders")
    coc = orders.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_orderstatus") == "P").alias("hold"))
    field = orders.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("sample_id"))
    return reconcile.missing_ids(lab, coc, field)


def _customer_ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers' names written two ways: lab_id in the one, coc_id in the other."""
    names = table(spark, sf_dir, "customer")
    lab = names.select(F.upper(F.replace("c_name", F.lit("#"), F.lit(" - "))).alias("lab_id"), F.col("c_nationkey").alias("matrix"), "c_custkey")
    return lab, names.select(F.col("c_name").alias("coc_id"), F.col("c_nationkey").alias("matrix"), "c_custkey")


def _compact_matches(lab: DataFrame, coc: DataFrame) -> DataFrame:
    joined = lab.select("lab_id", "matrix", exact.compact_id(F.col("lab_id")).alias("compact")).join(coc.withColumn("compact", exact.compact_id(F.col("coc_id"))), ["compact", "matrix"])
    return joined.groupBy("lab_id", "compact").agg(F.count("*").alias("n_candidates"), F.min("coc_id").alias("coc_id"))


def compact_id_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that meet by their letters and digits, for all customers."""
    return _compact_matches(*_customer_ids(spark, sf_dir))


#: Both names stay; either covers every customer.


def id_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-to-one matching of ``reconcile.suggestions`` over all customers; no stamps, custody rows in order of key."""
    lab, coc = _customer_ids(spark, sf_dir)
    stamp = F.struct(F.lit(None).cast("date").alias("d"), F.lit(None).cast("int").alias("minute")).alias("sampled")
    row = F.col("c_custkey").alias("row")
    return reconcile.suggestions(
        lab.select(F.col("lab_id").alias("sample_id"), stamp, "matrix", F.lit("customer").alias("file"), row),
        coc.select(F.col("coc_id").alias("sample_id"), stamp, "matrix", row, F.lit(False).alias("hold")),
    )


def duplicate_rpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line 1 and line 2 of an order are a sample and its duplicate, by quantity and price."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber in (1, 2)")

    def side(n: int, prefix: str) -> DataFrame:
        own = lines.where(f"l_linenumber = {n}").groupBy("l_orderkey").agg(F.max("l_quantity").cast(exact.AMOUNT).alias("q"), F.max("l_extendedprice").cast(exact.AMOUNT).alias("p"))
        long = own.select("l_orderkey", F.explode(F.array(F.struct(F.lit("quantity").alias("analyte"), F.col("q").alias("v"), F.lit(Decimal(2)).cast(exact.AMOUNT).alias("l")), F.struct(F.lit("price").alias("analyte"), F.col("p").alias("v"), F.lit(Decimal(1000)).cast(exact.AMOUNT).alias("l")))).alias("x"))
        value = F.when(F.col("x.v") >= F.col("x.l"), F.col("x.v"))
        return long.select("l_orderkey", F.col("x.analyte").alias("analyte"), value.alias(f"{prefix}_value"), F.col("x.l").alias(f"{prefix}_lor"))

    pairs = side(1, "p").join(side(2, "d"), ["l_orderkey", "analyte"])
    return reconcile.classify_pairs(pairs).select("l_orderkey", "analyte", "verdict")


def holding_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipment against 28 days or 6 clamped months, by order priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("analyte"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("extracted"))
    lab = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.lit("soil").alias("matrix"), "analyte", F.struct("d", F.lit(None).cast("int").alias("minute")).alias("sampled"), "extracted")
    rules = spark.createDataFrame([(0, "soil", "1-URGENT", 28, None), (1, "soil", "2-HIGH", None, 6), (2, "soil", "3-MEDIUM", 14, None), (3, "soil", "1-URGENT", 99, None)], "ordinal int, matrix string, analyte string, days int, months int")
    return reconcile.holding(lab, rules).groupBy("analyte", "outcome").agg(F.count("*").alias("n"), F.min("days_held").cast("long").alias("least_days"), F.max("days_held").cast("long").alias("most_days"))


def _lines_with_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_linenumber") % 4 == 1, "ng/L").when(F.col("l_linenumber") % 4 == 2, "µg / L").otherwise("ug/L")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("", F.lit("w"), F.col("l_returnflag")).alias("matrix"), exact.unit_key(unit).alias("unit_key"), F.col("l_orderkey").alias("row"), F.concat_ws("-", "l_suppkey", "l_returnflag").alias("sample_id"), F.col("l_quantity").cast(exact.AMOUNT).alias("amount")
    )


def majority_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.majority_units(_lines_with_units(spark, sf_dir))


def unit_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.unit_outliers(_lines_with_units(spark, sf_dir)).select("sample_id", "matrix", "majority", "n", "first_row", "last_row")


def exact_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities converted exactly and shown without trailing zeros."""
    lines = _lines_with_units(spark, sf_dir)
    converted = (F.col("amount") * exact.unit_factor(F.col("unit_key"))).cast(exact.AMOUNT)
    return lines.groupBy("unit_key", exact.shown(converted).alias("shown")).agg(F.count("*").alias("n"))


def linked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders of one clerk day are blanks of other orders that day; equipment is the customer's last digit."""
    orders = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderkey") % 40 == 0, "rinsate_blank").when(F.col("o_orderkey") % 40 == 1, "field_blank").when(F.col("o_orderkey") % 40 == 2, "trip_blank").otherwise("primary")
    field = orders.select(F.col("o_orderkey").alias("sample_id"), F.struct(F.to_date("o_orderdate").alias("d")).alias("sampled"), (F.col("o_custkey") % 3).cast("string").alias("equipment"), F.col("o_orderstatus").alias("location"), kind.alias("qa_type"))
    return reconcile.linked_samples(field).groupBy("blank", "blank_type").agg(F.count("*").alias("n_linked"), F.min("sample_id").alias("first_sample"))


# --- prose over the events adapter ---------------------------------------------


def fill_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template for each well and its last round; wells without a click result that day get no text."""
    found = results(spark, sf_dir)
    last = found.groupBy("well").agg(F.max("date").alias("date"))
    day = F.concat_ws("|", "well", F.date_format("date", "yyyy-MM-dd"))
    templates = last.select(
        F.col("well").alias("text_id"),
        F.col("well").cast("string").alias("well"),
        F.concat(F.lit("Clicks were {click|"), day, F.lit("}, reported down to {lor|click|"), day, F.lit("}; the value is {limit|purchase|two-part}.")).alias("text"),
    )
    return drafting.fill(templates, found, limits(spark)).select("text_id", "ok", "text", "n_values")


def claim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detected view of a well's last round as a sentence, a third of them off by 0.01."""
    ship(spark)
    found = results(spark, sf_dir)
    views = screening.latest_round(found).where("analyte = 'view' and value is not null")
    said = exact.shown(F.col("value") + F.when(F.col("well") % 3 == 0, Decimal("0.01")).otherwise(Decimal("0")))
    paragraphs = views.select(F.col("well").alias("paragraph_id"), "well", F.concat(F.lit("View was "), said, F.lit(" ug/L on "), F.date_format("date", "yyyy-MM-dd"), F.lit(". The site is polluted.")).alias("text"))
    screened = screening.screen_rounds(found, limits(spark))
    return claims.check(paragraphs, found, screened, ["click", "view", "error", "purchase", "signup"], {"two-part": "two-part rule", "single": "single rule"}).select("paragraph_id", "kind", "status")


QUERIES = {
    "fill_templates": fill_templates,
    "claim_check": claim_check,
    "screen_two_rules": screen_two_rules,
    "screen_limits": screen_limits,
    "rules_agree": rules_agree,
    "detected_counts": detected_counts,
    "latest_round": latest_round,
    "round_change": round_change,
    "kleene_all_by_well": kleene_all_by_well,
    "nearest_value": nearest_value,
    "criteria_bounds": criteria_bounds,
    "three_way_reconcile": three_way_reconcile,
    "missing_ids": missing_ids,
    "compact_id_match": compact_id_match,
    "id_suggestions": id_suggestions,
    "duplicate_rpd": duplicate_rpd,
    "holding_time": holding_time,
    "majority_unit": majority_unit,
    "unit_outliers": unit_outliers,
    "exact_conversion": exact_conversion,
    "linked_samples": linked_samples,
}

_UNIT_LINES = """
  select 'w' || l_returnflag as matrix, case when l_linenumber % 4 = 1 then 'ng/l' else 'ug/l' end as unit_key,
         l_orderkey as row, l_suppkey || '-' || l_returnflag as sample_id, cast(l_quantity as decimal(18,9)) as amount
  from lineitem"""

_SHOWN = "case when contains(cast({0} as varchar), '.') then rtrim(rtrim(cast({0} as varchar), '0'), '.') else cast({0} as varchar) end"

SQL = {
    "fill_templates": f"""
with results as ({RESULTS}), last as (select well, max(date) as date from results group by well),
found as (select l.well, r.lor, case when r.value is null then '<' || {_SHOWN.format('r.lor')} else {_SHOWN.format('r.value')} end as shown
          from last l left join results r on l.well = r.well and l.date = r.date and r.analyte = 'click')
select well as text_id, lor is not null as ok,
       case when lor is not null then 'Clicks were ' || shown || ' ug/L, reported down to {LOR} ug/L; the value is 115 ug/L.' end as text,
       case when lor is not null then 3 else 0 end::bigint as n_values
from found""",
    "claim_check": f"""
with results as ({RESULTS}), last as (select well, max(date) as date from results group by well),
views as (select r.well, r.date, r.value + case when r.well % 3 = 0 then 0.01 else 0 end as said from results r join last l on r.well = l.well and r.date = l.date where r.analyte = 'view' and r.value is not null)
select v.well as paragraph_id, 'result' as kind,
       case when exists (select 1 from results r where r.well = v.well and r.analyte = 'view' and r.date = v.date and r.value = v.said) then 'consistent'
            when exists (select 1 from results r where r.well = v.well and r.analyte = 'view' and r.value = v.said) then 'inconsistent' else 'untraced' end as status
from views v
union all select well, 'judgement', 'not checked' from views""",
    "screen_two_rules": f"with {SCREENED}, {_COMPARED} select * from compared",
    "screen_limits": f"with {SCREENED} select * from screened",
    "rules_agree": f"with {SCREENED}, {_COMPARED} select well, date, count(distinct overall) = 1 as rules_agree from compared group by all",
    "detected_counts": """
with results as (
  select event_type as analyte, event_id, cast(value as decimal(18,9)) >= 5 as found,
         row_number() over (partition by user_id, cast(ts as date), event_type order by ts desc, event_id desc) as k
  from events where user_id is not null and ts is not null and event_type is not null and value is not null)
select 'water' as matrix, analyte, count(*) as n_results, count(*) filter (found) as n_detected,
       count(*) filter (not found) as n_not_detected, min(event_id) as first_row
from results where k = 1 group by analyte""",
    "latest_round": f"""
with results as ({RESULTS}), last as (select well, max(date) as date from results group by well)
select r.well, r.date, count(*) as n_results, count(r.value) as n_detected
from results r join last l on r.well = l.well and r.date = l.date group by all""",
    "round_change": f"""
with results as ({RESULTS})
select a.well, a.analyte, count(*) as n_pairs, count(*) filter (b.value > a.value) as n_rises,
       max(cast(b.value - a.value as double)) as largest_rise, count(*) filter (abs(b.value - a.value) * 2 >= a.value) as n_half_or_more
from results a join results b on a.well = b.well and a.analyte = b.analyte and a.date < b.date and a.value <> b.value
group by all""",
    "kleene_all_by_well": f"""
with results as ({RESULTS})
select well, case when count(*) filter (not value < 200) > 0 then false when count(*) filter (value is null) > 0 then null else true end as all_below
from results group by well""",
    "nearest_value": f"""
with results as ({RESULTS}), stated(id, analyte, number) as (values {', '.join(f"({i}, '{a}', cast({n} as decimal(18,9)))" for i, a, n in STATED)}),
ranked as (
  select s.id, s.analyte, cast(s.number as double) as number, r.well, r.date, cast(r.value as double) as value,
         row_number() over (partition by s.id order by abs(r.value - s.number), r.date, r.well) as k
  from stated s join results r on s.analyte = r.analyte where r.value is not null)
select id, analyte, number, well, date, value from ranked where k = 1""",
    "criteria_bounds": f"""
with results as ({RESULTS}),
lab as (select well || '/' || date as sample_id, analyte, coalesce(value, 0) as low, coalesce(value, lor) as high, value is null as open from results),
pair as (select sample_id, count(*) as n, sum(low) as low, sum(high) as high, count(*) filter (open) as n_open from lab where analyte in ('click', 'view') group by sample_id having count(*) = 2),
compared as (
  select 'pair' as id, sample_id, null as alone, 60 as lim, low, high, n_open from pair
  union all select 'pair', sample_id, analyte, 60, low, high, open::bigint from lab where analyte in ('click', 'view') and sample_id in (select sample_id from pair)
  union all select 'purchase', sample_id, null, 80, low, high, open::bigint from lab where analyte = 'purchase')
select id, sample_id, alone, cast(low as double) as low, cast(high as double) as high, n_open,
       case when low > lim then 'above' when high <= lim then 'not above' else 'not confirmed' end as status,
       low > lim and low <= 1.5 * lim as marginal
from compared""",
    "three_way_reconcile": """
with coc as (select o_orderkey, o_orderstatus = 'P' as hold from orders where o_orderkey % 10 <> 3), field as (select o_orderkey from orders where o_custkey % 2 = 0)
select case when c.o_orderkey is not null and f.o_orderkey is not null then 'matched' when c.o_orderkey is not null then 'not on the field sheet'
            when f.o_orderkey is not null then 'not on the chain of custody' else 'lab only' end as match,
       c.hold, count(*) as n_rows, count(distinct l_orderkey) as n_samples
from lineitem l left join coc c on l.l_orderkey = c.o_orderkey left join field f on l.l_orderkey = f.o_orderkey group by all""",
    "missing_ids": """
with lab as (select distinct l_orderkey as s from lineitem), coc as (select o_orderkey as s, o_orderstatus = 'P' as hold from orders where o_orderkey % 10 <> 3),
field as (select o_orderkey as s from orders where o_custkey % 2 = 0)
select s as sample_id, 'lab file' as present_in, 'chain of custody' as missing_from from lab where s not in (select s from coc)
union all select s, 'chain of custody', 'lab file' from coc where not hold and s not in (select s from lab)
union all select s, 'chain of custody', 'field sheet' from coc where s not in (select s from field)
union all select s, 'field sheet', 'chain of custody' from field where s not in (select s from coc)""",
    "compact_id_match": """
with lab as (select upper(replace(c_name, '#', ' - ')) as lab_id, c_nationkey from customer)
select lab_id, regexp_replace(lower(lab_id), '[^0-9a-z]', '', 'g') as compact, count(*) as n_candidates, min(c_name) as coc_id
from lab l join customer c on l.c_nationkey = c.c_nationkey and regexp_replace(lower(lab_id), '[^0-9a-z]', '', 'g') = regexp_replace(lower(c_name), '[^0-9a-z]', '', 'g')
group by all""",
    "duplicate_rpd": """
with one as (select l_orderkey, l_linenumber as n, cast(max(l_quantity) as decimal(18,9)) as q, cast(max(l_extendedprice) as decimal(18,9)) as p from lineitem where l_linenumber in (1, 2) group by all),
long as (select l_orderkey, n, 'quantity' as analyte, q as v, 2 as l from one union all select l_orderkey, n, 'price', p, 1000 from one),
pairs as (
  select a.l_orderkey, a.analyte, a.v < a.l as a_open, b.v < b.l as b_open, greatest(a.v, a.l) as a, greatest(b.v, b.l) as b, a.l
  from long a join long b on a.l_orderkey = b.l_orderkey and a.analyte = b.analyte and a.n = 1 and b.n = 2)
select l_orderkey, analyte, case when a_open and b_open then 'both not detected' when a + b < 20 * l then 'no limit'
       when abs(a - b) * 200 > 50 * (a + b) then 'investigate' when abs(a - b) * 200 > 30 * (a + b) then 'review' else 'acceptable' end as verdict
from pairs""",
    "holding_time": """
with lab as (select o_orderpriority as analyte, cast(o_orderdate as date) as d, cast(l_shipdate as date) as e from lineitem join orders on l_orderkey = o_orderkey),
judged as (
  select analyte, date_diff('day', d, e) as held,
         case analyte when '1-URGENT' then d + 28 when '2-HIGH' then cast(d + interval 6 month as date) when '3-MEDIUM' then d + 14 end as deadline, e
  from lab)
select analyte, case when deadline is null and analyte not in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'no rule' when e is null then 'no extraction date'
       when held < 0 then 'extracted before sampling' when e > deadline then 'over' else 'within' end as outcome,
       count(*) as n, min(held) as least_days, max(held) as most_days
from judged group by all""",
    "majority_unit": f"""
with lines as ({_UNIT_LINES}), counted as (select matrix, unit_key, count(*) as n, min(row) as first_row from lines group by all)
select matrix, unit_key, n from (select *, row_number() over (partition by matrix order by n desc, first_row) as k from counted) where k = 1""",
    "unit_outliers": f"""
with lines as ({_UNIT_LINES}), counted as (select matrix, unit_key, count(*) as n, min(row) as first_row from lines group by all),
most as (select matrix, unit_key as majority from (select *, row_number() over (partition by matrix order by n desc, first_row) as k from counted) where k = 1)
select sample_id, matrix, majority, count(*) as n, min(row) as first_row, max(row) as last_row from lines join most using (matrix) where unit_key <> majority group by all""",
    "exact_conversion": f"""
with lines as ({_UNIT_LINES}), shown as (select unit_key, case when unit_key = 'ng/l' then amount * 0.001 else amount end as v from lines)
select unit_key, case when contains(cast(v as varchar), '.') then rtrim(rtrim(cast(v as varchar), '0'), '.') else cast(v as varchar) end as shown, count(*) as n from shown group by all""",
    "linked_samples": """
with field as (
  select o_orderkey as s, cast(o_orderdate as date) as d, o_custkey % 3 as equipment, o_orderstatus as loc,
         case o_orderkey % 40 when 0 then 'rinsate_blank' when 1 then 'field_blank' when 2 then 'trip_blank' else 'primary' end as kind
  from orders)
select b.s as blank, b.kind as blank_type, count(*) as n_linked, min(x.s) as first_sample
from field b join field x on b.d = x.d and b.kind <> 'primary' and x.kind = 'primary'
where case b.kind when 'rinsate_blank' then b.equipment = x.equipment when 'field_blank' then b.loc = x.loc else true end
group by all""",
    "id_suggestions": """
with lab as (select upper(replace(c_name, '#', ' - ')) as lab_id, c_nationkey from customer),
fit as (
  select lab_id, c_name as coc_id, count(*) over (partition by lab_id, l.c_nationkey) as n
  from lab l join customer c on l.c_nationkey = c.c_nationkey and regexp_replace(lower(lab_id), '[^0-9a-z]', '', 'g') = regexp_replace(lower(c_name), '[^0-9a-z]', '', 'g'))
select lab_id, coc_id from fit where n = 1""",
}
