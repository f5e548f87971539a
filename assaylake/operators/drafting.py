"""Filling placeholders in prose with exact values.

Forms: ``{ANALYTE|WELL|DATE}``, ``{sum A+B|WELL|DATE}``, ``{lor|ANALYTE|WELL|DATE}``,
``{limit|KEY|RULE}`` and ``{change|ANALYTE or sum|WELL|FROM|TO}``. Each
placeholder becomes a row, its fields are resolved by joins with rounds,
results and limits, and the text is put together again in order. A text with
any problem is not filled at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions import exact
from assaylake.sources.site_files import stamp

PLACEHOLDER = r"\{[^{}]*\}"
MOST_PROBLEMS = 10
UNIT = " ug/L"

_MONTH_YEAR = r"^([A-Za-z]{3,9})\.?\s+(\d{4})$"


def date_mention(text: Column) -> Column:
    """STRUCT (y, m, d): a day, or a month with a null day; null if it can't be read."""
    whole = stamp(text)["d"]
    month = stamp(F.regexp_replace(F.trim(text), _MONTH_YEAR, "1 $1 $2"))["d"]
    read = F.when(F.trim(text).rlike(_MONTH_YEAR), month).otherwise(whole)
    day = F.when(~F.trim(text).rlike(_MONTH_YEAR), F.day(read))
    return F.when(read.isNotNull(), F.struct(F.year(read).alias("y"), F.month(read).alias("m"), day.alias("d")))


def on_date(mention: Column, date: Column) -> Column:
    return (F.year(date) == mention["y"]) & (F.month(date) == mention["m"]) & (mention["d"].isNull() | (F.day(date) == mention["d"]))


def placeholders(templates: DataFrame) -> DataFrame:
    """(text_id, well, pos, body, head, fields) for each placeholder of (text_id, well, text)."""
    found = templates.select("text_id", "well", F.posexplode(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))).alias("pos", "body"))
    fields = F.transform(F.split(F.substring("body", F.lit(2), F.length("body") - 2), r"\|"), lambda f: F.trim(f))
    first = F.lower(fields[0])
    head = F.when(first.isin("limit", "lor", "change"), first).otherwise("result")
    rest = F.when(head == "result", fields).otherwise(F.slice(fields, 2, 10))
    return found.select("text_id", "well", "pos", "body", head.alias("head"), rest.alias("f"), (F.size(fields) == F.when(head == "lor", 4).when(head == "change", 5).otherwise(3)).alias("shaped"))


def _members(quantity: Column) -> Column:
    """Names of a quantity in lower case: the parts of ``sum A+B`` or ``A+B``, else the one analyte."""
    return F.transform(F.split(F.regexp_replace(F.lower(F.trim(quantity)), r"^sum\s+(of\s+)?", ""), r"\+"), lambda x: F.trim(x))


def resolve(found: DataFrame, results: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``fill`` or ``problem`` to each placeholder.

    ``results`` has one row for each (well, date, analyte); its well is a
    string here. A month must match one round of the well.
    """
    limit_rows = limits.select("rule", F.lower("key").alias("key"), F.col("value").alias("limit"))
    by_limit = (
        found.where("head = 'limit' and shaped")
        .join(limit_rows, (F.lower(F.array_join(_members(F.col("f")[0]), "+")) == F.col("key")) & (F.lower(F.col("f")[1]) == F.lower("rule")), "left")  # the guideline documents, a few dozen rows
        .select("text_id", "pos", F.concat(exact.shown(F.col("limit")), F.lit(UNIT)).alias("fill"), F.when(F.col("limit").isNull(), "the rule has no value of that key").alias("problem"))
    )
    asked = found.where("head <> 'limit' and shaped").select("text_id", "pos", "head", F.col("well").cast("string").alias("well"), "f", _members(F.col("f")[0]).alias("names"), F.posexplode(F.when(F.col("head") == "change", F.slice("f", 3, 2)).otherwise(F.slice("f", 3, 1))).alias("side", "when"))
    asked = asked.withColumn("mention", date_mention(F.col("when"))).withColumn("own_well", F.col("f")[1] == F.col("well"))
    rounds = results.select(F.col("well").cast("string").alias("well"), "date").distinct()
    r = rounds.toDF("r_well", "date")
    at = asked.join(r, (F.col("well") == F.col("r_well")) & on_date(F.col("mention"), F.col("date")), "left").groupBy("text_id", "pos", "side").agg(
        F.first("head").alias("head"), F.first("well").alias("well"), F.first("names").alias("names"), F.first("own_well").alias("own_well"), F.first("mention").alias("mention"), F.count("date").alias("n_rounds"), F.max("date").alias("date")
    )
    lab = results.select(F.col("well").cast("string").alias("l_well"), F.col("date").alias("l_date"), F.lower("analyte").alias("name"), "value", "lor")
    parts = at.select("*", F.explode("names").alias("want")).join(lab, (F.col("well") == F.col("l_well")) & (F.col("date") == F.col("l_date")) & (F.col("want") == F.col("name")), "left")
    sides = parts.groupBy("text_id", "pos", "side").agg(
        F.first("head").alias("head"),
        F.size(F.first("names")).alias("n_names"),
        F.first("own_well").alias("own_well"),
        F.first("mention").isNotNull().alias("readable"),
        F.first("n_rounds").alias("n_rounds"),
        F.first("date").alias("date"),
        F.count("lor").alias("n_analysed"),
        F.count("value").alias("n_detected"),
        F.sum("value").alias("total"),
        F.max("lor").alias("lor"),
    )
    wrong = (
        F.when(~F.col("own_well"), "the placeholder names another well")
        .when(~F.col("readable"), "the date can't be read")
        .when(F.col("n_rounds") == 0, "there is no round on that date")
        .when(F.col("n_rounds") > 1, "the date matches more than one round")
        .when(F.col("n_analysed") < F.col("n_names"), "an analyte was not analysed in that round")
        .when((F.col("head") == "lor") & (F.col("n_names") > 1), "a sum has no detection limit")
        .when((F.col("n_detected") < F.col("n_names")) & ((F.col("n_names") > 1) | (F.col("head") == "change")), "a part was not detected, so there is no single value")
    )
    sides = sides.withColumn("problem", wrong)
    joined = sides.groupBy("text_id", "pos").agg(
        F.first("head").alias("head"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("side"))).alias("problem"),
        F.min_by("total", "side").alias("before"),
        F.max_by("total", "side").alias("after"),
        F.min_by("lor", "side").alias("lor"),
        F.min_by("date", "side").alias("date_from"),
        F.max_by("date", "side").alias("date_to"),
    )
    change = F.col("after") - F.col("before")
    percent = exact.percent_change_half_even(F.col("before").cast(exact.AMOUNT), F.col("after").cast(exact.AMOUNT))
    moved = F.concat(F.when(change > 0, "a rise of ").otherwise("a fall of "), exact.shown(F.abs(change)), F.lit(UNIT), F.coalesce(F.concat(F.lit(" ("), F.abs(percent).cast("string"), F.lit("%)")), F.lit("")))
    fill = (
        F.when(F.col("head") == "lor", F.concat(exact.shown(F.col("lor")), F.lit(UNIT)))
        .when(F.col("head") == "change", F.when(change == 0, F.concat(F.lit("no change ("), exact.shown(F.col("before")), F.lit(UNIT + " in both rounds)"))).otherwise(moved))
        .when(F.col("after").isNull(), F.concat(F.lit("<"), exact.shown(F.col("lor")), F.lit(UNIT)))
        .otherwise(F.concat(exact.shown(F.col("after")), F.lit(UNIT)))
    )
    order = F.when((F.col("head") == "change") & (F.col("date_from") >= F.col("date_to")), "the earlier round comes first, and the two differ")
    values = joined.select("text_id", "pos", fill.alias("fill"), F.coalesce("problem", order).alias("problem"))
    shape = found.where("not shaped").select("text_id", "pos", F.lit(None).cast("string").alias("fill"), F.lit("the number of fields is wrong").alias("problem"))
    solved = by_limit.unionByName(values).unionByName(shape)
    return found.join(solved, ["text_id", "pos"], "left").withColumn("problem", F.when(F.col("fill").isNull() & F.col("problem").isNull(), "the value can't be read").otherwise(F.col("problem")))


def fill(templates: DataFrame, results: DataFrame, limits: DataFrame) -> DataFrame:
    """(text_id, ok, text, problems, n_values): all placeholders of a text filled, or none of them."""
    solved = resolve(placeholders(templates), results, limits)
    by_text = solved.groupBy("text_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "fill"))), lambda x: F.coalesce(x["fill"], F.lit(""))).alias("fills"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("pos", "body", "problem")))), lambda x: F.concat(x["body"], F.lit(": "), x["problem"])), 1, MOST_PROBLEMS).alias("problems"),
    )
    between = F.split("text", PLACEHOLDER)
    stray = F.exists(between, lambda p: p.rlike(r"[{}]"))
    joined = templates.join(by_text, "text_id", "left").withColumn("between", between).withColumn("stray", stray)
    problems = F.concat(F.coalesce("problems", F.array().cast("array<string>")), F.when(F.col("stray"), F.array(F.lit("a brace is not part of a placeholder"))).otherwise(F.array().cast("array<string>")))
    problems = F.when(F.col("fills").isNull() & ~F.col("stray"), F.array(F.lit("there is no placeholder"))).otherwise(problems)
    text = F.array_join(F.zip_with("between", "fills", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    ok = F.size("p") == 0
    return joined.withColumn("p", problems).select("text_id", ok.alias("ok"), F.when(ok, text).alias("text"), F.col("p").alias("problems"), F.when(ok, F.size("fills")).otherwise(0).cast("long").alias("n_values"))


def offsets(solved: DataFrame, templates: DataFrame) -> DataFrame:
    """(text_id, pos, start, end): where each value lies in its filled text."""
    pieces = templates.select("text_id", F.posexplode(F.split("text", PLACEHOLDER)).alias("pos", "before"))
    joined = solved.join(pieces, ["text_id", "pos"])
    earlier = Window.partitionBy("text_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("before") + F.length("fill")).over(earlier), F.lit(0)) + F.length("before")
    return joined.select("text_id", "pos", start.alias("start"), (start + F.length("fill")).alias("end"))


def numbered_sources(solved: DataFrame) -> DataFrame:
    """(text_id, pos, kind, reference, source): sources numbered from 1 by first use, one number for each (kind, reference) of a text."""
    kind = F.when(F.col("head") == "limit", "guideline").otherwise("laboratory")
    rows = solved.select("text_id", "pos", kind.alias("kind"), F.lower(F.array_join("f", "|")).alias("reference"))
    first = rows.withColumn("first", F.min("pos").over(Window.partitionBy("text_id", "kind", "reference")))
    return first.select("text_id", "pos", "kind", "reference", F.dense_rank().over(Window.partitionBy("text_id").orderBy("first")).alias("source"))


#: Stands for a filled value while the text around it is redacted; too long for the parts of a name to be joined by it.
_GAP = "\ue000" * 9


def fill_redacted(templates: DataFrame, results: DataFrame, limits: DataFrame, redact) -> DataFrame:
    """:func:`fill` with identifiers masked by a redactor; filled values are never changed, and ``counts`` says what was masked."""
    masked = templates.withColumn("r", redact(F.array_join(F.split("text", PLACEHOLDER), _GAP)))
    around = F.split("r.text", _GAP)
    bodies = F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0))
    again = F.array_join(F.zip_with(around, bodies, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    rewritten = masked.select("text_id", "well", again.alias("text"), F.col("r.counts").alias("counts"))
    return fill(rewritten.drop("counts"), results, limits).join(rewritten.select("text_id", "counts"), "text_id")
