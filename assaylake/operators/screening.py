"""Screening of monitoring rounds against guideline limits under several rules.

``results`` is a long table (well, date, analyte, value, lor, file, row) with a
null value for a non-detect. ``limits`` is a small dimension (rule, ordinal,
key, applies_to, members, value) of the guideline documents; its rows become
literals of the plan, and more than ``session.MOST_LISTED`` of them are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions import exact
from assaylake.session import listed

SUM_LOW = "decimal(28,9)"


def last_of_repeats(results: DataFrame, *order: str) -> DataFrame:
    """One row for each (well, date, analyte): the last in file order."""
    rest = [c for c in results.columns if c not in ("well", "date", "analyte")]
    return (
        results.groupBy("well", "date", "analyte")
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
        .select("well", "date", "analyte", *(F.col(f"r.{c}").alias(c) for c in rest))
    )


def screens(limits: DataFrame) -> DataFrame:
    """Every comparison that the rules ask for: each limit, then each member of a sum alone."""
    listed = limits.select("rule", "ordinal", "key", "members", "value", F.lit(None).cast("string").alias("alone"))
    members = limits.where("applies_to = 'sum'").select("rule", (F.col("ordinal") + 1000).alias("ordinal"), "key", F.explode("members").alias("alone"), "value")
    return listed.unionByName(members.select("rule", "ordinal", "key", F.array("alone").alias("members"), "value", "alone"))


def screen_rounds(results: DataFrame, limits: DataFrame) -> DataFrame:
    """(well, date, rule, ordinal, key, alone, low, high, status, above) for each round and screen.

    Sums of members are bounded: a non-detect counts as zero below and as its
    LOR above. A round without one of the members is ``not analysed``.
    ``results`` has one row for each (well, date, analyte).
    """
    rounds = results.groupBy("well", "date").agg(
        F.map_from_entries(F.collect_list(F.struct("analyte", F.struct(F.coalesce("value", F.lit(0).cast(exact.AMOUNT)).alias("low"), F.coalesce("value", "lor").alias("high"))))).alias("found")
    )
    paired = rounds.select("*", F.explode(listed(screens(limits))).alias("s")).select("well", "date", "found", "s.*")

    def total(side: str) -> Column:
        return F.aggregate("members", F.lit(0).cast(SUM_LOW), lambda acc, m: (acc + F.col("found")[m][side]).cast(SUM_LOW))

    analysed = F.forall("members", lambda m: F.map_contains_key("found", m))
    bounded = paired.select("well", "date", "rule", "ordinal", "key", "alone", "value", analysed.alias("analysed"), *(F.when(analysed, total(s)).alias(s) for s in ("low", "high")))
    above = exact.above_bounds(F.col("low"), F.col("high"), F.col("value"))
    status = F.when(~F.col("analysed"), "not analysed").when(above, "above").when(~above, "not above").otherwise("not confirmed")
    return bounded.select("well", "date", "rule", "ordinal", "key", "alone", "value", "low", "high", status.alias("status"), F.when(F.col("analysed"), above).alias("above"))


def compare_rules(screened: DataFrame) -> DataFrame:
    """One verdict for each round and rule; screens that were not analysed don't count."""
    counted = F.col("status") != "not analysed"
    above = F.count_if(counted & F.col("above"))
    open_ = F.count_if(counted & F.col("above").isNull())
    overall = F.when(above > 0, "above").when((F.count_if(counted) > 0) & (open_ == 0), "not above").otherwise("not confirmed")
    return screened.groupBy("well", "date", "rule").agg(
        F.count_if(counted).alias("n_screens"), F.count_if(F.col("status") == "not analysed").alias("n_missing"), above.alias("n_above"), overall.alias("overall")
    )


def rules_agree(compared: DataFrame) -> DataFrame:
    return compared.groupBy("well", "date").agg((F.count_distinct("overall") == 1).alias("rules_agree"))


def latest_round(results: DataFrame) -> DataFrame:
    """All results of each well's last round."""
    last = Window.partitionBy("well")
    return results.withColumn("last_date", F.max("date").over(last)).where("date = last_date").drop("last_date")


def round_changes(results: DataFrame) -> DataFrame:
    """Each earlier and later pair of detected, differing values of one well and analyte.

    The join carries well and analyte as equal keys, so it never becomes a
    product of all rounds.
    """
    detected = results.where("value is not null").select("well", "analyte", "date", "value")
    a, b = detected.toDF("well", "analyte", "date_from", "value_from"), detected.toDF("well", "analyte", "date_to", "value_to")
    pairs = a.join(b, ["well", "analyte"]).where("date_from < date_to and value_from <> value_to")
    return pairs.withColumn("percent", exact.percent_change_half_even(F.col("value_from"), F.col("value_to"))).withColumn(
        "direction", F.when(F.col("value_to") > F.col("value_from"), "rise").otherwise("fall")
    )


def nearest_value(stated: DataFrame, results: DataFrame) -> DataFrame:
    """For each stated number (id, analyte, number) the lab value of that analyte at the least distance."""
    distance = F.abs(F.col("value") - F.col("number"))
    return (
        stated.join(results.where("value is not null"), "analyte")
        .groupBy("id", "analyte", "number")
        .agg(F.min_by(F.struct("well", "date", "value"), F.struct(distance.alias("x"), "date", "well", "value")).alias("n"))
        .select("id", "analyte", "number", "n.well", "n.date", "n.value")
    )


def counts_by_analyte(lab: DataFrame) -> DataFrame:
    """Results by matrix and analyte with how many were detected, in order of first appearance."""
    return lab.groupBy("matrix", "analyte").agg(
        F.count("*").alias("n_results"), F.count_if(F.col("value").isNotNull()).alias("n_detected"), F.count_if(F.col("value").isNull()).alias("n_not_detected"), F.min("row").alias("first_row")
    )


def criteria_comparisons(lab: DataFrame, criteria: DataFrame) -> DataFrame:
    """Each sample against each criterion whose members were all analysed, then each member alone.

    ``criteria``: id, matrix, members, each_member_too, value; a small dimension.
    """
    parts = criteria.select("id", "matrix", "value", F.size("members").alias("n_members"), F.explode("members").alias("analyte"), "each_member_too")
    bounds = lab.select("sample_id", "matrix", "analyte", F.coalesce("value", F.lit(0).cast(exact.AMOUNT)).alias("low"), F.coalesce("value", "lor").alias("high"), F.col("value").isNull().alias("open"))
    joined = bounds.join(parts.withColumnRenamed("value", "limit"), ["matrix", "analyte"])
    whole = joined.groupBy("id", "sample_id", "limit", "n_members").agg(
        F.count("*").alias("n"), F.sum("low").cast(SUM_LOW).alias("low"), F.sum("high").cast(SUM_LOW).alias("high"), F.count_if("open").alias("n_open")
    ).where("n = n_members").select("id", "sample_id", F.lit(None).cast("string").alias("alone"), "limit", "low", "high", "n_open")
    complete = joined.join(whole.select("id", "sample_id"), ["id", "sample_id"], "left_semi")
    alone = complete.where("each_member_too and n_members > 1").select("id", "sample_id", F.col("analyte").alias("alone"), "limit", F.col("low").cast(SUM_LOW).alias("low"), F.col("high").cast(SUM_LOW).alias("high"), F.col("open").cast("long").alias("n_open"))
    both = whole.unionByName(alone)
    above = exact.above_bounds(F.col("low"), F.col("high"), F.col("limit"))
    return both.withColumn("status", F.when(above, "above").when(~above, "not above").otherwise("not confirmed"))


def results_of(results: DataFrame, well, analyte: str | None = None) -> DataFrame:
    """Results of one well in order of date and row, of one analyte in any case or of all.

    An analyte or a well without results is an error that lists those there are.
    """
    for name, value, column in (("well", well, F.col("well")), ("analyte", analyte, F.lower("analyte"))):
        if value is None:
            continue
        wanted = value.lower() if name == "analyte" else value
        if results.where(column == wanted).limit(1).count() == 0:
            known = [str(r[0]) for r in results.select(name).distinct().orderBy(name).limit(50).collect()]
            raise ValueError(f"no {name} {value}; there are {', '.join(known)}")
        results = results.where(column == wanted)
    return results.orderBy("date", "row")


def first_seen(results: DataFrame) -> DataFrame:
    """(analyte, first_row): analytes in the order in which they first appear."""
    return results.groupBy("analyte").agg(F.min("row").alias("first_row")).orderBy("first_row")


def samples_in_order(results: DataFrame) -> DataFrame:
    """(sample_id, rows): the result rows of each sample in file order; a sample has as many as it has analytes."""
    return results.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("row", "analyte"))).alias("rows"))


def detection_limits(results: DataFrame) -> DataFrame:
    """(well, date, lor, analytes, rows): results of a round that share a detection limit."""
    return results.groupBy("well", "date", "lor").agg(F.array_sort(F.collect_set("analyte")).alias("analytes"), F.array_sort(F.collect_list("row")).alias("rows"))
