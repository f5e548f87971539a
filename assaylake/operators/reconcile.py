"""Relational quality checks over lab results, chain of custody and field sheet.

``lab``: file, row, sample_id, sampled (d, minute, written), matrix, analyte,
value, lor, unit_key, unit_written, extracted. ``coc``: row, sample_id, sampled,
matrix, hold. ``field``: row, sample_id, sampled, location, equipment, qa_type,
parent_sample, matrix. Each check is a DataFrame of findings or of classified
pairs; row order is carried as (file, row), never taken from partitions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions import exact
from assaylake.session import cut

#: Thresholds of the duplicate and blank checks (fixed values).
RPD_REVIEW, RPD_INVESTIGATE, LOR_MULTIPLE, MARGINAL = 30, 50, 10, "1.5"

BLANKS = ("rinsate_blank", "field_blank", "trip_blank", "container_blank")

#: Analytes of the holding rules (fixed values).
FLUORINATED = ("PFOS", "PFHxS", "PFOA", "PFHxA", "PFBS", "PFBA", "PFPeA", "PFHpA", "PFNA", "PFDA", "PFPeS", "PFHpS", "4:2 FTS", "6:2 FTS", "8:2 FTS")
STABLE_METALS = ("Arsenic", "Cadmium", "Chromium (total)", "Copper", "Lead", "Nickel", "Zinc")

#: Holding times by ordinal: matrix, analytes, days, months (fixed values).
HOLDING = (
    ("soil", ("Mercury",), 28, None),
    ("soil", STABLE_METALS, None, 6),
    ("soil", FLUORINATED, 28, None),
    ("water", FLUORINATED, 14, None),
)


def three_way(lab: DataFrame, coc: DataFrame, field: DataFrame) -> DataFrame:
    """Lab rows with their custody and field rows on the exact sample id, and where the sample is listed."""
    joined = lab.join(coc.select("sample_id", F.col("row").alias("coc_row"), "hold"), "sample_id", "left").join(
        field.select("sample_id", F.col("row").alias("field_row"), "qa_type"), "sample_id", "left"
    )
    status = (
        F.when(F.col("coc_row").isNotNull() & F.col("field_row").isNotNull(), "matched")
        .when(F.col("coc_row").isNotNull(), "not on the field sheet")
        .when(F.col("field_row").isNotNull(), "not on the chain of custody")
        .otherwise("lab only")
    )
    return joined.withColumn("match", status)


def missing_ids(lab: DataFrame, coc: DataFrame, field: DataFrame) -> DataFrame:
    """(sample_id, present_in, missing_from): the four one-sided differences; held samples need no lab result."""
    ids = {"lab file": lab.select("sample_id").distinct(), "chain of custody": coc.select("sample_id"), "field sheet": field.select("sample_id")}
    sides = (
        ("lab file", "chain of custody", ids["lab file"]),
        ("chain of custody", "lab file", coc.where("not hold").select("sample_id")),
        ("chain of custody", "field sheet", ids["chain of custody"]),
        ("field sheet", "chain of custody", ids["field sheet"]),
    )
    out = None
    for here, there, rows in sides:
        part = rows.join(ids[there], "sample_id", "left_anti").select("sample_id", F.lit(here).alias("present_in"), F.lit(there).alias("missing_from"))
        out = part if out is None else out.unionByName(part)
    return out


def suggestions(lab: DataFrame, coc: DataFrame) -> DataFrame:
    """(lab_id, coc_id): a lab id and the one open custody id that agrees in all but punctuation.

    Candidates agree in compact id, matrix and stamp. A lab id is matched only
    where exactly one candidate is open, and a taken candidate is closed to
    later lab ids, so order matters; it does so within one block of
    (compact id, matrix, day), which holds a handful of spellings of one
    sample, and each block is one small group.
    """
    first = lab.groupBy("sample_id").agg(F.min_by(F.struct("sampled", "matrix", "row"), F.struct("file", "row")).alias("f")).select("sample_id", "f.*")
    alone = first.join(coc.select("sample_id"), "sample_id", "left_anti")
    open_ = coc.where("not hold").join(lab.select("sample_id").distinct(), "sample_id", "left_anti")

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(exact.compact_id(F.col("sample_id")).alias("compact"), "matrix", F.col("sampled.d").alias("d"), F.col("sampled.minute").alias("minute"), "sample_id", "row", F.lit(side).alias("side"))

    def match(block: pd.DataFrame) -> pd.DataFrame:
        free = list(block[block["side"] == "coc"].sort_values("row").itertuples())
        out = []
        for mine in block[block["side"] == "lab"].sort_values("row").itertuples():
            fit = [c for c in free if pd.isna(c.minute) or pd.isna(mine.minute) or c.minute == mine.minute]
            if len(fit) == 1:
                free.remove(fit[0])
                out.append((mine.sample_id, fit[0].sample_id))
        return pd.DataFrame(out, columns=["lab_id", "coc_id"])

    both = keyed(alone, "lab").unionByName(keyed(open_, "coc"))
    own = Window.partitionBy("compact", "matrix", "d")
    sized = both.withColumns({"n_lab": F.count_if(F.col("side") == "lab").over(own), "n_coc": F.count_if(F.col("side") == "coc").over(own)}).where("n_lab > 0 and n_coc > 0")
    held = cut(sized, "id-blocks")
    # a lab id that is alone in its block needs no order, and most are
    lab_of = F.max(F.when(F.col("side") == "lab", F.struct("sample_id", "minute"))).over(own)
    met = held.where("n_lab = 1").withColumn("mine", lab_of).where("side = 'coc'").where(F.col("minute").isNull() | F.col("mine.minute").isNull() | (F.col("minute") == F.col("mine.minute")))
    found = met.groupBy("compact", "matrix", "d").agg(F.count("*").alias("n"), F.max("mine.sample_id").alias("lab_id"), F.max("sample_id").alias("coc_id"))
    pairs = found.where("n = 1").select("lab_id", "coc_id")
    several = held.where("n_lab > 1").drop("n_lab", "n_coc")
    return pairs.unionByName(several.groupBy("compact", "matrix", "d").applyInPandas(match, "lab_id string, coc_id string"))


def date_conflicts(lab: DataFrame, coc: DataFrame, field: DataFrame) -> DataFrame:
    """(sample_id, n_days, n_minutes): custody samples whose stamps disagree.

    Compared are the custody stamp, the first lab stamp, the lab stamps that
    disagree with that first one, and the field stamp.
    """
    in_order = Window.partitionBy("sample_id").orderBy("file", "row")
    seen = lab.select("sample_id", "sampled", F.first("sampled").over(in_order).alias("first"), F.row_number().over(in_order).alias("k"))
    stamps = (
        coc.select("sample_id", "sampled")
        .unionByName(seen.where((F.col("k") == 1) | ~exact.stamps_agree(F.col("sampled"), F.col("first"))).select("sample_id", "sampled"))
        .unionByName(field.select("sample_id", "sampled"))
    )
    return (
        stamps.join(coc.select("sample_id"), "sample_id", "left_semi")
        .groupBy("sample_id")
        .agg(F.count_distinct("sampled.d").alias("n_days"), F.count_distinct("sampled.minute").alias("n_minutes"))
        .where("n_days > 1 or n_minutes > 1")
    )


def majority_units(lab: DataFrame) -> DataFrame:
    """(matrix, unit_key, n): the commonest unit of each matrix; ties prefer the canonical one, then the first seen."""
    canonical = F.col("unit_key") == exact.unit_key(exact.literal_map(exact.CANONICAL_UNIT)[F.col("matrix")])
    counted = lab.groupBy("matrix", "unit_key").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))
    return counted.groupBy("matrix").agg(F.max_by(F.struct("unit_key", "n"), F.struct("n", canonical.cast("int"), -F.col("first_row"))).alias("m")).select("matrix", "m.unit_key", "m.n")


def unit_outliers(lab: DataFrame) -> DataFrame:
    """Results in another unit than the majority of their matrix, by sample."""
    most = majority_units(lab).select("matrix", F.col("unit_key").alias("majority"))
    return (
        lab.join(most, "matrix")  # one row for each matrix
        .where("unit_key <> majority")
        .groupBy("sample_id", "matrix", "majority")
        .agg(F.count("*").alias("n"), F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("unit_key").alias("unit_key"))
    )


def pair_verdict(a, b, a_open, b_open, lor, review: int = RPD_REVIEW, investigate: int = RPD_INVESTIGATE, lor_multiple: int = LOR_MULTIPLE):
    """Class of one duplicate pair by cross-multiplied differences."""
    return (
        F.when(a_open & b_open, "both not detected")
        .when(a + b < 2 * lor_multiple * lor, "no limit")
        .when(exact.exceeds_rpd(a, b, investigate), "investigate")
        .when(exact.exceeds_rpd(a, b, review), "review")
        .otherwise("acceptable")
    )


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with p_value, p_lor, d_value, d_lor classified; a non-detect takes its LOR."""
    a, b = F.coalesce("p_value", "p_lor"), F.coalesce("d_value", "d_lor")
    lor = F.greatest("p_lor", "d_lor")
    return pairs.withColumn("verdict", pair_verdict(a, b, F.col("p_value").isNull(), F.col("d_value").isNull(), lor)).withColumn("rpd", exact.rpd_half_up(a, b))


def duplicates(lab: DataFrame, field: DataFrame) -> DataFrame:
    """Every analyte of both samples of each field duplicate, classified."""
    pairs = field.where("qa_type = 'field_duplicate'").select(F.col("sample_id").alias("duplicate"), F.col("parent_sample").alias("parent"))
    p = lab.select(F.col("sample_id").alias("parent"), "analyte", F.col("value").alias("p_value"), F.col("lor").alias("p_lor"), F.col("row").alias("p_row"))
    d = lab.select(F.col("sample_id").alias("duplicate"), "analyte", F.col("value").alias("d_value"), F.col("lor").alias("d_lor"), F.col("row").alias("d_row"))
    return classify_pairs(pairs.join(p, "parent").join(d, ["duplicate", "analyte"]))


def unpaired(lab: DataFrame, field: DataFrame) -> DataFrame:
    """Analytes of a duplicate pair that only one of its samples has."""
    pairs = field.where("qa_type = 'field_duplicate'").select(F.col("sample_id").alias("duplicate"), F.col("parent_sample").alias("parent"))
    p, d = (pairs.join(lab.select(F.col("sample_id").alias(side), "analyte", "row"), side) for side in ("parent", "duplicate"))
    keys = ["parent", "duplicate", "analyte"]
    return p.join(d, keys, "left_anti").withColumn("has", F.col("parent")).unionByName(d.join(p, keys, "left_anti").withColumn("has", F.col("duplicate")))


def holding_rules(spark) -> DataFrame:
    rows = [(i, m, a, d, n) for i, (m, names, d, n) in enumerate(HOLDING) for a in names]
    return spark.createDataFrame(rows, "ordinal int, matrix string, analyte string, days int, months int")


def holding(lab: DataFrame, rules: DataFrame) -> DataFrame:
    """Days from sampling to extraction against the first rule for the matrix and analyte.

    The last allowed day is within the time; months end on the clamped day of
    the calendar; extraction before sampling is an error in one of the dates.
    """
    first = rules.groupBy("matrix", "analyte").agg(F.min_by(F.struct("days", "months"), "ordinal").alias("r")).select("matrix", "analyte", "r.*")
    joined = lab.join(first.withColumn("has_rule", F.lit(True)), ["matrix", "analyte"], "left")  # a few dozen rules
    sampled = F.col("sampled.d")
    deadline = F.when(F.col("days").isNotNull(), F.date_add(sampled, F.col("days"))).otherwise(F.add_months(sampled, F.col("months")))
    held = F.datediff("extracted", sampled)
    outcome = (
        F.when(F.col("has_rule").isNull(), "no rule")
        .when(F.col("extracted").isNull(), "no extraction date")
        .when(held < 0, "extracted before sampling")
        .when(F.col("extracted") > deadline, "over")
        .otherwise("within")
    )
    return joined.withColumn("days_held", held).withColumn("deadline", deadline).withColumn("outcome", outcome).drop("has_rule")


def linked_samples(field: DataFrame) -> DataFrame:
    """(blank, sample_id): samples of a blank's day that share its equipment, its location, or only the day."""
    b = field.where(F.col("qa_type").isin(*BLANKS)).select(F.col("sample_id").alias("blank"), F.col("qa_type").alias("blank_type"), F.col("sampled.d").alias("d"), F.lower(F.trim("equipment")).alias("b_equipment"), F.col("location").alias("b_location"))
    s = field.where(~F.col("qa_type").isin(*BLANKS)).select("sample_id", F.col("sampled.d").alias("d"), F.lower(F.trim("equipment")).alias("equipment"), "location")
    shares = (
        F.when(F.col("blank_type") == "rinsate_blank", (F.col("b_equipment") != "") & (F.col("b_equipment") == F.col("equipment")))
        .when(F.col("blank_type") == "field_blank", (F.col("b_location") != "") & (F.col("b_location") == F.col("location")))
        .otherwise(True)
    )
    return b.join(s, "d").where(shares).select("blank", "blank_type", "sample_id")


def blank_detections(lab: DataFrame, field: DataFrame) -> DataFrame:
    """Detected results in blanks with their multiple of the LOR."""
    blanks = field.where(F.col("qa_type").isin(*BLANKS)).select("sample_id", "qa_type")
    return lab.where("value is not null").join(blanks, "sample_id").select("sample_id", "qa_type", "analyte", "value", "lor", exact.ratio_half_up(F.col("value"), F.col("lor")).alias("times_lor"), "row")


def marginal(comparisons: DataFrame) -> DataFrame:
    """Comparisons above their criterion by no more than the marginal factor."""
    return comparisons.withColumn("marginal", (F.col("status") == "above") & (F.col("low") <= F.lit(MARGINAL).cast("decimal(3,1)") * F.col("limit")))


def unconfirmed_limits(comparisons: DataFrame, field: DataFrame) -> DataFrame:
    """Comparisons of samples that aren't blanks in which a non-detect leaves a bound open."""
    blanks = field.where(F.col("qa_type").isin(*BLANKS)).select("sample_id")
    return comparisons.where("n_open > 0").join(blanks, "sample_id", "left_anti")


#: Findings of one check whose draft orders lie in one block of this length are numbered by one task.
BLOCK = 65_536


def number_findings(findings: DataFrame) -> DataFrame:
    """Global numbers from 1 by (check_order, draft_order).

    Findings are numbered within blocks of draft orders; a block starts after
    the counts of all blocks before it, so only counts are ordered as a whole.
    Draft orders are whole numbers, one for each finding of a check.
    """
    blocked = findings.withColumn("block", F.floor(F.col("draft_order") / BLOCK))
    before = Window.orderBy("check_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy("check_order", "block").agg(F.count("*").alias("n")).select("check_order", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("check_order", "block").orderBy("draft_order"))
    return blocked.join(starts, ["check_order", "block"]).withColumn("number", F.col("start") + within).drop("block", "start")


def longest_held(held: DataFrame) -> DataFrame:
    """The result that waited longest over its time, for each matrix and analyte; the first row on ties."""
    over = held.where("outcome = 'over'")
    most = F.max_by(F.struct("sample_id", "row", "days_held", "deadline"), F.struct("days_held", -F.col("row")))
    return over.groupBy("matrix", "analyte").agg(F.count("*").alias("n_over"), most.alias("m")).select("matrix", "analyte", "n_over", "m.*")


def related(findings: DataFrame) -> DataFrame:
    """Findings (number, samples) that share a sample, as arrays of numbers."""
    by_sample = findings.select("number", F.explode("samples").alias("sample"))
    pairs = by_sample.join(by_sample.toDF("other", "sample"), "sample").where("number <> other")
    return pairs.groupBy("number").agg(F.sort_array(F.collect_set("other")).alias("related"))
