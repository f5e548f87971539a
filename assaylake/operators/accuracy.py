"""How well retrieval, independent checks and tests agree with what is expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.session import listed

#: Ranks that count as hits (fixed values).
FIRST, TOP, LIVE = 1, 5, 8


def on_target(found_page: Column, found_section: Column, page: Column, section: Column) -> Column:
    """A target is a page, or a section with all that lies below it."""
    by_section = (found_section == section) | found_section.startswith(F.concat(section, F.lit(" > ")))
    return F.coalesce(F.when(page.isNotNull(), found_page == page).otherwise(by_section), F.lit(False))


def retrieval_rates(questions: DataFrame, targets: DataFrame, found: DataFrame) -> DataFrame:
    """Hits and recall over all questions and for each group; the total has a null group.

    ``questions``: qid, grp, in_scope. ``targets``: qid, doc, page, section.
    ``found``: qid, rank, doc, page, section, the first 8 counting. A question
    out of scope is right if nothing was found. Recall is the share of a
    question's targets on which something was found, averaged to two places;
    a question without targets recalls nothing.
    """
    goals = targets.distinct()
    live = found.where(F.col("rank") <= LIVE)
    f = live.select("qid", "rank", "doc", F.col("page").alias("f_page"), F.col("section").alias("f_section"))
    hit = goals.join(f, ["qid", "doc"]).where(on_target(F.col("f_page"), F.col("f_section"), F.col("page"), F.col("section")))
    firsts = hit.groupBy("qid").agg(F.min("rank").alias("first"), F.count_distinct("doc", F.coalesce(F.col("page").cast("string"), F.lit("")), F.coalesce("section", F.lit(""))).alias("n_hit"))
    goals_per = goals.groupBy("qid").agg(F.count("*").alias("n_goals"))
    any_found = live.select("qid").distinct().withColumn("any", F.lit(True))
    joined = questions.join(firsts, "qid", "left").join(goals_per, "qid", "left").join(any_found, "qid", "left")
    inside = F.col("in_scope")
    share = F.when(inside, F.coalesce(F.col("n_hit") / F.col("n_goals"), F.lit(0.0)))
    rolled = joined.withColumn("share", share).rollup("grp").agg(
        F.grouping("grp").alias("g"),
        F.count_if(inside).alias("n_in_scope"),
        F.count_if(inside & (F.col("first") <= FIRST)).alias("hit1"),
        F.count_if(inside & (F.col("first") <= TOP)).alias("hit5"),
        F.count_if(inside & (F.col("first") <= LIVE)).alias("hit8"),
        F.bround(F.avg("share"), 2).alias("recall8"),
        F.count_if(~inside).alias("n_out_of_scope"),
        F.count_if(~inside & F.col("any").isNull()).alias("n_right_out_of_scope"),
    )
    return rolled.select(F.when(F.col("g") == 0, F.col("grp")).alias("grp"), (F.col("g") == 1).alias("is_total"), "n_in_scope", "hit1", "hit5", "hit8", "recall8", "n_out_of_scope", "n_right_out_of_scope")


def without(found: DataFrame, near_copies: DataFrame) -> DataFrame:
    """Questions or results less those listed as near copies (qid)."""
    return found.join(near_copies.select("qid"), "qid", "left_anti")


CONFIRMED = "confirmed"


def compare_passes(values: DataFrame, passes: DataFrame) -> DataFrame:
    """Each value (key, value) beside its verdict and reading in every pass (pass, key, verdict, reading).

    ``both_confirm`` needs a confirming verdict of every pass; ``matches`` needs
    every reading to equal the value on file. A pass without the key reads as
    ``not checked``. A key that a pass holds twice keeps all its verdicts
    against it: it confirms only if each does.
    """
    names = passes.select("pass").distinct()
    wanted = values.select("*", F.explode(listed(names)).alias("p")).select(*values.columns, "p.pass")
    judged = passes.groupBy("pass", "key").agg(F.min(F.when(F.col("verdict") == CONFIRMED, 1).otherwise(0)).alias("ok"), F.min("verdict").alias("verdict"), F.collect_set("reading").alias("readings"))
    joined = wanted.join(judged, ["pass", "key"], "left")
    same = (F.size("readings") == 1) & (F.element_at(F.when(F.size("readings") > 0, F.col("readings")), 1) == F.col("value"))
    rows = joined.select("key", "value", F.struct("pass", F.coalesce("verdict", F.lit("not checked")).alias("verdict")).alias("v"), F.coalesce(F.col("ok") == 1, F.lit(False)).alias("ok"), F.coalesce(same, F.lit(False)).alias("same"))
    return rows.groupBy("key", "value").agg(F.array_sort(F.collect_list("v")).alias("verdicts"), F.bool_and("ok").alias("both_confirm"), F.bool_and("same").alias("matches"))


def unplaced(values: DataFrame, passes: DataFrame) -> DataFrame:
    """(pass, key, problem): keys of a pass that no value has, and keys that a pass holds twice."""
    twice = passes.groupBy("pass", "key").count().where("count > 1").select("pass", "key", F.lit("repeated").alias("problem"))
    return passes.join(values.select("key"), "key", "left_anti").select("pass", "key", F.lit("not a value on file").alias("problem")).distinct().unionByName(twice)


def pass_counts(compared: DataFrame) -> DataFrame:
    """One row: n_values, n_confirmed, n_not_confirmed, n_differs."""
    ok = F.col("both_confirm")
    return compared.agg(F.count("*").alias("n_values"), F.count_if(ok).alias("n_confirmed"), F.count_if(~ok).alias("n_not_confirmed"), F.count_if(~F.col("matches")).alias("n_differs"))


def test_areas(cases: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, n_passed, n_failed, n_skipped) of test cases (classname, name, failed, errored, skipped_type).

    ``areas``: module, area; a module of none is ``other``. A test that was
    expected to fail counts as failed, as do errors. ``skipped_type`` is null
    for a test that ran.
    """
    module = F.element_at(F.split("classname", r"\."), -1)
    failed = F.coalesce("failed", F.lit(False)) | F.coalesce("errored", F.lit(False)) | F.coalesce(F.col("skipped_type") == "pytest.xfail", F.lit(False))
    known = cases.withColumn("module", module).join(areas, "module", "left")  # a line for each test module
    skipped = ~failed & F.col("skipped_type").isNotNull()
    return known.groupBy(F.coalesce("area", F.lit("other")).alias("area")).agg(F.count_if(~failed & ~skipped).alias("n_passed"), F.count_if(failed).alias("n_failed"), F.count_if(skipped).alias("n_skipped"))


NOT_CHECKED, MISMATCH = "not checked", "mismatch"


def split_verdict(verdict: Column, value_confirmed: Column, reason: Column, note_verdict: Column, about_note: str) -> Column:
    """STRUCT (value, note) of one verdict: a mismatch that confirms the value and whose reason holds ``about_note`` is about the note."""
    only_note = F.coalesce((verdict == MISMATCH) & value_confirmed & reason.contains(about_note), F.lit(False))
    return F.struct(F.when(only_note, CONFIRMED).otherwise(verdict).alias("value"), F.when(only_note, MISMATCH).otherwise(note_verdict).alias("note"))


def doubted_notes(notes: DataFrame, passes: DataFrame) -> DataFrame:
    """(key, note, checked_note, changed): notes that changed since a first pass read them, or that one didn't confirm.

    ``notes``: key, note. ``passes``: pass, key, verdict on the note (null: it
    gave none), checked_note (null: it quoted none). What the passes judged is
    the wording that the last of them quoted, by the order of their names.
    """
    read = passes.groupBy("key").agg(F.max_by("checked_note", F.when(F.col("checked_note").isNotNull(), F.col("pass"))).alias("checked_note"), F.max(F.coalesce(F.col("verdict") != CONFIRMED, F.lit(False))).alias("doubted"))
    changed = F.col("checked_note").isNotNull() & ~F.col("checked_note").eqNullSafe(F.col("note"))
    return notes.join(read, "key").withColumn("changed", changed).where("changed or doubted").select("key", "note", "checked_note", "changed")


def recheck_verdicts(notes: DataFrame, rechecks: DataFrame) -> DataFrame:
    """(key, recheck, verdict, reason, current, confirmed_by_all): each note beside every re-check, however many there are.

    ``rechecks``: recheck, key, verdict, reason, checked_note. One that didn't
    look at a note has ``not checked``. ``current`` tells whether it judged the
    wording on file; a note is confirmed by all if each re-check confirmed its
    current wording, and by none if there is no re-check. Names of re-checks
    become literals of the plan, so notes are not multiplied by a join.
    """
    named = notes.select("key", "note", F.explode(listed(rechecks.select("recheck").distinct())).alias("r")).select("key", "note", "r.recheck")
    met = named.join(rechecks.select("recheck", "key", "verdict", "reason", "checked_note"), ["recheck", "key"], "left")
    verdict, current = F.coalesce("verdict", F.lit(NOT_CHECKED)), F.coalesce(F.col("checked_note") == F.col("note"), F.lit(False))
    rows = met.select("key", "recheck", verdict.alias("verdict"), F.coalesce("reason", F.lit("")).alias("reason"), current.alias("current"))
    every = rows.groupBy("key").agg(F.bool_and((F.col("verdict") == CONFIRMED) & F.col("current")).alias("confirmed_by_all"))
    return rows.join(every, "key")


def recheck_problems(notes: DataFrame, passes: DataFrame, rechecks: DataFrame, resolved: DataFrame) -> DataFrame:
    """(key, recheck, problem): what the re-checks leave to a person.

    A mismatch in a doubted note; a reworded note that not every re-check
    confirmed (a null recheck); of other notes a mismatch without a resolution
    (``resolved``: key), or a verdict on an earlier wording. Keys that no note
    has, and keys that a re-check holds twice, are rows too: nothing is dropped.
    """
    doubted = doubted_notes(notes, passes)
    own = recheck_verdicts(doubted, rechecks)
    missed = own.where(F.col("verdict") == MISMATCH).select("key", "recheck", F.lit("mismatch in a doubted note").alias("problem"))
    reworded = doubted.where("changed").select("key").join(own.where("not confirmed_by_all").select("key").distinct(), "key").select("key", F.lit(None).cast("string").alias("recheck"), F.lit("reworded and not confirmed by all").alias("problem"))
    others = notes.join(rechecks.select("key").distinct(), "key", "left_semi").join(doubted.select("key"), "key", "left_anti")
    judged = recheck_verdicts(others, rechecks).where(F.col("verdict") != NOT_CHECKED).join(resolved.select("key", F.lit(True).alias("done")), "key", "left")
    found = F.when((F.col("verdict") == MISMATCH) & F.col("done").isNull(), "mismatch without a resolution").when(~F.col("current"), "judged an earlier wording")
    finding = judged.select("key", "recheck", found.alias("problem")).where("problem is not null")
    strange = rechecks.join(notes.select("key"), "key", "left_anti").select("key", "recheck", F.lit("no such note").alias("problem")).distinct()
    twice = rechecks.groupBy("key", "recheck").count().where("count > 1").select("key", "recheck", F.lit("two records").alias("problem"))
    return missed.unionByName(reworded).unionByName(finding).unionByName(strange).unionByName(twice)
