"""Queries on pages, spelling, phrases and agreement over the driver's tables, with their DuckDB SQL.

Adapters: fifty documents that follow each other are the pages of one book,
numbered from 5 at the foot save for every seventh page; conversations are
Markdown texts with a heading for each turn; documents that copy a benchmark
item are what a search for it should find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators import accuracy, pages, phrases, retrieval, spelling
from assaylake.plans import texts
from assaylake.session import Tables, cut, ship, table
from assaylake.streaming import limits

BOOK = 50


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = (F.col("doc_id") % BOOK + 1).cast("int")
    foot = F.when(page % 7 == 0, F.col("text")).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("\nPage "), (page + 4).cast("string")))
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / BOOK).alias("doc"), page.alias("page"), foot.alias("text"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_labels(_pages(spark, sf_dir))


def contents_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pages.contents_marks(F.col("text")).alias("m")).select("doc_id", "m.*")


def markdown_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n\n### "), F.coalesce("role", F.lit("unknown")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    docs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("# Conversation\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n\n")).alias("text"))
    return pages.markdown_passages(docs)


def _words(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


def spelling_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words used once, against those used more often. DuckDB has no distance that edits no part twice, so this has no SQL."""
    ship(spark)
    used = _words(spark, sf_dir, "documents").unionByName(_words(spark, sf_dir, "conversations")).groupBy("word").agg(F.count("*").alias("uses"))
    return spelling.proposals(used.where("uses = 1"), used.where("uses > 1"))


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of neighbouring words of the benchmark, by stems, in all documents."""
    ship(spark)
    held = table(spark, sf_dir, "benchmark").select(retrieval.tokens(F.col("text")).alias("t")).where("size(t) > 1")
    pairs = held.select(F.explode(F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("text")).distinct()
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rowid"), "text")
    hits = phrases.phrase_scores(pairs.withColumn("phrase_id", F.col("text")), rows)
    return hits.select("phrase_id", "rowid", "n", F.round("score", 6).alias("score"))


def retrieval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents that copy a benchmark item are found for it; an item that none copies is out of scope."""
    tables = Tables(spark)
    try:
        targets = tables.cut(texts.copied_runs(spark, sf_dir).select(F.col("item_id").alias("qid"), F.lit("documents").alias("doc"), F.col("doc_id").alias("page"), F.lit(None).cast("string").alias("section")), "targets")
        found = tables.cut(retrieval.gates(texts._ranked(spark, sf_dir)).where("strong").select("qid", F.col("place").alias("rank"), F.lit("documents").alias("doc"), F.col("rowid").alias("page"), F.lit(None).cast("string").alias("section")), "found")
        items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.size(retrieval.tokens(F.col("text"))) >= 40, "long").otherwise("short").alias("grp"))
        scoped = items.join(targets.select("qid", F.lit(True).alias("in_scope")).distinct(), "qid", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))
        rates = accuracy.retrieval_rates(scoped, targets, found)
        return cut(rates.select(F.coalesce("grp", F.lit("all")).alias("grp"), "n_in_scope", "hit1", "hit5", "hit8", "n_out_of_scope", "n_right_out_of_scope"), "retrieval-rates")
    finally:
        tables.clear()


def pass_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as values; one pass reads them by the quality mark, another confirms documents of 200 characters or more."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("toxic").cast("string").alias("value"), "quality")
    first = labels.select(F.lit("A").alias("pass"), "key", F.when(F.col("quality") == 1, accuracy.CONFIRMED).otherwise("doubted").alias("verdict"), F.col("value").alias("reading"))
    second = table(spark, sf_dir, "documents").select(F.lit("B").alias("pass"), F.col("doc_id").alias("key"), F.when(F.col("n_chars") >= 200, accuracy.CONFIRMED).otherwise("doubted").alias("verdict"), F.lit("0").alias("reading"))
    return accuracy.pass_counts(accuracy.compare_passes(labels.select("key", "value"), first.unionByName(second)))


def _rechecks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Labels as values with a note on their document; two passes read the notes, three re-checks some of them again.

    Every seventh note was reworded since; a re-check of each language's shorter
    documents judges the wording on file, or the old one where it is of an even
    id. Documents without a label are notes of none.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.concat(F.lit("from "), F.coalesce("source", F.lit("nowhere"))).alias("old"), "lang", "n_chars")
    held = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "quality", "toxic").join(docs, "key")
    note = F.when(F.col("key") % 7 == 0, F.concat("old", F.lit(", see text"))).otherwise(F.col("old"))
    first = held.select(F.lit("A").alias("pass"), "key", F.when(F.col("quality") == 1, accuracy.CONFIRMED).when(F.col("toxic") == 1, accuracy.MISMATCH).alias("verdict"), "old")
    second = held.where("n_chars >= 100").select(F.lit("B").alias("pass"), "key", F.lit(accuracy.CONFIRMED).alias("verdict"), F.when(F.col("key") % 3 > 0, F.col("old")).alias("old"))
    passes = first.unionByName(second).withColumnRenamed("old", "checked_note")
    verdict = F.when(F.col("n_chars") % 5 == 0, accuracy.MISMATCH).when(F.col("n_chars") % 5 == 1, "unclear").otherwise(accuracy.CONFIRMED)
    checked = F.when((F.col("key") % 7 == 0) & (F.col("key") % 2 > 0), F.concat("old", F.lit(", see text"))).otherwise(F.col("old"))
    again = docs.where("lang is not null and n_chars < 1500").select(F.concat(F.lit("re-check "), "lang").alias("recheck"), "key", verdict.alias("verdict"), F.lit("read again").alias("reason"), checked.alias("checked_note"))
    whole = docs.where("n_chars < 600").select(F.lit("re-check of short ones").alias("recheck"), "key", F.lit(accuracy.CONFIRMED).alias("verdict"), F.lit("short").alias("reason"), checked.alias("checked_note"))
    return held.select("key", note.alias("note")), passes, again.unionByName(whole), held.where("toxic = 1").select("key")


def recheck_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes, passes, rechecks, _ = _rechecks(spark, sf_dir)
    return accuracy.recheck_verdicts(accuracy.doubted_notes(notes, passes), rechecks)


def recheck_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy.recheck_problems(*_rechecks(spark, sf_dir))


def outcome_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as test cases: above 150 failed, below 5 skipped, errors expected to fail."""
    cases = table(spark, sf_dir, "events").select(
        F.concat(F.lit("tests."), "event_type").alias("classname"), F.col("event_id").cast("string").alias("name"), (F.col("value") > 150).alias("failed"), F.lit(False).alias("errored"), F.when(F.col("event_type") == "error", "pytest.xfail").when(F.col("value") < 5, "pytest.skip").alias("skipped_type")
    )
    areas = spark.createDataFrame([("click", "use"), ("view", "use"), ("purchase", "sales")], "module string, area string")
    return accuracy.test_areas(cases, areas)


def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.status_counts(texts.rate_limit(spark, sf_dir))


QUERIES = {
    "page_labels": page_labels,
    "contents_marks": contents_marks,
    "markdown_passages": markdown_passages,
    "spelling_proposals": spelling_proposals,
    "phrase_hits": phrase_hits,
    "retrieval_rates": retrieval_rates,
    "pass_agreement": pass_agreement,
    "recheck_verdicts": recheck_verdicts,
    "recheck_problems": recheck_problems,
    "outcome_areas": outcome_areas,
    "request_status": request_status,
}

_LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x, ' ')), lambda x: x <> '')"

_RECHECKS = """
with docs as (select doc_id as key, 'from ' || coalesce(source, 'nowhere') as old, lang, n_chars from documents),
held as (select l.doc_id as key, quality, toxic, old, lang, n_chars from labels l join docs d on d.key = l.doc_id),
notes as (select key, case when key % 7 = 0 then old || ', see text' else old end as note from held),
passes as (
  select 'A' as pass, key, case when quality = 1 then 'confirmed' when toxic = 1 then 'mismatch' end as verdict, old as checked_note from held
  union all select 'B', key, 'confirmed', case when key % 3 > 0 then old end from held where n_chars >= 100),
judged0 as (select *, case when key % 7 = 0 and key % 2 > 0 then old || ', see text' else old end as checked_note from docs),
rechecks as (
  select 're-check ' || lang as recheck, key, case n_chars % 5 when 0 then 'mismatch' when 1 then 'unclear' else 'confirmed' end as verdict, 'read again' as reason, checked_note
  from judged0 where lang is not null and n_chars < 1500
  union all select 're-check of short ones', key, 'confirmed', 'short', checked_note from judged0 where n_chars < 600),
read_ as (select key, arg_max(checked_note, pass) filter (checked_note is not null) as checked_note, bool_or(coalesce(verdict <> 'confirmed', false)) as doubted from passes group by key),
doubted as (
  select key, note, coalesce(checked_note <> note, false) as changed from notes join read_ using (key) where doubted or coalesce(checked_note <> note, false)),
names as (select distinct recheck from rechecks),
own0 as (
  select d.key, n.recheck, coalesce(r.verdict, 'not checked') as verdict, coalesce(r.reason, '') as reason, coalesce(r.checked_note = d.note, false) as current
  from doubted d cross join names n left join rechecks r on r.key = d.key and r.recheck = n.recheck),
own as (select *, bool_and(verdict = 'confirmed' and current) over (partition by key) as confirmed_by_all from own0)
"""

SQL = {
    "recheck_verdicts": f"{_RECHECKS} select key, recheck, verdict, reason, current, confirmed_by_all from own",
    "recheck_problems": f"""{_RECHECKS}
select key, recheck, 'mismatch in a doubted note' as problem from own where verdict = 'mismatch'
union all select distinct key, null, 'reworded and not confirmed by all' from own join doubted using (key) where changed and not confirmed_by_all
union all select * from (
  select r.key, r.recheck, case when r.verdict = 'mismatch' and r.key not in (select key from held where toxic = 1) then 'mismatch without a resolution' when r.checked_note <> n.note then 'judged an earlier wording' end as problem
  from rechecks r join notes n using (key) where key not in (select key from doubted)) where problem is not null
union all select distinct key, recheck, 'no such note' from rechecks where key not in (select key from notes)
union all select key, recheck, 'two records' from rechecks group by key, recheck having count(*) > 1""",
    "page_labels": rf"""
with pages as (
  select doc_id // {BOOK} as doc, cast(doc_id % {BOOK} + 1 as integer) as page,
         case when (doc_id % {BOOK} + 1) % 7 = 0 then text else coalesce(text, '') || chr(10) || 'Page ' || (doc_id % {BOOK} + 5) end as text
  from documents),
held as (select doc, page, {_LINES} as l from pages),
edge as (select doc, page, unnest(case when len(l) > 6 then list_concat(list_slice(l, 1, 3), list_slice(l, len(l) - 2, len(l))) else l end) as x from held),
read as (
  select distinct doc, page, cast(coalesce(
    nullif(regexp_extract(x, '(?i)\bpage\s+(\d{{1,4}})\s+of\s+\d{{1,4}}\b', 1), ''), nullif(regexp_extract(x, '(?i)^\s*(?:page\s+)?(\d{{1,4}})\s*$', 1), ''),
    nullif(regexp_extract(x, '^\D.*?\D\s(\d{{1,4}})\s*$', 1), ''), nullif(regexp_extract(x, '^\s*(\d{{1,4}})\s+\D', 1), '')) as integer) - page as off
  from edge),
ok as (
  select doc, page, arg_min(off, (abs(off), off)) as off from read r
  where off is not null and exists (select 1 from read o where o.doc = r.doc and o.off = r.off and o.page <> r.page and abs(o.page - r.page) <= 3)
  group by doc, page),
found as (select p.doc, p.page, o.off from pages p left join ok o using (doc, page)),
b as (select f.doc, f.page, max(o.page) as bp, arg_max(o.off, o.page) as bo from found f join ok o on o.doc = f.doc and o.page < f.page and o.page >= f.page - 41 group by all),
a as (select f.doc, f.page, min(o.page) as ap, arg_min(o.off, o.page) as ao from found f join ok o on o.doc = f.doc and o.page > f.page and o.page <= f.page + 41 group by all),
s as (
  select f.doc, f.page, case when f.page + f.off >= 1 then f.page + f.off end as printed,
         case when bo = ao and ap - bp - 1 <= 40 and f.page + bo >= 1 then f.page + bo end as filled
  from found f left join b using (doc, page) left join a using (doc, page))
select doc, page, cast(coalesce(printed, filled) as varchar) as label,
       case when printed is not null then 'printed on the page' when filled is not null then 'inferred from neighbouring pages' else 'not derived' end as basis
from s""",
    "contents_marks": rf"""
with h as (select doc_id, coalesce({_LINES}, []) as l from documents),
t as (select doc_id, len(l) as n, list_transform(list_filter(l, lambda x: regexp_matches(x, '(?:\s|\.{{3,}}\s*)\d{{1,3}}$') and regexp_matches(regexp_replace(x, '(?:\s|\.{{3,}}\s*)\d{{1,3}}$', ''), '[A-Za-z]{{3,}}')),
      lambda x: cast(regexp_extract(x, '(\d{{1,3}})$', 1) as integer)) as v from h),
r as (select doc_id, n, len(v) as k, len(list_filter(range(1, len(v)), lambda i: v[i + 1] >= v[i])) as up from t)
select doc_id, n as n_lines, k as n_numbered, up as n_rising, k >= 8 and k >= 0.5 * n and up >= 0.85 * (k - 1) as is_contents from r""",
    "retrieval_rates": f"""
with {texts._RANKED},
runs as ({texts.SQL['copied_runs']}),
goal as (select distinct item_id as qid, doc_id as page from runs),
live as (select qid, place, rowid from gated where strong and place <= 8),
firsts as (select g.qid, min(l.place) as first from goal g join live l on l.qid = g.qid and l.rowid = g.page group by g.qid),
q as (
  select item_id as qid, case when len({texts._TOKENS.format('text')}) >= 40 then 'long' else 'short' end as grp,
         item_id in (select qid from goal) as inside, item_id in (select qid from live) as got, first
  from benchmark left join firsts on qid = item_id)
select case when grouping(grp) = 1 then 'all' else grp end as grp, count(*) filter (inside) as n_in_scope, count(*) filter (inside and first <= 1) as hit1,
       count(*) filter (inside and first <= 5) as hit5, count(*) filter (inside and first <= 8) as hit8, count(*) filter (not inside) as n_out_of_scope, count(*) filter (not inside and not got) as n_right_out_of_scope
from q group by rollup(grp)""",
    "pass_agreement": """
with v as (select l.doc_id, coalesce(l.quality = 1, false) and coalesce(d.n_chars >= 200, false) as ok, coalesce(d.doc_id is not null and l.toxic = 0, false) as same from labels l left join documents d using (doc_id))
select count(*) as n_values, count(*) filter (ok) as n_confirmed, count(*) filter (not ok) as n_not_confirmed, count(*) filter (not same) as n_differs from v""",
    "outcome_areas": """
with c as (select case when event_type in ('click', 'view') then 'use' when event_type = 'purchase' then 'sales' else 'other' end as area,
                  coalesce(value > 150, false) or coalesce(event_type = 'error', false) as failed, coalesce(value < 5, false) as skipped from events)
select area, count(*) filter (not failed and not skipped) as n_passed, count(*) filter (failed) as n_failed, count(*) filter (not failed and skipped) as n_skipped from c group by area""",
    "request_status": f"""
with decided as ({texts.SQL['rate_limit']})
select allowed, "window", count(*) as n from decided group by allowed, "window" order by n""",
}
