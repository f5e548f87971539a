"""Retrieval, copied-run, prose and rate-limit queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions import prose
from assaylake.operators import answers, retrieval
from assaylake.session import ship, table
from assaylake.streaming import limits


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def passage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.passages(_docs(spark, sf_dir)).select("doc_id", "ordinal", "start", "end", F.length("text").alias("n_chars"))


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source are the pages of one document; every edge line on two pages or more counts here."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return retrieval.boilerplate(pages, share=0.0)


def word_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.word_counts(_docs(spark, sf_dir))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.rank(questions, _docs(spark, sf_dir).withColumnRenamed("doc_id", "rowid"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).where("place <= 10").select("qid", "rowid", F.col("place").cast("int").alias("place"), F.round("score", 6).alias("score"))


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = retrieval.gates(_ranked(spark, sf_dir))
    return gated.where("strong or borderline").select("qid", "rowid", "n_matched", "n_terms", "n_known", "coverage", "strong")


def selected_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = retrieval.gates(_ranked(spark, sf_dir)).withColumn("page", F.floor(F.col("rowid") / 10))
    return retrieval.select_passages(gated, "page", 5).select("qid", "rowid", F.col("rank").cast("int").alias("rank"), F.round("relevance", 6).alias("relevance"))


def copied_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.copied_runs(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", prose.sentences(F.col("text")).alias("s"))
    chars = F.aggregate("s", F.lit(0), lambda acc, s: acc + F.length(s))
    return found.select("doc_id", F.size("s").cast("long").alias("n_sentences"), chars.cast("long").alias("n_chars"))


def number_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = _docs(spark, sf_dir).select("doc_id", F.explode(prose.find_numbers("text")).alias("m"))
    return found.groupBy(F.col("m.kind").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return prose.redaction_counts(_docs(spark, sf_dir))


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"


def email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses by a pattern without lookaround, which both engines read alike."""
    found = _docs(spark, sf_dir).select("doc_id", F.regexp_extract_all("text", F.lit(_EMAIL), F.lit(0)).alias("e")).where(F.size("e") > 0)
    return found.select("doc_id", F.size("e").cast("long").alias("n"), F.size(F.array_distinct(F.transform("e", lambda x: F.lower(x)))).cast("long").alias("n_distinct"))


def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.groupBy(prose.route(F.col("text")).alias("route")).agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_conversations"))


def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates for all labelled documents and by language; the total row has the group ``all``."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    rolled = joined.rollup("lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("n"), F.sum("quality").alias("n_good"), F.sum("toxic").alias("n_toxic"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("lang")).alias("grp"), "n", "n_good", "n_toxic", F.round(F.col("n_good") / F.col("n"), 6).alias("good_rate"))


#: Windows of the adapter's limiter: limit, seconds, name.
WINDOWS = ((3, 3600 * 6, "6 hours"), (8, 3600 * 48, "2 days"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    requests = table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select(F.col("user_id").cast("string").alias("key"), "ts")
    return limits.limit_batch(requests, WINDOWS)


def answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as an answer to the turn before it, which is its passage 1."""
    ship(spark)
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("answer_id"), "conv_id", "turn", "role", "text")
    said = turns.where("role = 'assistant'").select("answer_id", "text")
    passages = turns.where("role = 'user'").select(F.concat_ws("/", "conv_id", (F.col("turn") + 1)).alias("answer_id"), F.lit(1).alias("number"), F.col("text").alias("body"), F.lit(True).alias("reusable"))
    values = spark.createDataFrame([], "answer_id string, marker string, rule string, value decimal(18,9)")
    return answers.verify(said, passages, values).select("answer_id", "name", "passed")


QUERIES = {
    "answer_check": answer_check,
    "passage_windows": passage_windows,
    "boilerplate_lines": boilerplate_lines,
    "word_histogram": word_histogram,
    "bm25_topk": bm25_topk,
    "coverage_gate": coverage_gate,
    "selected_passages": selected_passages,
    "copied_runs": copied_runs,
    "sentence_split": sentence_split,
    "number_mentions": number_mentions,
    "redaction_counts": redaction_counts,
    "email_counts": email_counts,
    "route_questions": route_questions,
    "label_rates": label_rates,
    "rate_limit": rate_limit,
}

_TOKENS = "regexp_extract_all(lower(translate({}, 'µμ', 'uu')), '[a-z0-9]+')"

_RANKED = f"""
doc_tokens as (select doc_id as rowid, {_TOKENS.format('text')} as t from documents),
sizes as (select count(*) as total, avg(len(t)) as mean from doc_tokens),
idx as (select rowid, term, count(*) as tf, any_value(length) as length from (select rowid, len(t) as length, unnest(t) as term from doc_tokens) group by rowid, term),
freq as (select term, count(*) as df from idx group by term),
asked as (select item_id as qid, unnest(list_distinct({_TOKENS.format('text')})) as term from benchmark),
weighed as (
  select a.qid, a.term, f.df, s.mean, greatest(ln((s.total - f.df + 0.5) / (f.df + 0.5)), 1e-6) as idf, ln(1 + (s.total - f.df + 0.5) / (f.df + 0.5)) as weight
  from asked a left join freq f using (term) cross join sizes s),
per_question as (select qid, count(*) as n_terms, count(df) as n_known, sum(case when df is not null then weight end) as weight_sum from weighed group by qid),
scored as (
  select qid, rowid, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as score, count(*) as n_matched, sum(weight) as held
  from weighed join idx using (term) where df is not null group by qid, rowid),
placed as (select *, row_number() over (partition by qid order by round(score, 9) desc, rowid) as place from scored),
ranked as (
  select p.qid, p.rowid, p.score, p.place, p.n_matched, q.n_terms, q.n_known, round_even(p.held / q.weight_sum, 2) as coverage
  from placed p join per_question q using (qid) where p.place <= 200),
gated as (
  select *, coverage >= 0.45 and 2 * n_matched > n_terms and n_matched >= least(2, n_known) as strong,
         coverage >= 0.30 and n_matched >= 3 and 2 * n_matched >= n_terms as near, score * coverage as relevance
  from ranked)"""

SQL = {
    "passage_windows": r"""
with w as (select doc_id, regexp_extract_all(text, '\S+') as words from documents),
n as (select doc_id, words, len(words) as c, case when len(words) > 300 then cast(ceil((len(words) - 300) / 160.0) as integer) else 0 end as m from w where len(words) > 0),
s as (select doc_id, words, c, m, unnest(range(0, m + 1)) as i from n)
select doc_id, cast(i as integer) as ordinal, cast(160 * i as integer) as start, cast(case when i = m then c else 160 * i + 220 end as integer) as "end",
       cast(length(array_to_string(list_slice(words, 160 * i + 1, case when i = m then c else 160 * i + 220 end), ' ')) as integer) as n_chars
from s""",
    "boilerplate_lines": r"""
with l as (select source as doc, doc_id as page, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as lines from documents),
e as (select doc, page, unnest(list_concat(list_slice(lines, 1, 3), list_slice(lines, greatest(len(lines) - 2, 1), len(lines)))) as line from l),
k as (select doc, page, lower(regexp_replace(trim(line), '[0-9]+', '#', 'g')) as key from e),
c as (select doc, key, count(distinct page) as n_pages from k where trim(translate(key, '#.', '')) <> '' group by all),
t as (select source as doc, count(*) as pages from documents group by source having count(*) >= 5)
select doc, key, n_pages from c join t using (doc) where n_pages >= 2""",
    "word_histogram": f"""
with t as (select doc_id, unnest({_TOKENS.format('text')}) as term from documents)
select term, count(*) as n, count(distinct doc_id) as n_docs from t group by term""",
    "bm25_topk": f"with {_RANKED} select qid, rowid, cast(place as integer) as place, round(score, 6) as score from ranked where place <= 10",
    "coverage_gate": f"with {_RANKED} select qid, rowid, n_matched, n_terms, n_known, coverage, strong from gated where strong or near",
    "selected_passages": f"""
with {_RANKED},
in_page as (select *, row_number() over (partition by qid, rowid // 10 order by round(relevance, 9) desc, rowid) as p from gated where strong),
chosen as (select *, row_number() over (partition by qid order by round(relevance, 9) desc, rowid) as rank from in_page where p = 1)
select qid, rowid, cast(rank as integer) as rank, round(relevance, 6) as relevance from chosen where rank <= 5""",
    "copied_runs": f"""
with a as (select doc_id, {_TOKENS.format('text')} as t from documents), b as (select item_id, {_TOKENS.format('text')} as t from benchmark),
ga as (select doc_id, i, array_to_string(list_slice(t, i, i + 10), ' ') as g from (select doc_id, t, unnest(range(1, len(t) - 9)) as i from a where len(t) >= 11)),
gb as (select item_id, k, array_to_string(list_slice(t, k, k + 10), ' ') as g from (select item_id, t, unnest(range(1, len(t) - 9)) as k from b where len(t) >= 11)),
hit as (select doc_id, item_id, i, i - k as diagonal from ga join gb using (g)),
island as (select *, i - row_number() over (partition by doc_id, item_id, diagonal order by i) as n from hit),
runs as (select doc_id, item_id, count(*) + 10 as length from island group by doc_id, item_id, diagonal, n)
select doc_id, item_id, count(*) as n_runs, max(length) as longest from runs group by all""",
    "sentence_split": r"""
with m as (select doc_id, regexp_replace(regexp_replace(trim(text, chr(32)), '([.!?])\s+([A-Z"''(\[])', '\1' || chr(1) || '\2', 'g'), '\n\s*\n', chr(1), 'g') as t from documents),
p as (select doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as s from m)
select doc_id, cast(len(s) as bigint) as n_sentences, cast(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) as bigint) as n_chars from p""",
    "email_counts": f"""
with e as (select doc_id, regexp_extract_all(text, '{_EMAIL}') as e from documents)
select doc_id, cast(len(e) as bigint) as n, cast(len(list_distinct(list_transform(e, lambda x: lower(x)))) as bigint) as n_distinct from e where len(e) > 0""",
    "route_questions": "with r as (select conv_id, case "
    + " ".join(f"when regexp_matches(lower(text), '{pattern}') then '{name}'" for name, pattern in prose.ROUTES)
    + " when text is not null then 'search' end as route from conversations where role = 'user') select route, count(*) as n, count(distinct conv_id) as n_conversations from r group by route",
    "label_rates": """
with j as (select lang, quality, toxic from documents join labels using (doc_id))
select case when grouping(lang) = 1 then 'all' else lang end as grp, count(*) as n, cast(sum(quality) as bigint) as n_good, cast(sum(toxic) as bigint) as n_toxic, round(sum(quality) / count(*), 6) as good_rate
from j group by rollup(lang)""",
    "rate_limit": """
with recursive asked as (
  select cast(user_id as varchar) as key, ts, row_number() over (partition by user_id order by ts) as n from events where user_id is not null and ts is not null),
step as (
  select distinct key, cast(0 as bigint) as n, cast([] as timestamp[]) as hits, cast(null as timestamp) as ts, cast(null as boolean) as allowed, cast(null as varchar) as "window", cast(null as integer) as retry_after from asked
  union all
  select key, n, case when len(short) < 3 and len(live) < 8 then list_append(live, ts) else live end, ts, len(short) < 3 and len(live) < 8,
         case when len(short) >= 3 then '6 hours' when len(live) >= 8 then '2 days' end,
         cast(case when len(short) >= 3 then (epoch_us(short[1]) + 21600000000 - epoch_us(ts)) // 1000000 + 1 when len(live) >= 8 then (epoch_us(live[1]) + 172800000000 - epoch_us(ts)) // 1000000 + 1 end as integer)
  from (
    select a.key, a.n, a.ts, list_filter(s.hits, lambda h: epoch_us(h) > epoch_us(a.ts) - 21600000000) as short, list_filter(s.hits, lambda h: epoch_us(h) > epoch_us(a.ts) - 172800000000) as live
    from step s join asked a on a.key = s.key and a.n = s.n + 1))
select key, ts, allowed, "window", retry_after from step where n > 0""",
}
