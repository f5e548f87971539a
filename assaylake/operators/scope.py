"""What a question is about before it is searched: documents it names, other places, topics and notes.

``rules`` is a table of the user: kind, ord, pattern, says, ordinary. A pattern
is a regular expression; ``says`` holds what it stands for, ``ordinary`` marks a
place that is also a common word. Kinds:

* ``drop``: what is left out of the search, such as placeholders;
* ``document``: a name of the documents in ``says``, most specific first; what it matches is taken out of the text;
* ``place``: a place whose rules the documents don't hold; ``country``: one that counts in a question about rules only;
* ``cited``: a place of kind country that the documents cite themselves, which counts where rules are asked for, not where a statement is;
* ``rules`` and ``statement``: wordings that ask for rules, and for what somebody says;
* ``own``: a place or document of the corpus, beside which other places don't count;
* ``topic``: what no document answers; ``note``: a remark to show.

Rules are few and become literals of the plan; questions are read by column
expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.session import listed

_NAMED = "struct<text:string,named:array<string>,exact:array<string>,loose:array<string>>"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _mostly_capitals(text: Column) -> Column:
    return 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) > F.regexp_count(text, F.lit(r"\p{L}"))


def read(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """(qid, search_text, named, no_edition, place, topic, notes) of each question (qid, text).

    ``named`` are the documents named, ``no_edition`` those named only by a name
    of several documents. ``place`` is null beside a wording of the corpus. A
    null text names nothing.
    """
    held = listed(rules.select("kind", "ord", "pattern", "says", F.coalesce("ordinary", F.lit(False)).alias("ordinary")))
    rows = questions.select("qid", F.coalesce("text", F.lit("")).alias("text"), F.array_sort(F.transform(held, lambda r: F.struct(r["kind"].alias("kind"), r["ord"].alias("ord"), r["pattern"].alias("pattern"), r["says"].alias("says"), r["ordinary"].alias("ordinary")))).alias("rules"))

    def of(kind: str) -> Column:
        return F.filter("rules", lambda r: r["kind"] == kind)

    def asks(kind: str) -> Column:
        return F.exists(of(kind), lambda r: F.rlike(F.col("text"), r["pattern"]))

    def cut(text: Column, pattern: Column) -> Column:
        return F.regexp_replace(text, pattern, F.lit(" "))

    bare = F.aggregate(of("drop"), F.col("text"), lambda s, r: cut(s, r["pattern"]))
    empty = F.array().cast("array<string>")
    start = F.struct(bare.alias("text"), empty.alias("named"), empty.alias("exact"), empty.alias("loose")).cast(_NAMED)

    def name(s: Column, r: Column) -> Column:
        several = F.size(r["says"]) > 1
        found = F.struct(
            cut(s["text"], r["pattern"]).alias("text"),
            F.array_union(s["named"], r["says"]).alias("named"),
            F.when(several, s["exact"]).otherwise(F.array_union(s["exact"], r["says"])).alias("exact"),
            F.when(several, F.array_union(s["loose"], r["says"])).otherwise(s["loose"]).alias("loose"),
        ).cast(_NAMED)
        return F.when(F.rlike(s["text"], r["pattern"]), found).otherwise(s)

    read_ = rows.withColumns({"n": F.aggregate(of("document"), start, name), "by_rules": asks("rules"), "by_word": asks("statement"), "capitals": _mostly_capitals(F.col("text"))})

    def places(kind: str) -> Column:
        return F.flatten(F.transform(of(kind), lambda r: F.filter(F.regexp_extract_all(F.col("text"), r["pattern"], F.lit(0)), lambda x: ~(F.col("capitals") & r["ordinary"]))))

    cited = lambda x: F.exists(of("cited"), lambda r: F.rlike(x, r["pattern"]))
    abroad = F.when(F.col("by_rules"), places("country")).when(F.col("by_word"), F.filter(places("country"), lambda x: ~cited(x))).otherwise(empty)
    place = F.when(~asks("own"), F.get(F.concat(places("place"), abroad), F.lit(0)))
    said = lambda kind: F.transform(F.filter(of(kind), lambda r: F.rlike(F.col("text"), r["pattern"])), lambda r: F.get(r["says"], F.lit(0)))
    return read_.select(
        "qid",
        _squeezed(F.col("n.text")).alias("search_text"),
        F.array_sort("n.named").alias("named"),
        F.array_sort(F.array_except("n.loose", "n.exact")).alias("no_edition"),
        place.alias("place"),
        F.get(said("topic"), F.lit(0)).alias("topic"),
        said("note").alias("notes"),
    )


def early(scope: DataFrame, indexed: DataFrame) -> DataFrame:
    """(qid, why): questions that need no search: another place, a topic of none, or only documents that aren't indexed (doc)."""
    held = scope.select("qid", F.explode_outer("named").alias("doc")).join(indexed.select("doc", F.lit(True).alias("here")), "doc", "left")
    known = held.groupBy("qid").agg(F.count("doc").alias("n"), F.count("here").alias("n_here"))
    why = F.when(F.col("place").isNotNull(), F.concat(F.lit("about the rules of "), "place")).when(F.col("topic").isNotNull(), F.col("topic")).when((F.col("n") > 0) & (F.col("n_here") == 0), "names a document that is not indexed")
    return scope.join(known, "qid").select("qid", why.alias("why")).where("why is not null")


def allowed(scope: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, rowid): the rows (rowid, doc) of named documents, for questions that name one."""
    return scope.select("qid", F.explode("named").alias("doc")).join(rows.select("rowid", "doc"), "doc").select("qid", "rowid")
