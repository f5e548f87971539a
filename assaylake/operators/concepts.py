"""What a question asks: concepts from a table of wordings, and neighbouring meaningful words.

``questions``: qid (a key), text. ``wordings``: group_id, label, wording,
searched; the wordings of a group name one idea, and those that are searched
become its phrases. Runs of a question's words meet the wordings by hashes of
whole runs; which of overlapping matches count is decided by a fold over each
question's matches, longest first. Nothing grows with the product of questions
and wordings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.retrieval import tokens

#: Ways to frame a question that say nothing of its subject (fixed values).
FRAMING = (
    "can you tell me", "could you tell me", "can you let me know", "tell me about", "tell me", "let me know", "i need to know", "need to know",
    "needs to know", "want to know", "wants to know", "wanted to know", "i want to know", "i d like to know", "i would like to know", "do you know",
    "does anyone know", "anyone know", "how do i know", "how do we know", "how would i know", "how will i know", "how can i tell", "how do i tell",
    "how can we tell", "what s the deal with", "what is the deal with", "what s the story with", "what s the go with", "where do i find",
    "where can i find", "where would i find", "where do we find", "what s the rule for", "what s the rule on", "what are the rules for",
    "what are the rules on", "is it true that", "i was wondering", "quick question", "any idea", "any ideas", "in plain english", "in simple terms",
    "stand for", "stands for", "short for", "abbreviation for",
)

#: Places that only set the scope (fixed values).
PLACES = ("western australian", "western australia", "australian", "australia", "perth", "wa")

LEAST_LETTERS = 2

#: What wordings take of a question: all words, those in wordings of several words, and each wording in turn.
_TAKEN = "struct<used:array<int>,wide:array<int>,taken:array<struct<pos:int,group_id:bigint>>>"


def singular(word: Column) -> Column:
    """A light plural fold: a final s goes, but not of ss, us or is, nor of words of three letters."""
    plural = (F.length(word) > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$")
    return F.when(plural, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def singular_word(word: str) -> str:
    """:func:`singular` of one word."""
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def fold(words: Column) -> Column:
    return F.transform(words, singular)


def _hashes(words: Column) -> list[Column]:
    return [F.xxhash64(words).alias("h"), F.hash(words).alias("check")]


def _known(wordings: DataFrame) -> DataFrame:
    """(group_id, words, size, h, check) of the different wordings, folded; one without a word is none."""
    held = wordings.select(F.col("group_id").cast("long").alias("group_id"), fold(tokens(F.col("wording"))).alias("words")).where(F.size("words") > 0).distinct()
    return held.select("group_id", "words", F.size("words").alias("size"), *_hashes(F.col("words")))


def _runs(items: Column, size: int) -> Column:
    """Runs of ``size`` neighbours among items (pos, word): their hashes and places."""

    def run(i: Column) -> Column:
        part = F.slice(items, i, size)
        return F.struct(F.lit(size).alias("size"), *_hashes(F.transform(part, lambda x: x["word"])), F.transform(part, lambda x: x["pos"]).alias("at"))

    return F.when(F.size(items) >= size, F.transform(F.sequence(F.lit(1), F.size(items) - size + 1), run))


def claimed(held: DataFrame, items: Column, known: DataFrame, sizes: Sequence[int], name: str) -> DataFrame:
    """``held`` (qid, ...) with STRUCT ``name`` (used, wide, taken): the wordings that its items hold.

    The longest come first, of equally long ones those of the earlier group,
    then in the order of their words, then from the left; a match with a word
    that an earlier one took doesn't count.
    """
    start = F.struct(*(F.array().alias(n) for n in ("used", "wide", "taken"))).cast(_TAKEN)
    if not sizes:
        return held.withColumn(name, start)
    runs = F.flatten(F.array_compact(F.array(*(_runs(items, k) for k in sizes))))
    met = held.select("qid", F.explode(runs).alias("x")).select("qid", "x.*").join(known, ["h", "check", "size"])
    found = met.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("short"), "group_id", "words", "at"))).alias("found"))

    def take(s: Column, c: Column) -> Column:
        one = F.struct(c["at"][0].alias("pos"), c["group_id"].alias("group_id"))
        wide = F.when(F.size(c["at"]) > 1, F.concat(s["wide"], c["at"])).otherwise(s["wide"])
        more = F.struct(F.concat(s["used"], c["at"]).alias("used"), wide.alias("wide"), F.array_append(s["taken"], one).alias("taken")).cast(_TAKEN)
        return F.when(F.arrays_overlap(s["used"], c["at"]), s).otherwise(more)

    return held.join(found, "qid", "left").withColumn(name, F.aggregate(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), start, take)).drop("found")


def _items(words: Column, keep) -> Column:
    """(pos, word) of the words at places that ``keep`` (word, place) lets through; places count from 0."""
    placed = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    return F.filter(placed, keep)


def _sizes(known: DataFrame) -> list[int]:
    return [r[0] for r in known.select("size").distinct().orderBy("size").collect()]  # lengths of wordings, a handful


def read(questions: DataFrame, wordings: DataFrame, stopwords: Sequence[str] = (), ignored: Sequence[str] = FRAMING + PLACES) -> DataFrame:
    """(qid, text, words, used, taken, pairs): the words of each question, what its wordings take, and its pairs.

    Framing and places go first. Wordings are matched on what is left, then
    again without stopwords. ``pairs`` are neighbouring words of two letters or
    more that are no stopwords and lie in no wording of several words. A null
    text has no words.
    """
    known, stop = _known(wordings), list(stopwords)
    sizes = _sizes(known)
    phrases = questions.sparkSession.createDataFrame([(0, p) for p in ignored], "group_id long, wording string")
    words = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
    held = questions.select("qid", "text", words.alias("words")).withColumn("folded", fold(F.col("words")))

    def stops(word: Column) -> Column:
        return word.isin(stop) if stop else F.lit(False)

    def left(free: str, also=lambda place: F.lit(True)) -> Column:
        return _items(F.col("folded"), lambda x: ~F.array_contains(F.col(free), x["pos"]) & also(x["pos"]))

    out = claimed(held, _items(F.col("folded"), lambda x: F.lit(True)), _known(phrases), sorted({len(p.split()) for p in ignored}), "framed")
    out = claimed(out, left("framed.used"), known, sizes, "one").withColumn("gone", F.concat("framed.used", "one.used"))
    out = claimed(out, left("gone", lambda at: ~stops(F.element_at("words", at + 1))), known, sizes, "two")
    out = out.withColumn("inside", F.concat("framed.used", "one.wide"))

    def meaningful(at: Column) -> Column:
        word = F.element_at("words", at + 1)
        return (F.length(word) >= LEAST_LETTERS) & ~stops(word) & ~F.array_contains("inside", at)

    starts = F.when(F.size("words") > 1, F.sequence(F.lit(0), F.size("words") - 2)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(F.filter(starts, lambda i: meaningful(i) & meaningful(i + 1)), lambda i: F.concat_ws(" ", F.element_at("words", i + 1), F.element_at("words", i + 2)))
    return out.select("qid", "text", "words", F.concat("gone", "two.used").alias("used"), F.concat("one.taken", "two.taken").alias("taken"), F.array_distinct(pairs).alias("pairs"))


def concepts(asked: DataFrame, wordings: DataFrame, stopwords: Sequence[str] = ()) -> DataFrame:
    """(qid, n, label, phrases, expanded) of the questions that :func:`read` gives: ideas in the order of their words.

    A group counts once, where it was first taken; words that are left count
    once each. A question without a concept has no row.
    """
    groups = wordings.where("searched").groupBy(F.col("group_id").cast("long").alias("group_id")).agg(
        F.min("label").alias("label"), F.array_sort(F.collect_set(F.array_join(tokens(F.col("wording")), " "))).alias("phrases")
    )
    taken = asked.select("qid", F.posexplode("taken").alias("turn", "t")).groupBy("qid", "t.group_id").agg(F.min_by("t.pos", "turn").alias("pos"))
    wide = taken.join(groups, "group_id").select("qid", "pos", "label", "phrases", F.lit(True).alias("expanded"))
    stop = list(stopwords)
    free = _items(F.col("words"), lambda x: ~F.array_contains("used", x["pos"]) & (F.length(x["word"]) >= LEAST_LETTERS) & (~x["word"].isin(stop) if stop else F.lit(True)))
    single = asked.select("qid", F.explode(free).alias("x")).groupBy("qid", F.col("x.word").alias("label")).agg(F.min("x.pos").alias("pos"))
    both = wide.unionByName(single.select("qid", "pos", "label", F.array("label").alias("phrases"), F.lit(False).alias("expanded")))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    return both.select("qid", nth.alias("n"), "label", "phrases", "expanded")


def written_as_name(word: Column, text: Column) -> Column:
    """Whether a lower-case word stands in ``text`` as a name: in capitals, or with a capital where no sentence starts.

    Never in a text written mostly in capitals, where case says nothing.
    """
    rest, first, edge = F.substring(word, F.lit(2), F.length(word)), F.upper(F.substring(word, 1, 1)), "(?![A-Za-z0-9])"
    letters, capitals = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    short = F.concat(F.lit("(?<![A-Za-z0-9])"), F.upper(word), F.lit(edge))
    before = r"""(?:[^.?!:;"'(\[\s]\s+|[^.?!:;"'(\[\sA-Za-z0-9])"""
    inner = F.concat(F.lit(before), first, F.lit("(?i:"), rest, F.lit(")" + edge))
    named = ((F.length(word) >= 2) & F.rlike(text, short)) | F.rlike(text, inner)
    return F.coalesce((letters > 0) & (2 * capitals <= letters) & word.rlike("^[a-z]") & named, F.lit(False))
