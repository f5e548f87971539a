"""Checks of a written answer against the passages and values it cites.

``answers``: answer_id, text. ``passages``: answer_id, number, body, reusable.
``values``: answer_id, marker, rule, value (ug/L). Each check gives one row
(answer_id, name, passed, detail); an answer passes if all of its checks do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions import exact, prose
from assaylake.operators import retrieval

#: Limits of quoting and style (fixed values).
QUOTED, REUSED, LONG_SENTENCE, RUN_ON = 10, 30, 30, 60

_BRACKET = re.compile(r"\[(?=G?\d)([^\]]*)\]")
_GOOD = re.compile(r"\s*G?\d+(?:\s*,\s*G?\d+)*\s*")
_END = re.compile(r"(?<=[.!?])((?:\s*\[[^\]]*\])*)\s+")
_SHORT = {"p", "pp", "e.g", "i.e", "no", "vs", "approx", "fig", "cf", "etc"}

SENTENCES = T.ArrayType(
    T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("cited", T.ArrayType(T.StringType())), T.StructField("malformed", T.ArrayType(T.StringType())), T.StructField("numbers", prose.MENTION)])
)


def split(text: str) -> list[tuple[int, str]]:
    """(paragraph, sentence); line breaks end sentences, abbreviations don't, markers stay with the sentence before."""
    out = []
    for p, block in enumerate(b for b in re.split(r"\s*\n\s*", text.strip()) if b):
        start = 0
        for m in _END.finditer(block):
            words = block[start : m.start()].split()
            last = words[-1].rstrip(".").lower() if words else ""
            if last in _SHORT or len(last) == 1 and last.isalpha():
                continue
            out.append((p, block[start : m.end()].strip()))
            start = m.end()
        if block[start:].strip():
            out.append((p, block[start:].strip()))
    return out


def _read(text: str | None) -> list[dict]:
    out = []
    for n, (p, s) in enumerate(split(text or "")):
        cited, malformed = [], []
        for m in _BRACKET.finditer(s):
            (cited.extend(x.strip() for x in m[1].split(",")) if _GOOD.fullmatch(m[1]) else malformed.append(m[0]))
        out.append({"paragraph": p, "n": n + 1, "text": s, "cited": cited, "malformed": malformed, "numbers": prose.number_mentions(s)})
    return out


@F.pandas_udf(SENTENCES)
def read_sentences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(_read)


def sentences(answers: DataFrame) -> DataFrame:
    return answers.select("answer_id", F.explode(read_sentences("text")).alias("s")).select("answer_id", "s.*")


def verify(answers: DataFrame, passages: DataFrame, values: DataFrame) -> DataFrame:
    """All checks of all answers; an answer without a sentence fails the check that there is one."""
    s = sentences(answers)
    markers = passages.select("answer_id", F.col("number").cast("string").alias("marker")).unionByName(values.select("answer_id", "marker"))
    cited = s.select("answer_id", "n", F.explode("cited").alias("marker"))
    bad = {
        "has sentences": answers.select("answer_id").join(s.select("answer_id").distinct(), "answer_id", "left_anti").select("answer_id", F.lit("the answer is empty").alias("detail")),
        "citations exist": cited.join(markers, ["answer_id", "marker"], "left_anti").select("answer_id", F.concat(F.lit("["), "marker", F.lit("] is not a source")).alias("detail")).unionByName(
            s.select("answer_id", F.explode("malformed").alias("m")).select("answer_id", F.concat("m", F.lit(" is malformed")).alias("detail"))
        ),
        "every sentence cited": s.where("size(cited) = 0").select("answer_id", F.concat(F.lit("sentence "), F.col("n").cast("string"), F.lit(" has no citation")).alias("detail")),
        "numbers traced": _untraced(s, passages, values),
        "no long quotes": _copied(s, passages),
        "no run-on sentences": s.where(F.size(retrieval.tokens(F.col("text"))) > RUN_ON).select("answer_id", F.concat(F.lit("sentence "), F.col("n").cast("string"), F.lit(" is too long")).alias("detail")),
        "easy first paragraph": s.where((F.col("paragraph") == 0) & (F.size(retrieval.tokens(F.col("text"))) > LONG_SENTENCE)).select("answer_id", F.concat(F.lit("sentence "), F.col("n").cast("string"), F.lit(" is long for the first paragraph")).alias("detail")),
        "no dashes": s.where(F.col("text").rlike("[–—]")).select("answer_id", F.concat(F.lit("sentence "), F.col("n").cast("string"), F.lit(" holds a dash")).alias("detail")),
    }
    failures = None
    for name, rows in bad.items():
        part = rows.select("answer_id", F.lit(name).alias("name"), "detail")
        failures = part if failures is None else failures.unionByName(part)
    found = failures.groupBy("answer_id", "name").agg(F.array_join(F.array_sort(F.collect_set("detail")), "; ").alias("detail"))
    every = answers.select("answer_id", F.explode(F.array(*map(F.lit, bad))).alias("name"))
    return every.join(found, ["answer_id", "name"], "left").select("answer_id", "name", F.col("detail").isNull().alias("passed"), F.coalesce("detail", F.lit("")).alias("detail"))


def _numbers(rows: DataFrame, *keep: str) -> DataFrame:
    held = rows.select(*keep, F.explode("numbers").alias("m")).where("m.kind <> 'label'")
    factor = F.when(F.col("m.exponent") == -3, F.lit("0.001").cast("decimal(8,3)")).when(F.col("m.exponent") == 3, F.lit("1000").cast("decimal(8,3)")).otherwise(F.lit("1").cast("decimal(8,3)"))
    value = (exact.plain_decimal(F.col("m.number")) * factor).try_cast(exact.AMOUNT)
    return held.select(*keep, F.col("m.kind").alias("kind"), F.col("m.written").alias("written"), value.alias("value"))


def _untraced(s: DataFrame, passages: DataFrame, values: DataFrame) -> DataFrame:
    """Numbers of a sentence that neither a cited passage nor a cited value holds, by kind of unit."""
    stated = _numbers(s, "answer_id", "n", "cited").select("answer_id", "n", "kind", "written", "value", F.explode_outer("cited").alias("marker"))
    in_passages = _numbers(passages.select("answer_id", F.col("number").cast("string").alias("marker"), prose.find_numbers("body").alias("numbers")), "answer_id", "marker").select("answer_id", "marker", "kind", "value")
    given = in_passages.unionByName(values.select("answer_id", "marker", F.lit("water").alias("kind"), F.col("value").cast(exact.AMOUNT).alias("value"))).distinct()
    traced = stated.join(given, ["answer_id", "marker", "kind", "value"], "left_semi").select("answer_id", "n", "written").distinct()
    return stated.join(traced, ["answer_id", "n", "written"], "left_anti").select("answer_id", F.concat(F.lit("sentence "), F.col("n").cast("string"), F.lit(": "), "written", F.lit(" is not in a cited source")).alias("detail")).distinct()


def _copied(s: DataFrame, passages: DataFrame) -> DataFrame:
    """Sentences that share more words in a row with a passage than its licence and their place allow."""
    texts = s.select("answer_id", F.struct("answer_id", "n", "paragraph").alias("doc_id"), "text")
    sources = passages.select("answer_id", F.struct("number", "reusable").alias("item_id"), F.col("body").alias("text"))
    runs = retrieval.copied_runs(texts, sources, QUOTED, within=("answer_id",))
    over = runs.where(~(F.col("item_id.reusable") & (F.col("doc_id.paragraph") > 0) & (F.col("longest") <= REUSED)))
    return over.select(F.col("doc_id.answer_id").alias("answer_id"), F.concat(F.lit("sentence "), F.col("doc_id.n").cast("string"), F.lit(" copies passage "), F.col("item_id.number").cast("string")).alias("detail"))


def verdict(checks: DataFrame) -> DataFrame:
    return checks.groupBy("answer_id").agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"))
