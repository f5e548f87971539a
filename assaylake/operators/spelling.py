"""Spelling proposals from a corpus's own words.

Two words within k edits share a string that each gives up to k letters for,
so candidates meet by equality on such strings and no block of words by first
letter is ever compared in full. The distance counts an adjacent swap as one
edit and is found for the candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.session import cut

#: Limits of proposals (fixed values).
LEAST_LENGTH, LONG_WORD, LEAST_USES, CLEAR_WINNER = 4, 7, 2, 1.5


def swap_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; no part is edited twice."""
    # what both begin or end with needs no edit
    first, most = 0, min(len(a), len(b))
    while first < most and a[first] == b[first]:
        first += 1
    last = 0
    while last < most - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    rows: list[list[int]] = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows = [*rows[-1:], row]
    return rows[-1][-1]


@F.pandas_udf(T.IntegerType())
def _distance(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([None if x is None else swap_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def shortened(word: Column, limit: Column) -> Column:
    """The word and all strings that lack one letter of it, or two where the limit is two."""
    once = _without_one(word)
    twice = F.when((limit == 2) & (F.length(word) > 1), F.flatten(F.transform(once, _without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def proposals(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, proposal, distance, uses): the one clearly meant word of ``vocabulary`` (word, uses) for each unknown word.

    Words are lower-case letters. A word of seven letters or more may differ by
    two edits, others by one, and the first letter is kept. The closest wins,
    among them the same letters in another order, then the most used; without
    half as many uses again as the next such word there is no proposal.
    Repeated, null, known and short words give none.
    """
    known = vocabulary.where((F.col("uses") >= LEAST_USES) & (F.length("word") >= LEAST_LENGTH - 1) & F.col("word").rlike("^[a-z]+$")).select("word", "uses")
    asked = words.select("word").where((F.length("word") >= LEAST_LENGTH) & F.col("word").rlike("^[a-z]+$")).distinct()
    limit = F.when(F.length("word") >= LONG_WORD, 2).otherwise(1).alias("k")
    typed = asked.join(vocabulary.select("word"), "word", "left_anti").select(F.col("word").alias("typed"), limit)

    def forms(word: Column) -> Column:
        """Hashes of the first letter, which is kept, with what is left of the others, and with the limit."""
        first, rest = F.substring(word, 1, 1), F.substring(word, F.lit(2), F.length(word))
        return F.transform(shortened(rest, F.col("k")), lambda x: F.xxhash64(first, x, F.col("k")))

    # Words meet by a hash; what meets by chance is too far apart and goes with the others.
    left = typed.select("typed", F.explode(forms(F.col("typed"))).alias("form"))
    right = known.select("word", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select("word", F.explode(forms(F.col("word"))).alias("form"))
    k = F.when(F.length("typed") >= LONG_WORD, 2).otherwise(1)
    met = left.join(right, "form").select("typed", "word", k.alias("k")).where((F.substring("typed", 1, 1) == F.substring("word", 1, 1)) & (F.abs(F.length("typed") - F.length("word")) <= F.col("k"))).distinct()
    # A swap is two plain edits and keeps the letters, so only pairs that may hold one go to the UDF.
    sorted_ = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    measured_ = met.withColumn("plain", F.levenshtein("typed", "word", 4)).where((F.col("plain") >= 0) & (F.col("plain") <= 2 * F.col("k")))
    pairs = measured_.withColumns({"typed_letters": sorted_("typed"), "letters": sorted_("word")})
    swapped = (F.col("plain") > 1) & ((F.col("plain") <= F.col("k")) | (F.levenshtein("typed_letters", "letters") <= 2 * (2 * F.col("k") - F.col("plain"))))
    distance = F.when(F.col("plain") <= 1, F.col("plain")).otherwise(_distance(F.when(F.col("plain") > 1, F.col("typed")), "word"))
    scored = pairs.where((F.col("plain") <= 1) | swapped).withColumn("distance", distance).where(F.col("distance") <= F.col("k")).join(known, "word").withColumn("other", F.col("typed_letters") != F.col("letters"))
    scored = cut(scored.select("typed", "word", "uses", "distance", "other"), "spelling-pairs")
    best = scored.groupBy("typed").agg(F.min(F.struct("distance", "other")).alias("best"))
    level = scored.join(best, "typed").where((F.col("distance") == F.col("best.distance")) & (F.col("other") == F.col("best.other")))
    first = level.groupBy("typed").agg(F.min(F.struct((-F.col("uses")).alias("u"), F.col("word").alias("w"), "distance")).alias("first"))
    rival = level.join(first, "typed").where(F.col("word") != F.col("first.w")).groupBy("typed").agg(F.max("uses").alias("rival"))
    chosen = first.join(rival, "typed", "left").where(F.col("rival").isNull() | (F.col("rival") * CLEAR_WINNER <= -F.col("first.u")))
    return chosen.select(F.col("typed").alias("word"), F.col("first.w").alias("proposal"), F.col("first.distance").alias("distance"), (-F.col("first.u")).alias("uses"))


def corrected(questions: DataFrame, chosen: DataFrame) -> DataFrame:
    """(qid, text, n_changed): questions (qid, text) with each misspelt word of ``chosen`` put right, case of its first letter kept."""
    pieces = questions.select("qid", F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+|[^A-Za-z]+"), F.lit(0))).alias("pos", "piece"))
    joined = pieces.join(chosen.select(F.col("word"), "proposal"), F.lower("piece") == F.col("word"), "left")
    put = F.when(F.col("proposal").isNull(), F.col("piece")).when(F.col("piece").rlike("^[A-Z]"), F.initcap("proposal")).otherwise(F.col("proposal"))
    return joined.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", put.alias("p")))), lambda x: x["p"]), "").alias("text"), F.count("proposal").alias("n_changed"))
