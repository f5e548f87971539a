"""Checking statements in prose against results and limits.

An Arrow UDF reads each sentence and emits claims: numbers with a unit,
detections, comparisons with a guideline or a number, changes between two
dates, and judgements. Joins and grouped three-valued logic decide them.
Judgements of safety or risk are always listed and never decided.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions import exact, prose
from assaylake.operators.drafting import on_date

_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_DATE = re.compile(rf"\b(?:(?P<iy>\d{{4}})-(?P<im>\d{{2}})-(?P<id>\d{{2}})|(?:(?P<d>\d{{1,2}})\s+)?(?P<m>{_MONTH})\.?\s+(?P<y>\d{{4}}))\b", re.IGNORECASE)
_NUMBER_OF_MONTH = {name[:3]: i for i, name in enumerate(exact.MONTHS, 1)}

_WORD = re.compile(r"[A-Za-z]+(?:['\u2019-][A-Za-z]+)*")


def _lexicon(**meanings: str) -> dict[tuple[str, ...], str]:
    """Phrases, parted by commas, by what they mean."""
    return {tuple(phrase.split()): meaning for meaning, phrases in meanings.items() for phrase in phrases.split(",")}


#: What words say (fixed values).
COMPARES = _lexicon(
    most="at or below, within, meet, meets, met, comply with, complies with, complied with",
    over="above, exceed, exceeds, exceeded, exceeding, exceedance, exceedances, in excess of, over, higher than, greater than, more than",
    under="below, under, lower than, less than",
)
DETECTS = _lexicon(absent="non-detect, non-detects, nondetect, nondetects, undetected", present="detected, detection, detections")
CHANGES = _lexicon(
    up="increase, increased, increases, increasing, rose, risen, rise, rises, rising, went up, gone up, goes up, up from, climbed, higher",
    down="decrease, decreased, decreases, decreasing, fell, fallen, fall, falls, falling, went down, gone down, goes down, down from, lower, dropped, drop, drops, dropping, decline, declined, declines, declining",
    same="similar, stable, unchanged, steady",
)
GUIDELINES = _lexicon(
    guideline="guideline, guidelines, limit, limits, criterion, criteria, screening level, screening levels, screening value, screening values, investigation level, investigation levels, trigger value, trigger values, standard, standards"
)
REPORTING = _lexicon(limit="detection limit, detection limits, limit of reporting, limits of reporting, limit of detection, limits of detection, reporting limit, reporting limits, lor, lod")
JUDGEMENTS = _lexicon(risk="contaminated, polluted, unsafe, hazardous, toxic, health risk, health risks, human risk, human risks, ecological risk, ecological risks")
REFERENCES = _lexicon(earlier="than, compared with, compared to, relative to, versus, vs, since")
DENIALS, BREAKS = frozenset("not no never nor neither".split()), frozenset("and but while whereas although though".split())
DIFFERENCES = frozenset(n + s for n in "increase decrease rise fall drop decline reduction change difference".split() for s in ("", "s"))
ABOUT, LINKS, PLACING = frozenset("about around approximately roughly some".split()), frozenset("of is was are were at equals".split()), frozenset("in on the at".split())
SUMS = frozenset("sum total combined".split())

OPERATORS = {"most": "<=", "over": ">", "under": "<"}

#: Characters of a text in which a comparison's target, or what a number stands for, is looked for.
TARGET, NEXT_NUMBER = 60, 25


class Words:
    """The words of a sentence with their places."""

    def __init__(self, text: str):
        self.text = text
        self.held = [(m.start(), m.end(), m[0].lower().replace("\u2019", "'")) for m in _WORD.finditer(text)]

    def phrase_at(self, i: int, lexicon: dict[tuple[str, ...], str]) -> tuple[int, str] | None:
        """(words, meaning) of the longest phrase that begins with the word ``i``."""
        for size in range(min(3, len(self.held) - i), 0, -1):
            part = self.held[i : i + size]
            meaning = lexicon.get(tuple(w for _, _, w in part))
            if meaning and all(self.text[a[1] : b[0]].isspace() for a, b in zip(part, part[1:])):
                return size, meaning
        return None

    def find(self, lexicon: dict[tuple[str, ...], str], start: int = 0, end: int | None = None) -> list[tuple[int, int, str, int]]:
        """(start, end, meaning, number of the first word) of phrases within a stretch of the text."""
        out, i = [], 0
        while i < len(self.held):
            found = self.phrase_at(i, lexicon) if self.held[i][0] >= start else None
            if found and (end is None or self.held[i + found[0] - 1][1] <= end):
                out.append((self.held[i][0], self.held[i + found[0] - 1][1], found[1], i))
            i += found[0] if found else 1
        return out

    def before(self, at: int, gap: str = " \t\n") -> int | None:
        """The word that ends right before ``at``, with nothing but ``gap`` between."""
        i = next((k for k in range(len(self.held) - 1, -1, -1) if self.held[k][1] <= at), None)
        return i if i is not None and not self.text[self.held[i][1] : at].strip(gap) else None

    def ends_with(self, i: int | None, lexicon: dict[tuple[str, ...], str]) -> str | None:
        """What the phrase means whose last word is ``i``."""
        if i is None:
            return None
        return next((found[1] for k in range(max(0, i - 2), i + 1) if (found := self.phrase_at(k, lexicon)) and k + found[0] - 1 == i), None)

    def led_by(self, at: int, lexicon: dict[tuple[str, ...], str], gap: str) -> bool:
        """Whether a phrase stands before ``at``, with a linking word between or none."""
        i = self.before(at, gap)
        if self.ends_with(i, lexicon):
            return True
        if i is None or self.held[i][2] not in LINKS:
            return False
        return self.ends_with(self.before(self.held[i][0], gap), lexicon) is not None

    def is_difference(self, at: int) -> bool:
        """Whether a number at ``at`` says by how much something differs."""
        i = self.before(at)
        if i is not None and self.held[i][2] in ABOUT:
            i = self.before(self.held[i][0])
        if i is None:
            return False
        word = self.held[i][2]
        return word == "by" or word == "of" and i > 0 and self.held[i - 1][2] in DIFFERENCES

    def is_reference(self, at: int) -> bool:
        """Whether something is compared with what stands at ``at``."""
        i = self.before(at)
        if i is not None and self.held[i][2] in PLACING:
            i = self.before(self.held[i][0])
        return self.ends_with(i, REFERENCES) is not None

    def denied(self, at: int) -> bool:
        """Whether the clause up to ``at`` denies what comes there."""
        edges = [self.text.rfind(mark, 0, at) + 1 for mark in ";,:"] + [end for _, end, w in self.held if w in BREAKS and end <= at]
        start = max(edges, default=0)
        return any((w in DENIALS or w.endswith("n't")) and a >= start and e <= at for a, e, w in self.held)

    def judgements(self) -> list[tuple[int, int]]:
        """Words of judgement; ``safe to`` or ``safe for`` with what it is safe for."""
        out = [(a, e) for a, e, _, _ in self.find(JUDGEMENTS)]
        for x, y, z in zip(self.held, self.held[1:], self.held[2:]):
            if x[2] == "safe" and y[2] in ("to", "for"):
                out.append((x[0], z[1]))
        for i, x in enumerate(self.held):  # poses a (serious) risk
            rest = [w for _, _, w in self.held[i + 1 : i + 4]]
            bare = rest[1:] if rest[:1] in (["a"], ["an"]) else rest
            if x[2] in ("pose", "poses") and (k := next((k for k, w in enumerate(bare[:2]) if w in ("risk", "risks")), None)) is not None:
                whole = (x[0], self.held[i + 1 + len(rest) - len(bare) + k][1])
                out = [o for o in out if not whole[0] <= o[0] < whole[1]] + [whole]
        return sorted(out)


_DAY = T.StructType([T.StructField(n, T.IntegerType()) for n in "ymd"])
CLAIM = T.StructType(
    [
        T.StructField("sentence", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("quote", T.StringType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("summed", T.BooleanType()),
        T.StructField("dates", T.ArrayType(_DAY)),
        T.StructField("op", T.StringType()),
        T.StructField("negated", T.BooleanType()),
        T.StructField("number", T.StringType()),
        T.StructField("exponent", T.IntegerType()),
        T.StructField("rule", T.StringType()),
    ]
)


def _dates(text: str) -> list[tuple[int, int, dict]]:
    out = []
    for m in _DATE.finditer(text):
        if m["iy"]:
            out.append((m.start(), m.end(), {"y": int(m["iy"]), "m": int(m["im"]), "d": int(m["id"])}))
        else:
            out.append((m.start(), m.end(), {"y": int(m["y"]), "m": _NUMBER_OF_MONTH[m["m"][:3].lower()], "d": int(m["d"]) if m["d"] else None}))
    return out


def read_sentence(n: int, text: str, analytes: list[str], rules: dict[str, str]) -> list[dict]:
    """The claims of one sentence."""
    dates, numbers = _dates(text), [x for x in prose.number_mentions(text) if x["kind"] == "water"]
    held = [(m.start(), a) for a in analytes for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(a)}(?![A-Za-z0-9])", text, re.IGNORECASE)]
    held.sort()
    words = Words(text)
    summed = any(w in SUMS for _, _, w in words.held) and len({a for _, a in held}) > 1
    rule = next((r for r, pattern in rules.items() if re.search(pattern, text, re.IGNORECASE)), None)

    def subject(at: int) -> list[str]:
        names = list(dict.fromkeys(a for _, a in held))
        if summed or not names:
            return names
        before = [a for p, a in held if p < at]
        return [before[-1] if before else names[0]]

    def claim(kind: str, m: tuple[int, int], **more) -> dict:
        base = {"sentence": n, "start": m[0], "kind": kind, "quote": text[m[0] : m[1]].strip(), "names": subject(m[0]), "summed": summed, "dates": [d for _, _, d in dates], "op": None, "negated": words.denied(m[0]), "number": None, "exponent": None, "rule": rule}
        return base | more

    out, targets = [], set()
    compared = {a for a, _, _, _ in words.find(COMPARES)}
    for start, end, meaning, _ in words.find(COMPARES):
        number = next((x for x in numbers if end <= x["start"] <= end + NEXT_NUMBER), None)
        if words.find(REPORTING, end, end + TARGET):
            continue
        if number is not None:
            targets.add(number["start"])
            out.append(claim("threshold", (start, end), op=OPERATORS[meaning], number=number["number"], exponent=number["exponent"]))
        elif words.find(GUIDELINES, end, end + TARGET) or rule and re.search(rules[rule], text[end : end + TARGET], re.IGNORECASE):
            out.append(claim("guideline", (start, end), op=OPERATORS[meaning]))
    for x in numbers:
        at = x["start"]
        if at in targets:
            continue
        if words.is_difference(at):
            role = "difference"
        elif words.led_by(at, REPORTING, " \t\n(:=<"):
            role = "detection limit"
        else:
            role = "guideline value" if words.led_by(at, GUIDELINES, " \t\n(:=") else "result"
        out.append(claim(role, (at, at + len(x["written"])), number=x["number"], exponent=x["exponent"], op="<" if text[:at].rstrip().endswith("<") else "="))
    for start, end, meaning, i in words.find(DETECTS):
        after = words.held[i + 1][2] if i + 1 < len(words.held) else ""
        if meaning == "absent" or not (i and words.held[i - 1][2] == "of" or after in ("limit", "limits")):
            out.append(claim("detection", (start, end), negated=words.denied(start) != (meaning == "absent")))
    for start, end, meaning, _ in words.find(CHANGES):
        if text[start:end].lower() in ("higher", "lower") and start in compared and not dates:
            continue
        ordered = [d for _, _, d in dates]
        if len(dates) == 2 and words.is_reference(dates[1][0]):
            ordered.reverse()
        out.append(claim("change", (start, end), op=meaning, dates=ordered))
    out += [claim("judgement", m) for m in words.judgements()]
    return out


def claims(paragraphs: DataFrame, analytes: list[str], rules: dict[str, str]) -> DataFrame:
    """One row for each claim of (paragraph_id, well, text); ``rules`` maps a rule to the pattern of its names."""

    @F.pandas_udf(T.ArrayType(CLAIM))
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda parts: [c for n, s in enumerate(parts) for c in read_sentence(n, s, analytes, rules)] if parts is not None else [])

    found = paragraphs.select("paragraph_id", F.col("well").cast("string").alias("well"), F.explode(read(prose.sentences(F.col("text")))).alias("c")).select("paragraph_id", "well", "c.*")
    factor = F.when(F.col("exponent") == -3, F.lit("0.001").cast("decimal(8,3)")).when(F.col("exponent") == 3, F.lit("1000").cast("decimal(8,3)")).otherwise(F.lit("1").cast("decimal(8,3)"))
    return found.withColumn("value", (exact.plain_decimal(F.col("number")) * factor).try_cast(exact.AMOUNT)).withColumn("claim_id", F.row_number().over(Window.partitionBy("paragraph_id").orderBy("sentence", "start", "kind")))


def check(paragraphs: DataFrame, results: DataFrame, screened: DataFrame, analytes: list[str], rules: dict[str, str]) -> DataFrame:
    """(paragraph_id, claim_id, sentence, kind, quote, status) for every claim.

    ``results`` has one row for each (well, date, analyte), ``screened`` the
    screens of the same rounds. Status is consistent, inconsistent, untraced,
    not confirmed, depends on rule, or not checked.
    """
    found = claims(paragraphs, analytes, rules)
    lab = results.select(F.col("well").cast("string").alias("l_well"), "date", F.lower("analyte").alias("analyte"), F.coalesce("value", F.lit(0).cast(exact.AMOUNT)).alias("low"), F.coalesce("value", "lor").alias("high"), F.col("value").alias("detected"), "lor")
    keys = ["paragraph_id", "claim_id"]
    named = found.withColumn("names", F.transform("names", lambda x: F.lower(x)))

    # One row for each claim and round: bounds of the subject, exact where all parts are detected.
    parts = named.where("size(names) > 0 and kind <> 'judgement'").select(*keys, "kind", "dates", "op", "negated", "value", "rule", "well", "names", F.explode("names").alias("name"))
    at = parts.join(lab, (F.col("well") == F.col("l_well")) & (F.col("name") == F.col("analyte")))
    in_scope = (F.size("dates") == 0) | F.exists("dates", lambda d: on_date(d, F.col("date")))
    rounds = at.withColumn("in_scope", in_scope).groupBy(*keys, "date").agg(
        F.first("kind").alias("kind"), F.first("op").alias("op"), F.first("negated").alias("negated"), F.first("value").alias("value"), F.first("dates").alias("dates"), F.first("in_scope").alias("in_scope"), F.first("rule").alias("rule"), F.first("well").alias("well"),
        F.size(F.first("names")).alias("n_names"), F.first("name").alias("name"), F.count("*").alias("n"), F.count("detected").alias("n_detected"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.max("lor").alias("lor"),
    ).where("n = n_names")
    exactly = F.col("n_detected") == F.col("n")
    hit = F.when(F.col("op") == "<", ~exactly & (F.col("high") == F.col("value"))).otherwise(exactly & (F.col("low") == F.col("value")))
    numbers = rounds.where("kind in ('result', 'detection limit')").withColumn("hit", F.when(F.col("kind") == "detection limit", F.col("lor") == F.col("value")).otherwise(hit)).groupBy(*keys).agg(F.bool_or(F.col("hit") & F.col("in_scope")).alias("here"), F.bool_or("hit").alias("anywhere"))
    decided = [numbers.select(*keys, F.when(F.col("here"), "consistent").when(F.col("anywhere"), "inconsistent").otherwise("untraced").alias("status"))]

    def kleene(test: F.Column) -> F.Column:
        answer = exact.all_three_valued(test)
        return F.when(answer.isNull(), "not confirmed").when(answer, "consistent").otherwise("inconsistent")

    said = F.col("negated")
    found_all = F.when(F.col("n_detected") == F.col("n"), True).when(F.col("n_detected") == 0, False)
    decided.append(rounds.where("kind = 'detection' and in_scope").groupBy(*keys).agg(kleene(F.when(said, ~found_all).otherwise(found_all)).alias("status")))
    low, high, limit = F.col("low"), F.col("high"), F.col("value")
    holds = F.when(F.col("op") == ">", exact.compare_bounds(low, high, ">", limit)).when(F.col("op") == "<", exact.compare_bounds(low, high, "<", limit)).otherwise(exact.compare_bounds(low, high, "<=", limit))
    decided.append(rounds.where("kind = 'threshold' and in_scope").groupBy(*keys).agg(kleene(F.when(said, ~holds).otherwise(holds)).alias("status")))

    # Guideline claims: one outcome for each rule, from the screens of the subject.
    screens = screened.where("status <> 'not analysed'").select(F.col("well").cast("string").alias("s_well"), F.col("date").alias("s_date"), F.col("rule").alias("s_rule"), F.lower(F.coalesce("alone", "key")).alias("s_key"), "above")
    subject = F.when(F.col("n_names") > 1, F.lit(None)).otherwise(F.col("name"))
    ruled = rounds.where("kind = 'guideline' and in_scope").withColumn("subject", subject).join(
        screens, (F.col("well") == F.col("s_well")) & (F.col("date") == F.col("s_date")) & (F.col("s_key") == F.col("subject")) & (F.col("rule").isNull() | (F.col("rule") == F.col("s_rule")))
    )
    is_above = F.col("op") == ">"
    outcome = F.when(is_above != said, F.col("above")).otherwise(~F.col("above"))
    by_rule = ruled.groupBy(*keys, "s_rule").agg(kleene(outcome).alias("one"))
    decided.append(by_rule.groupBy(*keys).agg(F.when(F.count_distinct("one") == 1, F.first("one")).otherwise("depends on rule").alias("status")))

    # Changes: the first and second date of the claim, in the order told.
    which = F.when(on_date(F.col("dates")[0], F.col("date")), 0).when(on_date(F.col("dates")[1], F.col("date")), 1)
    two = rounds.where("kind = 'change' and size(dates) = 2").withColumn("which", which).where("which is not null")
    ends = two.groupBy(*keys).agg(
        F.first("op").alias("op"), F.first("negated").alias("negated"), F.count_distinct("which").alias("k"), F.count("*").alias("n"),
        F.max(F.when(F.col("which") == 0, F.col("low"))).alias("l0"), F.max(F.when(F.col("which") == 0, F.col("high"))).alias("h0"), F.max(F.when(F.col("which") == 1, F.col("low"))).alias("l1"), F.max(F.when(F.col("which") == 1, F.col("high"))).alias("h1"),
    ).where("k = 2 and n = 2")
    up = F.when(F.col("l1") > F.col("h0"), True).when(F.col("h1") <= F.col("l0"), False)
    down = F.when(F.col("h1") < F.col("l0"), True).when(F.col("l1") >= F.col("h0"), False)
    same = F.when((F.col("l0") == F.col("h0")) & (F.col("l1") == F.col("h1")) & (F.col("l0") == F.col("l1")), True)
    moved = F.when(F.col("op") == "up", up).when(F.col("op") == "down", down).otherwise(same)
    moved = F.when(F.col("negated"), ~moved).otherwise(moved)
    decided.append(ends.select(*keys, F.when(moved.isNull(), "not confirmed").when(moved, "consistent").otherwise("inconsistent").alias("status")))

    status = decided[0]
    for part in decided[1:]:
        status = status.unionByName(part)
    fallback = F.when(F.col("kind").isin("result", "detection limit"), "untraced").otherwise("not checked")
    return found.select(*keys, "sentence", "kind", "quote").join(status, keys, "left").withColumn("status", F.coalesce("status", fallback))


def report(checked: DataFrame) -> DataFrame:
    """Counts by status for each paragraph, and how many claims need attention."""
    count = {s: F.count_if(F.col("status") == s).alias(f"n_{s.replace(' ', '_')}") for s in ("consistent", "inconsistent", "untraced", "not confirmed", "depends on rule", "not checked")}
    return checked.groupBy("paragraph_id").agg(*count.values(), F.count_if(F.col("status") != "consistent").alias("n_attention"))
