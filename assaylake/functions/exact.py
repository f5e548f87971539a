"""Column expressions for exact concentrations and three-valued logic.

Concentrations are DECIMAL(18,9); a null value means not detected, never zero.
Rounding is named by its mode. All expressions stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 9)

#: Places that a concentration may have after conversion.
PLACES = 9

#: Units by spelling key: the matrix and the power of ten to its canonical unit (fixed values).
UNITS = {
    "ng/l": ("water", -3),
    "ug/l": ("water", 0),
    "mg/l": ("water", 3),
    "ug/kg": ("soil", -3),
    "mg/kg": ("soil", 0),
}
CANONICAL_UNIT = {"water": "ug/L", "soil": "mg/kg"}

#: Months in order (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

#: Matrices by the words that files use (fixed values).
MATRICES = {"s": "soil", "soil": "soil", "w": "water", "water": "water", "groundwater": "water"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def unit_key(raw: Column) -> Column:
    """Spelling key of a unit: no white space, lower case, both mu signs as u, mcg as ug."""
    plain = F.translate(F.regexp_replace(raw, r"\s+", ""), "µμΜ", "uuu")  # the capital too, so that lower() mostly meets ASCII
    return F.replace(F.lower(plain), F.lit("mcg"), F.lit("ug"))


def unit_matrix(key: Column) -> Column:
    return literal_map({k: m for k, (m, _) in UNITS.items()})[key]


def unit_factor(key: Column) -> Column:
    """Exact decimal factor that turns a number in this unit into the canonical unit."""
    factors = {k: e for k, (_, e) in UNITS.items()}
    out = F.lit(None).cast(T.DecimalType(8, 3))
    for k, e in factors.items():
        out = F.when(key == k, F.lit(f"{10.0**e:.3f}").cast(T.DecimalType(8, 3))).otherwise(out)
    return out


def plain_decimal(text: Column) -> Column:
    """A plain decimal without sign or exponent, commas ignored; null for anything else."""
    cleaned = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(cleaned.rlike(r"^[0-9]*\.?[0-9]+$"), cleaned.try_cast("decimal(27,12)"))


def fits(amount: Column) -> Column:
    """True where a converted number is kept whole by DECIMAL(18,9)."""
    return amount.try_cast(AMOUNT).isNotNull() & (amount.try_cast(AMOUNT) == amount)


def shown(amount: Column) -> Column:
    """Without trailing zeros or exponent; zero is ``0``."""
    text = amount.cast(T.DecimalType(38, 12)).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def percent_change_half_even(before: Column, after: Column) -> Column:
    """Change in percent to one place; null where ``before`` is zero."""
    wide = T.DecimalType(28, 9)
    return F.when(before != 0, F.bround((after - before).cast(wide) * 100 / before, 1).cast(T.DecimalType(20, 1)))


def exceeds_rpd(a: Column, b: Column, threshold) -> Column:
    """Relative percent difference above a threshold, by cross-multiplication."""
    return F.abs(a - b) * 200 > F.lit(threshold) * (a + b)


def rpd_half_up(a: Column, b: Column, places: int = 1) -> Column:
    return F.when(a + b != 0, F.round((F.abs(a - b) * 200).cast("decimal(38,14)") / (a + b), places))


def rpd_shown(a: Column, b: Column, threshold: int) -> Column:
    """The difference to the fewest places, from 1 to 6, at which a breach doesn't read as the threshold."""
    out = shown(rpd_half_up(a, b, 6))
    for places in range(5, 0, -1):
        at = rpd_half_up(a, b, places)
        out = F.when(~exceeds_rpd(a, b, threshold) | (at > threshold), shown(at)).otherwise(out)
    return out


def ratio_half_up(a: Column, b: Column) -> Column:
    return F.round(a.cast("decimal(28,9)") / b, 2)


def ratio_half_even(a: Column, b: Column) -> Column:
    return F.bround(a.cast("decimal(28,9)") / b, 2)


def above_bounds(low: Column, high: Column, limit: Column) -> Column:
    """True, false or null for a value known to lie in [low, high]; equality is not above."""
    return F.when(low > limit, True).when(high <= limit, False)


def compare_bounds(low: Column, high: Column, op: str, limit: Column) -> Column:
    if op == ">":
        return above_bounds(low, high, limit)
    if op == "<":
        return F.when(high < limit, True).when(low >= limit, False)
    return ~compare_bounds(low, high, {">=": "<", "<=": ">"}[op], limit)


def all_three_valued(test: Column) -> Column:
    """Aggregate: false if any is false, else null if any is null, else true; true over no rows."""
    return F.when(F.count_if(~test) > 0, False).when(F.count_if(test.isNull()) > 0, F.lit(None)).otherwise(True)


def compact_id(sample: Column) -> Column:
    """Letters and digits of an identifier, in lower case."""
    return F.regexp_replace(F.lower(sample), "[^0-9a-z]", "")


def stamps_agree(a: Column, b: Column) -> Column:
    """Same day, and the same minute where both stamps (d, minute, written) have one."""
    return (a["d"] == b["d"]) & (a["minute"].isNull() | b["minute"].isNull() | (a["minute"] == b["minute"]))


def plural(n: Column, word: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, word).otherwise(word + "s"))


def listed(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, ", ")).otherwise(F.concat(F.array_join(F.slice(items, 1, n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def iso_stamp(at: Column) -> Column:
    """``2025-09-12`` or, where the stamp has a time, ``2025-09-12 13:40``."""
    day = F.date_format(at["d"], "yyyy-MM-dd")
    return F.concat_ws(" ", day, F.when(at["minute"].isNotNull(), F.format_string("%02d:%02d", F.floor(at["minute"] / 60), at["minute"] % 60)))


def long_date(day: Column) -> Column:
    """``6 September 2025``."""
    return F.date_format(day, "d MMMM yyyy")


def first_words(text: Column, most: int) -> Column:
    """A text cut after ``most`` words, its white space made single; an ellipsis marks the cut."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return F.concat(F.array_join(F.slice(words, 1, most), " "), F.when(F.size(words) > most, " ...").otherwise(""))
