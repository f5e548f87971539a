"""Porter's stemmer (1980) and positional phrases.

Arrow UDFs stem single words or whole arrays; a worker stems each distinct word
once and keeps its stem.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes and their replacements by step of the published algorithm (fixed values).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

def _shape(stem: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in stem:
        vowel = ch in "aeiou" or ch == "y" and out[-1:] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How many times a consonant follows a vowel."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x or y at the end."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted((s for s in table if word.endswith(s)), key=len, reverse=True)[:1]:
        stem = word[: -len(suffix)]
        return stem + table[suffix] if _measure(stem) > least else word
    return word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
    if ending is None:
        return word
    stem = word[: -len(ending)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-1:] == stem[-2:-1] and _shape(stem).endswith("cc") and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _drop(word: str) -> str:
    suffix = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
        return stem
    return word


def porter(word: str) -> str:
    """The stem of a lower-case word; words under three or over 64 letters stay."""
    if not 3 <= len(word) <= 64:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _drop(_swap(_swap(word, STEP_2, 0), STEP_3, 0))
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not _short_end(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(T.StringType())
def stem(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Null stays null."""
    for batch in words:
        yield batch.map(lambda w: porter(w) if isinstance(w, str) else None)


#: Stems that one worker keeps; the store is emptied when it is full.
KEPT = 500_000

_known: dict[str, str] = {}


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stems of an array of words, in their order; null stays null."""

    def one(held) -> list[str] | None:
        if held is None:
            return None
        if len(_known) > KEPT:
            _known.clear()
        for w in set(held) - _known.keys():
            _known[w] = porter(w)
        return [_known[w] for w in held]

    for batch in words:
        yield batch.map(one)
