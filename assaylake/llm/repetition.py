"""Repetition inside a text, from a suffix array over its words.

The suffixes of the word sequence are sorted by prefix doubling: suffixes that
are still tied are sorted by the rank of what follows, twice as far each round.
The ranks of each round give the longest common prefix of neighbours in the
array by descending powers of two. A run of neighbours that share at least L
words is an LCP interval; its substring is a maximal repeat where the words
before its occurrences differ. The spans of all maximal repeats are united, and
a text is kept if neither the covered share of its characters nor its longest
repeat is beyond a limit.

The same array over characters finds repeats that no 8 words hold: short
phrases, parts of words, and texts without spaces. Their covered share and
longest repeat have limits of their own.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from assaylake.llm.common import WORD, extended, texts_of

#: Words in a repeat that counts.
WINDOW = 8

#: Limits of the method's verdict.
MAX_COVERED = 0.3
MAX_LONGEST = 200

#: Characters in a repeat that counts, and the limits on such repeats: the covered share of all
#: characters, and the longest one as a share of them (shorter ones than MIN_LONGEST_CHARS pass).
CHARS = 20
MAX_CHARS_COVERED = 0.3
MAX_CHARS_LONGEST = 0.1
MIN_LONGEST_CHARS = 100

#: Limits of the base rules (fixed values).
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

_word = re.compile(WORD)
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def suffix_array(ids: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``ids`` and the LCP of each suffix with the one before it.

    ``ids`` are non-negative integers. Ties are broken exactly, however long
    they last. ``reach`` only steers effort: once no tie is left, or for ties
    beyond it, rounds touch nothing but tied suffixes.
    """
    n = len(ids)
    levels = [np.append(ids.astype(np.int64) + 1, 0)]  # rank by the first 2**k words; 0 beyond the end
    order = np.argsort(levels[0][:n], kind="stable")
    rank, tied = _ranked(levels[0][order], order, n)
    width = 1
    while len(tied):
        # tied: places in the array whose suffix shares its rank with a neighbour
        after = np.minimum(order[tied] + width, n)
        key = rank[order[tied]] * (n + 2) + rank[after]
        by = np.argsort(key, kind="stable")
        order[tied] = order[tied][by]
        key = key[by]
        levels.append(rank)
        rank, tied = _refined(rank, order, tied, key, n)
        width *= 2
    levels.append(rank)
    return order, _lcp(levels[1:], order, n)


def _ranked(values: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    new = np.append(True, values[1:] != values[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = first + 1
    alone = new & np.append(new[1:], True)
    return rank, np.flatnonzero(~alone)


def _refined(rank: np.ndarray, order: np.ndarray, tied: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """New ranks of the tied places; a rank is one more than the first place of its group."""
    new = np.append(True, key[1:] != key[:-1])
    first = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
    out = rank.copy()
    out[order[tied]] = first + 1
    alone = new & np.append(new[1:], True)
    return out, tied[~alone]


def _lcp(levels: list[np.ndarray], order: np.ndarray, n: int) -> np.ndarray:
    """levels[k]: ranks by the first 2**k words. LCP of each place with the one before; 0 for the first."""
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    a, b = order[:-1].copy(), order[1:].copy()
    at = np.arange(1, n)
    live = levels[0][a] == levels[0][b]
    a, b, at = a[live], b[live], at[live]
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) & (levels[k][a] > 0)
        step = same * (1 << k)
        lcp[at] += step
        a, b = np.minimum(a + step, n), np.minimum(b + step, n)
    return lcp


def maximal_repeats(ids: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Maximal repeats of at least ``least`` words: (length, occurrences, first start).

    Each is an LCP interval of the suffix array whose occurrences are preceded
    by more than one word (or by the start of the text).
    """
    order, lcp = suffix_array(ids, least)
    return intervals(ids, order, lcp, least)


def intervals(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``maximal_repeats`` from a suffix array. Only places under a repeat are visited, each once."""
    places = np.flatnonzero(lcp >= least)
    if not len(places):
        return []
    before = np.where(order > 0, np.append(ids, -1)[order - 1], -1)
    out: list[tuple[int, int, int]] = []
    for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
        base = int(run[0]) - 1
        starts, lefts, lengths = order[base : run[-1] + 1].tolist(), before[base : run[-1] + 1].tolist(), lcp[run].tolist()
        stack: list[list] = []  # [lcp, left edge, first start, word before or None where words differ]
        for i, length in enumerate([*lengths, 0]):
            left, first, word = i, starts[i], lefts[i] if starts[i] else None
            while stack and stack[-1][0] > length:
                size, left, low, common = stack.pop()
                first, word = min(first, low), common if common == word else None
                if word is None:
                    out.append((size, i + 1 - left, first))
                if stack and stack[-1][0] >= length:
                    stack[-1][2] = min(stack[-1][2], first)
                    stack[-1][3] = word if word == stack[-1][3] else None
                    first, word = stack[-1][2], stack[-1][3]
            if length and (not stack or stack[-1][0] < length):
                stack.append([length, left, first, word])
            elif length:
                stack[-1][2] = min(stack[-1][2], first)
                stack[-1][3] = word if word == stack[-1][3] else None
    return sorted(out)


def longest_at(ids: np.ndarray, least: int) -> np.ndarray:
    """For each word the length of the longest repeat that starts there, 0 if under ``least``."""
    return _longest(*suffix_array(ids, least), least)


def _longest(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    longest = np.zeros(len(order), np.int64)
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    longest[longest < least] = 0
    return longest


def _covered(longest: np.ndarray) -> np.ndarray:
    """Words under the union of the spans [i, i + longest[i])."""
    at = np.flatnonzero(longest)
    reach = np.zeros(len(longest) + 1, np.int64)
    np.add.at(reach, at, 1)
    np.subtract.at(reach, at + longest[at], 1)
    return np.cumsum(reach[:-1]) > 0


def _numbered(words: list[str], seen: dict[str, int]) -> list[int]:
    return [seen.setdefault(w, len(seen)) for w in words]


_BASE = 0x9E3779B97F4A7C15
_powers, _inverses = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _any_repeat(ids: np.ndarray, size: int) -> bool:
    """False only where no ``size`` neighbouring ids come twice: equal windows always have equal hashes."""
    global _powers, _inverses
    if len(_powers) <= len(ids):
        _powers, _inverses = (
            np.concatenate([np.ones(1, np.uint64), np.full(2 * len(ids), base, np.uint64).cumprod(dtype=np.uint64)]) for base in (_BASE, pow(_BASE, -1, 1 << 64))
        )
    sums = np.concatenate([np.zeros(1, np.uint64), ((ids.astype(np.uint64) + np.uint64(1)) * _powers[: len(ids)]).cumsum(dtype=np.uint64)])
    windows = np.sort((sums[size:] - sums[:-size]) * _inverses[: len(sums) - size])
    return bool((windows[1:] == windows[:-1]).any())


def char_repeats(text: str, least: int = CHARS) -> tuple[int, int, float]:
    """Maximal repeats of ``least`` characters or more in a whole text: their number, the longest, the share covered."""
    if len(text) <= least:
        return 0, 0, 0.0
    ids = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not _any_repeat(ids, least):
        return 0, 0, 0.0
    order, lcp = suffix_array(ids, least)
    found = intervals(ids, order, lcp, least)
    if not found:
        return 0, 0, 0.0
    return len(found), found[-1][0], float(_covered(_longest(order, lcp, least)).mean())


def measure(texts: list[str | None], window: int = WINDOW, words_at_once: int = 400_000) -> pd.DataFrame:
    """Base counts and repeats of whole texts.

    Words of many texts are sorted together, each text's words under numbers of
    its own and with an end mark of its own, so that no repeat crosses texts.
    """
    rows, held, ids = [], [], []
    results: list[tuple[int, int, float] | None] = [None] * len(texts)

    def flush() -> None:
        if not held:
            return
        joined = np.array(ids, np.int64)
        longest = longest_at(joined, window)
        covered = _covered(longest)
        for number, start, lengths in held:
            own, over = longest[start : start + len(lengths)], covered[start : start + len(lengths)]
            chars = np.array(lengths)
            results[number] = (int(over.sum()), int(own.max(initial=0)), float(chars[over].sum() / max(1, chars.sum())))
        held.clear()
        ids.clear()

    numbered = 0
    for number, text in enumerate(texts):
        text = text if isinstance(text, str) else ""
        words = _word.findall(text)
        lines = text.split("\n")
        n_dup_lines = 0
        if len(set(lines)) < len(lines):
            seen_lines: set[str] = set()
            for line in lines:
                if line in seen_lines:
                    n_dup_lines += _word.search(line) is not None
                seen_lines.add(line)
        rows.append((len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), n_dup_lines))
        seen: dict[str, int] = {}
        local = _numbered(words, seen)
        if len(words) - len(seen) < window:  # two windows with equal words repeat at least that many
            results[number] = (0, 0, 0.0)
            continue
        held.append((number, len(ids), list(map(len, words))))
        ids += [i + numbered for i in local]
        numbered += len(seen)
        ids.append(numbered)
        numbered += 1
        if len(ids) >= words_at_once:
            flush()
            numbered = 0
    flush()
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines"])
    return out.assign(n_repeat_words=[r[0] for r in results], longest_repeat=[r[1] for r in results], covered_share=[r[2] for r in results])


COLUMNS = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "longest_repeat": "long",
    "covered_share": "double",
    "n_char_repeats": "long",
    "longest_char_repeat": "long",
    "char_covered_share": "double",
}


def judged(texts: list[str | None], max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, window: int = WINDOW) -> pd.DataFrame:
    """The columns of ``COLUMNS`` for whole texts."""
    out = measure(texts, window)
    failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEATED_PERCENT * out["n_words"])
    kept = ~failed & (out["covered_share"] <= max_covered) & (out["longest_repeat"] <= max_longest)
    found = [char_repeats(t) if t else (0, 0, 0.0) for t in texts]
    out = out.assign(**{name: [f[i] for f in found] for i, name in enumerate(("n_char_repeats", "longest_char_repeat", "char_covered_share"))})
    most = np.maximum(MIN_LONGEST_CHARS, MAX_CHARS_LONGEST * np.array([len(t) if t else 0 for t in texts]))
    kept &= (out["char_covered_share"] <= MAX_CHARS_COVERED) & (out["longest_char_repeat"] <= most)
    return out.assign(base_failed=failed, kept=kept)


def judge(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, window: int = WINDOW) -> DataFrame:
    """doc_id, base counts, base verdict and the method's verdict for every row of ``docs``.

    Reads doc_id and text only; other columns, whatever their names, are left
    out. A null or empty text has no words, fails the base rule of least words
    and is not kept. Repeated rows give repeated results; an empty table gives
    no rows. ``longest_repeat`` is in words, ``covered_share`` the share of word
    characters under repeats of ``window`` words or more. The last three columns
    tell the same of maximal repeats of CHARS characters or more.
    """

    def make(piece: pa.RecordBatch) -> dict:
        out = judged(texts_of(piece), max_covered, max_longest, window)
        return {name: out[name].to_numpy() for name in COLUMNS}

    return extended(docs.select("doc_id", "text"), COLUMNS, make, drop=("text",))
