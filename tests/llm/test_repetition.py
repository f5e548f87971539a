import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from assaylake.llm import repetition
from assaylake.llm.common import WORD


def naive_array(ids):
    order = sorted(range(len(ids)), key=lambda i: ids[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while max(a, b) + n < len(ids) and ids[a + n] == ids[b + n]:
            n += 1
        lcp.append(n)
    return order, lcp


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_suffix_array(ids):
    order, lcp = repetition.suffix_array(np.array(ids), 3)
    assert (order.tolist(), lcp.tolist()) == naive_array(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=25))
def test_maximal_repeats(ids):
    places = {}
    for n in range(2, len(ids)):
        for i in range(len(ids) - n + 1):
            places.setdefault(tuple(ids[i : i + n]), []).append(i)
    want = []
    for s, at in places.items():
        right = {ids[i + len(s)] if i + len(s) < len(ids) else -1 - i for i in at}
        left = {ids[i - 1] if i else None for i in at}
        if len(at) > 1 and len(right) > 1 and len(left) > 1:
            want.append((len(s), len(at), min(at)))
    assert repetition.maximal_repeats(np.array(ids), 2) == sorted(want)


def repeated_words(text, window=8):
    words = re.findall(WORD, text)
    counts = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    return len({j for i in range(len(words) - window + 1) if counts[tuple(words[i : i + window])] > 1 for j in range(i, i + window)})


def test_base_counts(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    got = repetition.judge(docs).collect()
    assert len(got) == docs.count()
    by_words = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    want = Counter()
    for r in docs.collect():
        text = r.text or ""
        words = re.findall(WORD, text)
        lines = text.split("\n")
        dup = sum(bool(re.search(WORD, line)) and line in lines[:i] for i, line in enumerate(lines))
        want[r.doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeated_words(text)] += 1
    assert by_words == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert repetition.judge(no_docs).count() == 0


def test_method_rejects_what_the_base_passes(spark):
    """Short phrases, a text almost without spaces, and a copied paragraph; a plain text is kept."""
    rng = random.Random(5)

    def word():
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))

    phrases = " ".join(f"{word()} buy our great product now {word()} {word()}" for _ in range(40))
    joined = " ".join(word() for _ in range(30)) + " " + "".join(f"{word()}verylongrepeatedstringwithoutspaces" for _ in range(40))
    copied = " ".join(word() for _ in range(18))
    paragraph = f"{copied} " + " ".join(word() for _ in range(100)) + f" {copied}"
    plain = " ".join(word() for _ in range(150))
    docs = spark.createDataFrame(list(enumerate([phrases, joined, paragraph, plain])), "doc_id long, text string")
    rows = repetition.judge(docs).orderBy("doc_id").collect()
    assert not any(r.base_failed for r in rows)
    assert [r.kept for r in rows] == [False, False, False, True]
    assert rows[0].longest_repeat == 0 and rows[0].char_covered_share > 0.3 and rows[2].longest_char_repeat >= len(copied)


def test_one_character_repeated():
    assert repetition.char_repeats("a" * 20000) == (19980, 19999, 1.0)
    assert repetition.char_repeats("") == repetition.char_repeats("short") == (0, 0, 0.0)


def test_texts_without_a_repeated_window_skip_nothing():
    rng = np.random.default_rng(4)
    for size in (3, 5):
        for _ in range(300):
            ids = rng.integers(0, 3, rng.integers(size + 1, 30))
            windows = [tuple(ids[i : i + size]) for i in range(len(ids) - size + 1)]
            assert repetition._any_repeat(ids, size) == (len(set(windows)) < len(windows))
