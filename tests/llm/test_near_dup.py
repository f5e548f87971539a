import math
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import near_dup
from assaylake.llm.common import Tables

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 20 * min(len(x), len(y)) >= 17 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 85 * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    least[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def family(rng, base, n, edits):
    """Copies of a text with some words changed."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_shingles_follow_the_definition():
    rng = random.Random(4)
    for _ in range(100):
        text = "".join(rng.choice(["A", "b", "C", " ", "\t", "\n", "é", "\x0b", "ab c d e f g", " "]) for _ in range(rng.randrange(60)))
        assert len(near_dup.shingles(text)) == len(shingle_set(text))
    assert np.array_equal(near_dup.shingles("A b C d E f"), near_dup.shingles(" a B\tc d\ne F "))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    texts = []
    for size, edits in ((2, 3), (5, 4), (60, 12), (40, 7)):
        base = [f"b{rng.randrange(5000)}" for _ in range(rng.randrange(90, 260))]
        texts += family(rng, base, size, edits)
    texts += [" ".join(f"s{rng.randrange(9000)}" for _ in range(rng.randrange(1, 120))) for _ in range(80)]
    texts += [texts[3]] * 30 + ["", "  ", "one two", "ONE two", "One"]
    rng.shuffle(texts)
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_against_brute_force(planted):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(planted).collect()}
    assert got == brute(planted.collect())


@pytest.mark.parametrize("small", [3, 20])
def test_large_nodes_lose_no_link(planted, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(planted).collect()}
    assert got == brute(planted.collect())


def test_template_family_below_the_threshold(spark):
    """Many texts of one template, few of them linked: the result is that of brute force."""
    rng = random.Random(21)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randrange(2, 14)):
            words[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(docs.collect())
    assert len({root for _, root in want.values()}) > 50
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.key: r.label for r in near_dup.components(links, Tables(spark)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100}


def test_odd_rows(odd_docs, no_docs):
    rows = near_dup.near_duplicates(odd_docs.withColumn("component_id", F.lit(1))).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 4 and not by[5].kept and by[4].kept
    assert by[2].n_shingles == by[1].n_shingles == by[7].n_shingles == 0
    assert by[1].component_id == 1 and by[1].kept and by[None].component_id is None and by[None].kept
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_dedup_keeps_one(odd_docs):
    left = near_dup.dedup_documents(odd_docs)
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 3, 4, 7, 8, 9, 10, 11]
    assert left.where("doc_id is null").count() == 1


def test_threshold_of_the_stage(spark):
    """A pair between 0.80 and 0.85 goes in the stage and stays two components under op5's contract."""
    words = [f"w{i}" for i in range(104)]
    pair = [" ".join(words), " ".join([*words[:93], *(f"x{i}" for i in range(11))])]
    a, b = map(shingle_set, pair)
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1]), (3, "a text of its own that is like no other one here")], "doc_id long, text string")
    assert [r.component_id for r in near_dup.near_duplicates(docs, 85).orderBy("doc_id").collect()] == [1, 2, 3]
    assert [r.component_id for r in near_dup.near_duplicates(docs, 80).orderBy("doc_id").collect()] == [1, 1, 3]
    assert sorted(r.doc_id for r in near_dup.dedup_documents(docs).collect()) == [1, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_rare_misses():
    """The test on minwise tokens and the number of trees keep to their chances."""
    for percent in (80, 85):
        p, least = percent / 100, near_dup.least_agreeing(percent)
        fewer = sum(math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(least))
        assert fewer <= near_dup.MISS_TEST < fewer + math.comb(64, least) * p**least * (1 - p) ** (64 - least)
        assert (1 - p**3) ** near_dup.trees(percent) <= near_dup.MISS


def test_large_ids_beside_a_null(spark):
    big, text = 2**60 + 1, "one two three four five six seven"
    docs = spark.createDataFrame([(big, text), (None, text), (big + 2, text + " eight"), (None, "other words")], "doc_id long, text string").coalesce(1)
    rows = near_dup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, big), (big, big), (big + 2, big + 2)]
    assert {r.doc_id for r in near_dup.dedup_documents(docs).collect()} == {big, big + 2, None}


def test_one_id_in_two_components(spark):
    t, u = "a b c d e f g h i j", "q r s t u v w x y z"
    docs = spark.createDataFrame([(2, t), (4, u), (4, t), (4, t.upper())], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_dup.dedup_documents(docs).collect()) == [(2, t), (4, u)]
