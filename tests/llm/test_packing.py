import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from assaylake.llm import packing


def check(docs, rows, capacity, per_source):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r)
    bins = defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
        else:
            assert r.length == 0
    for held in bins.values():
        assert sum(r.length for r in held) == held[0].bin_fill <= capacity
        at = 0
        for r in sorted(held, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        if len(held) > 1:
            source = Counter(texts[r.doc_id][0].source for r in held)
            assert max((n for s, n in source.items() if s is not None), default=0) <= per_source
            clusters = [texts[r.doc_id][0].text for r in held]
            assert len(set(clusters)) == len(clusters)
    assert sum(r.length for r in rows) == sum(len(r.text or "") for rs in texts.values() for r in rs)


def test_real_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, capacity=4096, per_source=2, group=60).collect()
    check(docs, rows, 4096, 2)
    bins = {r.bin_id: r.bin_fill for r in rows if r.bin_id}
    assert sum(bins.values()) / (4096 * len(bins)) > 0.8


def test_tightest_compatible_bin():
    bins = packing.Bins(10, 1)
    assert bins.place(6, 1, 0) == (0, 0)  # residual 4
    assert bins.place(7, 2, 0) == (1, 0)  # residual 3
    assert bins.place(3, 2, 0) == (0, 6)  # bin 1 is tighter but holds source 2
    assert bins.place(3, 4, 0) == (1, 7)
    assert bins.place(2, 1, 1) == (2, 0)
    assert bins.place(2, 2, 1) == (3, 0)  # the same cluster


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, capacity=300).collect()
    check(odd_docs, rows, 300, packing.PER_SOURCE)
    assert Counter(r.piece for r in rows)[0] == 12
    assert packing.pack(no_docs).count() == 0
    assert packing.pack(odd_docs.withColumn("bin_id", F.lit(1)), capacity=300).columns[:2] == ["doc_id", "piece"]


def plain_best_fit(rows, capacity, per_source):
    """The same choice by looking at every open bin: the least residual that holds the piece and has no conflict."""
    bins, out = [], []
    for doc_id, length, source, cluster in sorted(rows, key=lambda r: (-r[1], r[0], r[3])):
        rest = length % capacity
        if not rest:
            continue
        fits = [
            (b["left"], n)
            for n, b in enumerate(bins)
            if b["left"] >= rest and cluster not in b["clusters"] and (source is None or b["sources"].count(source) < per_source)
        ]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"left": capacity, "clusters": [], "sources": []})
        out.append((doc_id, n, capacity - bins[n]["left"]))
        bins[n]["left"] -= rest
        bins[n]["clusters"].append(cluster)
        bins[n]["sources"].append(source)
    return out


def test_against_plain_best_fit():
    rng = random.Random(6)
    for _ in range(20):
        rows = [(i, rng.randrange(1, 260), rng.choice(["a", "a", "b", None]), rng.randrange(30)) for i in range(120)]
        got = [(r[0], int(r[4].split("-")[1]), r[5]) for r in packing.pack_group(rows, 100, 2) if r[4] and "f" not in r[4]]
        assert got == plain_best_fit(rows, 100, 2)


def test_equal_rows_are_dealt_apart(spark):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("s").alias("source"))
    rows = packing.pack(docs, group=100).collect()
    groups = Counter(r.bin_id.split("-")[0] for r in rows)
    assert len(rows) == 3000 and len(groups) > 20 and max(groups.values()) < 200


def test_other_lengths_and_clusters(spark):
    docs = spark.createDataFrame([(1, "aa", "s", 5, 1), (2, "bb", "t", 5, 1), (3, "cc", "u", 4, 2)], "doc_id long, text string, source string, tokens long, component long")
    rows = {r.doc_id: r for r in packing.pack(docs, capacity=10, length=F.col("tokens"), cluster=F.col("component")).collect()}
    assert [rows[i].length for i in (1, 2, 3)] == [5, 5, 4] and rows[1].bin_id != rows[2].bin_id
