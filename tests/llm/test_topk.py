import math

import numpy as np

from assaylake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def brute(rows, k, every):
    held = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in rows if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    out = []
    for q, v in {q: v for q, v in held if q % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in held if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted(map(tuple, topk.top_k(vectors, block=64, queries_a_block=4).collect()))
    assert got == brute(vectors.collect(), 5, 50)


def test_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, 0.25], 0, 0) for i in range(100, 140)] + [(0, [1.0, 1.0], 0, 0), (50, [-1.0, 0.0], 0, 0), (3, None, 0, 0), (4, [None, 1.0], 0, 0), (5, [nan, 1.0], 0, 0), (6, [inf, 1.0], 0, 0), (None, [1.0, 1.0], 0, 0), (7, [], 0, 0), (8, [9.0], None, None), (150, [9.0], 0, 0), (200, [0.0, 0.0], 0, 0)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, topk.top_k(vectors, block=8).collect()))
    assert got == brute(vectors.collect(), 5, 50)
    assert [g[2] for g in got if g[0] == 0][:5] == [100, 101, 102, 103, 104]
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search_stops_early():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 20, (5000, 3))
    rows[17] = (900, 900, 900)
    order = rows.argsort(axis=0, kind="stable").T
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, item):
            reads.append(1)
            return super().__getitem__(item)

    ids, scores = topk.search(np.array([1, 1, 1]), -1, np.arange(5000), rows, np.asarray(order).view(Counted), 1)
    assert ids[0] == 17 and scores[0] == 2700 and len(reads) <= 4


def test_repeated_ids(spark):
    """A query id with two vectors is searched by the least one, however the rows lie."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])]
    for order in (rows, rows[::-1]):
        got = topk.top_k(spark.createDataFrame(order, "vec_id long, embedding array<float>").repartition(3)).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(2, 3 * 65536), (1, 0)]
