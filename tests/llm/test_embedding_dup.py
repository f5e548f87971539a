"""Near-duplicate vectors against all pairs, on copies, chains, families and odd rows."""

import numpy as np
import pytest

from assaylake.llm import embedding_dup as ed


def plain(ids, x, cosine=ed.COSINE):
    """n_links, component of every row by all pairs."""
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    n, label = [0] * len(ids), list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(len(ids)):
            if a != b and ok[a] and ok[b] and len(x[a]) == len(x[b]):
                p, q = np.float64(x[a]), np.float64(x[b])
                if p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= cosine:
                    n[a] += 1
                    la, lb = label[a], label[b]
                    label = [la if z == lb else z for z in label]
    least = {}
    for i, z in zip(ids, label):
        least[z] = i if least.get(z) is None else least[z] if i is None else min(i, least[z])
    return [(i, k, least[z]) for i, k, z in zip(ids, n, label)]


def found(spark, ids, x, **more):
    frame = spark.createDataFrame(list(zip(ids, x)), "vec_id long, embedding array<float>")
    rows = ed.near_duplicates(frame, **more).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in rows), key=str)


def rounded(x):
    return [None if v is None else [None if c is None else float(np.float32(c)) for c in v] for v in x]


def made(rng, n, width, families, spread):
    centres = rng.normal(size=(families, width))
    return (centres[rng.integers(families, size=n)] + spread * rng.normal(size=(n, width))).tolist()


@pytest.mark.parametrize(("width", "spread", "tile"), [(3, 0.2, 7), (16, 0.22, 40), (64, 0.25, 16), (64, 0.1, 64)])
def test_against_all_pairs(spark, width, spread, tile):
    rng = np.random.default_rng(width)
    x = rounded(made(rng, 180, width, 9, spread))
    x += x[:20] + [x[0]] * 10  # copies
    ids = rng.permutation(len(x)).tolist()
    assert found(spark, ids, x, tile=tile) == sorted(plain(ids, x), key=str)


def test_pivots_leave_out_pairs_but_no_link(spark):
    rng = np.random.default_rng(4)
    x = rounded(made(rng, 400, 32, 12, 0.15))
    frame = spark.createDataFrame(list(enumerate(x)), "key long, v array<double>").selectExpr("key", "v", "xxhash64(v) high", "xxhash64(key) low")
    rows = ed.placed(frame, ed.pivots(frame, 12), ed.COSINE).collect()
    reached = sum(len(r["cells"]) for r in rows)
    assert reached < 0.6 * len(rows) * 12
    own = {r["key"]: (r["cell"], set(r["cells"])) for r in rows}
    units = ed.unit(np.array(x))
    for a, b in zip(*np.nonzero(units @ units.T >= ed.COSINE)):
        assert own[a][0] in own[b][1] and own[b][0] in own[a][1]


def test_bounds_hold(spark):
    rng = np.random.default_rng(9)
    for width in (1, 2, 64, 3000):
        x = ed.unit(rng.normal(size=(60, width)) * 10.0 ** rng.integers(-30, 30, size=(60, 1)))
        codes, scale, left = ed.quantised(x)
        near = ed.products(codes, codes) * (scale[:, None] * scale)
        assert np.array_equal(ed.products(codes, codes), codes.astype(np.int64) @ codes.astype(np.int64).T)
        assert (np.abs(near - x @ x.T) <= left[:, None] + left + left[:, None] * left + ed.SLACK).all()
        open_ = [(near + left[:, None] + left >= ed.COSINE) & (near - left[:, None] - left < ed.COSINE)]
        assert width < 64 or np.mean(open_) < 0.02  # few pairs are computed again


def test_at_the_threshold(spark):
    x = [[1.0, 0.0], [0.5, 0.5], [3.0, 4.0], [4.0, 3.0]]
    frame = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    at = {r["vec_id"]: r["n_links"] for r in ed.near_duplicates(frame, cosine=24 / 25).collect()}
    assert at[2] == at[3] and at[2] >= 1  # exactly 0.96


def test_chain_and_family(spark):
    turn = np.arccos(0.96)
    x = rounded([[np.cos(k * turn), np.sin(k * turn)] for k in range(12)])
    assert found(spark, list(range(12)), x, tile=4) == sorted(plain(list(range(12)), x), key=str)
    rng = np.random.default_rng(3)
    near = rounded((np.ones((600, 64)) + 0.02 * rng.normal(size=(600, 64))).tolist())
    assert {(n, c) for _, n, c in found(spark, list(range(600)), near, tile=100)} == {(599, 0)}


def test_family_links_stay_linear():
    rng = np.random.default_rng(1)
    x = np.ones((500, 8)) + 0.001 * rng.normal(size=(500, 8))
    forest = ed.Forest(500)
    for i, j in ed.linked(x, x, True, ed.COSINE):
        forest.add(i, j)
    assert len(forest.links) == 499


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    x = [None, [], [0.0, 0.0], [1.0, None], [1.0, nan], [1.0, inf], [1.0, 0.0], [1.0, -0.0], [1.0, 0.0, 0.0], [1e30, 1.0], [1e-38, 0.0], [1.0, 1.0], [1.0, 1.0]]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None, 7]
    want = sorted(plain(ids, rounded(x)), key=str)
    assert found(spark, ids, x) == want
    clash = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, key int, v int, component int")
    assert ed.near_duplicates(clash).count() == len(ids)
    huge = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (2**60 + 1, [-1.0, -1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"]) for r in ed.near_duplicates(huge).collect()) == [(1, 1), (2, 1), (2**60 + 1, 0)]


def test_empty_table(spark):
    assert ed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
