"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the hashes of its distinct 5-word shingles. Documents
with equal sets are one class, found by a 128-bit fingerprint; the join runs
over classes. Each class has PERMUTATIONS minwise tokens.

A tree branches the classes by selected tokens. Which tokens a node looks at
follows from a hash of its path, and a class goes to the child that its own
tokens there name. At its root a tree looks at ROOT_STEP tokens; a deeper node
has CHILDREN selections of STEP tokens, so a class goes to several children. There
are as many independent trees as bring the chance that a pair at the threshold
meets in none of them under MISS.

In every node, one pivot is compared with all others. Links to it join most of
a family of near copies: components are closed, and nodes whose classes all lie
in one component are done. What is left of small nodes is compared
exhaustively across components. Of larger ones, those that share a pivot are
one family where that makes fewer comparisons than tree by tree: a tight
family, which branching would hardly split. It is compared once, the classes
outside its largest component with all others, in blocks. Looser and very large
nodes branch again, and after DEPTHS selections they too meet in blocks.

Pivot pairs, small nodes and blocks first pass a size test, which loses nothing,
and a test on minwise tokens, which loses a link less than once in
1 / MISS_TEST; then every link is confirmed on full sets. Components are closed
under the links by minimum labels with pointer jumping. Nodes exchange class
numbers, blocks minwise tokens; sets are exchanged for classes with a candidate.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import Tables, cut, extended, texts_of

WORDS = 5

#: Least similarity of a link in percent: by the contract of op5, and where none is given (the pipeline's stage).
OP5_PERCENT, PERCENT = 85, 80

PERMUTATIONS = 64
ROOT_STEP, STEP, CHILDREN, DEPTHS = 3, 5, 3, 4

#: Chance of a pair at the threshold to meet in no tree, and to fail the test on minwise tokens.
MISS, MISS_TEST = 1e-8, 1e-9

#: A node of up to so many classes with up to so many shingles together is compared exhaustively, in one group.
SMALL, SMALL_SHINGLES = 256, 8_000_000

#: Classes of a block in groups that are too large for one task, and of the largest family that is compared in blocks.
BLOCK, FAMILY = 256, 16_384

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(2024)
_SEEDS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_SLOTS = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def trees(percent: int) -> int:
    """Trees that a pair at the threshold needs to meet in one of their first nodes."""
    return max(1, math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROOT_STEP)))


def roots(percent: int) -> list[list[int]]:
    """The tokens that the root of each tree looks at."""
    rng = np.random.default_rng(2025)
    return [rng.permutation(PERMUTATIONS)[:ROOT_STEP].tolist() for _ in range(trees(percent))]


def least_agreeing(percent: int) -> int:
    """Agreeing minwise tokens that a candidate needs; a pair at the threshold has fewer with a chance of MISS_TEST at most."""
    p, fewer = percent / 100, 0.0
    for k in range(PERMUTATIONS + 1):
        fewer += math.comb(PERMUTATIONS, k) * p**k * (1 - p) ** (PERMUTATIONS - k)
        if fewer > MISS_TEST:
            return k
    return PERMUTATIONS


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _P).cumprod(dtype=np.uint64)])
            _inverses = np.concatenate([np.ones(1, np.uint64), np.full(2 * n, inverse).cumprod(dtype=np.uint64)])
    return _powers, _inverses


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z count as a-z; words are runs without ASCII white space. With fewer
    words than a shingle has, the whole sequence is one shingle.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _grown(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), ((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)]).cumsum(dtype=np.uint64)])
    each = _mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    k = min(words, len(each))
    total = np.full(len(each) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        total += each[j : len(each) - k + 1 + j] * _SLOTS[j]
    return np.unique(_mixed(total))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The minwise token of a set for each permutation, as 32-bit integers."""
    out = np.full(PERMUTATIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 4096):
        part = (hashes[at : at + 4096, None] ^ _SEEDS) * _ODD
        out = np.minimum(out, (part ^ (part >> np.uint64(29))).min(0))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, high, low, tokens): high and low are the fingerprint of the set, null for an empty one."""

    def make(piece: pa.RecordBatch) -> dict:
        rows = []
        for text in texts_of(piece):
            found = shingles(text) if text else ()
            rows.append((len(found), *fingerprint(found), minwise(found)) if len(found) else (0, None, None, None))
        return dict(zip(("n_shingles", "high", "low", "tokens"), map(list, zip(*rows, strict=True)), strict=True))

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return extended(keyed, {"n_shingles": "long", "high": "long", "low": "long", "tokens": "array<int>"}, make, drop=("text",))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, set) of the wanted classes, from one document of each: that of the class's rep and text_hash."""

    def make(piece: pa.RecordBatch) -> dict:
        found = [shingles(t) for t in texts_of(piece)]
        same = [fingerprint(f) == (h, w) for f, h, w in zip(found, piece.column("high").to_pylist(), piece.column("low").to_pylist(), strict=True)]
        return {"set": [f.view(np.int64) if ok else None for f, ok in zip(found, same, strict=True)]}

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    asked = wanted.select("key", "rep", F.col("text_hash").alias("th"), "high", "low")
    one = keyed.join(asked, keyed["doc_id"].eqNullSafe(asked["rep"]) & (keyed["text_hash"] == asked["th"])).dropDuplicates(["key"])
    return extended(one.select("key", "high", "low", "text"), {"set": "array<long>"}, make, drop=("text", "high", "low")).where("set is not null")


def root_rows(classes: DataFrame, percent: int) -> DataFrame:
    """(key, rep, n_shingles, tree, node) of every class in every tree."""
    nodes = [F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), *(F.col("tokens")[c] for c in own)).alias("node")) for t, own in enumerate(roots(percent))]
    return classes.select("key", "rep", "n_shingles", F.explode(F.array(*nodes)).alias("x")).select("key", "rep", "n_shingles", "x.*")


def child_rows(held: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``held`` in the next nodes of their paths."""

    def token(child: int, j: int) -> F.Column:
        path = F.xxhash64("node", F.lit(child))
        step = 2 * F.pmod(F.xxhash64(path), F.lit(PERMUTATIONS // 2)) + 1
        return F.element_at("tokens", (F.pmod(path + j * step, F.lit(PERMUTATIONS)) + 1).cast("int"))

    nodes = [F.xxhash64("node", F.lit(c), *(token(c, j) for j in range(STEP))) for c in range(CHILDREN)]
    return held.select("tree", "node", "key").join(classes, "key").select("key", "rep", "n_shingles", "tree", F.explode(F.array(*nodes)).alias("node"))


def in_nodes(rows: DataFrame) -> DataFrame:
    """(tree, node, key, n, weight, pivot) of the rows that are not alone in their node.

    The pivot is the class of the first document: of a family of copies that is
    most often the one that the others were made from.
    """
    nodes = rows.groupBy("node").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.coalesce(F.min_by("key", "rep"), F.min("key")).alias("pivot")
    )
    return rows.select("tree", "node", "key").join(nodes.where("n > 1"), "node")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose sizes allow a link and whose minwise tokens agree often enough."""
    side = classes.select("key", "n_shingles", "tokens")
    a, b = (side.select(F.col("key").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("tokens").alias(f"t_{k}")) for k in "ab")
    joined = pairs.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    agreeing = F.aggregate(F.zip_with("t_a", "t_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return joined.where(agreeing >= least_agreeing(percent)).select("a", "b", "n_a", "n_b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) whose full sets meet the threshold.

    The set of ``a`` goes to 64 salts at most, so a pivot of many pairs is
    spread, and each set of ``b`` travels once a pair.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(64)))
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("key").alias("a"), F.col("set").alias("set_a")), "a")
    right = salted.join(sets.select(F.col("key").alias("b"), F.col("set").alias("set_b")), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return right.join(left, ["a", "salt"]).where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(key, label) for every key of a link: the least key that it reaches."""
    edges = tables.cut(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct(), "edges")
    labels = tables.cut(edges.groupBy(F.col("u").alias("key")).agg(F.min(F.least("u", "v")).alias("label")), "labels")
    total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    while True:
        near = edges.join(labels, F.col("u") == F.col("key")).groupBy("v").agg(F.min("label").alias("near"))
        lower = tables.cut(labels.join(near, F.col("key") == F.col("v")).select("key", F.least("label", "near").alias("label")), "lower")
        labels = tables.cut(lower.join(lower.select(F.col("key").alias("k"), F.col("label").alias("further")), F.col("label") == F.col("k")).select("key", F.col("further").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def _agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Agreeing tokens of each row of x with each row of y."""
    if len(x) * len(y) < 1024:
        return (x[:, None, :] == y[None, :, :]).sum(2)
    out = np.zeros((len(x), len(y)), np.uint8)
    for c in range(PERMUTATIONS):
        out += x[:, c, None] == y[None, :, c]
    return out


def _outside(labels: np.ndarray) -> np.ndarray:
    """Rows outside the largest component of a node: one of them is in every pair across components."""
    found, counts = np.unique(labels, return_counts=True)
    return np.flatnonzero(labels != found[counts.argmax()])


def _hopeful(tokens: np.ndarray, node: dict[str, np.ndarray], percent: int, own_roots: list[list[int]]) -> np.ndarray:
    """Rows of a node that may be linked to another across components.

    A pair that meets in the exhaustive node of an earlier tree is left to that
    tree; ``done`` holds a bit for each tree in which a class has such a node.
    Pairs with the pivot were confirmed before.
    """
    labels, sizes, done = node["label"], node["n_shingles"], node["done"]
    tree, least, others = int(node["tree"][0]), least_agreeing(percent), node["key"] != node["pivot"][0]
    rows, found = _outside(labels), []
    rows = rows[others[rows]]
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        fit = 100 * np.minimum(sizes[part, None], sizes) >= percent * np.maximum(sizes[part, None], sizes)
        i, j = np.nonzero(fit & others & (labels[part, None] != labels) & (_agreeing(tokens[part], tokens) >= least))
        i = part[i]
        for t in range(tree):
            if not len(i):
                break
            fresh = (done[i] >> t & 1 == 0) | (tokens[i][:, own_roots[t]] != tokens[j][:, own_roots[t]]).any(1)
            i, j = i[fresh], j[fresh]
        found += [i, j]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, int)


def _meeting(one: list[np.ndarray], two: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each set of one list with each of the other, by products of 0/1 matrices of some columns."""
    sizes = [np.array([len(s) for s in side]) for side in (one, two)]
    universe, column = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    parts = column[: sizes[0].sum()], column[sizes[0].sum() :]
    present = [np.bincount(part, minlength=len(universe)) > 0 for part in parts]
    number = np.where(present[0] & present[1], np.cumsum(present[0] & present[1]) - 1, -1)
    sides = []
    for part, size in zip(parts, sizes, strict=True):
        rows, columns = np.arange(len(size)).repeat(size), number[part]
        order = np.argsort(columns, kind="stable")
        sides.append((rows[order], columns[order]))
    out = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, int(number.max(initial=-1)) + 1, width):
        blocks = []
        for (rows, columns), size in zip(sides, sizes, strict=True):
            a, b = np.searchsorted(columns, [at, at + width])
            block = np.zeros((len(size), width), np.float32)
            block[rows[a:b], columns[a:b] - at] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out.astype(np.int64)


def _similar(one: pd.DataFrame, two: pd.DataFrame, percent: int) -> np.ndarray:
    """Which rows of two frames have full sets that meet the threshold."""
    both = _meeting([np.asarray(s) for s in one["set"]], [np.asarray(s) for s in two["set"]])
    return 100 * both >= percent * (one["n_shingles"].to_numpy()[:, None] + two["n_shingles"].to_numpy() - both)


def _forest(i: np.ndarray, j: np.ndarray, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    """Of the links (i, j) of two frames those that unite components which earlier ones have not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    keys, others = one["key"].to_numpy(), two["key"].to_numpy()
    out = []
    for a, b, x, y in zip(keys[i].tolist(), others[j].tolist(), one["label"].to_numpy()[i].tolist(), two["label"].to_numpy()[j].tolist(), strict=True):
        if (x := root(x)) != (y := root(y)):
            parent[max(x, y)] = min(x, y)
            out.append((min(a, b), max(a, b)))
    return pd.DataFrame(out, columns=["a", "b"])


def links_within(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that unite the components of a node as far as its full sets do; fewer than it has classes."""
    labels = frame["label"].to_numpy()
    outside = _outside(labels)
    own = frame.iloc[outside]
    i, j = np.nonzero(_similar(own, frame, percent) & (own["label"].to_numpy()[:, None] != labels)) if len(own) else (outside, outside)
    return _forest(i, j, own, frame)


def links_between(one: pd.DataFrame, two: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The same for a block of classes and another."""
    if not len(one) or not len(two):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    i, j = np.nonzero(_similar(one, two, percent) & (one["label"].to_numpy()[:, None] != two["label"].to_numpy()))
    return _forest(i, j, one, two)


def hopeful_rows(small: DataFrame, classes: DataFrame, percent: int, first: bool, tables: Tables) -> DataFrame:
    """Rows of small nodes (node, key, label) that have a candidate across components, by their minwise tokens."""
    own_roots = roots(percent)
    bit = F.expr("shiftleft(1L, tree)") if first else F.lit(0).cast("long")
    rows = small.join(small.groupBy("key").agg(F.bit_or(bit).alias("done")), "key")

    def run(held: pa.Table) -> pa.Table:
        tokens = held.column("tokens").combine_chunks().flatten().to_numpy().reshape(-1, PERMUTATIONS)
        node = {name: held.column(name).to_numpy() for name in ("tree", "key", "pivot", "label", "done", "n_shingles")}
        return held.select(["node", "key", "label"]).take(_hopeful(tokens, node, percent, own_roots))

    shown = rows.join(classes.select("key", "n_shingles", "tokens"), "key")
    return tables.cut(shown.groupBy("node").applyInArrow(run, "node long, key long, label long"), "hopeful")


def exact_links(asked: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Links across components within the nodes of ``hopeful_rows``, confirmed on full sets."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return links_within(frame, percent)

    full = asked.join(classes.select("key", "n_shingles").join(sets, "key"), "key")
    return tables.cut(full.groupBy("node").applyInPandas(run, "a long, b long").distinct(), "small-links")


def families(large: DataFrame) -> DataFrame:
    """(pivot) of large nodes that are better compared as one family, each pair of classes once, than tree by tree."""
    members = large.select("pivot", "key").distinct().groupBy("pivot").agg(F.count("*").alias("members"))
    by_tree = large.select("pivot", "node", "n").distinct().groupBy("pivot").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    return members.join(by_tree, "pivot").where(f"members <= {FAMILY} and members * members <= pairs").select("pivot")


def hopeful_between(one: pa.Table, two: pa.Table, percent: int) -> pa.Table:
    """Rows of two blocks that may be linked across components, by their sizes and minwise tokens; side is 0 in the first."""
    sides = []
    for held in (one, two):
        tokens = held.column("tokens").combine_chunks().flatten().to_numpy().reshape(-1, PERMUTATIONS)
        sides.append((tokens, held.column("label").to_numpy(), held.column("n_shingles").to_numpy()))
    (x, label_x, size_x), (y, label_y, size_y) = sides
    found = [np.zeros(len(x), bool), np.zeros(len(y), bool)]
    for at in range(0, len(x), 64):
        part = slice(at, at + 64)
        fit = 100 * np.minimum(size_x[part, None], size_y) >= percent * np.maximum(size_x[part, None], size_y)
        i, j = np.nonzero(fit & (label_x[part, None] != label_y) & (_agreeing(x[part], y) >= least_agreeing(percent)))
        found[0][i + at] = found[1][j] = True
    names = ["node", "group", "block", "key", "label"]
    parts = [held.select(names).append_column("side", pa.array(np.full(held.num_rows, k, np.int32))).filter(pa.array(rows)) for k, (held, rows) in enumerate(zip((one, two), found, strict=True))]
    return pa.concat_tables(parts)


def in_blocks(large: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Links across components within the groups (node, key, label) that are too large for one task.

    In each of them the classes outside its largest component are compared with
    all that it holds, block by block: first by their minwise tokens, then the
    full sets of those that may be linked. So sets are exchanged for hopeful
    classes only, however large a group is.
    """
    counted = large.groupBy("node", "label").agg(F.count("*").alias("n"))
    shape = (
        counted.groupBy("node")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
        .select("node", F.col("most.label").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("groups"))
    )
    held = large.select("node", "key", "label").join(tables.cut(shape, "node-shapes"), "node")
    sketched = classes.select("key", "n_shingles", "tokens")
    block, group = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("groups")).cast("int")
    own = held.where("label <> main").select("node", "key", "label", group.alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sketched, "key")
    theirs = held.where("groups > 0").select("node", "key", "label", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")).join(sketched, "key")
    by = ("node", "group", "block")
    theirs = theirs.toDF(*theirs.columns)  # names of its own for the cogroup

    def hopeful(one: pa.Table, two: pa.Table) -> pa.Table:
        return hopeful_between(one, two, percent)

    kind = "node long, group int, block int, key long, label long, side int"
    asked = tables.cut(own.groupBy(*by).cogroup(theirs.groupBy(*by)).applyInArrow(hopeful, kind), "hopeful-blocks")
    full = asked.join(classes.select("key", "n_shingles").join(sets, "key"), "key")
    first, second = full.where("side = 0").drop("side"), full.where("side = 1").drop("side")
    second = second.toDF(*second.columns)

    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return links_between(one, two, percent)

    return tables.cut(first.groupBy(*by).cogroup(second.groupBy(*by)).applyInPandas(run, "a long, b long").distinct(), "block-links")


def link_classes(docs: DataFrame, classes: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """(key, label) of classes that have a link."""

    def sets_of(keys: DataFrame, name: str) -> DataFrame:
        return tables.cut(full_sets(docs, classes.join(keys.distinct(), "key", "left_semi")), name)

    links: list[DataFrame] = []
    rows, labels, sets = root_rows(classes, percent), None, None
    for depth in range(DEPTHS):
        held = tables.cut(in_nodes(rows), f"nodes-{depth}")
        stars = held.where("key <> pivot").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()
        if labels is not None:  # pairs that are in one component by now need no more
            a, b = (labels.select(F.col("key").alias(k), F.col("label").alias(f"label_{k}")) for k in "ab")
            stars = stars.join(a, "a", "left").join(b, "b", "left").where("not coalesce(label_a = label_b, false)").select("a", "b")
        asked = tables.cut(likely(stars, classes, percent), "likely")
        if sets is None:
            sets = sets_of(asked.select(F.col("a").alias("key")).union(asked.select("b")), "sets")
        links.append(tables.cut(confirmed(asked, sets, percent), "links"))
        labels = components(reduce(DataFrame.unionByName, links), tables)
        known = held.where("n > 2").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        mixed = known.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("node")
        open_ = tables.cut(known.join(mixed, "node", "left_semi"), "mixed")
        few = (F.col("n") <= SMALL) & (F.col("weight") <= SMALL_SHINGLES)
        hopeful, large = hopeful_rows(open_.where(few), classes, percent, depth == 0, tables), open_.where(~few)
        if depth == 0:  # the classes of all deeper nodes are among these
            more = hopeful.select("key").union(large.select("key")).distinct().join(sets, "key", "left_anti")
            sets = sets.unionByName(sets_of(more, "more-sets"))
        links.append(exact_links(hopeful, classes, sets, percent, tables))
        if large.isEmpty():
            break
        tight = tables.cut(families(large) if depth + 1 < DEPTHS else large.select("pivot").distinct(), "families")
        links.append(in_blocks(large.join(tight, "pivot", "left_semi").select(F.col("pivot").alias("node"), "key", "label").distinct(), classes, sets, percent, tables))
        large = tables.cut(large.join(tight, "pivot", "left_anti"), "branching")
        if large.isEmpty():
            break
        labels, rows = components(reduce(DataFrame.unionByName, links), tables), child_rows(large, classes)
    if len(links) == 2 and links[-1].isEmpty():
        return labels
    return components(reduce(DataFrame.unionByName, links), tables)


def _marked(docs: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """doc_id, text_hash, high, low, n_shingles and component of every row."""
    sketched = tables.cut(sketches(docs), "sketches")
    by_set = sketched.where("high is not null")
    least = by_set.groupBy("high", "low").agg(F.min("doc_id").alias("rep")).toDF("h", "w", "rep")
    first = by_set.join(tables.cut(least, "reps"), (F.col("high") == F.col("h")) & (F.col("low") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    one = first.select("high", "low", "rep", "text_hash", "n_shingles", "tokens").dropDuplicates(["high", "low"])
    classes = tables.cut(one.withColumn("key", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    labels = link_classes(docs, classes, percent, tables)
    named = classes.select("key", "high", "low", "rep").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    lowest = named.groupBy("label").agg(F.min("rep").alias("component"))
    placed = tables.cut(named.join(lowest, "label").select(F.col("high").alias("h"), F.col("low").alias("w"), "component"), "components")
    out = sketched.drop("tokens").join(placed, (F.col("high") == F.col("h")) & (F.col("low") == F.col("w")), "left")
    return out.select("doc_id", "text_hash", "high", "low", "n_shingles", F.coalesce("component", "doc_id").alias("component"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _keeps() -> F.Column:
    return F.col("component").isNull() | F.col("doc_id").eqNullSafe(F.col("component"))


def near_duplicates(docs: DataFrame, percent: int = OP5_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Documents whose sets have a similarity of ``percent`` or more are linked.
    component_id is the least doc_id that a document reaches over links, itself
    included; kept marks it. Only doc_id and text are read, so other columns may
    have any name. Documents without a word (null or empty text) have no
    shingle, no link and their own component. Rows that share a doc_id are one
    document where their sets are equal, and may be in two components where
    not. A row with a null doc_id is compared like others; it never names a
    component of others, and where no row of it has an id the component is null
    and all are kept. Nothing depends on order or partitioning. An empty table
    gives no rows.
    """
    tables = Tables(docs.sparkSession)
    try:
        marked = _marked(_plain(docs), percent, tables)
        return cut(marked.select("doc_id", "n_shingles", F.col("component").alias("component_id"), _keeps().alias("kept")), "near-duplicates")
    finally:
        tables.clear()


def dedup_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the one of the least doc_id.

    Of rows with one doc_id and equal sets one stays, the one of the least hash
    of the text; of rows with one doc_id in two components each component keeps
    its own. Rows without a word are linked with nothing and stay, once for
    each doc_id. Of a component without any doc_id each distinct set stays
    once. All columns of ``docs`` come back as they were. An empty table gives
    no rows.
    """
    tables = Tables(docs.sparkSession)
    try:
        marked = _marked(_plain(docs), percent, tables)
        keep = cut(marked.where(_keeps()).groupBy("doc_id", "high", "low").agg(F.min("text_hash").alias("kept_hash")).select(F.col("doc_id").alias("kept_id"), "kept_hash"), "kept-documents")
    finally:
        tables.clear()
    by_text = F.xxhash64(F.col("text").cast("string")) == F.col("kept_hash")
    kept = docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(F.col("kept_id")) & by_text, "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).select(docs.columns)
