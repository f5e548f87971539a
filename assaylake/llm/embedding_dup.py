"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors with equal components are one class. A class is scaled to length one
and quantised: int8 codes, a scale, and the length of what the codes leave out.
For codes p, q with scales s, t and left-out lengths e, f the cosine is within
e + f + e f of s t (p . q), and p . q is computed exactly. So a pair is surely
linked, surely not, or open; only open pairs are computed in double precision.

Classes lie in cells, each with the nearest of some pivots. Unit vectors with a
cosine of at least c are no further apart than sqrt(2 - 2 c), so a vector that
lies further than that behind the plane between its own and another pivot has
no link into the other's cell, and it isn't sent there. Cells are cut into
tiles; a pair of tiles whose cells may be linked is one group. Groups get
codes first and answer with the rows that have an open or sure pair; full
vectors go only to those, which give counts of links and, instead of all
pairs, the few links that unite their components. Both are linear in the rows
of a tile, however many of them are near copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import Tables, cut, ship, table
from assaylake.llm.near_dup import components

#: Least cosine of a link.
COSINE = 0.95

#: Classes of a tile, on average, in small and in large tables; most pivots; rows that are quantised together.
TILE, MOST_TILE, PIVOTS, ROWS = 4096, 16_384, 256, 4096

#: What names a pair of tiles.
PAIR = ("width", "a", "b", "i", "j")

#: What rounding may add to a bound; rounding of unit vectors of any usual length stays far below it.
SLACK = 1e-9

#: Columns of a product whose sums of int8 products stay exact in single precision.
EXACT = 1024

#: Entries of a product that are looked at together.
STRIP = 1 << 20


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, holds finite components only and at least one that isn't zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(vec).isNotNull() & ~bad & F.exists(vec, lambda x: x != 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by a power of two, so that no square leaves the doubles."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(1, initial=0))[1][:, None])
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each row, and the length of what its codes leave out, rounded up."""
    scale = np.abs(units).max(1, initial=0) / 127
    codes = np.rint(units / np.where(scale > 0, scale, 1)[:, None])
    left = units - codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt((left * left).sum(1)) * (1 + SLACK) + SLACK


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact inner products of all int8 rows of one with all of two.

    Sums of up to EXACT products of codes are integers below 2**24, which
    single-precision products of matrices keep exactly.
    """
    parts = [one[:, at : at + EXACT].astype(np.float32) @ two[:, at : at + EXACT].astype(np.float32).T for at in range(0, one.shape[1], EXACT)]
    return parts[0] if len(parts) == 1 else np.sum([p.astype(np.float64) for p in parts], axis=0)


def strips(one: tuple, two: tuple, same: bool, cosine: float):
    """(i, j, sure) of the pairs that may be linked, strip by strip; with ``same`` only i < j."""
    (p, s, e), (q, t, f) = one, two
    step = max(1, STRIP // max(1, len(q)))
    for at in range(0, len(p), step):
        part = slice(at, at + step)
        near = products(p[part], q) * (s[part, None] * t)
        reach = (e[part, None] + f + e[part, None] * f) + SLACK
        i, j = np.nonzero(near + reach >= cosine)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        yield i + at, j, near[i, j] - reach[i, j] >= cosine


def cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of rows i of x with rows j of y, in double precision."""
    scaled = [np.ldexp(z, -np.frexp(np.abs(z).max(1, initial=0))[1][:, None]) for z in (x, y)]
    lengths = [np.sqrt((z * z).sum(1)) for z in scaled]
    out = np.empty(len(i))
    for at in range(0, len(i), 16_384):
        a, b = i[at : at + 16_384], j[at : at + 16_384]
        out[at : at + 16_384] = (scaled[0][a] * scaled[1][b]).sum(1) / (lengths[0][a] * lengths[1][b])
    return out


def linked(x: np.ndarray, y: np.ndarray, same: bool, cosine: float):
    """(i, j) of the linked rows of two tiles, strip by strip."""
    sides = [quantised(unit(z)) for z in (x, y)]
    for i, j, sure in strips(*sides, same, cosine):
        open_ = np.flatnonzero(~sure)
        sure[open_] = cosines(x, y, i[open_], j[open_]) >= cosine
        yield i[sure], j[sure]


class Forest:
    """Of the links it is shown, those that unite components which earlier ones have not; fewer than there are rows."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            apart = self.label[i] != self.label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            low, high = np.minimum(self.label[i], self.label[j]), np.maximum(self.label[i], self.label[j])
            order = np.lexsort((low, high))
            one = order[np.flatnonzero(np.diff(high[order], prepend=-1))]  # of each label the link to the least other
            self.links += zip(i[one].tolist(), j[one].tolist(), strict=True)
            parent = np.arange(len(self.label))
            parent[high[one]] = low[one]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]


def digests() -> list[F.Column]:
    """128 bits of a vector."""
    return [F.xxhash64("v").alias("high"), F.xxhash64(F.lit(13), F.reverse("v")).alias("low")]


def pivots(held: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Up to ``most`` unit vectors of different classes, those of the least digests, for each length of vector among them."""
    by_width: dict[int, list] = {}
    for row in held.select("v", "high", "low").orderBy("high", "low").limit(most).collect():
        by_width.setdefault(len(row["v"]), []).append(row["v"])
    return {n: unit(np.array(v)) for n, v in by_width.items()}


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def placed(held: DataFrame, centres: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """(key, width, codes, scale, left, cell, cells) of the classes: the own cell, and all cells that may hold partners.

    Vectors of a length that no pivot has are all in cell 0.
    """
    far = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    between = {n: np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) for n, c in centres.items()}

    def of_width(units: np.ndarray, keys: pa.Array, width: int) -> pa.RecordBatch:
        codes, scale, left = quantised(units)
        cell, reached = np.zeros(len(units), np.int32), np.ones((len(units), 1), bool)
        if width in centres:
            near = units @ centres[width].T
            cell = near.argmax(1).astype(np.int32)
            # a unit vector lies (own product - other product) / (distance of the pivots) from the plane between them
            reached = near[np.arange(len(units)), cell][:, None] - near <= far * between[width][cell] + SLACK
        cells = pa.ListArray.from_arrays(np.concatenate([[0], reached.sum(1).cumsum()]).astype(np.int32), np.nonzero(reached)[1].astype(np.int32))
        columns = [keys, pa.array(np.full(len(units), width, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(left), pa.array(cell), cells]
        return pa.RecordBatch.from_arrays(columns, names=["key", "width", "codes", "scale", "left", "cell", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                widths = pc.list_value_length(piece.column("v")).to_numpy()
                for width in np.unique(widths).tolist():
                    own = piece.take(pa.array(np.flatnonzero(widths == width)))
                    yield of_width(unit(_matrix(own.column("v"), width)), own.column("key"), width)

    return held.select("key", "v").mapInArrow(run, "key long, width int, codes binary, scale double, left double, cell int, cells array<int>")


def dealt(rows: DataFrame, tile: int) -> DataFrame:
    """The rows in every pair of tiles that they take part in: a, b and i, j are the cells and the tiles of a pair, side is 0 in (a, i), 1 in (b, j).

    The cells of a length are few, so their sizes are a small table.
    """
    sizes = rows.groupBy("width", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    own = rows.join(sizes, ["width", "cell"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).drop("tiles")
    met = own.withColumn("other", F.explode("cells")).drop("cells").join(sizes.toDF("width", "other", "tiles"), ["width", "other"])
    pairs = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    upper = (F.col("cell") > F.col("other")) | ((F.col("cell") == F.col("other")) & (F.col("tile") > F.col("o")))
    a, b = (F.when(upper, F.col(x)).otherwise(F.col(y)) for x, y in (("other", "cell"), ("cell", "other")))
    i, j = (F.when(upper, F.col(x)).otherwise(F.col(y)) for x, y in (("o", "tile"), ("tile", "o")))
    return pairs.select("width", a.alias("a"), b.alias("b"), i.alias("i"), j.alias("j"), upper.cast("int").alias("side"), "key", "codes", "scale", "left")


def _sides(held: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two sides of a group; a tile with itself has one side twice."""
    side = held.column("side").to_numpy()
    same = held.column("a")[0].as_py() == held.column("b")[0].as_py() and held.column("i")[0].as_py() == held.column("j")[0].as_py()
    one = np.flatnonzero(side == 0)
    return one, one if same else np.flatnonzero(side == 1), same


def hopeful(pairs: DataFrame, cosine: float) -> DataFrame:
    """The rows of each pair of tiles that have a pair which its codes don't rule out."""
    out_kind = ", ".join(f"{n} int" for n in (*PAIR, "side")) + ", key long"

    def run(held: pa.Table) -> pa.Table:
        width = held.column("width")[0].as_py()
        codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.int8).reshape(-1, width)
        scale, left = (held.column(n).to_numpy() for n in ("scale", "left"))
        one, two, same = _sides(held)
        found = np.zeros(held.num_rows, bool)
        for i, j, _ in strips((codes[one], scale[one], left[one]), (codes[two], scale[two], left[two]), same, cosine):
            found[one[i]] = found[two[j]] = True
        return held.select([*PAIR, "side", "key"]).take(pa.array(np.flatnonzero(found)))

    return pairs.groupBy(*PAIR).applyInArrow(run, out_kind)


def links_of(rows: DataFrame, cosine: float) -> DataFrame:
    """(key, n, other): counts of linked vectors, where other is null, and links that unite the components of a pair of tiles."""

    def run(held: pa.Table) -> pa.Table:
        v = _matrix(held.column("v").combine_chunks(), held.column("width")[0].as_py())
        keys, copies = held.column("key").to_numpy(), held.column("copies").to_numpy()
        one, two, same = _sides(held)
        counts, forest = np.zeros(len(keys), np.int64), Forest(len(keys))
        for i, j in linked(v[one], v[two], same, cosine):
            np.add.at(counts, one[i], copies[two[j]])
            np.add.at(counts, two[j], copies[one[i]])
            forest.add(one[i], two[j])
        some = np.flatnonzero(counts)
        a, b = (np.array([x[k] for x in forest.links], int) for k in (0, 1))
        return pa.table(
            {
                "key": np.concatenate([keys[some], keys[a]]),
                "n": np.concatenate([counts[some], np.zeros(len(a), np.int64)]),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(keys[b], pa.int64())]),
            }
        )

    return rows.groupBy(*PAIR).applyInArrow(run, "key long, n long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec: str = "embedding", tile: int | None = None, most_pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Rows whose vectors have a cosine of ``cosine`` or more, in double precision,
    are linked; no pair is left out. n_links counts the other rows linked with
    a row, copies included. component_id is the least vec_id that it reaches
    over links, itself included; kept marks it. A vector that is null, empty,
    zero or holds a null or non-finite component is linked with nothing, and
    vectors of unequal length are not linked. A negative zero is zero. Rows
    that share a vec_id are rows of their own; a null vec_id is compared like
    others, names no component, and is kept only where no row of its component
    has an id. Only vec_id and the vector are read. Nothing depends on order
    or partitioning. An empty table gives no rows. A threshold must be above 0.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine of a link is above 0 and at most 1")
    ship(vectors.sparkSession)
    tables = Tables(vectors.sparkSession)
    try:
        held = usable(vectors, vec).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vec, lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
        one = held.groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
        classes = tables.cut(one.select("v", "copies", "rep", *digests(), F.monotonically_increasing_id().alias("key")), "vector-classes")
        total = classes.count()
        tile = tile or min(MOST_TILE, max(TILE, total // 128))
        centres = pivots(classes, max(1, min(most_pivots, total // tile)))
        pairs = dealt(tables.cut(placed(classes, centres, cosine), "codes"), tile)
        asked = tables.cut(hopeful(pairs, cosine), "hopeful-vectors")
        found = tables.cut(links_of(asked.join(classes.select("key", "copies", "v"), "key"), cosine), "vector-links")
        counts = found.where("other is null").groupBy("key").agg(F.sum("n").alias("n"))
        edges = found.where("other is not null").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
        labels = components(edges, tables)
        named = classes.select("key", "rep", "copies", "high", "low").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        lowest = named.groupBy("label").agg(F.min("rep").alias("component"))
        known = named.join(lowest, "label").join(counts, "key", "left")
        known = tables.cut(known.select("high", "low", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")), "vector-components")
        bare = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).alias("raw"))
        bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
        good = F.coalesce(~bad & F.exists("raw", lambda x: x != 0), F.lit(False))
        v = F.when(good, F.transform("raw", lambda x: x.cast("double") + F.lit(0.0)))
        marked = bare.select("vec_id", v.alias("v")).select("vec_id", F.col("v").isNotNull().alias("usable"), *(F.when(F.col("v").isNotNull(), d).alias(n) for d, n in zip(digests(), ("high", "low"), strict=True)))
        out = marked.join(known, ["high", "low"], "left")
        component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
        kept = component.eqNullSafe(F.col("vec_id"))
        return cut(out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept")), "near-vectors")
    finally:
        tables.clear()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: The same for DuckDB, by all pairs.
SQL = f"""
with recursive good as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as l from good),
links as (
  select a.vec_id as a, b.vec_id as b
  from sized a join sized b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (a.l * b.l) >= {COSINE}),
reach as (
  select a as vec_id, a as seen from links
  union
  select r.vec_id, l.b from reach r join links l on l.a = r.seen),
lowest as (select vec_id, min(seen) as component from reach group by vec_id),
counted as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(c.n, 0) as bigint) as n_links, coalesce(l.component, e.vec_id) as component_id, coalesce(l.component, e.vec_id) = e.vec_id as kept
from embeddings e left join counted c using (vec_id) left join lowest l using (vec_id)
"""
