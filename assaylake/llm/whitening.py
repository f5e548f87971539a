"""Whitening of embeddings by a compensated covariance.

Components become integers. Their sums are exact, so the mean is known to twice
the precision of a double. Each task centres its rows in double-double and adds
their outer products in double-double: a product is split into its rounded
value and its rounding error, a sum likewise, and the errors gather in a low
part. The high and low parts of the tasks are merged the same way, row of the
matrix by row, in two steps, so neither a task nor the driver gathers more than
a few of them. The driver gets one matrix of the vectors' width.

Its eigenvectors come from the symmetric solver of LAPACK that reduces a matrix
to tridiagonal form and solves that by divide and conquer (``syevd``, which
numpy's ``eigh`` calls).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import Tables, cut, ship, table

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8

#: Widest vectors; the driver holds matrices of this width.
WIDEST = 4096

#: Partial matrices meet in so many groups first.
GROUPS = 256

#: Rows in one step, and most entries of their outer products together.
ROWS, ENTRIES = 1024, 1 << 16

#: Integers up to here are exact as doubles.
LARGEST = 1 << 52

_SPLIT = float((1 << 27) + 1)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b, rounded, and what the rounding left out."""
    total = a + b
    other = total - a
    return total, (a - (total - other)) + (b - other)


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of few enough bits that products of halves are exact."""
    wide = _SPLIT * a
    high = wide - (wide - a)
    return high, a - high


def centred(rows: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows - (high + low) in double-double."""
    d, e = two_sum(rows, -high)
    return two_sum(d, e - low)


def outer_sum(rows: np.ndarray, high: np.ndarray, low: np.ndarray, total: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, rest) with the outer products of the centred rows added, in double-double.

    Rows are taken together in lanes, whose products are added pair by pair.
    """
    d, e = centred(rows, high, low)
    up, down = split(d)
    width = rows.shape[1]
    lanes = max(1, ENTRIES // (width * width))
    for at in range(0, len(rows), lanes):
        part = slice(at, at + lanes)
        (a, b), (c, f), (g, h) = ((x[part, :, None], x[part, None, :]) for x in (d, up, down))
        value = a * b
        error = ((c * f - value) + c * h + g * f) + g * h
        error += a * e[part, None, :] + e[part, :, None] * b
        while len(value) > 1:
            half = len(value) // 2
            odd, odd_error = value[2 * half :], error[2 * half :]
            value, left = two_sum(value[:half], value[half : 2 * half])
            error = error[:half] + error[half : 2 * half] + left
            value, error = np.concatenate([value, odd]), np.concatenate([error, odd_error])
        total, left = two_sum(total, value[0])
        rest = rest + (left + error[0])
    return total, rest


def merged(highs: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several double-double arrays."""
    total, rest = np.zeros_like(highs[0]), np.zeros_like(lows[0])
    for high, low in zip(highs, lows, strict=True):
        total, left = two_sum(total, high)
        rest = rest + (left + low)
    return two_sum(total, rest)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def covariance(rows: DataFrame, column: str, width: int, n: int, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The covariance (divisor n) of vectors around high + low, as a double-double matrix."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest, some = np.zeros((width, width)), np.zeros((width, width)), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = True
                x = _matrix(batch.column(0).slice(at, ROWS), width).astype(np.float64)
                total, rest = outer_sum(x, high, low, total, rest)
        if some:
            group = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_pydict({"i": np.arange(width), "g": np.full(width, group), "high": list(total), "low": list(rest)})

    kind = "i long, g long, high array<double>, low array<double>"
    rows_of = rows.select(column).mapInArrow(partial, kind)

    def meet(held: pa.Table) -> pa.Table:
        high, low = merged(*(np.stack(held.column(n).to_numpy()) for n in ("high", "low")))
        return pa.table({"i": held.column("i")[:1], "g": held.column("g")[:1], "high": [high], "low": [low]})

    found = rows_of.groupBy("i", "g").applyInArrow(meet, kind).groupBy("i").applyInArrow(meet, kind).collect()
    out = np.zeros((2, width, width))
    for row in found:
        out[0, row["i"]], out[1, row["i"]] = row["high"], row["low"]
    quotient = out[0] / n
    # the remainder of the division, exactly, for the low part
    p, q = split(quotient)
    m, r = split(np.float64(n))
    value = quotient * n
    error = ((p * m - value) + p * r + q * m) + q * r
    return two_sum(quotient, ((out[0] - value) - error + out[1]) / n)


def _integer(c: Column) -> Column:
    """floor(SCALE c) + OFFSET; what is out of range stays beyond LARGEST."""
    far = F.lit(float(2 * LARGEST))
    return F.floor(F.greatest(F.least(c.cast("double") * SCALE, far), -far)).cast("long") + OFFSET


def fit_list(vectors: DataFrame, vec: str, tables: Tables) -> tuple[DataFrame, int]:
    """(vec_id, x) of the vectors that take part, and their width: the commonest, the widest of equally common ones."""
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    held = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad)
    rows = tables.cut(held.select("vec_id", F.transform(vec, _integer).alias("x")), "integers")
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest"))
    top = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if top is None:
        return rows, 0
    if top["width"] > WIDEST:
        raise ValueError(f"vectors of more than {WIDEST} components")
    if top["largest"] > LARGEST:
        raise ValueError("components are too large to be exact")
    return rows.where(F.size("x") == top["width"]), top["width"]


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their components."""
    each = rows.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"))
    found = sorted(each.collect())
    return found[0]["n"], [int(row["s"]) for row in found]


def mean(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean in double-double."""
    high = [float(Fraction(s, n)) for s in total]
    return np.array(high), np.array([float(Fraction(s, n) - Fraction(h)) for s, h in zip(total, high, strict=True)])


def components(cov: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, shares of the trace) of the largest ``most``, by falling eigenvalue.

    The eigenvalues are Rayleigh quotients over high and low parts. The sign of
    a vector is such that its entry of the largest size, the first of equals, is positive.
    """
    high, low = ((x + x.T) / 2 for x in cov)
    vectors = np.linalg.eigh(high)[1][:, ::-1][:, :most]
    vectors = vectors / np.sqrt((vectors * vectors).sum(0))
    values = np.einsum("ik,ij,jk->k", vectors, high, vectors) + np.einsum("ik,ij,jk->k", vectors, low, vectors)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    trace = float(sum(Fraction(float(h)) + Fraction(float(r)) for h, r in zip(np.diag(high), np.diag(low), strict=True)))
    real = values > len(high) * np.finfo(float).eps * max(trace, 0)
    return np.where(real, values, 0), vectors, np.where(real, values / (trace or 1), 0)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """The sum over components of (n x - S)^2 of each row, exactly."""
    s = np.array(total, dtype=object)
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
    if most < 1 << 62:
        t = n * x - s.astype(np.int64)
        if int(np.abs(t).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (t * t).sum(1).tolist()
    t = x.astype(object) * n - s
    return [int(v) for v in (t * t).sum(1)]


def whiten(vectors: DataFrame, most: int = COMPONENTS, vec: str = "embedding") -> DataFrame:
    """The whitened vectors: vec_id, component (from 1), n, deviation, whitened, explained and identity_error.

    Each component c of a vector becomes the integer floor(1024 c) + 100000.
    The n vectors of the fit list give sums S and a covariance; whitened is the
    centred vector projected on a unit eigenvector, over the root of its
    eigenvalue, and explained the eigenvalue's share of the trace. deviation,
    a decimal, is the exact sum of (n x - S)^2 over the components.
    identity_error is the largest entry of the covariance of whitened, less the
    identity, measured over all rows.

    Vectors that are null, empty or hold null or non-finite components take no
    part; nor do those of another width than the commonest (the widest of
    equally common ones). Repeated rows and null ids count and come back like
    others. A component whose variance is within rounding of none has a null
    whitened and explains 0; identity_error leaves it out, and is null where all
    are so. Components beyond 2**52 as integers, or vectors of more than WIDEST
    components, are an error. Only vec_id and the vector are read. Nothing
    depends on order; another partitioning moves the doubles by rounding only.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    tables = Tables(spark)
    try:
        rows, width = fit_list(vectors, vec, tables)
        if not width:
            return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, {kind}")
        n, total = sums(rows)
        high, low = mean(n, total)
        values, basis, shares = components(covariance(rows, "x", width, n, high, low), most)
        scaled = basis / np.sqrt(np.where(values > 0, values, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    piece = batch.slice(at, ROWS)
                    x = _matrix(piece.column("x"), width)
                    d, e = centred(x.astype(np.float64), high, low)
                    w = d @ scaled + e @ scaled
                    exact = pc.cast(pa.array([str(v) for v in deviations(x, n, total)]), pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays([piece.column("vec_id"), exact, pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

        id_kind = rows.schema["vec_id"].dataType.simpleString()
        white = tables.cut(rows.mapInArrow(run, f"vec_id {id_kind}, deviation decimal(38,0), w array<double>"), "whitened")
        real = np.flatnonzero(values > 0)
        error = None
        if len(real):
            centre = sorted(white.select(F.posexplode("w").alias("k", "c")).groupBy("k").agg(F.avg("c").alias("m")).collect())
            own = covariance(white, "w", len(values), n, np.array([r["m"] for r in centre]), np.zeros(len(values)))[0]
            error = float(np.abs(own[np.ix_(real, real)] - np.eye(len(real))).max())
        out = white.select("vec_id", "deviation", F.posexplode("w").alias("k", "c"))
        known = F.lit([float(s) for s in shares])
        has = F.element_at(F.lit([bool(v > 0) for v in values]), F.col("k") + 1)
        return cut(
            out.select(
                "vec_id",
                (F.col("k") + 1).alias("component"),
                F.lit(n).cast("long").alias("n"),
                "deviation",
                F.when(has, F.col("c")).alias("whitened"),
                F.element_at(known, F.col("k") + 1).alias("explained"),
                F.lit(error).cast("double").alias("identity_error"),
            ),
            "whitened-rows",
        )
    finally:
        tables.clear()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``whiten`` over ``embeddings``; a deviation beyond 64 bits, as of some 10**8 vectors, is null here (the operator has it as a decimal)."""
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
