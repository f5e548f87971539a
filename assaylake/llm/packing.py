"""Conflict-constrained best-fit packing of documents into training sequences.

Open bins are ordered by residual space, then by number. For a piece, the
search starts at the successor of its length in that order, the tightest bin
that holds it, and goes on to the next until a bin has no conflict: each bin
carries bitmaps of the sources and duplicate clusters in it, and a piece may
neither join its own cluster nor exceed the number of pieces a source may have
in one bin. If no open bin will do, a new one is opened.

A document longer than the capacity is cut into full pieces, which fill bins of
their own, and a rest. Documents are dealt by a hash into packing groups of
bounded size, whatever their source or cluster, so one task never holds more
than a group and a hot source or cluster is spread over all of them.
"""

from __future__ import annotations

import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import ship

#: Capacity of a bin, in the unit of the lengths: characters (code points) of text where none are given.
CAPACITY = 16_384

#: Documents in one packing group, on average.
GROUP = 8_000

#: Pieces of one source that a bin may hold.
PER_SOURCE = 4

SCHEMA = "doc_id long, piece int, start long, length long, bin_id string, bin_offset long, bin_fill long"
ARROW_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("bin_id", pa.string()), ("bin_offset", pa.int64()), ("bin_fill", pa.int64())]
)


class Bins:
    """Open bins in order of (residual, number), with conflict bitmaps."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        #: planes[k] of a bin: sources with more than k pieces in it
        self.planes: list[list[int]] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; source and cluster are bits, 0 for none."""
        at = bisect.bisect_left(self.order, (length, -1))
        while at < len(self.order):
            residual, number = self.order[at]
            if not self.clusters[number] & cluster and not self.planes[number][-1] & source:
                break
            at += 1
        else:
            residual, number = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.planes.append([0] * self.per_source)
            at = -1
        if at >= 0:
            del self.order[at]
        self.clusters[number] |= cluster
        planes = self.planes[number]
        for k in range(self.per_source):
            if not planes[k] & source:
                planes[k] |= source
                break
        if residual > length:
            bisect.insort(self.order, (residual - length, number))
        return number, self.capacity - residual


def pack_group(rows: list[tuple], capacity: int, per_source: int, group: int = 0) -> list[tuple]:
    """Pack one group of (doc_id, length, source, cluster): longest first, ties by doc_id (null first) and cluster."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0, r[3] is not None, r[3] or 0))
    sources: dict[object, int] = {}
    seen = Counter(r[3] for r in rows)
    repeated = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    bins, out, full = Bins(capacity, per_source), [], 0
    for doc_id, length, source, cluster in rows:
        bit = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        alike = 1 << repeated[cluster] if cluster in repeated else 0
        whole, rest = divmod(length, capacity)
        for k in range(whole):
            out.append((doc_id, k, k * capacity, capacity, f"{group}-f{full}", 0))
            full += 1
        if rest or not whole:
            number, offset = bins.place(rest, bit, alike) if rest else (None, 0)
            out.append((doc_id, whole, whole * capacity, rest, None if number is None else f"{group}-{number}", offset))
    fill: Counter = Counter()
    for r in out:
        fill[r[4]] += r[3]
    return [(*r, None if r[4] is None else fill[r[4]]) for r in out]


def pack(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group: int = GROUP, length: Column | None = None, cluster: Column | None = None
) -> DataFrame:
    """Pieces of all documents with their bins.

    One row for each piece: doc_id, piece (from 0), start and length, bin_id,
    bin_offset, and bin_fill, the sum of the bin. Lengths are code points of
    the text unless ``length`` gives others, such as token counts; duplicate
    clusters are equal texts unless ``cluster`` gives others, such as components
    of near duplicates. A null or empty text has one piece of length 0 and no
    bin (null bin_id). A null source or cluster conflicts with none. Repeated
    rows are packed as often as they occur; they are counted before the
    exchange and dealt apart, so no group holds all of them. Columns of ``docs``
    beside doc_id, text and source may have any name and are left out. An empty
    table gives no rows. The texts stay where they are: only lengths and hashes
    are exchanged.
    """
    ship(docs.sparkSession)
    groups = max(1, -(-docs.count() // group))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.length("text") if length is None else length, F.lit(0)).cast("long").alias("length"),
        F.col("source").cast("string").alias("source"),
        (F.when(F.length("text") > 0, F.xxhash64("text")) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
    )
    counted = sized.groupBy("doc_id", "length", "source", "cluster").agg(F.count("*").alias("n"))
    copies = counted.select("doc_id", "length", "source", "cluster", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    dealt = copies.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", "copy", F.lit(3)), F.lit(groups))).drop("copy")

    def run(held: pa.Table) -> pa.Table:
        rows = list(zip(*(held.column(c).to_pylist() for c in ("doc_id", "length", "source", "cluster")), strict=True))
        packed = pack_group(rows, capacity, per_source, held.column("group")[0].as_py())
        return pa.table([pa.array(column, kind) for column, kind in zip(zip(*packed, strict=True), ARROW_SCHEMA.types, strict=True)], schema=ARROW_SCHEMA)

    return dealt.groupBy("group").applyInArrow(run, SCHEMA)
