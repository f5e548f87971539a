"""Sharding by histogram sort, with DataFrame operations only.

Documents are ordered by a key: a hash of the text, so that equal texts lie
together, then a hash of the id, then the place in the written table. Shard
boundaries are found by counting: each round splits the ranges that still hold
a boundary into equal cells, counts the exact bytes in every cell across all
partitions, and keeps the cell with the boundary, until the bytes below each
splitter are within a tolerance of its target or the cell holds a single row.
Equal texts stay in one shard unless together they are larger than a shard's
share; then the range goes on to the hash of the id, so a text that a third of
all rows share is cut like any other stretch. Then rows are exchanged once.

Only counts reach the driver: at most ``shards * CELLS`` rows a round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import cut

SHARDS = 24

#: Cells that each open range is split into, a round.
CELLS = 1024

#: Share of one shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.0005

#: Bytes that a row takes beside its text.
OVERHEAD = 8

_TOP = (1 << 63) - 1
_PARTS = ("h", "d", "s")


@dataclass(frozen=True)
class Range:
    """Rows whose key parts equal ``fixed`` and whose next part lies in [low, high]."""

    fixed: tuple[int, ...] = ()
    low: int = 0
    high: int = _TOP

    @property
    def part(self) -> str:
        return _PARTS[len(self.fixed)]

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // CELLS)

    def holds(self) -> Column:
        test = (F.col(self.part) >= self.low) & (F.col(self.part) <= self.high)
        for name, value in zip(_PARTS, self.fixed, strict=False):
            test &= F.col(name) == value
        return test

    def cell(self) -> Column:
        return F.expr(f"({self.part} - {self.low}L) div {self.width}L")

    def key(self, value: int) -> tuple[int, int, int]:
        """The least key of this range whose next part is ``value``."""
        return (*self.fixed, value, *(0,) * (2 - len(self.fixed)))  # type: ignore[return-value]


def sized(docs: DataFrame) -> DataFrame:
    """Sizes and keys of all rows, without the texts. All parts of a key are from 0 to 2**63 - 1."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"),
        F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(29)), 1).alias("d"),
        F.monotonically_increasing_id().alias("s"),
    )


def _histogram(rows: DataFrame, ranges: list[Range]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """For each range its cells with rows: (cell, bytes, rows, least and greatest next part), in order."""
    which, cell, value = (F.when(F.lit(False), F.lit(None)) for _ in range(3))
    for i, r in enumerate(ranges):
        held = r.holds()
        which, cell, value = which.when(held, F.lit(i)), cell.when(held, r.cell()), value.when(held, F.col(r.part))
    counted = (
        rows.select(which.cast("int").alias("i"), cell.cast("long").alias("cell"), value.cast("long").alias("v"), "size")
        .where("i is not null")
        .groupBy("i", "cell")
        .agg(F.sum("size"), F.count("*"), F.min("v"), F.max("v"))
    )
    out: dict[int, list[tuple[int, int, int, int, int]]] = {i: [] for i in range(len(ranges))}
    for row in sorted(tuple(r) for r in counted.collect()):
        out[row[0]].append(row[1:])
    return out


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """Least keys of shards 1 to ``shards`` - 1, in order."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [(_TOP, _TOP, _TOP)] * (shards - 1)
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int, int]] = {}
    open_: dict[int, tuple[Range, int]] = {k: (Range(), 0) for k in range(1, shards)}  # and the bytes below the range
    while open_:
        ranges = sorted({r for r, _ in open_.values()}, key=lambda r: (r.fixed, r.low))
        cells = _histogram(rows, ranges)
        for k, (r, below) in list(open_.items()):
            target, last = total * k / shards, None
            for number, size, count, least, greatest in cells[ranges.index(r)]:
                last = (number, size, count, least, greatest)
                if below + size >= target:
                    break
                below += size
            number, size, count, least, greatest = last
            before, after = target - below, below + size - target
            if count == 1 or min(before, after) <= slack or (least == greatest and len(r.fixed) == 2):
                start = r.key(least) if before <= after else r.key(min(greatest + 1, _TOP))
                found[k] = start
                del open_[k]
            elif least == greatest and not r.fixed and size <= total / shards:  # equal texts stay together
                found[k] = r.key(least) if before <= after else r.key(min(greatest + 1, _TOP))
                del open_[k]
            elif least == greatest:
                open_[k] = (Range((*r.fixed, least)), below)
            else:
                open_[k] = (Range(r.fixed, least, greatest), below)
    return [found[k] for k in range(1, shards)]


def _shard(starts: list[tuple[int, int, int]]) -> Column:
    """Splitters that are not above a row's key."""
    out = F.lit(0)
    for h, d, s in starts:
        at_least = (F.col("h") > h) | ((F.col("h") == h) & ((F.col("d") > d) | ((F.col("d") == d) & (F.col("s") >= s))))
        out = out + at_least.cast("int")
    return out


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row of ``docs`` with its shard and its slot there.

    Returns doc_id, size (UTF-8 bytes and 8), text_crc32 (null for a null
    text), law, shard, slot (from 0 without gaps) and grown_shard (null). The
    law is ``bytes``: a shard's size differs from its share by the tolerance and
    at most half the group of equal texts, or the one row, at each of its
    boundaries; a group is cut only where it is larger than a share. A null text
    has 8 bytes and null texts are a group; repeated rows are placed as often as
    they occur; columns beside doc_id and text are left out; an empty table
    gives no rows.
    """
    rows = cut(sized(docs), "shard-keys")
    placed = rows.withColumn("shard", _shard(splitters(rows, shards, tolerance)))
    return place(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def place(placed: DataFrame, least_cells: int = 1024, rows_a_cell: int = 200_000) -> DataFrame:
    """Number the rows of each shard from 0.

    A shard is numbered in cells of the key, so that no task sorts a whole
    shard: the slot is the count of rows in earlier cells and the place within
    the cell. Cells far above the average, which hold a hot text, are cut by
    the hash of the id; there are fewer than a quarter as many as cells.
    """
    total = placed.count()
    cells = max(least_cells, -(-total // rows_a_cell))
    width = -(-(_TOP + 1) // cells)
    celled = placed.withColumn("hb", F.expr(f"h div {width}L"))
    most = max(1, 4 * -(-total // cells))
    heavy = {r["hb"]: -(-r["count"] // most) for r in celled.groupBy("hb").count().where(F.col("count") > most).collect()}
    part = F.lit(0)
    for parts in sorted(set(heavy.values())):
        own = [hb for hb, n in heavy.items() if n == parts]
        part = F.when(F.col("hb").isin(own), F.expr(f"d div {-(-(_TOP + 1) // parts)}L")).otherwise(part)
    celled = celled.withColumn("db", part.cast("long"))
    keys = ["shard", "hb", "db"]
    before = Window.partitionBy("shard").orderBy("hb", "db").rowsBetween(Window.unboundedPreceding, -1)
    offsets = celled.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = celled.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "d", "s")))
    return numbered.join(offsets, keys).withColumn("slot", (F.col("offset") + F.col("k") - 1).cast("long"))
