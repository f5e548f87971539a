"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.session import Tables, cut, shared_dir, ship, table

__all__ = ["WORD", "Tables", "cut", "documents", "extended", "is_held_out", "pieces_of", "shared_dir", "ship", "table", "texts_of"]

#: A word: a run of characters that are neither ASCII space nor \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow types of the columns that operators add.
ARROW: dict[str, pa.DataType] = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return table(spark, sf_dir, "documents")


def is_held_out(doc_id):
    """True where crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def pieces_of(batch: pa.RecordBatch, text: str, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each piece holds about ``chars`` bytes of text.

    Working memory then follows the longest text, not the number of rows that
    Spark puts into a batch. Every row is passed on, whole.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    number = sizes.cumsum() // chars
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def texts_of(piece: pa.RecordBatch, text: str = "text") -> list[str | None]:
    return piece.column(text).to_pylist()


def _typed(values, kind: str | pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    return pa.array(values, ARROW[kind] if isinstance(kind, str) else kind)


def extended(
    df: DataFrame,
    added: dict[str, str | tuple[str, pa.DataType]],
    make: Callable[[pa.RecordBatch], dict],
    text: str = "text",
    drop: tuple[str, ...] = (),
    chars: int = 2_000_000,
) -> DataFrame:
    """``df`` with columns that ``make`` derives from pieces of its Arrow batches.

    All other columns stay Arrow arrays, so they come back as they were: an id
    above 2**53 beside a null one, a decimal, a nested value. A column with the
    name of an added one is replaced, at its place; columns of ``drop`` are read
    by ``make`` and don't come back. An empty table gives an empty table.
    """
    ship(df.sparkSession)
    kinds = {name: kind if isinstance(kind, tuple) else (kind, ARROW[kind]) for name, kind in added.items()}
    base = [f for f in df.schema.fields if f.name not in drop or f.name in kinds]
    fresh = [n for n in kinds if n not in {f.name for f in base}]
    ddl = {n: T.StructField(n, T.StructType.fromDDL(f"x {kind}")["x"].dataType) for n, (kind, _) in kinds.items()}
    schema = T.StructType([ddl.get(f.name, f) for f in base] + [ddl[n] for n in fresh])
    order, arrow = schema.names, {n: kind for n, (_, kind) in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, text, chars):
                made = make(piece)
                yield pa.RecordBatch.from_arrays([_typed(made[n], arrow[n]) if n in arrow else piece.column(n) for n in order], names=order)

    return df.mapInArrow(run, schema)
