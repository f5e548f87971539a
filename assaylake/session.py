"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application.

    Workers that were started elsewhere than in the repository can then import
    the functions that UDFs refer to.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # already running from a shipped archive
        return
    path = os.path.join(tempfile.mkdtemp(prefix="assaylake-"), "assaylake.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a
    temporary folder is made and set, on one machine only: with executors
    elsewhere they could not see it, so that is an error.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_dir = held.get() if held.isDefined() else None
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir.rstrip("/")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assaylake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    The lineage ends there: a lost executor costs a read of the table, never
    the work before it. Columns keep their names and types.
    """
    return _written(df, name)[0]


class Tables:
    """Intermediate tables of one operator, removed once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Like :func:`cut`; the table goes with ``clear``."""
        out, path = _written(df, name)
        self.paths.append(path)
        return out

    def folder(self, name: str) -> str:
        """A new path in the shared folder, which goes with ``clear`` too."""
        path = f"{shared_dir(self.spark)}/assaylake-{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        return path

    def clear(self) -> None:
        """Remove the tables. Nothing that is still to run may read them."""
        context = self.spark.sparkContext
        for path in self.paths:
            held = context._jvm.org.apache.hadoop.fs.Path(path)
            held.getFileSystem(context._jsc.hadoopConfiguration()).delete(held, True)
        self.paths.clear()


#: Rows that a small dimension may have to become literals.
MOST_LISTED = 1000


def listed(rows: DataFrame, most: int = MOST_LISTED) -> Column:
    """The rows of a small dimension as a literal array of structs, for ``explode``: a pairing with every row without a join.

    More than ``most`` rows are an error, so what the plan carries is bounded.
    """
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"a small dimension has more than {most} rows")
    kind = T.ArrayType(rows.schema)
    return F.array(*(F.struct(*(F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(r, rows.schema.fields, strict=True))) for r in held)).cast(kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may be one that only Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
