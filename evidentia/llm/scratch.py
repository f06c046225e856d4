"""Shared folder for intermediate tables, shipping of this package to executors, and size-checked joins."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast. A row is a key and a few numbers, so this is some 30 MB at most.
BROADCAST_ROWS = 500_000

_shipped: set[str] = set()
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if driver and executors are one process; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


class Table:
    """A written intermediate table: ``df`` reads it, ``drop()`` deletes its files once nothing reads it any more."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.df = spark.read.parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write(df: DataFrame, name: str) -> Table:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner real sizes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return Table(spark, path)


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="evidentia-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join; right, known to have ``rows`` rows, is broadcast only up to BROADCAST_ROWS. Beyond it both sides are shuffled."""
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def fold(id_col: Column, parts: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts
