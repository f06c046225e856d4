"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a side of a join that may be broadcast, after they were counted: keys and a few numbers, some 30 MB at most.
BROADCAST_ROWS = 200_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder if driver and executors are one process, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    return _own[app]


def result(spark: SparkSession, name: str, of: Callable[[Folder], DataFrame]) -> DataFrame:
    """What ``of`` makes of a folder, written apart, so that the folder's tables can go."""
    work, kept = Folder(spark, name), Folder(spark, f"{name}-result")
    found = kept.write(of(work), "rows")
    work.drop()
    return found


class Folder:
    """A folder for the tables of one job. ``drop()`` deletes them; what a result still reads is kept in another folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back: no lineage grows, a lost executor costs one step, and the planner knows real sizes."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
