"""Tables of visits and usage by day, to which micro-batches are appended so that a replay changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

# Columns of the tables.
VISITS = "path string, visitor string, referer_host string, device string, created_at timestamp"
USAGE = "source string, api_key_id long, mode string, target string, target_host string, created_at timestamp"


class DayTable:
    """A Parquet table in folders of day and batch.

    A batch owns its folders: writing it again replaces them and nothing else, so a batch that Spark replays after a failure,
    half written or not, leaves the table as if it had been written once. The table is there as soon as it is named.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, writer: str = "main"):
        self.spark, self.path, self.writer = spark, path.rstrip("/"), writer
        self.schema = StructType.fromDDL(f"{schema}, day date, batch string")
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # also where it exists

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch, once or again. Rows without a time belong to no day and are left out; other columns too."""
        names = [f.name for f in self.schema.fields[:-2]]
        placed = rows.filter("created_at is not null").select(*names, F.to_date("created_at").alias("day"), F.lit(f"{self.writer}-{batch_id}").alias("batch"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)

    def read(self, first: Column | None = None, last: Column | None = None) -> DataFrame:
        """Rows of the days from first to last, both included; only their folders are read."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        if first is not None:
            rows = rows.filter(F.col("day") >= first)
        if last is not None:
            rows = rows.filter(F.col("day") <= last)
        return rows.drop("batch")

    def sink(self, stream: DataFrame, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
        """Start a query that appends what ``prepare`` makes of each micro-batch of a stream."""
        return stream.writeStream.foreachBatch(lambda rows, batch_id: self.append(prepare(rows), batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
