"""What the text classifiers share: labelled rows, bounded samples, temperature calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from .scratch import join_checked, ship

#: Bytes of a training sample's features that the driver takes at most.
MAX_SAMPLE_BYTES = 256 << 20
#: Rows whose texts a task holds as Python strings at a time.
PART = 256


def unit(id_col: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(id_col.cast("string"), F.lit(seed)), 11) / F.lit(float(1 << 53))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column) -> DataFrame:
    """(id, text, label) of the training rows: label 0 or 1; ids whose labels contradict each other don't take part.

    train is a condition on the id column; it is applied to labels, so that labels of other rows are never read.
    """
    one = (
        labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).filter(train & F.col("label").isin(0, 1))
        .groupBy(id_col).agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").drop("_most")
    )
    rows = one.count()
    return join_checked(docs.select(id_col, text_col), one, [id_col], "inner", rows)


def bounded_sample(rows: DataFrame, features: list[str], most: int, most_bytes: int = MAX_SAMPLE_BYTES) -> list:
    """The rows of a written sample, in a fixed order: at most ``most``, and so many that ``features`` take most_bytes or so.

    Which rows stay depends on a hash of their values alone, not on the order in which they are read.
    """
    key = F.xxhash64(*rows.columns)
    size = rows.agg(F.sum(sum((F.octet_length(c) for c in features), F.lit(0)))).first()[0] or 0
    if size > most_bytes:
        rows = rows.filter(F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53)) < most_bytes / size)
    return sorted(rows.orderBy(key).limit(most).collect())


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of a grid that gives the least cross-entropy. logits: rows x classes; y: class numbers."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def map_texts(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], start: Callable, fields: dict[str, pa.DataType]) -> DataFrame:
    """The columns id_col and ``keep`` with new ones computed from each whole text, a row for each input row.

    start() is called once in each task and returns a function from a list of texts (None for null) to a list of values for
    each field. No other columns of docs are read.
    """
    ship(docs.sparkSession)
    names = list(dict.fromkeys([id_col, *keep]))
    inner = [f"k{i}" for i in range(len(names))]
    source = docs.select(*[F.col(c).alias(k) for k, c in zip(inner, names, strict=True)], F.col(text_col).alias("text"))
    schema = StructType([StructField(k, docs.schema[c].dataType) for k, c in zip(inner, names, strict=True)] + [StructField(c, from_arrow_type(t)) for c, t in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for whole in batches:
            for at in range(0, whole.num_rows, PART):
                batch = whole.slice(at, PART)
                found = f(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in inner), *(pa.array(x, t) for x, t in zip(found, fields.values(), strict=True))], [*inner, *fields])
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema).select(*[F.col(k).alias(c) for k, c in zip(inner, names, strict=True)], *fields)
