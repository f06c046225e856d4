"""Whitening of vectors by two-pass covariance.

The first pass sums the vectors as whole numbers, so the mean is exact; the second centres every vector on it and sums the
outer products of a batch by one matrix product. Partial matrices, one for each partition, are merged by treeAggregate;
the driver holds one matrix of dimension x dimension numbers, takes its eigenvectors and broadcasts the projection.
A third pass measures the covariance of the whitened vectors. Vectors are only read: nothing of their number is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .embedding_dedup import _matrix
from .scratch import ship

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this don't take part: their sums and products are no longer exact.
LIMIT = 2**40
_LONG = 2**63 - 1


def finite(vector: Column, scale: int, limit: int, dim: int | None = None) -> Column:
    """True for a vector that has components, none of them null, non-finite or beyond limit when scaled; of dim components if given."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) * scale < limit), F.lit(False))) & (F.size(vector) > 0 if dim is None else F.size(vector) == dim)
    return F.coalesce(fine, F.lit(False))


def whole(batch: pa.RecordBatch) -> np.ndarray:
    return np.floor(SCALE * _matrix(batch.column("v"))).astype(np.int64) + SHIFT


@dataclass
class Moments:
    """Number and exact sums of the vectors, and for each dimension the largest |n * x - S|."""

    n: int
    sums: list[int]
    reach: list[int]

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """x - S / n as doubles, and the exact sums of (n * x - S)^2, null where a long can't hold them."""
        small = max(self.reach) < 2**62
        apart = self.n * (x if small else x.astype(object)) - np.array(self.sums, np.int64 if small else object)
        z = (apart / self.n).astype(float)
        if sum(r * r for r in self.reach) <= _LONG:
            return z, (apart * apart).sum(1).tolist()
        rough = (apart.astype(float) ** 2).sum(1)
        exact: list[int | None] = [None] * len(x)
        for k in np.flatnonzero(rough < 1.01 * _LONG):
            total = sum(int(d) * int(d) for d in apart[k])
            exact[k] = total if total <= _LONG else None
        return z, exact


def moments(rows: DataFrame, dim: int) -> Moments:
    """First pass over (id, v): whole-number sums, merged by dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, np.zeros(dim, object), np.full(dim, _LONG), np.full(dim, -_LONG)
        for batch in batches:
            for part in range(0, batch.num_rows, 8192):
                x = whole(batch.slice(part, 8192))
                n, sums, low, high = n + len(x), sums + x.sum(0), np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0)), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["k", "n", "s", "low", "high"]
            )

    parts = rows.select("v").mapInArrow(partial, "k int, n long, s decimal(38,0), low long, high long")
    found = sorted(parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect())
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    return Moments(n, sums, [max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(found, sums, strict=True)])


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows (v) of what ``of`` makes of a batch's whole numbers: ``size`` doubles, merged by treeAggregate."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for part in range(0, batch.num_rows, 8192):
                total += of(whole(batch.slice(part, 8192)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    matrices = rows.select("v").mapInArrow(partial, "total binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])))
    return matrices.treeAggregate(np.zeros(size), np.add, np.add)


def outer(of: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Sum of rows and of their outer products, one after the other."""

    def sums(x: np.ndarray) -> np.ndarray:
        z = of(x)
        return np.concatenate((z.sum(0), (z.T @ z).ravel()))

    return sums


@dataclass
class Whitening:
    """What to subtract and the projection: column k is the k-th eigenvector over the root of its eigenvalue, null if that is zero."""

    moments: Moments
    projection: np.ndarray
    explained: np.ndarray
    kept: np.ndarray
    identity_error: float | None = None

    def apply(self, z: np.ndarray) -> np.ndarray:
        return z @ self.projection


def fit(rows: DataFrame, dim: int, components: int) -> Whitening:
    """Eigenvectors of the covariance of rows (v), each of dim components, and how far whitened vectors are from unit covariance.

    Components whose eigenvalue is zero to rounding are not kept: they can't be scaled to unit variance.
    """
    of = moments(rows, dim)
    total = summed(rows, outer(lambda x: of.centred(x)[0]), dim + dim * dim)
    shift, cov = total[:dim] / of.n, total[dim:].reshape(dim, dim) / of.n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    kept = (values > 0) & (values > dim * np.finfo(float).eps * max(values.max(), 0.0))
    projection = vectors / np.sqrt(np.where(kept, values, 1.0))
    trace = np.trace(cov)
    model = Whitening(of, projection, values / trace if trace > 0 else np.zeros(len(values)), kept)
    if kept.any():
        m = int(kept.sum())
        base = (shift @ projection)[kept]
        again = summed(rows, outer(lambda x: model.apply(of.centred(x)[0])[:, kept] - base), m + m * m)
        model.identity_error = float(np.abs(again[m:].reshape(m, m) / of.n - np.eye(m)).max())
    return model


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector that takes part and component.

    Vectors that are null or empty, hold null or non-finite entries or entries beyond LIMIT when scaled, or are not of the
    table's most frequent length (of equals the greatest) take no part; an id may be null or repeated, each row counts.
    There are at most as many components as dimensions. Where an eigenvalue is zero to rounding (fewer different vectors
    than dimensions, equal columns), whitened is null for that component; identity_error leaves it out, and is null if that
    holds for all. deviation is null where a long can't hold it. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    read = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    dims = read.filter(finite(F.col("v"), SCALE, LIMIT)).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kind = vectors.schema[id_col].dataType.simpleString()
    types = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return read.filter(F.lit(False)).select(F.col("id").alias(id_col), *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in types.split(", ")])
    rows = read.filter(finite(F.col("v"), SCALE, LIMIT, dims["d"]))
    model = fit(rows, dims["d"], min(components, dims["d"]))
    shared = spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.kept)
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                b = batch.slice(part, 2048)
                z, deviation = m.moments.centred(whole(b))
                at = pa.array(np.repeat(np.arange(b.num_rows), k))
                spread = lambda values, kind, rows=b.num_rows: pa.array(np.tile(values, rows), kind)
                yield pa.RecordBatch.from_arrays([
                    b.column("id").take(at), spread(np.arange(1, k + 1, dtype=np.int32), pa.int32()), spread([m.moments.n] * k, pa.int64()), pa.array(deviation, pa.int64()).take(at),
                    pa.array(m.apply(z).ravel(), pa.float64(), mask=np.tile(~m.kept, b.num_rows)), spread(m.explained, pa.float64()), pa.array([m.identity_error] * b.num_rows * k, pa.float64()),
                ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"`{id_col}` {kind}, {types}")
