"""Centroid clustering by plain Lloyd rounds in whole numbers.

A round broadcasts the centroids (k x dimension numbers), takes the squared difference of every vector and each centroid in
NumPy, and sums the vectors of a cluster within each partition; a groupBy merges those sums, one row for each partition
and cluster. Vectors are read once a round and never shuffled, so a cluster that holds most rows costs no more than others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ship
from .whitening import finite

SCALE, DIM, CLUSTERS, ROUNDS, SEED = 256, 64, 40, 5, 2
#: Whole-number components beyond this don't take part: a squared distance would not fit a long.
LIMIT = 2**27
_LONG = 2**63 - 1


def whole(column: pd.Series) -> np.ndarray:
    return np.floor(SCALE * np.stack(column.to_numpy()).astype(float)).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row of x, the lowest of equals, and the squared distance."""
    squares = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        apart = x - c
        squares[:, k] = np.einsum("ij,ij->i", apart, apart)
    best = squares.argmin(1)
    return best, squares[np.arange(len(x)), best]


@dataclass
class Sums:
    """By cluster: how many vectors it has, their sum, and the sum of their squared distances."""

    n: dict[int, int]
    total: dict[int, list[int]]
    inertia: dict[int, int]


def assigned_sums(rows: DataFrame, centroids: np.ndarray) -> Sums:
    spark, dim = rows.sparkSession, centroids.shape[1]
    shared = spark.sparkContext.broadcast(centroids)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(shared.value)
        n, inertia, total = np.zeros(k, np.int64), [0] * k, np.zeros((k, dim), np.int64)
        for frame in frames:
            for part in range(0, len(frame), 4096):
                x = whole(frame["v"].iloc[part : part + 4096])
                cluster, distance = nearest(x, shared.value)
                order = np.argsort(cluster, kind="stable")
                some, start = np.unique(cluster[order], return_index=True)
                n += np.bincount(cluster, minlength=k)
                total[some] += np.add.reduceat(x[order], start)
                for c, d in zip(some.tolist(), np.split(distance[order], start[1:]), strict=True):
                    inertia[c] += int(d.astype(object).sum()) if d.max() > _LONG // 4096 else int(d.sum())
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "inertia": [Decimal(inertia[c]) for c in some], "total": list(total[some])})

    parts = rows.select("v").mapInPandas(partial, "cluster int, n long, inertia decimal(38,0), total array<long>")
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dim)]).alias("total")).collect()
    shared.unpersist()
    return Sums({r["cluster"]: r["n"] for r in found}, {r["cluster"]: r["total"] for r in found}, {r["cluster"]: int(r["inertia"]) for r in found})


def fit(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after the rounds: they start as the vectors of (id, v) whose ids hash lowest; empty clusters keep theirs."""
    first = rows.filter("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "v").limit(clusters).select("v").toPandas()
    centroids = whole(first["v"]) if len(first) else np.zeros((0, 0), np.int64)
    for _ in range(rounds if len(first) else 0):
        sums = assigned_sums(rows, centroids)
        for k, n in sums.n.items():
            centroids[k] = [s // n for s in sums.total[k]]
    return centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    Kept are vectors of exactly ``dim`` components, none null, non-finite or beyond LIMIT as a whole number. Each row counts,
    repeated ones too; rows with a null id are assigned but never start a centroid. Of repeated ids the smaller vector comes
    first. With fewer ids than ``clusters`` there are fewer centroids; with none all rows have nulls. cluster_inertia and
    inertia are null where a long can't hold them. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    read = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    rows = read.filter(finite(F.col("v"), SCALE, LIMIT, dim))
    centroids = fit(rows, clusters, rounds, seed)
    types = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in types.split(", ")])
    inertia = assigned_sums(rows, centroids).inertia
    known = lambda x: x if x <= _LONG else None
    by_cluster = [(known(inertia.get(k, 0)), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    shared = spark.sparkContext.broadcast((centroids, by_cluster, known(sum(inertia.values()))))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        middle, told, whole_inertia = shared.value
        for frame in frames:
            for part in range(0, len(frame), 4096):
                f = frame.iloc[part : part + 4096]
                k, distance = nearest(whole(f["v"]), middle)
                yield pd.DataFrame({
                    id_col: f["id"], "cluster": k.astype(np.int32), "distance": distance, "cluster_inertia": pd.array([told[c][0] for c in k], "Int64"),
                    "inertia": pd.array([whole_inertia] * len(f), "Int64"), "centroid_sha256": [told[c][1] for c in k],
                })

    # ids travel as text: pandas would make doubles of whole numbers among which one is null
    found = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(assign, f"`{id_col}` string, {types}")
    return found.withColumn(id_col, F.col(f"`{id_col}`").cast(vectors.schema[id_col].dataType))
