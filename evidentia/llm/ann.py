"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them for each query.

Trees are fitted on a bounded sample: each has orthonormal random directions, one for each level, and for each node the
median of its sample as threshold. Every vector is dealt to one leaf of each tree. A query's queue holds nodes of all trees,
the most probable first: a neighbour at the typical distance r of the table lies beyond a threshold at a distance m with
the probability Phi(-m sqrt(dim) / r), and a node has the product over its path. Leaves are taken from the queue until
they hold ``candidates`` vectors. That number and r are fitted: for PROBES vectors the true neighbours are found among all
vectors, and the number is the least for which the mean recall of the probes reaches TARGET.

Candidates are then ranked exactly: leaves that are neighbours in a tree form blocks, a block meets the queries that take
any of its leaves, and each query keeps its nearest in the block's leaves that it takes, by the distance in double precision.
Blocks of more than BLOCK vectors and lists of more than QUERIES queries are cut, and all cuts meet, so that a task's memory
is bounded and no candidate is left out. Copies of a vector are one point with the ids of its first rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding_dedup import _matrix, usable
from .learning import unit
from .scratch import ship, write

TREES, LEAF, BLOCK, QUERIES = 4, 64, 4096, 4096
#: Vectors that thresholds are fitted on, how many of them a node needs to be split, and probes for the number of candidates.
MAX_SAMPLE, LEAST, PROBES = 262_144, 4, 256
#: Mean recall of the probes.
TARGET = 0.96
_LEAF_BITS = 16


@dataclass
class Forest:
    directions: np.ndarray  # trees x depth x dimension
    thresholds: list[list[np.ndarray]]  # by tree and level, one for each node
    radius: float = 1.0  # typical distance of a neighbour
    sizes: np.ndarray | None = None  # vectors by tree and leaf
    candidates: int = 0

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: the leaf of every row in every tree."""
        found = np.zeros((len(x), len(self.directions)), np.int64)
        for t, levels in enumerate(self.thresholds):
            p = x @ self.directions[t].T if self.depth else None
            for level, at in enumerate(levels):
                found[:, t] = 2 * found[:, t] + (p[:, level] > at[found[:, t]])
        return found

    def visit(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) of every leaf, the most probable first, from one queue over all trees."""
        p = (self.directions @ x).tolist()
        scale = math.sqrt(len(x)) / self.radius / math.sqrt(2)
        queue = [(0.0, t, 0, 0) for t in range(len(self.thresholds))]
        while queue:
            cost, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                z = (p[t][level] - self.thresholds[t][level][node]) * scale
                right = z > 0
                far = 0.5 * math.erfc(abs(z))
                level, node = level + 1, 2 * node + right
                heapq.heappush(queue, (cost - math.log(max(far, 1e-300)), t, level, node ^ 1))
                cost -= math.log1p(-far)
                if queue[0][0] < cost:
                    heapq.heappush(queue, (cost, t, level, node))
                    break
            else:
                yield t, node

    def search(self, x: np.ndarray) -> list[tuple[int, int]]:
        """Leaves that hold the candidates of a query."""
        taken, left = [], self.candidates
        for t, leaf in self.visit(x):
            taken.append((t, leaf))
            left -= int(self.sizes[t, leaf])
            if left <= 0:
                break
        return taken

    def needed(self, x: np.ndarray, homes: np.ndarray) -> list[int]:
        """For each vector of which homes has the leaves (rows x trees): after how many candidates it is found."""
        found, waiting, seen = [0] * len(homes), set(range(len(homes))), 0
        for t, leaf in self.visit(x):
            seen += int(self.sizes[t, leaf])
            for k in [k for k in waiting if homes[k, t] == leaf]:
                found[k] = seen
                waiting.discard(k)
            if not waiting:
                break
        return found


def plant(sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> Forest:
    """A forest for ``total`` vectors of which ``sample`` has some."""
    random = np.random.default_rng(seed)
    dim = sample.shape[1]
    depth = max(0, min(math.ceil(math.log2(max(1.0, total / leaf))), int(math.log2(max(1, len(sample) // LEAST))), _LEAF_BITS))
    directions = np.zeros((trees, depth, dim))
    thresholds = []
    for t in range(trees):
        for start in range(0, depth, dim):  # deeper trees than dimensions take further bases
            directions[t, start : start + dim] = np.linalg.qr(random.normal(size=(dim, dim)))[0][: depth - start]
        node, levels = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            p = sample @ directions[t, level]
            order = np.lexsort((p, node))
            start = np.searchsorted(node[order], np.arange(1 << level))
            end = np.append(start[1:], len(sample))
            levels.append(p[order][np.minimum((start + end) // 2, len(sample) - 1)])
            node = 2 * node + (p > levels[-1][node])
        thresholds.append(levels)
    return Forest(directions, thresholds)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from q; scaled where squares would overflow or vanish."""
    apart = x - q
    with np.errstate(over="ignore", under="ignore"):
        squares = (apart * apart).sum(1)
    odd = ~((squares > 1e-280) & (squares < 1e280))
    found = np.sqrt(np.where(odd, 0.0, squares))
    if odd.any():
        size = np.maximum(np.abs(apart[odd]).max(1), 1e-320)
        found[odd] = size * np.sqrt(((apart[odd] / size[:, None]) ** 2).sum(1))
    return found


def first(x: np.ndarray, ids: np.ndarray, q: np.ndarray, near: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, distance) of the ``keep`` rows nearest to q, ties to the smaller id. near: rough squared distances, infinity for rows that don't count."""
    rows = np.flatnonzero(near < np.inf)
    if len(rows) > keep:
        cut = np.partition(near[rows], keep - 1)[keep - 1]
        if np.isfinite(cut):
            rows = rows[near[rows] <= cut + 1e-9 * (cut + (q * q).sum())]
    d = distances(x[rows], q)
    order = np.lexsort((ids[rows], d))[:keep]
    return rows[order], d[order]


def rough(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; zero, which lets a row pass, where it overflows."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * (q @ x.T)
    return np.where(np.isfinite(near), near, 0.0)


def points_of(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, keep: int) -> tuple[DataFrame, DataFrame] | None:
    """(rep, ids, v, h1, h2) of the different vectors that take part, and (id, h1, h2) of the queries; None if no vector does.

    ids are a point's first ``keep`` ids, rep is the first. Of rows with one id the vector of the lowest hash counts.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).filter("id is not null")
    dims = rows.filter(usable(F.col("v"))).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not dims:
        return None
    rows = rows.filter(usable(F.col("v"), dims["d"])).select("id", "asked", F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"), "v")
    named = rows.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h"), F.max("asked").alias("asked")).select("id", "asked", "h.*")
    order = Window.partitionBy("h1", "h2").orderBy("id")
    ids = named.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep)  # Spark limits a group before the shuffle, too
    ids = ids.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = named.filter("asked").select("id", "h1", "h2")
    points = rows.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(ids, ["h1", "h2"]).join(asked.select("h1", "h2", F.lit(True).alias("asked")).distinct(), ["h1", "h2"], "left")
    return points.select(F.get("ids", F.lit(0)).alias("rep"), "ids", "v", "h1", "h2", F.coalesce("asked", F.lit(False)).alias("asked")), asked


def grow(points: DataFrame, keep: int, trees: int, leaf: int, probes: int, target: float, seed: int) -> Forest:
    """A forest over points (rep, v), with leaf sizes of all of them and the number of candidates that probes need."""
    spark = points.sparkSession
    total = points.count()
    some = lambda n, salt: points.filter(unit(F.col("rep"), salt) < min(1.0, n / max(1, total))).select("rep", "v").toArrow().sort_by("rep")
    sample = some(MAX_SAMPLE, seed)
    forest = plant(_matrix(sample.column("v")), total, trees, leaf, seed)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((trees, 1 << forest.depth), np.int64)
        for batch in batches:
            for part in range(0, batch.num_rows, 8192):
                at = forest.leaves(_matrix(batch.column("v").slice(part, 8192)))
                for t in range(trees):
                    n[t] += np.bincount(at[:, t], minlength=n.shape[1])
        code = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(n.ravel()[code], pa.int64())], ["code", "n"])

    forest.sizes = np.zeros((trees, 1 << forest.depth), np.int64)
    for r in points.select("v").mapInArrow(sizes, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most a row for each leaf
        forest.sizes.ravel()[r["code"]] = r["n"]
    chosen = some(probes, seed + 1)
    asked, own = _matrix(chosen.column("v")), chosen.column("rep").to_numpy()
    shared = spark.sparkContext.broadcast((asked, own))

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, mine = shared.value
        for batch in batches:
            for part in range(0, batch.num_rows, BLOCK):
                x, rep = _matrix(batch.column("v").slice(part, BLOCK)), batch.column("rep").slice(part, BLOCK).to_numpy()
                near = rough(q, x)
                near[mine[:, None] == rep[None]] = np.inf
                best = [first(x, rep, q[k], near[k], keep - 1) for k in range(len(q))]
                at = np.concatenate([rows for rows, _ in best] or [np.zeros(0, np.int64)])
                probe = np.repeat(np.arange(len(q)), [len(rows) for rows, _ in best])
                homes = forest.leaves(x[at]) if len(at) else np.zeros((0, trees), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(probe, pa.int32()), pa.array(rep[at], pa.int64()), pa.array(np.concatenate([d for _, d in best] or [np.zeros(0)]), pa.float64()), pa.array(list(homes.astype(np.int32)), pa.list_(pa.int32())),
                ], ["probe", "rep", "distance", "homes"])

    order = Window.partitionBy("probe").orderBy("distance", "rep")
    near = points.select("rep", "v").mapInArrow(truth, "probe int, rep long, distance double, homes array<int>").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") < keep).collect()  # probes x (keep - 1)
    shared.unpersist()
    if not near:
        forest.candidates = total
        return forest
    by_probe: dict[int, list] = {}
    for r in near:
        by_probe.setdefault(r["probe"], []).append(r)
    forest.radius = float(np.median([max(r["distance"] for r in rows) for rows in by_probe.values()])) or 1.0
    needs = [n for probe, rows in by_probe.items() for n in forest.needed(asked[probe], np.array([r["homes"] for r in rows]))]
    forest.candidates = int(np.quantile(needs, target, method="higher"))
    return forest


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, probes: int = PROBES, target: float = TARGET, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row for which is_query, a column over vectors, holds.

    score is the Euclidean distance in double precision; ties go to the smaller id; a row is no candidate of its own. Vectors
    that are null, zero, hold null or non-finite components or are not of the table's most frequent length (of equals the
    greatest), and rows with a null id, take no part. Repeated rows count once; of rows with one id and several vectors one
    counts, that of the lowest hash. An empty table or one without queries gives no rows; other columns are read only where
    is_query names them.
    """
    spark = vectors.sparkSession
    ship(spark)
    keep = k + 1  # a query's own row is dropped at the end
    known = points_of(vectors, is_query, id_col, vector_col, keep)
    if known is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table, asked = write(known[0], "points"), known[1]
    points = table.df
    forest = grow(points, keep, trees, leaf, probes, target, seed)
    shared = spark.sparkContext.broadcast(forest)
    low = max(0, min(forest.depth, int(math.log2(max(1, block // leaf)))))  # leaves of one block differ in so many last bits

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                b = batch.slice(part, 256)
                at, code, taken = [], [], []
                for i, x in enumerate(_matrix(b.column("v"))):
                    by_block: dict[int, list[int]] = {}
                    for t, leaf_code in f.search(x):
                        by_block.setdefault(t << _LEAF_BITS | leaf_code >> low, []).append(leaf_code)
                    at += [i] * len(by_block)
                    code += by_block
                    taken += by_block.values()
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), b.column("rep").take(take), b.column("v").take(take), pa.array(taken, pa.list_(pa.int32()))], ["code", "rep", "v", "leaves"])

    kind = points.schema["v"].dataType.simpleString()
    routed = write(points.filter("asked").select("rep", "v").mapInArrow(route, f"code int, rep long, v {kind}, leaves array<int>"), "routes")
    # what is cut: at most a row for each block
    query_cuts = {r["code"]: -(-r["count"] // QUERIES) for r in routed.df.groupBy("code").count().filter(F.col("count") > QUERIES).collect()}
    by_block = forest.sizes.reshape(trees, -1, 1 << low).sum(2)
    row_cuts = {int(t << _LEAF_BITS | b): int(-(-by_block[t, b] // block)) for t, b in zip(*np.nonzero(by_block > 2 * block), strict=True)}
    cuts = spark.sparkContext.broadcast((row_cuts, query_cuts))

    def spread(code: np.ndarray, rep: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, own cut, cut of the other side) of each row in each cut that it meets."""
        mine, others = cuts.value[side], cuts.value[1 - side]
        own = np.array([(r & 0x7FFFFFFFFFFFFFFF) // 3 % mine.get(c, 1) for c, r in zip(code.tolist(), rep.tolist(), strict=True)], np.int64)
        n = np.array([others.get(c, 1) for c in code.tolist()], np.int64)
        at = np.repeat(np.arange(len(code)), n)
        return at, own[at], np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for part in range(0, batch.num_rows, 2048):
                b = batch.slice(part, 2048)
                home = f.leaves(_matrix(b.column("v")))
                code = ((np.arange(trees) << _LEAF_BITS)[None] | home >> low).ravel()
                row = np.repeat(np.arange(b.num_rows), trees)
                at, i, j = spread(code, b.column("rep").to_numpy()[row], 0)
                take = pa.array(row[at], pa.int32())
                leaves = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), pa.array(home.ravel()[at], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(code[at], pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.zeros(len(at), bool)), b.column("rep").take(take), b.column("v").take(take), leaves], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, j, i = spread(b.column("code").to_numpy(), b.column("rep").to_numpy(), 1)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("code").take(take), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.ones(len(at), bool)), b.column("rep").take(take), b.column("v").take(take), b.column("leaves").take(take)], names)

    def compare(met: pa.Table) -> pa.Table:
        met = met.combine_chunks()
        is_asked = met.column("asked").to_numpy()
        mine, theirs = met.filter(pa.array(~is_asked)), met.filter(pa.array(is_asked))
        if not mine.num_rows or not theirs.num_rows:
            return nothing
        x, q, rep = _matrix(mine.column("v")), _matrix(theirs.column("v")), mine.column("rep").to_numpy()
        base = int(met.column("code")[0].as_py() & ((1 << _LEAF_BITS) - 1)) << low
        leaf_of = mine.column("leaves").combine_chunks().flatten().to_numpy() - base
        lists = theirs.column("leaves").combine_chunks()
        taken = np.zeros((len(q), 1 << low), bool)
        taken[np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy() - base] = True
        out = []
        for part in range(0, len(q), 256):
            near = np.where(taken[part : part + 256][:, leaf_of], rough(q[part : part + 256], x), np.inf)
            out += [first(x, rep, q[part + i], near[i], keep) for i in range(len(near))]
        at = np.concatenate([r for r, _ in out])
        asking = np.repeat(theirs.column("rep").to_numpy(), [len(r) for r, _ in out])
        return pa.table({"rep": pa.array(asking, pa.int64()), "found": pa.array(rep[at], pa.int64()), "score": pa.array(np.concatenate([d for _, d in out]), pa.float64())})

    nothing = pa.table({"rep": pa.array([], pa.int64()), "found": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    names = ["code", "i", "j", "asked", "rep", "v", "leaves"]
    types = f"code int, i int, j int, asked boolean, rep long, v {kind}, leaves array<int>"
    dealt = points.select("rep", "v").mapInArrow(deal, types).unionByName(routed.df.mapInArrow(ask, types))
    met = dealt.groupBy("code", "i", "j").applyInArrow(compare, "rep long, found long, score double")
    # a point may be found in several trees; the first points by distance and least id hold the first rows
    by_query = Window.partitionBy("rep").orderBy("score", "found")
    best = write(met.groupBy("rep", "found").agg(F.min("score").alias("score")).withColumn("_n", F.row_number().over(by_query)).filter(F.col("_n") <= keep).drop("_n"), "found")
    routed.drop()
    rows_of = best.df.join(points.select(F.col("rep").alias("found"), "ids"), "found").select("rep", "score", F.explode("ids").alias("vec_id"))  # keep x keep rows of a query at most
    lists = rows_of.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, keep).alias("top"))
    own = asked.join(points.select("h1", "h2", "rep"), ["h1", "h2"]).join(lists, "rep")
    own = own.select(F.col("id").alias("query_id"), F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("id")), 1, k).alias("top"))
    return own.select("query_id", F.posexplode("top").alias("rank", "t")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
