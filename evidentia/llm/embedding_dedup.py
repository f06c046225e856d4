"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Every tree has a random direction for each level and, for each node, a threshold near the median of the node's sample;
vectors within a margin of it go to both sides. The thresholds are fitted on a bounded sample (MAX_SAMPLE); every vector
is dealt to its leaves in all trees, and all pairs of a leaf are compared there by their cosine. Leaves that hold more
than CHUNK vectors are cut into chunks, and pairs of chunks are compared, so that a task's memory is bounded and no pair
is left out. Pairs are never emitted: a leaf gives the number of its links that no earlier leaf has seen, and a spanning
forest of its links.

Miss probability: the margin is half a standard deviation of the difference of the projections of a pair of cosine 0.95.
Where a node's spread is large against it, so that a part f of the node spills, a pair is parted at one level with a chance
of about f / 6: 0.02 for vectors without structure. In a tight group half would spill and 0.09 of its pairs would be parted
at each level. So a node that would spill more than MAX_SPILL (0.2) at its median is cut beside the group or, if no
quantile spills less, stays whole, and all its pairs are compared. At that bound the chance is 0.033 a level: in one tree
0.21 at 7 levels, in all 8 (taken as independent) 4e-6, 2e-4 at 12 levels and 9e-4 at 16. It is an estimate: f is that of
a node's sample, and a group that is a small part of a node may spill more than the node does. Beyond 16 levels (33 million
vectors without structure) leaves grow with the table instead, which loses no pair and costs time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .learning import unit
from .scratch import ship, write

TREES, LEAF, CHUNK = 8, 512, 2048
#: Vectors that thresholds are fitted on, and how many of them a node needs to be split.
MAX_SAMPLE, LEAST = 262_144, 4
_LEAF_BITS = 16
#: The part of a node's sample that may go to both sides; and where thresholds are tried if it is more at the median.
MAX_SPILL, _QUANTILES = 0.2, np.arange(0.1, 0.91, 0.05)


@dataclass
class Forest:
    directions: np.ndarray  # trees x depth x dimension
    thresholds: list[list[np.ndarray]]  # by tree and level, one for each node
    margin: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf code) for every leaf of every row of unit vectors, ordered by row and code."""
        trees, depth, _ = self.directions.shape
        rows, codes = [], []
        for t in range(trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(depth):
                p = (x @ self.directions[t, level])[row] - self.thresholds[t][level][node]
                left, right = p <= self.margin, p >= -self.margin
                row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            rows.append(row)
            codes.append(node | t << _LEAF_BITS)
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return row[order], code[order]


def _gaps(p: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, margin: float) -> np.ndarray:
    """A threshold for each node, whose sorted projections are p[start:end]: p[at] if it spills at most MAX_SPILL of the node.

    Else that of the quantiles which spills least, and if that is too much as well, infinity: the node is one cluster and
    stays whole, as all go to the left.
    """
    found = np.zeros(len(start))
    for k in np.flatnonzero(end > start):
        mine = p[start[k] : end[k]]
        for tried in (p[at[k] : at[k] + 1], mine[(len(mine) * _QUANTILES).astype(np.int64)]):
            spill = np.searchsorted(mine, tried + margin, "right") - np.searchsorted(mine, tried - margin)
            best = int(spill.argmin())
            found[k] = tried[best] if spill[best] <= MAX_SPILL * len(mine) else np.inf
            if found[k] < np.inf:
                break
    return found


def plant(sample: np.ndarray, total: int, cosine: float, trees: int = TREES, leaf: int = LEAF, seed: int = 3) -> Forest:
    """A forest for ``total`` unit vectors of which ``sample`` has some."""
    random = np.random.default_rng(seed)
    dim = sample.shape[1]
    depth = max(0, min(int(np.ceil(np.log2(max(1.0, total / leaf)))), int(np.log2(max(1, len(sample) // LEAST))), _LEAF_BITS))
    directions = random.normal(size=(trees, depth, dim))
    directions /= np.sqrt((directions**2).sum(2, keepdims=True)) + 1e-300
    margin = 0.5 * np.sqrt(max(0.0, 2 * (1 - cosine)) / dim)
    thresholds = []
    for t in range(trees):
        node, levels = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            p = sample @ directions[t, level]
            order = np.lexsort((p, node))
            start = np.searchsorted(node[order], np.arange(1 << level))
            end = np.append(start[1:], len(sample))
            at = np.minimum(start + ((end - start) * random.uniform(0.45, 0.55, 1 << level)).astype(np.int64), len(sample) - 1)
            levels.append(_gaps(p[order], start, end, at, margin))
            node = 2 * node + (p > levels[-1][node])
        thresholds.append(levels)
    return Forest(directions, thresholds, margin)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _local_roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest id that it is connected with by the edges (i, j), by lowering labels until none changes."""
    label = ids.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            return label
        label = new


def usable(vector: Column, dim: int | None = None) -> Column:
    """True for a vector that isn't null, has no null or non-finite component, is not zero, and has dim components if given."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < big), F.lit(False))) & F.exists(vector, lambda x: x != 0)
    if dim is not None:
        fine = (F.size(vector) == dim) & fine
    return F.coalesce(fine, F.lit(False))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, trees: int = TREES, leaf: int = LEAF, chunk: int = CHUNK, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; the id column keeps its name and becomes a long.

    Rows whose cosine in double precision is ``cosine`` or more and which the forest brings together are linked. n_links
    counts the other rows linked with a row, copies included; component_id is the smallest id reachable by links, itself
    included; kept says that this is the row's own id. Vectors that are null, zero, hold null or non-finite components or
    are not of the table's most frequent length (of equals the greatest) link with nothing. Rows with a null id link with
    nothing. Repeated rows are copies of each other. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    dims = rows.filter(usable(F.col("v"))).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    plain = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    if not dims:
        return plain
    marked = rows.withColumn("ok", usable(F.col("v"), dims["d"]) & F.col("id").isNotNull())
    hashes = [F.when(F.col("ok"), F.xxhash64(F.lit(k), "v")).alias(f"h{k}") for k in (1, 2)]
    keyed = marked.select("id", "ok", *hashes, "v")
    classes = write(keyed.filter("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    total = classes.df.count()
    picked = classes.df.filter(unit(F.col("rep"), seed) < min(1.0, MAX_SAMPLE / max(1, total))).select("rep", "v").toArrow()  # MAX_SAMPLE rows or so
    order = np.argsort(picked.column("rep").to_numpy(), kind="stable")
    sample = _units(_matrix(picked.column("v"))[order]) if len(order) else np.zeros((0, dims["d"]))
    forest = plant(sample, total, cosine, trees, leaf, seed)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, n = np.unique(forest.leaves(_units(_matrix(batch.column("v"))))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(n, pa.int64())], ["code", "n"])

    # leaves of more than a chunk: at most one row for each leaf of the forest
    large = {r["code"]: -(-r["n"] // chunk) for r in classes.df.select("v").mapInArrow(sizes, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") > chunk).collect()}

    chunked = np.array(sorted(large), np.int64)
    chunks = np.array([large[c] for c in chunked.tolist()], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                b = batch.slice(part, 2000)
                row, code = forest.leaves(_units(_matrix(b.column("v"))))
                cut = np.searchsorted(row, np.arange(b.num_rows + 1))
                rep = b.column("rep").to_numpy()
                # a vector of a leaf of k chunks meets each of them
                k = np.ones(len(code), np.int64)
                if len(chunked):
                    place = np.minimum(np.searchsorted(chunked, code), len(chunked) - 1)
                    k = np.where(chunked[place] == code, chunks[place], 1)
                spread = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                own = ((spread[row] * k.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                at, group, mine = np.repeat(row, k), np.repeat(code, k), np.repeat(own, k)
                other = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
                one, two = np.minimum(mine, other), np.maximum(mine, other)
                codes = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(code, pa.int32()))
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(mine, pa.int32()), b.column("rep").take(take), b.column("copies").take(take), b.column("v").take(take), codes.take(take)], ["code", "i", "j", "own", "rep", "copies", "v", "codes"])

    def compare(table: pa.Table) -> pa.Table:
        code, i, j = (table.column(c)[0].as_py() for c in ("code", "i", "j"))
        x, rep, copies, own = _matrix(table.column("v")), *(table.column(c).to_numpy() for c in ("rep", "copies", "own"))
        order = np.argsort(rep, kind="stable")
        x, rep, copies, own = x[order], rep[order], copies[order], own[order]
        x = x / np.abs(x).max(1, keepdims=True)
        norm = np.sqrt((x * x).sum(1))
        near = x @ x.T
        near /= norm[:, None] * norm[None, :]
        near = near >= cosine
        np.fill_diagonal(near, False)
        if i != j:
            near &= own[:, None] != own[None, :]
        some = np.flatnonzero(near.any(1))
        near = near[np.ix_(some, some)]
        # pairs that share an earlier leaf are counted there
        codes = table.column("codes").combine_chunks().take(pa.array(order[some]))
        earlier = codes.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(some)), np.diff(codes.offsets.to_numpy()))
        of, earlier = of[earlier < code], earlier[earlier < code]
        known, place = np.unique(earlier, return_inverse=True)
        member = np.zeros((len(some), len(known)), np.float32)
        member[of, place] = 1
        new = near & (member @ member.T == 0)
        links = new @ copies[some]
        a, b = np.nonzero(np.triu(near))
        root = _local_roots(len(some), a, b, rep[some])
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "links": pa.array(links.astype(np.int64)), "root": pa.array(root, pa.int64())})

    dealt = classes.df.select("rep", "copies", "v").mapInArrow(deal, f"code int, i int, j int, own int, rep long, copies long, v {classes.df.schema['v'].dataType.simpleString()}, codes array<int>")
    found = write(dealt.groupBy("code", "i", "j").applyInArrow(compare, "rep long, links long, root long"), "leaves")
    joined = components(found.df.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.df.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = write(classes.df.select("h1", "h2", "rep", "copies").join(links, "rep", "left").join(joined.df.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes")
    found.drop()
    out = keyed.select("id", "h1", "h2").join(by_class.df, ["h1", "h2"], "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
