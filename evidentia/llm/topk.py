"""Exact top-k inner products over vectors processed by descending length.

Vectors are rotated by the singular vectors of a bounded sample, so that most of an inner product tends to lie in the
first coordinates, sorted by descending length and cut into blocks. Queries are cut into larger blocks. A first pass
compares all queries with the block of the longest vectors, which gives each query a score that its k-th best reaches at
least. Then a block of queries meets the blocks of a lane one after another, longest vectors first, and keeps its k best.

Pruning, by Cauchy-Schwarz and never by chance: a block is not even sent to a block of queries if the product of lengths
can't reach the first pass's score of any of them; blocks are passed over in the same way with the scores reached since.
Within a block a pair is dropped as soon as its partial sum over the first coordinates and the product of the lengths of
the rests can't reach the query's k-th best score; this is tried at several cuts, where the sample's rests have shares of
RESTS of the squared length. What survives is scored exactly, in integers.

A tile of queries and a lane is one task: QUERY_BLOCK queries stay in its memory and blocks stream past them. So a
vector is sent once for each QUERY_BLOCK queries that it may matter to, some hundred bytes for QUERY_BLOCK inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding_dedup import usable
from .learning import unit
from .scratch import BROADCAST_ROWS, ship, write

QUERY_BLOCK, BLOCK = 32_768, 4096
#: Tasks that share a block of queries: at least, if there are as many blocks; and the blocks that a task takes at most.
LANES, LANE_BLOCKS = 8, 256
#: Shares of the squared length that lie beyond a cut.
RESTS = (0.5, 0.25, 0.1, 0.03)
#: Vectors that the rotation is fitted on; results don't depend on it.
MAX_SAMPLE = 16_384
_SLICE = 512
#: Pairs are listed one by one when no more than this part of a slice is left.
_FEW = 0.05


def _pack(x: np.ndarray) -> tuple[bytes, str]:
    """Integers in the narrowest type that holds them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return x.astype(kind).tobytes(), kind


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(length, ids, x, kind): blocks of at most ``size`` vectors (id, x) of each partition, in the partition's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, n = [], [], 0

        def flush():
            x = np.concatenate(xs)
            data, kind = _pack(x)
            longest = float(np.sqrt((x.astype(float) ** 2).sum(1)).max())
            return pa.RecordBatch.from_arrays([pa.array([longest]), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([data], pa.binary()), pa.array([kind])], ["length", "ids", "x", "kind"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                b = batch.slice(at, size - n)
                ids.append(b.column("id").to_numpy())
                xs.append(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                at, n = at + b.num_rows, n + b.num_rows
                if n == size:
                    yield flush()
                    ids, xs, n = [], [], 0
        if n:
            yield flush()

    return rows.select("id", "x").mapInArrow(run, "length double, ids binary, x binary, kind string").withColumn("number", F.spark_partition_id())


def cuts(spectrum: np.ndarray) -> list[int]:
    """The numbers of first coordinates beyond which RESTS of the sample's squared length are left, least first."""
    total = spectrum.sum()
    left = 1 - np.cumsum(spectrum) / total if total else np.zeros(len(spectrum))
    found = {int(np.argmax(left <= r + 1e-12)) + 1 for r in RESTS if (left <= r + 1e-12).any()}
    return sorted(h for h in found if h < len(spectrum))


class Best:
    """The k best (score, id) of each query of a block, over the blocks of vectors seen so far.

    ``least`` are scores that the k-th best are known to reach. ``pairs`` and ``scored`` count the pairs met, and those whose
    whole product was needed.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, at: list[int], k: int, least: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, x, k
        self.rotation, self.at = rotation, at
        self.turned = x.astype(float) @ rotation
        self.rests = self._rests(self.turned)
        self.length = np.sqrt((x.astype(float) ** 2).sum(1))
        self.top = [np.empty(0, np.int64)] * 3  # query position, score, id
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.pairs = self.scored = 0

    def _rests(self, turned: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt(np.maximum(0, (turned[:, h:] ** 2).sum(1))) for h in self.at]

    def meet(self, ids: np.ndarray, x: np.ndarray, longest: float) -> None:
        reach = self.length * longest * (1 + 1e-9) + 1e-6
        if (reach < self.least).all():
            return
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order].astype(np.int64)
        wide = x.astype(float)
        turned = wide @ self.rotation
        rests = self._rests(turned)
        # doubles hold products exactly while they stay below 2**53
        exact = float(self.length.max(initial=0)) * longest < 2**52
        found, held = [], 0
        for first in range(0, len(self.ids), _SLICE):
            q = np.flatnonzero(reach[first : first + _SLICE] >= self.least[first : first + _SLICE]) + first
            if not len(q):
                continue
            own = np.searchsorted(ids, self.ids[q])
            own[own == len(ids)] = 0
            mine = ids[own] == self.ids[q]
            least = self.least[q, None]
            slack = 1e-9 * self.length[q, None] * longest + 1e-6
            self.pairs += len(q) * len(ids) - int(mine.sum())
            row = col = None  # the pairs left, once they are few
            may, part, done = None, None, 0
            if np.isfinite(least).any():
                for h, rest_q, rest in zip(self.at, self.rests, rests, strict=True):
                    if row is None:
                        more = self.turned[q, done:h] @ turned[:, done:h].T
                        part = more if part is None else np.add(part, more, out=part)
                        may = part + rest_q[q, None] * rest[None, :] >= least - slack
                        if np.count_nonzero(may) <= _FEW * may.size:
                            row, col = np.nonzero(may)
                            part = part[row, col]
                    else:
                        part = part + np.einsum("ij,ij->i", self.turned[q[row], done:h], turned[col, done:h])
                        ok = part + rest_q[q[row]] * rest[col] >= least[row, 0] - slack[row, 0]
                        row, col, part = row[ok], col[ok], part[ok]
                    done = h
            if row is None and exact:
                may = np.ones((len(q), len(ids)), bool) if may is None else may
                may[np.flatnonzero(mine), own[mine]] = False
                self.scored += np.count_nonzero(may)
                score = self.x[q].astype(float) @ wide.T
                score[~may] = -np.inf
                if len(ids) > self.k:  # of equal scores the smaller id, which comes first
                    rank = score * float(2 ** (len(ids).bit_length())) - np.arange(len(ids))
                    if float(self.length.max()) * longest * 2 ** len(ids).bit_length() < 2**52:
                        col = np.argpartition(rank, -self.k, axis=1)[:, -self.k :]
                    else:
                        col = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
                else:
                    col = np.broadcast_to(np.arange(len(ids)), score.shape)
                row = np.repeat(np.arange(len(score)), col.shape[1])
                col = col.ravel()
                ok = may[row, col] & (score[row, col] >= self.least[q][row])
                row, col = row[ok], col[ok]
            else:
                if row is None:
                    row, col = np.nonzero(may) if may is not None else (a.ravel() for a in np.indices((len(q), len(ids))))
                other = ids[col] != self.ids[q[row]]
                row, col = row[other], col[other]
                self.scored += len(row)
            for part_at in range(0, len(row), 1 << 18):
                r, c = q[row[part_at : part_at + (1 << 18)]], col[part_at : part_at + (1 << 18)]
                s = (self.x[r].astype(np.int64) * x[c]).sum(1)
                ok = s >= self.least[r]
                found.append((r[ok], s[ok], ids[c[ok]]))
                held += int(ok.sum())
                if held > 1 << 20:
                    self._merge(found)
                    found, held = [], 0
        self._merge(found)

    def _merge(self, found: list[tuple]) -> None:
        q, s, i = (np.concatenate([self.top[j], *(f[j] for f in found)]) for j in range(3))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        start = np.searchsorted(q, np.arange(len(self.ids)))
        keep = np.arange(len(q)) - start[q] < self.k
        self.top = [q[keep], s[keep], i[keep]]
        n = np.bincount(self.top[0], minlength=len(self.ids))
        last = np.cumsum(n) - 1
        full = n == self.k
        self.least[full] = np.maximum(self.least[full], self.top[1][last[full]])


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, k: int = 20, query_block: int = QUERY_BLOCK, block: int = BLOCK, lanes: int = LANES, seed: int = 13) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floor(scale * x), ties to the smaller id.

    is_query is a condition on the id column. Candidates of a query are all rows with another id. Vectors that are null,
    empty, hold null or non-finite components or are not of the table's most frequent length (of equals the greatest), and
    rows with a null id, take no part; zero vectors do. Rows that repeat an id count once, with their least vector. Scores
    must fit in a long. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col)
    any_vector = F.size(v) > 0
    fine = F.coalesce(any_vector & (usable(v) | F.forall(v, lambda x: F.coalesce(x == 0, F.lit(False)))), F.lit(False))
    source = vectors.filter(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("x"))
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    dims = source.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not dims:
        return empty
    one = source.filter(F.size("x") == dims["d"]).groupBy("id").agg(F.min("x").alias("x"), F.max("q").alias("q"))
    length = F.aggregate("x", F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))
    table = write(one.withColumn("len", length), "integers")
    total = table.df.count()
    sample = table.df.filter(unit(F.col("id"), seed) < min(1.0, MAX_SAMPLE / max(1, total))).select("id", "x").toArrow()  # ids are distinct: MAX_SAMPLE rows or so
    picked = sample.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims["d"]).astype(float)
    picked = picked[np.argsort(sample.column("id").to_numpy(), kind="stable")]
    rotation, spectrum, _ = np.linalg.svd(picked.T @ picked) if len(picked) else (np.eye(dims["d"]), np.ones(dims["d"]), None)
    at, d = cuts(spectrum), dims["d"]
    n_queries = table.df.filter("q").count()
    if not n_queries:
        table.drop()
        return empty
    parts = max(1, -(-total // block))
    blocks = write(_blocks(table.df.repartitionByRange(parts, F.desc("len"), "id").sortWithinPartitions(F.desc("len"), "id"), block), "blocks")
    groups = max(1, -(-n_queries // query_block))
    asked = table.df.filter("q").repartitionByRange(groups, "id").sortWithinPartitions("id")
    asked = write(_blocks(asked, query_block).withColumn("group", F.monotonically_increasing_id()), "queries")
    table.drop()
    longest = blocks.df.orderBy(F.desc("length"), "number", "ids").select("ids", "x", "kind").first()  # one block
    seeds = np.frombuffer(longest["ids"], "<i8"), np.frombuffer(longest["x"], longest["kind"]).reshape(-1, d)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 1) for i in range(batch.num_rows)):
                ids, x, kind = (b.column(c)[0] for c in ("ids", "x", "kind"))
                best = Best(np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(x.as_buffer(), kind.as_py()).reshape(-1, d), rotation, at, k)
                best.meet(*seeds, float(np.sqrt((seeds[1].astype(float) ** 2).sum(1)).max()))
                # vectors shorter than this matter to none of the queries
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(best.least <= 0, -np.inf, best.least * (1 - 1e-9) / best.length).min()
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("group", "ids", "x", "kind")), pa.array([best.least.astype("<f8").tobytes()], pa.binary()), pa.array([float(need)])], ["group", "ids", "x", "kind", "least", "need"])

    begun = write(asked.df.select("group", "ids", "x", "kind").mapInArrow(begin, "group long, ids binary, x binary, kind string, least binary, need double"), "begun")
    asked.drop()
    lanes = min(parts, max(lanes, -(-parts // LANE_BLOCKS)))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    firsts = begun.df.select("group", numbers.alias("lane"), F.lit(float("inf")).alias("length"), "ids", "x", "kind", "least")
    reached = begun.df.select("group", "need")  # one row for each block of queries
    rest = blocks.df.join(F.broadcast(reached) if groups <= BROADCAST_ROWS else reached, F.col("length") >= F.col("need"))
    rest = rest.select("group", (F.col("number") % lanes).alias("lane"), "length", "ids", "x", "kind", F.lit(None).cast("binary").alias("least"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None

        def result():
            q, s, i = best.top
            return pa.RecordBatch.from_arrays([pa.array(best.ids[q], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["query_id", "id", "score"])

        for batch in batches:
            for length, ids, x, kind, least in zip(*(batch.column(c) for c in ("length", "ids", "x", "kind", "least")), strict=True):
                i, m = np.frombuffer(ids.as_buffer(), "<i8"), np.frombuffer(x.as_buffer(), kind.as_py()).reshape(-1, d)
                if least.is_valid:
                    if best:
                        yield result()
                    best = Best(i, m, rotation, at, k, np.frombuffer(least.as_buffer(), "<f8"))
                else:
                    best.meet(i, m, length.as_py())
        if best:
            yield result()

    dealt = firsts.unionAll(rest).repartition("group", "lane").sortWithinPartitions("group", "lane", F.desc("length"))
    found = dealt.select("length", "ids", "x", "kind", "least").mapInArrow(search, "query_id long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
