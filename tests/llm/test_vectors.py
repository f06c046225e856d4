"""Whitening, nearest neighbours and clusters of vectors against brute force, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from evidentia.llm import ann, lloyd, whitening

VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("component", LongType()), StructField("rep", StringType()), StructField("cluster", LongType())])


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], 1, "x", 2) for i, v in rows], VECTORS)


def bad(dim):
    return [(9001, None), (9003, [float("nan")] + [1.0] * (dim - 1)), (9004, [float("inf")] + [1.0] * (dim - 1)), (9005, [None] + [1.0] * (dim - 1)), (9006, [1.0] * 3), (9007, []), (9008, [1e200] + [1.0] * (dim - 1))]


# ------------------------------------------------------------------ whitening


def exact(rows, scale=64, shift=1_000_000):
    return [(i, [math.floor(scale * float(y)) + shift for y in v]) for i, v in rows]


def test_whitening(spark):
    random = np.random.default_rng(1)
    x = random.normal(size=(300, 8)) @ random.normal(size=(8, 8)) + 3
    rows = list(enumerate(x)) + [(7, x[7]), (None, x[8])]
    got = whitening.whiten(table(spark, rows + bad(8)), components=5).collect()
    whole = exact(rows)
    n, sums = len(whole), [sum(v[d] for _, v in whole) for d in range(8)]
    z = np.array([[(n * v[d] - sums[d]) / n for d in range(8)] for _, v in whole])
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:5], vectors[:, ::-1][:, :5]
    expected = z @ vectors / np.sqrt(values)
    assert len(got) == n * 5 and {r["n"] for r in got} == {n} and {r["component"] for r in got} == {1, 2, 3, 4, 5}
    deviation = {i: sum((n * v[d] - sums[d]) ** 2 for d in range(8)) for i, v in whole}
    assert all(r["deviation"] == deviation[r["vec_id"]] for r in got)
    mine = {}
    for r in got:
        mine.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-9
    sign = np.sign([mine[0][c + 1] * expected[0][c] for c in range(5)])
    for (i, _), w in zip(whole, expected, strict=True):
        assert np.allclose([mine[i][c + 1] for c in range(5)], w * sign, atol=1e-8)


def test_whitening_of_few_equal_and_large_vectors(spark):
    assert whitening.whiten(table(spark, [])).count() == 0 and whitening.whiten(table(spark, bad(8)[:4])).count() == 0
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] is None for r in one)
    flat = whitening.whiten(table(spark, [(k, [float(k), 2.0 * k, 5.0]) for k in range(4)])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True} and {round(r["identity_error"], 9) for r in flat} == {0.0}
    # deviations that a long can't hold are null, smaller ones stay exact
    rows = [(k, [1e9 * (k == 0), 1.0 * (k % 2)]) for k in range(40)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(table(spark, rows)).collect()}
    whole = exact(rows)
    sums = [sum(v[d] for _, v in whole) for d in range(2)]
    for i, v in whole:
        true = sum((40 * v[d] - sums[d]) ** 2 for d in range(2))
        assert got[i] == (true if true < 2**63 else None)
    assert got[0] is None
    m = whitening.Moments(4, [0, 0], [2**63, 1])
    z, d = m.centred(np.array([[2**61, 0], [1, 2]]))
    assert z.tolist() == [[2.0**61, 0.0], [1.0, 2.0]] and d == [None, 80]


# ------------------------------------------------------------------ neighbours


def nearest_loop(rows, queries, k):
    out = []
    for q in queries:
        v = dict(rows)[q]
        ranked = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(u, v, strict=True))), i) for i, u in dict(rows).items() if i != q)
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(ranked[:k])]
    return out


@pytest.mark.parametrize("shape", ["plain", "copies", "scaled"])
def test_neighbours_without_a_miss_equal_brute_force(spark, shape):
    random = np.random.default_rng(2)
    x = random.normal(size=(500, 8))
    if shape == "copies":
        x[100:300] = x[100]  # more copies than are returned, queries among them
        x[300:310] = x[0]
    if shape == "scaled":
        x *= np.exp(random.normal(size=(500, 1)) * 3)
    rows = [(int(i), [float(y) for y in v]) for i, v in enumerate(x)]
    more = [(20, rows[20][1]), (None, rows[3][1]), (9100, [0.0] * 8)]
    df = table(spark, rows + more + [b for b in bad(8) if b[0] != 9008])
    # so small blocks that they are cut, and a target that no probe may miss
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=10, leaf=16, block=32, target=1.0, probes=500).collect()
    expected = nearest_loop(rows, range(0, 500, 20), 10)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got}
    assert len(found) == len(got) == len(expected)
    for q, rank, i, d in expected:
        assert found[q, rank][0] == i and abs(found[q, rank][1] - d) <= 1e-12 * max(1.0, d)


def test_neighbours_of_tiny_tables(spark):
    asked = F.col("vec_id") % 2 == 0
    assert ann.nearest(table(spark, []), asked).count() == 0 and ann.nearest(table(spark, [(1, [1.0, 2.0])]), asked).count() == 0
    assert ann.nearest(table(spark, [(2, [1.0, 2.0])]), asked).count() == 0
    rows = [(2, [1.0, 2.0]), (3, [1.0, 2.0]), (5, [4.0, 6.0]), (4, [1e200, 0.0]), (6, [1e-200, 0.0])]
    got = sorted(map(tuple, ann.nearest(table(spark, rows), asked, k=2).collect()))
    assert got[:2] == [(2, 1, 3, 0.0), (2, 2, 6, 2.23606797749979)] and got[2][:3] == (4, 1, 2) and got[2][3] == 1e200 and [r[2] for r in got[4:]] == [2, 3]


def test_recall_of_vectors_without_structure(spark):
    """The number of candidates is fitted to the table, so recall holds where trees part neighbours most."""
    random = np.random.default_rng(3)
    x = random.normal(size=(4000, 64))
    got = ann.nearest(table(spark, list(enumerate(x))), F.col("vec_id") % 20 == 0, k=10).collect()
    true = {q: set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11].tolist()) for q in range(0, 4000, 20)}
    assert len(got) == 2000 and sum(r["vec_id"] in true[r["query_id"]] for r in got) / 2000 >= 0.92


def test_one_queue_over_all_trees():
    random = np.random.default_rng(4)
    x = random.normal(size=(800, 6))
    forest = ann.plant(x, len(x), trees=3, leaf=25)
    forest.radius = 1.0
    at = forest.leaves(x)
    forest.sizes = np.stack([np.bincount(at[:, t], minlength=1 << forest.depth) for t in range(3)])
    assert (forest.sizes.sum(1) == 800).all()
    order = list(forest.visit(x[0]))
    assert len(order) == len(set(order)) == 3 << forest.depth

    def cost(t, leaf):
        total, node = 0.0, 0
        for level in range(forest.depth):
            bit = leaf >> (forest.depth - 1 - level) & 1
            z = (forest.directions[t, level] @ x[0] - forest.thresholds[t][level][node]) * math.sqrt(6)
            total -= math.log(max(0.5 * math.erfc((-z if bit else z) / math.sqrt(2)), 1e-300))
            node = 2 * node + bit
        return total

    costs = [cost(t, leaf) for t, leaf in order]
    assert all(a <= b + 1e-9 for a, b in zip(costs, costs[1:], strict=False))
    forest.candidates = 200
    taken = forest.search(x[0])
    assert taken == order[: len(taken)] and sum(forest.sizes[t, n] for t, n in taken) >= 200 > sum(forest.sizes[t, n] for t, n in taken[:-1])
    assert forest.needed(x[0], at[:1]) == [int(forest.sizes[order[0][0], order[0][1]])] or at[0, order[0][0]] != order[0][1]


# ------------------------------------------------------------------ clusters


def lloyd_loop(rows, dim, clusters, rounds):
    whole = [(i, [math.floor(256 * float(y)) for y in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None)
    centroids = [v for _, v in first[:clusters]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(assign(v)[1], []).append(v)
        for k, g in groups.items():
            centroids[k] = [sum(v[d] for v in g) // len(g) for d in range(dim)]
    last = [(i, *assign(v)) for i, v in whole]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = {}
    for _, d, k in last:
        inertia[k] = inertia.get(k, 0) + d
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), sha[k]) for i, d, k in last), key=repr)


def test_clusters_equal_a_loop(spark):
    random = np.random.default_rng(6)
    x = np.concatenate([random.normal(size=(120, 4)), np.tile(random.normal(size=4), (90, 1)), random.normal(size=(40, 4)) * 0.01])
    rows = [(int(i) * 7, v) for i, v in enumerate(x)] + [(14, x[2]), (14, x[3]), (None, x[5]), (2**60 + 1, x[6])]
    df = table(spark, rows + bad(4)).repartition(5)
    for clusters, rounds in ((12, 5), (400, 1), (1, 2)):
        got = lloyd.cluster(df, dim=4, clusters=clusters, rounds=rounds).collect()
        assert sorted(map(tuple, got), key=repr) == lloyd_loop(rows, 4, clusters, rounds)


def test_clusters_of_tiny_tables(spark):
    assert lloyd.cluster(table(spark, [])).count() == 0 and lloyd.cluster(table(spark, bad(64))).count() == 0
    alone = lloyd.cluster(table(spark, [(None, [1.0] * 64)])).collect()
    assert len(alone) == 1 and alone[0]["cluster"] is None and alone[0]["inertia"] is None
    # ties go to the smaller number, and a cluster that loses all its vectors keeps its centroid
    same = lloyd.cluster(table(spark, [(k, [2.0] * 64) for k in range(50)])).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in same} == {(0, 0, 0)} and len({r["centroid_sha256"] for r in same}) == 1
    far = lloyd.cluster(table(spark, [(1, [5e5] * 64), (2, [-5e5] * 64), (3, [5e5] * 63 + [4e5])]), clusters=1, rounds=0).collect()
    assert all(r["distance"] is not None for r in far)
