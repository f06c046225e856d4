"""Near-duplicates, components and top-k search against brute force, and their edge cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from evidentia.llm import embedding_dedup, minhash, topk
from evidentia.llm.components import components

DOCS = "doc_id long, text string, source string, rep long, n long"
VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("rep", LongType()), StructField("x", StringType())])


def roots(ids, links):
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)] + [(7, 7), (None, 3), (5, None)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).df.collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == roots({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).df.count() == 0


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(k, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    random.seed(words)
    word = lambda: "".join(random.choice("abcdeÉß") for _ in range(4))
    rows, at = [], 0
    for _ in range(12):
        base = [word() for _ in range(random.choice([3, 40, 200]))]
        for _ in range(random.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(random.choice([0, 1, 3, 6])):
                copy[random.randrange(len(copy))] = word()
            rows.append((at * 3 % 1009, random.choice([" ", "\n", "\t "]).join(copy)))
            at += 1
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "One"), (2004, "one"), (2005, "ONE two"), (None, "one"), (2006, "wor d " * 30), (2007, "x" * 70), (2008, "Tail"), (2008, "Tail")]
    rows.append((2009, " ".join(f"w{i}" for i in range(30_000))))
    rows.append((2010, "\n".join(f"W{i}" for i in range(30_000)) + " end"))
    df = spark.createDataFrame([(i, t, "s", 1, 1) for i, t in rows], DOCS)
    got = minhash.near_duplicates(df, words=words).collect()
    assert len(got) == len(rows)
    sets = {i: sets_of(t, words) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = roots(ids, links)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"] and r["n_shingles"] == 1
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), expected[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"]), r
    assert minhash.near_duplicates(df.limit(0), words=words).count() == 0


def test_hot_group_of_near_copies_with_outliers(spark):
    """A bucket that the first leader doesn't unite is finished by further rounds."""
    random.seed(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for j in random.sample(range(60), random.choice([1, 2, 4, 5])):
            copy[j] = f"z{i}-{j}"
        rows.append((i, " ".join(copy)))
    sets = {i: sets_of(t, 2) for i, t in rows}
    links = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    assert got == roots(sets, links)


def test_posterior_bounds():
    limits = minhash.least_matches(80)
    assert [n for n, _ in limits] == list(range(16, 129, 16))
    for n, m in limits:
        tail = lambda k, n=n: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= minhash.MISS and (m == 0 or tail(m - 1) < minhash.MISS)


def bad_vectors():
    return [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] + [1.0] * 7), (9004, [float("inf")] + [1.0] * 7), (9005, [None] + [1.0] * 7), (9006, [1.0] * 3), (9007, []), (None, [1.0] * 8)]


def vector_rows(seed, clusters=12, dim=8):
    random = np.random.default_rng(seed)
    rows = []
    for _ in range(clusters):
        base = random.normal(size=dim)
        for _ in range(int(random.choice([1, 4, 60]))):
            rows.append((base + random.normal(size=dim) * 0.12 * np.sqrt((base**2).mean())) * random.choice([1.0, 1e-3, 1e200]))
    rows += [rows[0]] * 5
    return [(int(i) * 7 % 5003, [float(y) for y in x]) for i, x in enumerate(rows)]


@pytest.mark.parametrize("chunk", [2048, 16])
def test_embedding_near_duplicates(spark, chunk):
    rows = vector_rows(3)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad_vectors()], VECTORS)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, leaf=32, chunk=chunk).collect()}
    assert len(got) == len(rows) + len(bad_vectors())
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    expected = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    for k, i in enumerate(ids):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[k].sum(), expected[i], expected[i] == i)
    for i, _ in bad_vectors():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, i is not None)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", ["plain", "skewed", "tied"])
def test_top_k(spark, shape):
    random = np.random.default_rng(5)
    x = random.normal(size=(400, 8))
    if shape == "skewed":
        x *= np.exp(random.normal(size=(400, 1)) * 2)
    if shape == "tied":
        x[50:350] = x[50]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(500, [0.0] * 8), (501, [0.5] * 8), (501, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + [b for b in bad_vectors() if b[0] != 9002]], VECTORS)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, block=64, query_block=7, lanes=3).collect()]
    whole = {i: np.floor(64 * np.array(v)).astype(np.int64) for i, v in rows}
    expected = []
    for q in whole:
        if q % 20 == 0:
            best = sorted(((-int(whole[q] @ whole[c]), c) for c in whole if c != q))[:20]
            expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(got) == sorted(expected)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_leave_few_pairs_and_lose_none():
    random = np.random.default_rng(2)
    x = np.floor(64 * random.normal(size=(3000, 32)) * np.linspace(1.5, 0.3, 32)).astype(np.int64)
    ids = np.arange(len(x))
    length = np.sqrt((x**2.0).sum(1))
    order = np.argsort(-length, kind="stable")
    rotation, spectrum, _ = np.linalg.svd(x.T.astype(float) @ x)
    at = topk.cuts(spectrum)
    assert len(at) >= 2 and at == sorted(at) and at[-1] < 32
    best = topk.Best(ids[:100], x[:100], rotation, at, 20)
    for i in range(0, len(x), 500):
        part = order[i : i + 500]
        best.meet(ids[part], x[part], length[part].max())
    assert best.pairs <= 100 * 2999 and best.scored < 0.3 * best.pairs
    q, s, i = best.top
    for k in range(100):
        expected = sorted((-int(x[k] @ x[c]), c) for c in range(len(x)) if c != k)[:20]
        assert [(-int(a), int(b)) for a, b in zip(s[q == k], i[q == k], strict=True)] == expected
    assert topk.cuts(np.zeros(4)) == [1] and topk.cuts(np.array([5.0])) == []
