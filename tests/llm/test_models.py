"""The classifiers' numbers against slow versions in plain Python."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import language_id, learning, quality, toxicity


def grams(text, orders):
    """n-grams of lower-cased letters, with each run of other characters, and either end, as one space."""
    kept = []
    for c in text.lower():
        if c.isalpha():
            kept.append(c)
        elif not kept or kept[-1] != " ":
            kept.append(" ")
    s = "".join(kept)
    s = (s if s.startswith(" ") else " " + s) + ("" if s.endswith(" ") else " ")
    return collections.Counter(s[i : i + n] for n in orders for i in range(len(s) - n + 1))


def test_term_counts_are_those_of_slow_ngrams():
    for text in ("The house, and THE water!", "schöne Häuser 12 am See", "a", "日本 語"):
        at, n = language_id.term_counts(text)
        assert sum(n) == sum(grams(text, language_id.ORDERS).values())
        if len(at) == len(grams(text, language_id.ORDERS)):  # no two in one bucket
            assert sorted(n.tolist()) == sorted(grams(text, language_id.ORDERS).values())
    idf = np.linspace(1, 2, 1 << language_id.BITS)
    at, n = language_id.term_counts("the house and the water")
    slow = [(1 + math.log(k)) * idf[i] for i, k in zip(at.tolist(), n.tolist(), strict=True)]
    size = math.sqrt(sum(x * x for x in slow))
    assert np.allclose(language_id.tf_idf(at, n, idf), [x / size for x in slow])


def test_ftrl_is_that_of_slow_loops():
    random.seed(4)
    rows = [(np.array(sorted(random.sample(range(12), 4))), np.array([random.random() for _ in range(4)])) for _ in range(30)]
    y = np.array([random.randrange(3) for _ in rows])
    weights, bias = language_id.ftrl(rows, y, 3, epochs=2, seed=1)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(key):
        return 0.0 if abs(z[key]) <= l1 else (math.copysign(l1, z[key]) - z[key]) / ((beta + math.sqrt(n[key])) / alpha + l2)

    order = np.random.default_rng(1)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            x = [*zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True), ("bias", 1.0)]
            w = {(f, c): weight((f, c)) for f, _ in x for c in range(3)}
            scores = [sum(w[f, c] * v for f, v in x) for c in range(3)]
            total = sum(math.exp(s - max(scores)) for s in scores)
            for c in range(3):
                error = math.exp(scores[c] - max(scores)) / total - (y[i] == c)
                for f, v in x:
                    g = v * error
                    sigma = (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / alpha
                    z[f, c] += g - sigma * w[f, c]
                    n[f, c] += g * g
    for c in range(3):
        assert np.allclose(weights[:12, c], [weight((f, c)) for f in range(12)]) and np.isclose(bias[c], weight(("bias", c)))
    assert not weights[12:].any()


def test_every_language_is_learned(spark):
    rows = [(i, f"{'xyzabcdefghij'[k % 13]}{'klmnopqrstuvw'[k // 13 % 13]}o " * 6, f"l{k}") for i, k in enumerate(k for k in range(230) for _ in range(3))]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(model.languages) == 230


def test_log_count_ratios_are_those_of_slow_counts(spark, monkeypatch):
    random.seed(5)
    calm, rude = "calm garden weather spring".split(), "wretched scoundrel villain".split()
    rows = [(i, " ".join(random.choice(calm + (rude if i % 3 == 0 else [])) for _ in range(12))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    seen, fit = {}, toxicity.fit

    def spy(features, y, ratio, prior):
        seen["ratio"], seen["prior"] = ratio, prior
        return fit(features, y, ratio, prior)

    monkeypatch.setattr(toxicity, "fit", spy)
    toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    df = [collections.Counter(), collections.Counter()]
    number = [0, 0]
    for i, text in rows:
        if i % 5:
            df[i % 3 == 0].update(set(grams(text, toxicity.ORDERS)))
            number[i % 3 == 0] += 1
    every = set(df[0]) | set(df[1])
    p, q = sum(df[1][g] + 1 for g in every), sum(df[0][g] + 1 for g in every)
    expected = []
    for g in every:
        a, b = df[1][g], df[0][g]
        c, d = number[1] - a, number[0] - b
        if (a * d - b * c) ** 2 * sum(number) / ((a + b) * (c + d) * number[0] * number[1] + 1e-9) >= toxicity.MIN_CHI:
            expected.append(math.log((a + 1) / p / ((b + 1) / q)))
    assert np.allclose(sorted(seen["ratio"]), sorted(expected)) and len(expected) > 20
    assert np.isclose(seen["prior"], number[1] / sum(number))


def test_word_vectors_are_sums_of_contexts(spark):
    random.seed(6)
    texts = [" ".join(random.choice(["alpha", "beta", "gamma,", "delta!!", "12"]) for _ in range(random.randint(0, 30))) for _ in range(40)] + [None, ""]
    vectors, weight = quality.word_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    place, sign = quality.index_entries()
    total, seen = collections.defaultdict(lambda: np.zeros(quality.DIM)), collections.Counter()
    for text in texts:
        t = quality.tokens(text or "").tolist()
        for i, word in enumerate(t):
            seen[word] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(t), i + quality.WINDOW + 1)):
                for k in range(quality.NONZERO):
                    total[word][place[t[j], k]] += sign[t[j], k]
    n, whole = sum(seen.values()), sum(total.values())
    for word in seen:
        v = total[word] - seen[word] / n * whole
        assert np.allclose(vectors[word], v / (np.sqrt((v * v).sum()) + 1e-9)) and np.isclose(weight[word], 1e-3 / (1e-3 + seen[word] / n))
    model = quality.Model(vectors, weight)
    t = quality.tokens("alpha gamma, alpha").tolist()
    assert np.allclose(model.pool("alpha gamma, alpha"), sum(weight[x] * vectors[x] for x in t) / sum(weight[x] for x in t)) and not model.pool("").any()


def test_samples_are_bounded_in_a_fixed_order(spark):
    rows = spark.createDataFrame([(i, bytes(100)) for i in range(500)], "n long, x binary")
    one = learning.bounded_sample(rows.repartition(7), ["x"], 50)
    assert len(one) == 50 and one == learning.bounded_sample(rows.repartition(2), ["x"], 50)
    assert 10 < len(learning.bounded_sample(rows, ["x"], 500, 5_000)) < 110
