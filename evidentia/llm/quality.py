"""Document quality: random-indexing word vectors pooled per document, then a two-layer network in numpy.

A token is a run of letters and digits, or a run of other visible characters. Every token bucket has a fixed sparse random
index vector; a bucket's context vector is the sum of the index vectors of the tokens at most WINDOW places away (its own
place included), over all texts of the corpus, in integers, so that it doesn't depend on the order of the sums. A
document is the mean of its tokens' vectors, frequent tokens weighing less. The network is fitted on a bounded sample of
labelled documents (MAX_SAMPLE) and its probabilities are calibrated with a temperature on a part that the fit didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import bounded_sample, map_texts, labelled, sigmoid, temperature, unit
from .scratch import ship, write
from .textarrays import blocks, codes, letter_table, mix, runs, space_table, span_hashes

BITS, DIM, WINDOW, NONZERO = 13, 32, 2, 2
MAX_SAMPLE, HIDDEN = 6000, 24
_HOLD = 200_000


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the nonzero entries of each bucket's index vector; the last row, for no token, has sign 0."""
    h = mix(np.arange((1 << BITS) * NONZERO, dtype=np.uint64) + np.uint64(0x51ED)).reshape(-1, NONZERO)
    place = (h % np.uint64(DIM)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1, -1).astype(np.int64)
    return np.vstack([place, np.zeros((1, NONZERO), np.int64)]), np.vstack([sign, np.zeros((1, NONZERO), np.int64)])


def tokens(text: str) -> np.ndarray:
    """Bucket of each token of a whole text, in order. A block of a very long text ends a token."""
    found = []
    for piece in blocks(text):
        a = codes(piece)
        word = letter_table()[a] | ((a >= 48) & (a <= 57))
        sign = ~word & ~space_table()[a]
        s1, e1 = runs(word)
        s2, e2 = runs(sign)
        s, e = np.concatenate((s1, s2)), np.concatenate((e1, e2))
        order = np.argsort(s, kind="stable")
        found.append((span_hashes(a, s[order], e[order]) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of index vectors by bucket, of the texts of a partition."""
    size = 1 << BITS
    place, sign = index_entries()
    total, seen = np.zeros(size * DIM), np.zeros(size, np.int64)
    held: list[np.ndarray] = []
    n = 0
    gap = np.full(WINDOW, size, np.int64)

    def add():
        t = np.concatenate(held)
        at = t < size
        np.add(seen, np.bincount(t[at], minlength=size), out=seen)
        for k in range(-WINDOW, WINDOW + 1):
            word, other = (t[k:], t[: len(t) - k]) if k >= 0 else (t[:k], t[-k:])
            ok = word < size
            word, other = word[ok], other[ok]
            for j in range(NONZERO):
                np.add(total, np.bincount(word * DIM + place[other, j], sign[other, j], size * DIM), out=total)

    for batch in batches:
        for text in batch.column(0):
            t = tokens(text.as_py() or "")
            held += [t, gap]
            n += len(t)
            if n >= _HOLD:
                add()
                held, n = [], 0
    if n:
        add()
    at = np.flatnonzero(seen)
    sums = total.reshape(size, DIM)[at].astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64()), *(pa.array(sums[:, j], pa.int64()) for j in range(DIM))], ["bucket", "n", *(f"c{j}" for j in range(DIM))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vector (DIM numbers) and weight of each of the 2**BITS buckets, from all texts."""
    ship(docs.sparkSession)
    names = [f"c{j}" for j in range(DIM)]
    parts = docs.select(F.col(text_col).alias("text")).filter("text is not null").mapInArrow(_contexts, ", ".join(["bucket int", "n long", *(f"{c} long" for c in names)]))
    vectors, count = np.zeros((1 << BITS, DIM)), np.zeros(1 << BITS)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():
        vectors[r["bucket"]], count[r["bucket"]] = r[2:], r["n"]
    share = count / max(1.0, count.sum())
    vectors -= share[:, None] * vectors.sum(0)  # what a bucket's contexts have beyond those of any token
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True)) + 1e-9
    return vectors, 1e-3 / (1e-3 + share)


@dataclass
class Model:
    vectors: np.ndarray
    weight: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(DIM))
    scale: np.ndarray = field(default_factory=lambda: np.ones(DIM))
    w1: np.ndarray = field(default_factory=lambda: np.zeros((DIM, HIDDEN)))
    b1: np.ndarray = field(default_factory=lambda: np.zeros(HIDDEN))
    w2: np.ndarray = field(default_factory=lambda: np.zeros(HIDDEN))
    b2: float = 0.0
    temperature: float = 1.0

    def pool(self, text: str | None) -> np.ndarray:
        n = np.bincount(tokens(text or ""), minlength=1 << BITS)
        at = np.flatnonzero(n)
        if not len(at):
            return np.zeros(DIM)
        return (n[at] * self.weight[at]) @ self.vectors[at] / (n[at] * self.weight[at]).sum()

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def fit(model: Model, x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.01, l2: float = 1e-4, seed: int = 5) -> None:
    """Fit the network by Adam on all rows."""
    random = np.random.default_rng(seed)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    x = (x - model.mean) / model.scale
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    p = [random.normal(0, 1 / np.sqrt(DIM), (DIM, HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(share / (1 - share)))]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        h = np.tanh(x @ p[0] + p[1])
        e = (sigmoid(h @ p[2] + p[3]) - y) / len(y)
        back = e[:, None] * p[2] * (1 - h * h)
        for i, g in enumerate((x.T @ back + l2 * p[0], back.sum(0), h.T @ e + l2 * p[2], e.sum())):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = p[0], p[1], p[2], float(p[3])


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_sample: int = MAX_SAMPLE, seed: int = 5) -> Model:
    """Word vectors from all documents; the network from documents with a label of 0 or 1 for which train_rows (a condition on the id) holds.

    Null texts count as empty, and have the zero vector. Without labelled documents every score is 0.5; with one class the
    network only learns its share.
    """
    model = Model(*word_vectors(docs, text_col))
    known = labelled(docs, labels, id_col, text_col, label_col, train_rows).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "label")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not n:
        return model
    # rare classes are taken whole, and at most half of the sample is of one class where both are frequent
    rate = F.create_map(*[F.lit(v) for k, c in n.items() for v in (k, min(1.0, max_sample / 2 / c))])[F.col("label")]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.pool(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.binary())], ["label", "x"])

    picked = write(known.filter(unit(F.col("id"), seed) < rate).select("text", "label").mapInArrow(pick, "label int, x binary"), "sample")
    sample = bounded_sample(picked.df, ["x"], 2 * max_sample)
    picked.drop()
    if not sample:
        return model
    y = np.array([r["label"] for r in sample], float)
    x = np.array([np.frombuffer(r["x"]) for r in sample])
    later = np.random.default_rng(seed).random(len(y)) < 0.15
    if later.all() or len(set(y[~later])) < 2:
        later[:] = False
    fit(model, x[~later], y[~later], seed=seed)
    # the sample has the classes in other shares than the labelled rows
    kept = {k: min(1.0, max_sample / 2 / c) for k, c in n.items()}
    shift = float(np.log(kept.get(0, 1.0) / kept.get(1, 1.0)))
    if len(set(y[later])) == 2:
        z = model.logits(x[later])
        model.temperature = temperature(np.stack([np.zeros(len(z)), z], 1), y[later].astype(int))
    model.b2 += shift * model.temperature
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns id_col and ``keep``, then score (0 to 1, higher: likelier class 1), a row for each input row.

    Whole texts are used; null and empty texts are scored by the zero vector. Repeated rows and null ids are scored like
    any others; other columns are not read.
    """
    def start():
        return lambda texts: [model.score(np.array([model.pool(t) for t in texts]).reshape(-1, DIM))]

    return map_texts(docs, id_col, text_col, keep, start, {"score": pa.float64()})
