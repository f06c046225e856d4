"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

The document frequencies of all n-grams in toxic and in other labelled training texts are counted over all of them; they
give each n-gram a log-count ratio. The n-grams whose frequencies differ significantly (a chi-square of MIN_CHI or more; the
MAX_FEATURES that differ most, a model size) become features, present or not, scaled by their ratio. A logistic regression over them is fitted on a bounded sample (MAX_SAMPLE).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import bounded_sample, map_texts, labelled, sigmoid, temperature, unit
from .scratch import ship, write
from .textarrays import letter_ngrams

ORDERS = (5, 6)
MIN_CHI, MAX_FEATURES, MAX_SAMPLE = 25.0, 20_000, 6000
_BITS = 22
#: N-grams that a counting task holds before it hands its counts on.
_HOLD = 1_000_000


@dataclass
class Model:
    features: np.ndarray  # sorted n-gram hashes
    weights: np.ndarray  # coefficient times log-count ratio
    bias: float

    def table(self) -> np.ndarray:
        t = np.zeros(1 << _BITS, bool)
        t[(self.features >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return t

    def score(self, text: str | None, table: np.ndarray) -> float:
        return float(sigmoid(self.bias + self.weights[present(text or "", self.features, table)].sum()))


def present(text: str, features: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of the features that occur in a whole text."""
    found = []
    for h in letter_ngrams(text, ORDERS):
        h = h[table[(h >> np.uint64(64 - _BITS)).astype(np.int64)]]
        if len(h):
            at = np.searchsorted(features, h)
            at[at == len(features)] = 0
            found.append(at[features[at] == h])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _distinct(text: str) -> np.ndarray:
    found = letter_ngrams(text, ORDERS)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of n-grams by label; the row without an n-gram has the numbers of documents."""

    def out(h, pos, neg):
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(pos, pa.int64()), pa.array(neg, pa.int64())], ["h", "pos", "neg"])

    held: list[list[np.ndarray]] = [[], []]
    docs, size = [0, 0], 0

    def flush():
        sides = [np.unique(np.concatenate(x), return_counts=True) if x else (np.empty(0, np.uint64), np.empty(0, np.int64)) for x in held]
        keys = np.union1d(sides[0][0], sides[1][0])
        n = np.zeros((2, len(keys)), np.int64)
        for i, (k, c) in enumerate(sides):
            n[i, np.searchsorted(keys, k)] = c
        return out(keys.view(np.int64), n[1], n[0])

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label"), strict=True):
            y = label.as_py()
            h = _distinct(text.as_py() or "")
            docs[y] += 1
            held[y].append(h)
            size += len(h)
            if size >= _HOLD:
                yield flush()
                held, size = [[], []], 0
    if size:
        yield flush()
    pa.default_memory_pool().release_unused()
    yield out([None], [docs[1]], [docs[0]])


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, prior: float, l2: float = 1e-4, steps: int = 300, rate: float = 0.03) -> tuple[np.ndarray, float]:
    """Coefficients (times ratios) and bias of a logistic regression on present features scaled by ratio, by Adam on all rows.

    Both classes weigh the same in the fit; the bias is then set for the share ``prior`` of class 1.
    """
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    x = ratio[at]
    for t in range(1, steps + 1):
        z = np.bincount(row, w[at] * x, minlength=len(rows)) + b
        e = (sigmoid(z) - y) * weight
        g, gb = np.bincount(at, e[row] * x, minlength=len(ratio)) + l2 * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b = b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w * ratio, b + float(np.log(prior / (1 - prior)))


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_features: int = MAX_FEATURES, max_sample: int = MAX_SAMPLE, seed: int = 11) -> Model:
    """Fit on documents with a label of 0 or 1 for which train_rows (a condition on the id) holds.

    Null texts count as empty. Without documents of both classes, or n-grams that tell them apart, the model has no features and gives the share of class 1
    among the labelled documents (0.0 without any).
    """
    spark = docs.sparkSession
    ship(spark)
    known = labelled(docs, labels, id_col, text_col, label_col, train_rows).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "label")
    counts = write(known.select("text", "label").mapInArrow(_count, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "ngrams")
    sizes = counts.df.filter("h is null").select("pos", "neg").first()
    n_pos, n_neg = sizes if sizes else (0, 0)

    def plain() -> Model:
        share = min(max(n_pos / max(1, n_pos + n_neg), 1e-12), 1 - 1e-12)
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(share / (1 - share))) if n_pos else -40.0)

    if not n_pos or not n_neg:
        counts.drop()
        return plain()
    total = counts.df.filter("h is not null").agg(F.sum(F.col("pos") + 1).cast("double").alias("p"), F.sum(F.col("neg") + 1).cast("double").alias("q")).first()
    # the signed root of Pearson's chi-square of the presence of an n-gram and the label
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    c, d = F.lit(float(n_pos)) - a, F.lit(float(n_neg)) - b
    chi = F.pow(a * d - b * c, F.lit(2.0)) * (n_pos + n_neg) / ((a + b) * (c + d) * float(n_pos) * float(n_neg) + 1e-9)
    top = counts.df.filter("h is not null").select("h", "pos", "neg", chi.alias("chi")).filter(F.col("chi") >= MIN_CHI).orderBy(F.desc("chi"), "h").limit(max_features).collect()
    counts.drop()
    if not top:
        return plain()
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    features = h[order]
    pos, neg = np.array([r["pos"] for r in top], float)[order], np.array([r["neg"] for r in top], float)[order]
    ratio = np.log(((pos + 1) / total["p"]) / ((neg + 1) / total["q"]))
    half = max_sample / 2
    rate = F.when(F.col("label") == 1, min(1.0, half / n_pos)).otherwise(min(1.0, half / n_neg))
    model = Model(features, np.zeros(len(features)), 0.0)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            at = [present(t.as_py() or "", features, table).astype("<i4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(at, pa.binary())], ["id", "label", "at"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = write(known.filter(unit(F.col("id"), seed) < rate).mapInArrow(pick, f"id {kind}, label int, at binary").select("label", "at"), "sample")
    sample = bounded_sample(picked.df, ["at"], 2 * max_sample)
    picked.drop()
    y = np.array([r["label"] for r in sample], np.int64)
    rows = [np.frombuffer(r["at"], "<i4").astype(np.int64) for r in sample]
    later = np.random.default_rng(seed).random(len(rows)) < 0.15
    f, held = np.flatnonzero(~later), np.flatnonzero(later)
    prior = n_pos / (n_pos + n_neg)
    weights, bias = fit([rows[i] for i in f], y[f], ratio, prior)
    z = np.array([weights[rows[i]].sum() + bias for i in held])
    shift = np.log(prior / (1 - prior))  # the sample's classes weigh the same
    t = temperature(np.stack([np.zeros(len(z)), z - shift], 1), y[held]) if len(set(y[held])) == 2 else 1.0
    return Model(features, weights / t, float((bias - shift) / t + shift))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns id_col and ``keep``, then score (0 to 1, higher: likelier class 1), a row for each input row.

    Whole texts are used; null and empty texts have no n-grams and get the model's base score. Repeated rows and null ids
    are scored like any others; other columns are not read.
    """
    def start():
        table = model.table()
        return lambda texts: [[model.score(t, table) for t in texts]]

    return map_texts(docs, id_col, text_col, keep, start, {"score": pa.float64()})
