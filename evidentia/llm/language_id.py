"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training texts. The regression is fitted on a bounded sample of them
(MAX_SAMPLE rows, and LEAST of each language) with follow-the-regularised-leader updates and elastic-net penalties, which leave most weights zero, and its
probabilities are calibrated with a temperature on a part of the sample that the fit didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import bounded_sample, map_texts, softmax, temperature, unit
from .scratch import ship, write
from .textarrays import codes, letter_ngrams, letter_table

ORDERS, BITS = (1, 2, 3), 15
#: Documents that the regression is fitted on, shared equally by the languages; and how many of each language at least.
MAX_SAMPLE, LEAST = 4000, 8
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not letter_table()[codes(text)].any():
            return UNKNOWN, 0.0
        at, n = term_counts(text)
        x = tf_idf(at, n, self.idf)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's n-grams, and how often each occurs."""
    total = np.zeros(1 << BITS, np.int64)
    for h in letter_ngrams(text, ORDERS):
        total += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def tf_idf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / (np.sqrt((x * x).sum()) or 1)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial regression, by proximal follow-the-regularised-leader steps a row at a time."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)
    order = np.random.default_rng(seed)

    def solve(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w, b = solve(zi, ni), solve(zb, nb)
            error = softmax(x @ w + b)
            error[y[i]] -= 1
            g = x[:, None] * error
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
            zb = zb + error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / alpha * b
            nb = nb + error * error
    return solve(z, n), solve(zb, nb)


def train(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_sample: int = MAX_SAMPLE, seed: int = 7) -> Model:
    """Fit on the rows where train_rows holds and text and language are not null; no such rows: a model that knows no language.

    Every language that occurs is learned: the driver holds one number for each, and half a megabyte of weights.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), train_rows.alias("_train")).filter(F.col("_train") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = known.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros(1), np.zeros((1, 0)), np.zeros(0), 1.0)
    share = max(max_sample / len(languages), LEAST)
    rate = {r["lang"]: share / r["count"] for r in counts}
    picked = known.select("text", "lang", unit(F.col("id"), seed).alias("u"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, np.int64)
        docs_seen = 0

        def out(lang, bucket, n, at, tf):
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(bucket, pa.int32()), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(tf, pa.binary())], ["lang", "bucket", "n", "at", "tf"])

        for batch in batches:
            sample = []
            for text, lang, u in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("u").to_pylist(), strict=True):
                at, n = term_counts(text.as_py())
                df[at] += 1
                docs_seen += 1
                if u is not None and u < rate[lang]:  # no sample of rows with a null id
                    sample.append((lang, at.astype("<u2").tobytes(), np.minimum(n, 65_535).astype("<u2").tobytes()))
            if sample:
                langs, ats, tfs = zip(*sample, strict=True)
                yield out(langs, [None] * len(langs), [None] * len(langs), ats, tfs)
        pa.default_memory_pool().release_unused()
        at = np.flatnonzero(df)
        yield out([None] * (len(at) + 1), np.append(at, -1), np.append(df[at], docs_seen), [None] * (len(at) + 1), [None] * (len(at) + 1))

    counted = write(picked.mapInArrow(count, "lang string, bucket int, n long, at binary, tf binary"), "langid")
    df = np.zeros(1 << BITS)
    total = 0
    for r in counted.df.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    sample = bounded_sample(counted.df.filter("lang is not null").select("lang", "at", "tf"), ["at", "tf"], 2 * int(share * len(languages)))
    counted.drop()
    idf = np.log((1 + total) / (1 + df)) + 1
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[r["lang"]] for r in sample], np.int64)
    rows = []
    for r in sample:
        at, n = np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["tf"], "<u2")
        rows.append((at, tf_idf(at, n, idf)))
    later = np.random.default_rng(seed).random(len(rows)) < 0.15
    fit = np.flatnonzero(~later)
    weights, bias = ftrl([rows[i] for i in fit], y[fit], len(languages), seed=seed)
    held = np.flatnonzero(later)
    logits = np.array([rows[i][1] @ weights[rows[i][0]] + bias for i in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, bias, temperature(logits, y[held]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns id_col and ``keep``, then lang_pred and score (the calibrated probability), a row for each input row.

    Whole texts are used. A text that is null, empty or has no letter, and any text under a model that knows no language,
    gets ``und`` and score 0. Repeated rows and null ids are scored like any others; other columns are not read.
    """
    def start():
        def f(texts):
            found = [model.predict(t) for t in texts]
            return [x[0] for x in found], [x[1] for x in found]

        return f

    return map_texts(docs, id_col, text_col, keep, start, {"lang_pred": pa.string(), "score": pa.float64()})
