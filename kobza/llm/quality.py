"""Quality classifier by positive-unlabelled learning.

Positives are documents marked good; the unlabelled sample is drawn from all documents of the learning part, whatever
their marks. The class prior is the share of good ones among all marked documents of that part, with one of each added. A linear model
minimises the non-negative risk ``prior * R+(good) + max(0, R-(unlabelled) - prior * R-(good))`` with the logistic loss;
where the second term falls below zero, the step is taken the other way, as in the published estimator.

Features see the whole text and no other column: frequencies of triples of character classes, shares of repeated words,
word pairs and lines, and lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kobza.llm.common import map_arrow, sample_keys, trimmed

#: Bounds of the sample that the model is fitted on.
POSITIVES, UNLABELLED = 2500, 5000
#: Characters of each class; the rest of ASCII is the class after them, bytes beyond ASCII the last.
CLASSES = [b"aeiouy", b"bcdfghjklmnpqrstvwxz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",;:", b"!?", b"*#$%&", b"|<>/\\=_{}[]", b"'\"()-"]
N = len(CLASSES) + 2
EXTRA = 7


def class_table() -> np.ndarray:
    out = np.full(256, N - 1, np.int32)
    out[:128] = N - 2
    for i, members in enumerate(CLASSES):
        out[list(members)] = i
    return out


TABLE = class_table()


def share(items: list) -> float:
    return len(set(items)) / len(items) if items else 1.0


def features(text: str | None) -> np.ndarray:
    text = text or ""
    data = TABLE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    words, lines = text.split(), text.split("\n")
    triples = np.bincount(data[:-2] * (N * N) + data[1:-1] * N + data[2:], minlength=N**3) if len(data) > 2 else np.zeros(N**3)
    n = max(1, len(words))
    extra = [share(words), share(list(zip(words, words[1:], strict=False))), share(lines), math.log1p(len(words)) / 10, min(4.0, len(text) / n / 10), min(1.0, n / 20), min(4.0, len(lines) * 10 / n)]
    return np.concatenate([np.sqrt(triples / max(1, len(data) - 2)), extra]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(good: np.ndarray, any_: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02, decay: float = 1e-4) -> np.ndarray:
    """Weights, the last one the bias, by Adam on the non-negative risk of the whole sample."""
    good, any_ = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (good, any_))
    w = np.zeros(good.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g, u = good @ w, any_ @ w
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, g).mean()
        of_negative = sigmoid(u) @ any_ / len(any_) - prior * (sigmoid(g) @ good) / len(good)
        gradient = prior * ((sigmoid(g) - 1) @ good) / len(good) + of_negative if negative >= 0 else -of_negative
        gradient = gradient + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def feature_rows(df: DataFrame, text: str) -> np.ndarray:
    """Features of a bounded sample, as rows on the driver."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(t).tobytes() for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["features"])

    rows = [np.frombuffer(r.features, np.float32) for r in map_arrow(df.select(text), of, "features binary").collect()]
    return np.array(rows, np.float32).reshape(-1, N**3 + EXTRA)


def score_quality(documents: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Per document: key, held_out, score (0 to 1), predicted.

    Learns from rows where held_out (of the key alone) is false. A null text counts as an empty one and gets a score too.
    Rows are scored on their own, so repeated rows and ties get equal scores; null marks and keys teach nothing, further
    columns are not read. Without a good document to learn from every score is the prior (one half without any mark).
    """
    spark = documents.sparkSession
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out).select(key, F.col(label).cast("int").alias("_mark"))
    n, positive = marked.agg(F.count("*"), F.sum((F.col("_mark") == 1).cast("long"))).first()
    prior = ((positive or 0) + 1) / (n + 2)
    learn = documents.where(~held_out).select(key, text)
    good_keys = sample_keys(marked.where("_mark = 1"), key, POSITIVES)
    any_keys = sample_keys(learn, key, UNLABELLED)
    # Both key lists are bounded by the parameters above.
    good = feature_rows(learn.join(F.broadcast(good_keys), key, "left_semi"), text)
    any_ = feature_rows(learn.join(F.broadcast(any_keys), key, "left_semi"), text)
    if len(good) and len(any_):
        w = fit(good, any_, prior)
    else:
        w = np.append(np.zeros(N**3 + EXTRA), math.log(prior / (1 - prior)))
    model = spark.sparkContext.broadcast(w)
    key_type = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = model.value
            scores = np.array([sigmoid(features(t) @ weights[:-1] + weights[-1]) for t in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    return documents.select(key, held_out.alias("held_out"), text).mapInArrow(trimmed(run), f"{key} {key_type}, held_out boolean, score double, predicted int")
