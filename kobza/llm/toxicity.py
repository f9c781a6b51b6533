"""Toxicity by a classifier chain.

Categories are predicted one after the other; each category's linear model sees, besides the words of the document, the
probabilities of the categories before it. While learning, those are out-of-fold predictions, so that a later model does
not trust an earlier one more than unseen documents deserve.

The labels mark documents as toxic or not, and as of good quality or not. The chain of the query is: "toxic_good" (toxic
in a text of good quality, such as abuse within fluent prose), "toxic_poor" (toxic in any other text) and "toxic" (the label
itself, decided last). No category is known from the features. The models see how often words and beginnings of words
occur that the learning sample's toxic documents use most distinctly; words of prose that occur in both kinds alike carry
no weight. Toxic and clean rows of the sample are weighted by the labelled rows that they stand for, so that a
probability means the same however much of either kind the sample holds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kobza.llm.common import durable, map_arrow, release, sample_keys, trimmed

#: Bounds of the sample that the chain is fitted on; length of the mark list; folds.
TOXIC, CLEAN, MARKS, FOLDS = 3000, 6000, 256, 5
#: Rows that a step of the fit multiplies at once.
ROWS = 1024
#: Lengths in bytes of the beginnings of words that may be marks, and distinct words that one task remembers.
BEGINNINGS, MEMORY = (4, 5, 6, 7), 400_000
CHAIN = ["toxic_good", "toxic_poor", "toxic"]
#: ASCII letters in lower case, bytes beyond ASCII as they are, white space for the rest.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(LETTERS).split()


def marks_of(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, which end in a star."""
    return [word, *(word[:n] + b"*" for n in BEGINNINGS if len(word) >= n)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Logistic regression of weighted rows by Newton steps; the last weight is the bias. Rows are summed in blocks, as
    intermediate matrices are as large as the rows they are of."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), decay * len(x))
    ridge[-1] = 1e-6
    for _ in range(steps):
        curve, slope = np.diag(ridge + 1e-9), ridge * w
        for at in range(0, len(x), ROWS):
            part, u = np.hstack([x[at : at + ROWS], np.ones((len(x[at : at + ROWS]), 1))]), weight[at : at + ROWS]
            p = sigmoid(part @ w)
            curve += (part.T * (u * p * (1 - p))) @ part
            slope += part.T @ (u * (p - y[at : at + ROWS]))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply_linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def fit_chain(x: np.ndarray, targets: list[np.ndarray], folds: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    models = []
    for y in targets:
        models.append(fit_linear(x, y, weight))
        out = np.empty(len(x))
        for k in np.unique(folds):
            own = folds == k
            out[own] = apply_linear(x[own], fit_linear(x[~own], y[~own], weight[~own]) if (~own).any() else models[-1])
        x = np.hstack([x, out[:, None]])
    return models


def run_chain(x: np.ndarray, models: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for w in models:
        out.append(apply_linear(x, w))
        x = np.hstack([x, out[-1][:, None]])
    return out


def telling(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Whether toxic documents have a mark clearly more often. Columns: numbers of documents with it."""
    return (toxic >= 3) & (toxic / n_toxic >= 3 * (clean + 0.5) / (n_clean + 1))


def mark_list(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, looked_at: int, most: int = MARKS) -> list[bytes]:
    """Telling marks by their G statistic. Counters: documents by mark.

    The statistic has to exceed the logarithm of the number of marks looked at, so that chance brings about one in all.
    """
    found, least = [], math.log(max(2, looked_at))
    for w, a in toxic.items():
        b = clean[w]
        p = (a + b) / (n_toxic + n_clean)
        g = a * math.log(a / (n_toxic * p)) + (b * math.log(b / (n_clean * p)) if b else 0)
        if g > least:
            found.append((-g, w))
    return [w for _, w in sorted(found)[:most]]


class Model:
    def __init__(self, marks: list[bytes], models: list[np.ndarray]):
        self.place, self.models, self.known = {w: i for i, w in enumerate(marks)}, models, {}

    def marks(self, word: bytes) -> list[int]:
        """Places of the marks on a word, which are remembered."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            got = self.known[word] = [self.place[m] for m in marks_of(word) if m in self.place]
        return got

    def features(self, words: list[bytes]) -> np.ndarray:
        """Whether each mark occurs, then how many words have one and their share of the text."""
        hits = [h for h in map(self.marks, words) if h]
        x = np.zeros(len(self.place) + 2)
        x[[i for h in hits for i in h]] = 1
        x[-2], x[-1] = min(len(hits), 8) / 4, min(1.0, 20 * len(hits) / (len(words) + 20))
        return x

    def probabilities(self, texts: list[str | None]) -> list[np.ndarray]:
        return run_chain(np.array([self.features(words_of(t)) for t in texts]).reshape(len(texts), -1), self.models)


def fit(documents: DataFrame, labels: DataFrame, held_out: Column, text: str, key: str, label: str, quality: str) -> Model | None:
    # 0: clean, 1: toxic, 2: toxic and of good quality
    kind = F.when(F.col(label).cast("int") == 1, F.when(F.col(quality).cast("int") == 1, 2).otherwise(1)).otherwise(0)
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out).select(key, kind.alias("_mark"))
    keys = sample_keys(marks.where("_mark > 0"), key, TOXIC, ["_mark"]).unionByName(sample_keys(marks.where("_mark = 0"), key, CLEAN, ["_mark"]))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        # A document is kept as its words: the sample is bounded, and no text is cut.
        rows = [b" ".join(words_of(t)) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["fold", "mark", "words"])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean, toxic = counted = Counter(), Counter()
        for mark, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            counted[mark > 0].update({m for w in set(words.split()) for m in marks_of(w)})
        every = list(toxic | clean)
        arrays = [pa.array(every, pa.binary()), *(pa.array([c[w] for w in every], pa.int64()) for c in (toxic, clean))]
        return pa.RecordBatch.from_arrays(arrays, names=["word", "toxic", "clean"])

    def see(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = [model.features(w.split()) for w in batch.column(2).to_pylist()]
        arrays = [pa.array([np.flatnonzero(x).astype(np.int32) for x in seen], pa.list_(pa.int32())), pa.array([x[x != 0] for x in seen], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["fold", "mark", "places", "values"])

    # The sample's words stay with the executors; the driver gets what a mark needs at least, and which marks a document has.
    sample = documents.select(key, text).join(F.broadcast(keys), key).select(F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int").alias("fold"), "_mark", text)
    sample = durable(map_arrow(sample, of, "fold int, mark int, words binary"))
    sizes = [0, 0, 0]
    for r in sample.groupBy("mark").agg(F.count("*").alias("n")).collect():
        sizes[r["mark"]] = r["n"]
    n_toxic, n_clean = sum(sizes[1:]), sizes[0]
    if not n_clean or not n_toxic:
        return None
    totals = map_arrow(sample, count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0")
    distinct = F.when(telling(F.col("toxic"), F.col("clean"), n_toxic, n_clean), F.col("word")).alias("word")  # null for all others, which are but counted
    found = totals.groupBy(distinct).agg(F.count("*").alias("n"), F.first("toxic").alias("toxic"), F.first("clean").alias("clean")).collect()
    counted = [Counter({bytes(r.word): r[c] for r in found if r.word is not None}) for c in ("toxic", "clean")]
    model = Model(mark_list(*counted, n_toxic, n_clean, looked_at=sum(r.n for r in found)), [])
    rows = sorted(tuple(r) for r in map_arrow(sample, see, "fold int, mark int, places array<int>, values array<double>").collect())
    labelled = {r["_mark"]: r["n"] for r in marks.groupBy("_mark").agg(F.count("*").alias("n")).collect()}
    share = np.array([labelled.get(k, 0) / max(1, n) for k, n in enumerate(sizes)])  # labelled rows that each row of the sample stands for
    x = np.zeros((len(rows), len(model.place) + 2))
    for i, (_, _, places, values) in enumerate(rows):
        x[i, places] = values
    kinds = np.array([r[1] for r in rows])
    weight = share[kinds]
    weight *= len(weight) / weight.sum()
    model.models = fit_chain(x, [(kinds == 2).astype(float), (kinds == 1).astype(float), (kinds > 0).astype(float)], np.array([r[0] for r in rows]), weight)
    return model


def score_toxicity(documents: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", label: str = "toxic", quality: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """Per document: key, the columns to keep, held_out, a probability for each category of the chain, predicted (1: toxic).

    Learns from labels where held_out (of the key alone) is false, from TOXIC rows of each toxic kind and CLEAN others at
    most. Null and empty texts have no words and are judged by that, very long ones by all of theirs. Rows are judged on
    their own, so repeated rows and ties agree; a score of 0.5 is toxic. Null labels teach nothing, a null quality is not a good one; other
    columns are not read, whatever their names. Without both toxic and clean documents to learn from, as with an empty
    table, every probability is 0.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, held_out, text, key, label, quality))
    release(documents.sparkSession)  # the sample's words are no longer needed
    keep = [c for c in keep or [] if c != key]
    kept = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(texts_at).to_pylist()
                found = model.value.probabilities(texts) if model.value else [np.zeros(len(texts))] * len(CHAIN)
                out = [*(batch.column(i) for i in range(len(kept) + 1)), *map(pa.array, found), pa.array((found[-1] >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=[*kept, "held_out", *(f"p_{c}" for c in CHAIN), "predicted"])

    types = dict(documents.dtypes)
    texts_at = kept.index(text) if text in kept else len(kept) + 1  # a text that is kept is sent once
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "held_out boolean", *(f"p_{c} double" for c in CHAIN), "predicted int"])
    return documents.select(*(f"`{c}`" for c in kept), held_out.alias("held_out"), *([] if text in kept else [F.col(text).alias("_text")])).mapInArrow(trimmed(run), schema)
