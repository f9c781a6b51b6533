"""The toxicity chain's probabilities against the share of toxic labels."""

import random

import numpy as np
from pyspark.sql import functions as F

from kobza.llm import toxicity


def test_probabilities_keep_the_share_of_labels(spark, monkeypatch):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.1
        words = [rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(20)]
        if rng.random() < (0.6 if toxic else 0.1):
            words[3] = "grumbo"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), i % 2))
    documents, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    monkeypatch.setattr(toxicity, "TOXIC", 100)
    monkeypatch.setattr(toxicity, "CLEAN", 100)  # half of the sample is toxic, a tenth of the labels
    found = [r.p_toxic for r in toxicity.score_toxicity(documents, marks, F.lit(False)).collect()]
    assert abs(np.mean(found) - np.mean([t for _, t, _ in labels])) < 0.04


def test_a_chain_is_no_worse_than_independent_models():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 6))
    first = (x[:, 0] + 0.5 * rng.normal(size=1200) > 0.8).astype(float)
    second = (x[:, 1] + 0.5 * rng.normal(size=1200) > 0.8).astype(float)
    either = np.maximum(first, second)
    learn, held, folds, weight = slice(0, 800), slice(800, 1200), np.arange(800) % 5, np.ones(800)
    chain = toxicity.fit_chain(x[learn], [first[learn], second[learn], either[learn]], folds, weight)
    apart = toxicity.apply_linear(x[held], toxicity.fit_linear(x[learn], either[learn], weight))
    joined = toxicity.run_chain(x[held], chain)[-1]

    def loss(p):
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return -np.mean(either[held] * np.log(p) + (1 - either[held]) * np.log(1 - p))

    assert loss(joined) < loss(apart)
    # The later model's inputs while learning are out-of-fold: those of a fold come from a model without it.
    again = toxicity.fit_linear(x[learn][folds != 2], first[learn][folds != 2], weight[folds != 2])
    out = toxicity.apply_linear(x[learn][folds == 2], again)
    seen = np.empty(800)
    for k in range(5):
        seen[folds == k] = toxicity.apply_linear(x[learn][folds == k], toxicity.fit_linear(x[learn][folds != k], first[learn][folds != k], weight[folds != k]))
    assert np.allclose(seen[folds == 2], out)
    assert np.allclose(chain[1], toxicity.fit_linear(np.hstack([x[learn], seen[:, None]]), second[learn], weight))


def test_the_sample_stays_with_the_executors(spark, monkeypatch):
    """The driver sees no word of the sample but the marks, whatever is in its documents, and broadcasts nothing else."""
    rows = [(i, " ".join(["grumbo" if i % 3 == 0 else "lorem", *(f"word{chr(97 + j)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for j in range(20))])) for i in range(600)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0), i % 2) for i in range(600)], "doc_id long, toxic int, quality int")
    here = []
    words_of, marks_of = toxicity.words_of, toxicity.marks_of
    monkeypatch.setattr(toxicity, "marks_of", lambda word: here.append(word) or marks_of(word))
    model = toxicity.fit(documents, marks, F.lit(False), "text", "doc_id", "toxic", "quality")
    assert b"grumbo" in model.place and not here and not model.known
    found = model.probabilities(["grumbo dolor", "lorem dolor", None])[-1]
    assert words_of("Grumbo!") == [b"grumbo"] and here and found[0] > 0.5 > max(found[1:])
