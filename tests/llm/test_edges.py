"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from kobza.llm import queries as Q
from kobza.llm.bpe_automaton import encode_digests
from kobza.llm.common import tokenizer_path
from kobza.llm.context_mixing import score_texts
from kobza.llm.cover_tree import near_duplicates
from kobza.llm.jaccard import jaccard_components
from kobza.llm.langid import identify_languages
from kobza.llm.packing import pack_documents
from kobza.llm.quality import score_quality
from kobza.llm.secrets import redact_secrets, secret_digests
from kobza.llm.toxicity import score_toxicity
from kobza.llm.vantage_tree import nearest_neighbours

DOCS = "doc_id long, text string, lang string, score double, held_out string, length long, id string, n int, bucket int, spans string, _base string"
WORDS = ["die", "der", "und", "the", "of", "and", "les", "des", "une", "haus", "house", "maison"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "en", "ing", "eux"]) for _ in range(n))


def documents():
    texts = [None, "", " \n\t ", "one", "!!! ???", prose(1, 30_000), prose(2, 40), prose(2, 40), prose(2, 40), "é" * 5000, "a\x00b  c d", prose(3, 12) + " token = abcdefghijklmnop"]
    return [(i, t, None if i % 3 == 0 else "en" if i % 2 else "de", 0.5, "x", 7, "id", 1, 2, "s", "b") for i, t in enumerate(texts)]


ON_TEXT = {
    "quality": lambda d, lab: score_quality(d, lab, Q.rest_is(3, 1)),
    "packing": lambda d, lab: pack_documents(d, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")),
    "mixing": lambda d, lab: score_texts(d, Q.rest_is(7, 2)),
    "jaccard": lambda d, lab: jaccard_components(d),
    "language": lambda d, lab: identify_languages(d, Q.rest_is(4, 2)),
    "bpe": lambda d, lab: encode_digests(d, tokenizer_path("word_bpe_49k.json")),
    "toxicity": lambda d, lab: score_toxicity(d, lab, Q.rest_is(5, 3)),
    "secrets": lambda d, lab: secret_digests(d),
    "redaction": lambda d, lab: redact_secrets(d),
}
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.mark.parametrize("name", ON_TEXT)
def test_text_operators(spark, name):
    docs = spark.createDataFrame(documents() + documents()[5:7], DOCS)
    labels = spark.createDataFrame([(0, 1, 0, "x"), (2, None, None, None), (3, 1, 1, None), (5, 0, 0, None), (6, 1, 1, None), (None, 1, 1, None)], LABELS)
    rows = ON_TEXT[name](docs, labels).collect()
    assert len(rows) == 14 if name != "packing" else len(rows) > 14
    assert {r.doc_id for r in rows} == set(range(12))
    if name == "jaccard":
        by = {r.doc_id: r for r in rows}
        assert by[6].component_id == by[7].component_id == by[8].component_id == 6
        assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[2].component_id == 2
        assert by[3].n_shingles == 1
    if name == "language":
        assert {r.doc_id for r in rows if r.lang_pred == "und"} == {0, 1, 2, 4}
    if name == "secrets":
        assert [r.n_assign for r in rows if r.doc_id == 11] == [1]
    if name == "mixing":
        assert all(r.n_tokens >= 1 and r.score < 0 for r in rows)


@pytest.mark.parametrize("name", ON_TEXT)
def test_text_operators_on_empty_tables(spark, name):
    assert ON_TEXT[name](spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize("name", ["quality", "language", "toxicity", "mixing"])
def test_nothing_to_learn_from(spark, name):
    docs = spark.createDataFrame([(i, "some text here", None, 0.1, "", 1, "", 1, 1, "", "") for i in range(3)], DOCS)
    assert len(ON_TEXT[name](docs, spark.createDataFrame([], LABELS)).collect()) == 3


VECTORS = "vec_id long, embedding array<float>, label int, id string, n int, cell int, vector string, component long"


def vectors():
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    near = [[x + rng.gauss(0, 0.02) for x in base[0]] for _ in range(20)]
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0]]
    same = [base[3]] * 9 + [[2 * x for x in base[3]]]
    return [(i, v, 0, "", 1, 1, "", 5) for i, v in enumerate(base + near + odd + same)]


def brute_cosines(spark, df):
    import numpy as np

    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect() if r.embedding and None not in r.embedding and np.isfinite(np.array(r.embedding, float)).all() and any(r.embedding)}
    unit = {i: x / np.linalg.norm(x) for i, x in rows.items()}
    return {i: {j: float(unit[i] @ unit[j]) for j in unit if j != i and len(unit[i]) == len(unit[j])} for i in unit}


def test_near_duplicates(spark):
    df = spark.createDataFrame(vectors(), VECTORS)
    cos = brute_cosines(spark, df)
    links = {i: {j for j, c in row.items() if c >= 0.95} for i, row in cos.items()}
    rows = {r.vec_id: r for r in near_duplicates(df).collect()}
    assert len(rows) == df.count()
    for i, r in rows.items():
        assert r.n_links == len(links.get(i, ()))
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert r.component_id == min(seen) and r.kept == (min(seen) == i)
    assert near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def test_nearest_neighbours(spark):
    df = spark.createDataFrame(vectors(), VECTORS)
    cos = brute_cosines(spark, df)
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q, found in got.items():
        best = sorted(cos[q].items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        assert [i for i, _ in found] == [i for i, _ in best]
        assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(found, best, strict=True))
    assert set(got) == {q for q in cos if q % 5 == 0}
    assert nearest_neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0).collect() == []
