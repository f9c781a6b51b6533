"""Operators against brute force, exact round trips and held-out accuracy on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kobza.llm import queries as Q
from kobza.llm.bpe_automaton import WordCodec, encode_documents
from kobza.llm.common import tokenizer_path
from kobza.llm.context_mixing import score_texts
from kobza.llm.cover_tree import CoverTree, Links, dual_traversal, near_duplicates
from kobza.llm.jaccard import jaccard_components
from kobza.llm.langid import identify_languages
from kobza.llm.packing import ChunkEncoder, best_plan, pack_documents, plan, used
from kobza.llm.quality import score_quality
from kobza.llm.secrets import redact_secrets, secret_digests
from kobza.llm.toxicity import score_toxicity
from kobza.llm.vectors import cosines, unit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SYLLABLES = {"en": ["th", "er", "ing", "ou", "sh", "wh", "ly"], "de": ["sch", "ein", "ung", "pf", "ber", "keit", "ü"], "fr": ["eau", "eux", "que", "oi", "é", "ai", "tion"]}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(seed: int = 1, n: int = 120) -> list[tuple[int, str, str]]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = prose(rng, lang, rng.randint(3, 80))
        if out and rng.random() < 0.4:  # near and exact copies
            words = rng.choice(out)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = "edit"
            text, lang = " ".join(words), "en"
        out.append((i, text, lang))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string").repartition(3)


def shingles(text: str) -> frozenset:
    w = WORD.findall(text.translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard_components(spark, docs):
    sets = {i: shingles(t) for i, t, _ in corpus()}
    least = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(linked) > 20
    while changed:
        changed = False
        for a, b in linked:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()} == {i: (len(sets[i]), least[i]) for i in sets}


def test_base_score_and_model(spark, docs):
    tokens = {i: [*WORD.findall(t.translate(FOLD)), None] for i, t, _ in corpus()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total = sum(count.values())
    rows = {r.doc_id: r for r in score_texts(docs, Q.rest_is(7, 2)).collect()}
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(count[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    assert sum(r.score for i, r in rows.items() if held[i]) > 1.2 * sum(r.base_score for i, r in rows.items() if held[i])


def test_packing(spark, docs):
    path, ranks = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
    encoder = ChunkEncoder(path, ranks)
    rows = pack_documents(docs, path, ranks, capacity=64).collect()
    texts = {i: t for i, t, _ in corpus()}
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = [*encoder.library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert {i: sum(r.length for r in rows if r.doc_id == i) for i in texts} == {i: len(encoder.library.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 64) + 2


def test_plan_is_as_good_as_enumeration():
    # 6 sequences of 10 hold these exactly; best-fit decreasing needs 7.
    histogram = Counter([6, 6, 4, 4, 5, 5, 3, 3, 3, 1, 7, 3, 2, 2, 2, 4])
    assert sum(k * n for k, n in histogram.items()) == 60
    found, proven = best_plan(histogram, 10)
    assert used(found) == 6 and proven


def fewest(items: list[int], capacity: int) -> int:
    """By enumeration."""
    best = len(items)

    def place(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if items[i] <= rooms[k] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best


def test_packing_needs_no_more_sequences_than_any_plan():
    chance, fitted_worse = random.Random(2), 0
    for turn in range(150):
        capacity = chance.choice([10, 20, 50])
        items = sorted((chance.randint(1 if turn % 2 else capacity // 5, capacity if turn % 2 else capacity // 2) for _ in range(chance.randint(1, 11))), reverse=True)
        histogram = Counter(items)
        found, proven = best_plan(histogram, capacity)
        held = Counter()
        for filling, times in found:
            assert sum(filling) <= capacity
            held.update({x: filling.count(x) * times for x in set(filling)})
        assert held == histogram
        assert used(found) == fewest(items, capacity) and proven
        fitted_worse += used(plan(histogram, capacity, search=False)) > used(found)
    assert fitted_worse


def test_chunks_encode_as_whole_texts():
    encoder = ChunkEncoder(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    for text in ["a   b\n \n c  d", "<|endoftext|> a b", "\0 a b", " lead", "it's 'd we'll ", *("".join(rng.choice("ab  \n\t'sé1.中") for _ in range(rng.randint(0, 14))) for _ in range(3000))]:
        assert np.frombuffer(encoder.encode_all([text])[0], np.uint32).tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_automaton_encodes_as_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library, codec = Tokenizer.from_file(path), WordCodec(path)
    rng = random.Random(1)
    texts = [t for _, t, _ in corpus()] + ["a" * n for n in range(1, 60)] + ["<|endoftext|> hi<|startoftext|>x", "é Å \x1cfoo", "", " ", "DON'T I'LL", *("".join(rng.choice("aabbcde ing'sthe0123!?.,éßñ\n\tΣσİ中文й") for _ in range(rng.randint(0, 50))) for _ in range(1500))]
    for t in texts:
        assert codec.encode(t) == library.encode(t, add_special_tokens=False).ids
    for r in encode_documents(docs, path).collect():
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_languages(spark, docs):
    rows = identify_languages(docs, Q.rest_is(4, 2)).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and not text like '%edit%' and length(text) > 60").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.9


def test_quality_and_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = rng.random() < 0.2, rng.random() < 0.25
        words = prose(rng, "en", 60).split(" ")
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["grumbo", "vexlit", "snarp"])
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words)))
        labels.append((i, int(not bad), int(toxic)))
    documents, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    quality = [r for r in score_quality(documents, marks, Q.rest_is(3, 1)).collect() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in quality]) > 0.95
    toxicity = [r for r in score_toxicity(documents, marks, Q.rest_is(5, 3)).collect() if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in toxicity]) > 0.95


def test_secrets(spark):
    rng = random.Random(6)
    pieces = ["token=abc", "password: \"hunter2hunter2\"", "API_KEY='aB3+/=xyzabc12'", "secret=token=abcdefghijkl", "AKIA" + "Q" * 14, "AKIAX", "deadbeef" * 2, "deadbeef", "плюс", "😀", "\n"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts += [f"see {key} here", "see thinghathinghatingthing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secret_digests(df).collect():
        t = texts[r.doc_id]
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
        if r.doc_id >= 200:
            assert r.spans == (f"random:4:{4 + len(key)}" if r.doc_id == 200 else "")
    assert redact_secrets(df).where("doc_id = 200").first().text == "see [secret] here"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, lang, "src", len(t)) for i, t, lang in corpus()] + [(500, "...", "en", "s", 3), (501, None, "en", "s", 0), (502, "here is token = abcdefghijklmnopq now", "en", "s", 30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    components = {r.doc_id: r.component_id for r in jaccard_components(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {i for i, c in components.items() if i == c} - {500, 501}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = stages["secrets"](spark, kept, str(tmp_path)).where("doc_id = 502").first()
    assert clean.text == "here is [secret] now" and clean.n_chars == len(clean.text)


def clustered_vectors() -> np.ndarray:
    chance = np.random.default_rng(3)
    centres = chance.normal(size=(30, 16))
    loose = centres[chance.integers(0, 30, 1500)] + chance.normal(size=(1500, 16)) * chance.uniform(0, 0.6, size=(1500, 1))
    dense = chance.normal(size=(1, 16)) + 0.03 * chance.normal(size=(700, 16))
    return np.concatenate([loose, dense, dense[:50], 2 * loose[:50], chance.normal(size=(400, 16))])


def test_cover_trees_find_every_link_of_dense_clusters():
    x = clustered_vectors()
    near = np.array([cosines(np.repeat(x[i : i + 1], len(x), 0), x) >= 0.95 for i in range(len(x))])
    np.fill_diagonal(near, False)
    assert near.sum() > 100_000
    tree = CoverTree(unit(x))
    links = Links(np.arange(len(x)), np.ones(len(x), np.int64))
    dual_traversal(tree, tree, True, x, x, 0.95, links)
    assert (links.count == near.sum(axis=1)).all()
    half = len(x) // 2
    links = Links(np.arange(len(x)), np.ones(len(x), np.int64))
    dual_traversal(CoverTree(unit(x[:half])), CoverTree(unit(x[half:])), False, x[:half], x[half:], 0.95, links)
    near[:half, :half] = near[half:, half:] = False
    assert (links.count == near.sum(axis=1)).all()


def test_near_duplicate_vectors_of_clusters(spark):
    x = clustered_vectors()
    near = np.array([cosines(np.repeat(x[i : i + 1], len(x), 0), x) >= 0.95 for i in range(len(x))])
    label = np.arange(len(x))
    while (lower := np.where(near, label, len(x)).min(axis=1)).tolist() != label.tolist():
        label = np.minimum(label, lower)
    found = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    assert found.n_links.tolist() == (near.sum(axis=1) - 1).tolist()
    assert found.component_id.tolist() == label.tolist()


def test_repeated_and_null_keys_of_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (0, [0.01, 1.0]), (None, [1.0, 0.0])]
    found = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in found.collect()) == [(False, 0, 1, 0, True), (False, 1, 1, 0, False), (False, 1, 1, 1, True), (False, 2, 1, 1, False), (True, 0, 0, 0, False)]


def test_repeated_and_null_keys_of_texts(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a), (1, b), (2, a), (0, b), (None, a), (5, None), (6, "")]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in found.collect()) == [(False, 0, 2, 0), (False, 1, 2, 0), (False, 1, 2, 1), (False, 2, 2, 1), (False, 5, 0, 5), (False, 6, 0, 6), (True, 0, 2, -1)]


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    from kobza.llm import jaccard

    texts = [" a bb\tc\n\ndd e  ", " " + "x" * 100 + " y ", "  ", " one two three four five six seven "]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        monkeypatch.setattr(jaccard, "PIECE", 1 << 20)
        hashes, starts = jaccard.Shingler().word_hashes(data)
        assert len(hashes) == len(text.split())
        for piece in (1, 2, 7, 16):
            monkeypatch.setattr(jaccard, "PIECE", piece)
            found = jaccard.Shingler().word_hashes(data)
            assert found[0].tolist() == hashes.tolist() and found[1].tolist() == starts.tolist()


def test_blocks_of_strings_and_of_bytes():
    import pyarrow as pa

    from kobza.llm.jaccard import blocks

    texts = ["ab", None, "é" * 3, "", "x" * 20, "c"]
    for kind, own in ((pa.string(), texts), (pa.binary(), [None if t is None else t.encode() for t in texts])):
        batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(own, kind)], names=["key", "text"])
        found = [(k.to_pylist(), t) for k, t in blocks(iter([batch]), 7)]
        assert [k for k, _ in found] == [[0, 1], [2, 3], [4], [5]] and [t for _, part in found for t in part] == own


def test_buckets_of_contexts_grow_with_the_texts(spark, monkeypatch):
    from kobza.llm import context_mixing

    rows = [(i, f"Some words of text {i} and {i % 7} more") for i in range(60)]
    dealt = []
    monkeypatch.setattr(context_mixing, "BUCKET", 100, raising=False)
    monkeypatch.setattr(context_mixing, "sources", lambda *a, f=context_mixing.sources: dealt.append(a[3]) or f(*a))
    found = score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 0).collect()
    assert dealt == [-(-sum(len(t) for _, t in rows) // 100)]
    learned = Counter(w for i, t in rows if i % 5 for w in [*t.lower().split(), ""])
    total = sum(learned.values())
    for r in found:
        words = [*rows[r.doc_id][1].lower().split(), ""]
        assert (r.train_tokens, r.n_known, r.n_tokens) == (total, sum(w in learned for w in words), len(words)) and r.score < 0
        assert math.isclose(r.base_score, sum(math.log10((learned[w] + 1) / (total + len(learned) + 1)) for w in words))


def test_a_shard_is_sent_once_and_its_tree_built_once(spark, monkeypatch):
    from kobza.llm import vantage_tree

    for name, value in {"SHARD": 100, "BLOCK": 10, "LEAF": 16, "SHARDS": 1000}.items():
        monkeypatch.setattr(vantage_tree, name, value, raising=False)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    x[:60] = x[0] + rng.normal(size=(60, 6)) * 0.01
    built = spark.sparkContext.accumulator(0)

    class Counted(vantage_tree.VantageTree):
        def __init__(self, points):
            built.add(1)
            super().__init__(points)

    monkeypatch.setattr(vantage_tree, "VantageTree", Counted)
    found = {}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in vantage_tree.nearest_neighbours(df, F.col("vec_id") % 4 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = u @ u.T
    np.fill_diagonal(g, -3)
    assert found == {q: np.argsort(-g[q], kind="stable")[:5].tolist() for q in range(0, 400, 4)}
    assert built.value == 4  # shards of 100 points, which ten blocks of queries meet


def test_driver_collects_its_garbage_between_rounds(spark, monkeypatch):
    from kobza.llm import components, toxicity

    calls = []
    for module in (components, toxicity):
        monkeypatch.setattr(module, "release", lambda session: calls.append(session), raising=False)
    found = components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
    assert {(r.id, r.component) for r in found.collect()} == {(i, 0) for i in range(10)} and len(calls) >= 2
    docs = spark.createDataFrame([(i, "foul word" if i % 2 else "fine word") for i in range(40)], "doc_id long, text string")
    before = len(calls)
    score_toxicity(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int"), F.lit(False)).collect()
    assert len(calls) > before
