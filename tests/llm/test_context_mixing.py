"""Context mixing: what is counted, what teaches the mixer, and how far contexts reach."""

import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kobza.llm.context_mixing import DEPTH, FOLDS, ORDERS, START, Counts, Mixer, canonical, gram_costs, grams_of, low_counts, mask, merged, sources, text_scores


def counts_by_fold(keys: np.ndarray, folds: np.ndarray) -> Counts:
    one = np.zeros((len(keys), FOLDS), np.int64)
    one[np.arange(len(keys)), folds] = 1
    keys, counts, _ = merged(keys, one)
    return Counts(merged(keys & mask(2), counts)[:2], keys, counts)


def test_no_two_contexts_share_a_count():
    rng = np.random.default_rng(5)
    n = 300_000  # far more contexts with bits than tables of 2**20 slots hold without collisions
    keys = rng.integers(0, 1 << 62, n, dtype=np.uint64) & mask(DEPTH)
    counts = counts_by_fold(np.concatenate([keys, keys[:1000]]), rng.integers(0, FOLDS, n + 1000))
    every = np.concatenate([keys, keys[:1000]])
    for k in ORDERS:
        for d in (0, 3, 7):
            before = (every & mask(k)) >> np.uint64(8 - d)
            bit = (every >> np.uint64(7 - d)) & np.uint64(1)
            seen = Counter(zip(before.tolist(), bit.tolist(), strict=True))
            zeros, ones = (c.sum(1)[counts.at[k]] for c in counts.seen(k, d))
            own = ((counts.keys & mask(k)) >> np.uint64(8 - d)).tolist()
            assert zeros.tolist() == [seen[c, 0] for c in own] and ones.tolist() == [seen[c, 1] for c in own]


def test_all_learning_documents_teach_the_mixer():
    texts = [b"a word %d" % i for i in range(400)] + ["рідко ж".encode()]
    parts = [grams_of([t])[0] for t in texts]
    counts = counts_by_fold(np.concatenate(parts), np.repeat(np.arange(len(texts)) % FOLDS, [len(p) for p in parts]))
    mixer = Mixer()
    found = mixer.learn(counts)
    assert found[0].sum() == found[2].sum() == found[4].sum() == 8 * sum(map(len, parts))
    mixer.average(found)
    rows = np.array([b * 8 + d for b in {*b"\n".join(texts)} for d in range(8)])
    assert (mixer.weights[1][rows] != START).any(axis=1).all()


def test_contexts_of_seven_bytes():
    ends = {b"xa-----": b"1", b"yb-----": b"2"}
    texts = [a + b for a, b in ends.items()] * 40
    keys = np.concatenate([grams_of([t])[0][7:8] for t in texts])
    counts = counts_by_fold(keys, np.arange(len(keys)) % FOLDS)
    mixer = Mixer()
    mixer.average(mixer.learn(counts))
    assert len(counts.keys) == 2 and (mixer.costs(counts) > np.log10(0.7)).all()


def test_grams_are_not_sent_back_with_their_costs(spark):
    texts = ["Слово за словом", "a word and a word", "", None, "x" * 40] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("held_out", F.expr("doc_id % 5 = 1")).withColumn("fold", F.expr(f"cast(doc_id % {FOLDS} as int)"))
    read = sources(df.repartition(3), "doc_id", "text", 4).localCheckpoint()
    grams = read.where("bucket is not null").select("bucket", "source", "grams", "counts")
    mixer, low = Mixer(), low_counts(grams)
    sent = gram_costs(grams, spark.sparkContext.broadcast(low), spark.sparkContext.broadcast(mixer))
    assert sorted(sent.columns) == ["bucket", "costs", "source"]
    found = {r.doc_id: r.score for r in text_scores(read, sent, "doc_id", "bigint", 4).collect()}
    keys = [grams_of([b" ".join(canonical(t))])[0] for t in texts]
    counts = counts_by_fold(np.concatenate(keys), np.repeat(np.arange(len(texts)) % FOLDS, [len(k) for k in keys]))
    held = np.repeat(np.arange(len(texts)) % 5 == 1, [len(k) for k in keys])
    learned = counts_by_fold(np.concatenate(keys)[~held], np.repeat(np.arange(len(texts)) % FOLDS, [len(k) for k in keys])[~held])
    own = np.zeros_like(counts.counts)
    own[np.searchsorted(counts.keys, learned.keys)] = learned.counts
    costs = mixer.costs(Counts(low, counts.keys, own))
    assert all(abs(found[i] - costs[np.searchsorted(counts.keys, k)].sum()) < 1e-4 for i, k in enumerate(keys))


def test_grams_are_dealt_once_and_phases_free_their_shuffles(spark, monkeypatch):
    from kobza.llm import context_mixing

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv

    def shuffled():
        return {x.rpartition("/")[2] for x in env.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").splitlines() if x.endswith(".data")}

    before, left, plans = shuffled(), [], []

    def seen(name):
        def call(grams, *a, f=getattr(context_mixing, name)):
            deadline = time.time() + 5  # files are deleted in another thread
            while shuffled() - before and time.time() < deadline:
                time.sleep(0.1)
            left.append((name, shuffled() - before))
            out = f(grams, *a)
            plans.append(grams.groupBy("bucket").applyInArrow(lambda t: t, grams.schema)._jdf.queryExecution().toString())
            return out

        return call

    for name in {"word_blocks", "gram_costs"} & set(vars(context_mixing)):
        monkeypatch.setattr(context_mixing, name, seen(name), raising=False)
    rows = [(i, f"Some words of text {i} and {i % 7} more") for i in range(60)]
    assert len(context_mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 0).collect()) == 60
    assert left[-1][0] == "gram_costs" and not any(x for _, x in left), left
    assert "Exchange" not in plans[-1]
