"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word in both directions, is trained in numpy by backpropagation through time, and
labels every position with probabilities of the languages; a document's are the mean over all positions of all its words.
States start anew at each word (and after SPAN bytes in a longer one), so a word is labelled once a task however often
it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kobza.llm.common import sample_keys, trimmed

#: Learning documents per language and learning steps; hidden units a direction; bytes read without a new start.
DOCUMENTS, STEPS, HIDDEN, SPAN = 64, 500, 16, 24
#: Distinct words that one task remembers; beyond it the memory is emptied, which costs time only.
MEMORY = 400_000
#: ASCII letters in lower case, bytes beyond ASCII as they are, white space for the rest.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNKNOWN = "und"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(LETTERS).split()


def spans(words: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the bytes of all words' spans of that length, and the words they belong to."""
    found: dict[int, tuple[list[bytes], list[int]]] = {}
    for i, w in enumerate(words):
        for at in range(0, len(w), SPAN):
            part = w[at : at + SPAN]
            own = found.setdefault(len(part), ([], []))
            own[0].append(part)
            own[1].append(i)
    return {n: (np.frombuffer(b"".join(parts), np.uint8).reshape(-1, n), np.array(at)) for n, (parts, at) in found.items()}


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters: for each direction the input rows, the recurrent matrix and biases; one output layer for both."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, k = hidden, len(languages)
        self.languages, self.h = languages, h
        self.p = {f"{n}{d}": v for d in "fb" for n, v in (("E", rng.normal(0, 0.3, (256, 3 * h))), ("U", rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))), ("c", np.zeros(3 * h)))}
        self.p |= {"W": rng.normal(0, 0.3, (2 * h, k)), "d": np.zeros(k)}
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    def forward(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction at every position. x: rows of equal length."""
        h, E, U, c = self.h, self.p["E" + d], self.p["U" + d], self.p["c" + d]
        n, length = x.shape
        state, out = np.zeros((n, h), np.float32), np.empty((length, n, h), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a, b = E[x[:, t]] + c, state @ U
            gates = logistic(a[:, : 2 * h] + b[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, new, b[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by position, row and language."""
        states = np.concatenate([self.forward(x, "f"), self.forward(x, "b")], axis=2)
        y = states @ self.p["W"] + self.p["d"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        return y / y.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions. y: the language of each row."""
        h, p = self.h, self.p
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.forward(x, d, kept[d]) for d in "fb"], axis=2)
        logits = states @ p["W"] + p["d"]
        q = np.exp(logits - logits.max(axis=2, keepdims=True))
        q /= q.sum(axis=2, keepdims=True)
        q[:, np.arange(len(x)), y] -= 1
        q /= q.shape[0] * q.shape[1]
        g = {"W": np.einsum("tnh,tnk->hk", states, q), "d": q.sum(axis=(0, 1))}
        back = q @ p["W"].T
        for i, d in enumerate("fb"):
            g |= {n + d: np.zeros_like(p[n + d]) for n in "EUc"}
            onward = np.zeros((len(x), h), np.float32)
            for t, before, z, r, new, b in reversed(kept[d]):
                ds = back[t, :, i * h : (i + 1) * h] + onward
                dnew = ds * (1 - z) * (1 - new * new)
                da = np.concatenate([ds * (before - new) * z * (1 - z), dnew * b * r * (1 - r), dnew], axis=1)
                db = da.copy()
                db[:, 2 * h :] = dnew * r
                np.add.at(g["E" + d], x[:, t], da)
                g["c" + d] += da.sum(axis=0)
                g["U" + d] += before.T @ db
                onward = ds * z + db @ p["U" + d].T
        return g

    def train(self, words: list[bytes], languages: list[int], steps: int = STEPS, batch: int = 256, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        y = np.array(languages)
        groups = {n: (x, y[at]) for n, (x, at) in spans(words).items()}
        lengths = sorted(groups)
        weight = np.array([groups[n][0].size for n in lengths], float)
        m, v = ({n: np.zeros_like(a) for n, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            x, own = groups[lengths[rng.choice(len(lengths), p=weight / weight.sum())]]
            rows = rng.integers(0, len(x), batch)
            now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for n, g in self.gradients(x[rows], own[rows]).items():
                m[n] = 0.9 * m[n] + 0.1 * g
                v[n] = 0.99 * v[n] + 0.01 * g * g
                self.p[n] -= (now * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def sums(self, words: list[bytes]) -> np.ndarray:
        """For each word, its positions' probabilities summed, then their number."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        if not self.languages:
            return out
        for n, (x, at) in spans(words).items():
            for i in range(0, len(x), 4096):
                part = self.label(x[i : i + 4096]).sum(axis=0)
                np.add.at(out[:, :-1], at[i : i + 4096], part)
                np.add.at(out[:, -1], at[i : i + 4096], n)
        return out


class Labeller:
    """Pools documents; labels of words are remembered."""

    def __init__(self, network: Network):
        self.network, self.known, self.rows = network, {}, np.zeros((0, len(network.languages) + 1), np.float32)

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.known) > MEMORY:
            self.known, self.rows = {}, self.rows[:0]
        split = [words_of(t) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        self.known |= {w: i for i, w in enumerate(new, len(self.known))}
        self.rows = np.concatenate([self.rows, self.network.sums(new)])
        out = []
        for text, words in zip(texts, split, strict=True):
            if not words or not (any(w[0] < 128 for w in words) or any(c.isalpha() for c in text)) or not self.network.languages:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.rows[list(map(self.known.__getitem__, words))].sum(axis=0, dtype=np.float64)
            best = int(total[:-1].argmax())
            out.append((self.network.languages[best], float(min(1.0, total[best] / total[-1]))))
        return out


def fit_network(documents: DataFrame, held_out: Column, text: str, key: str, lang: str) -> Network:
    """From at most DOCUMENTS documents of each language outside the held-out part."""
    learn = documents.where(~held_out & F.col(lang).isNotNull() & F.col(text).isNotNull())
    keys = sample_keys(learn.select(key, lang), key, DOCUMENTS, [lang])
    rows = learn.select(key, lang, text).join(F.broadcast(keys.select(key)), key, "left_semi").orderBy(key).collect()
    network = Network(sorted({r[lang] for r in rows}))
    place = {x: i for i, x in enumerate(network.languages)}
    pairs = sorted({(w, place[r[lang]]) for r in rows for w in words_of(r[text])})
    if pairs:
        network.train([w for w, _ in pairs], [i for _, i in pairs])
    return network


def identify_languages(documents: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Per document: key, the columns to keep, held_out, lang_pred, score (the predicted language's pooled probability).

    Learns from rows where held_out is false and lang is not null. A text that is null or has no letter gets "und" and
    score 0, and so does every text where there is nothing to learn from. Documents are labelled on their own: repeated
    rows get equal labels, ties go to the first language in order, further columns are not read.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit_network(documents, held_out, text, key, lang))
    kept = [key, *(c for c in keep or [] if c != key)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                labeller = labeller or Labeller(model.value)
                found = labeller.documents(batch.column(texts_at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept) + 1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*kept, "held_out", "lang_pred", "score"])

    types = dict(documents.dtypes)
    texts_at = kept.index(text) if text in kept else len(kept) + 1  # a text that is kept is sent once
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "held_out boolean", "lang_pred string", "score double"])
    return documents.select(*(f"`{c}`" for c in kept), held_out.alias("held_out"), *([] if text in kept else [F.col(text).alias("_text")])).mapInArrow(trimmed(run), schema)
