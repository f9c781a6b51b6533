"""Language-model scores by online logistic context mixing.

A text is read as its words, lower-cased over A-Z and joined by single spaces, and one end symbol; the model gives every
bit of every byte a probability, so a text's is a product and sums to one over all texts.

* Bit predictors: for each order (1 to 5, and 7) the last bytes and the bits of the present one are the key of a count of
  zeros and ones over all learning documents. Counts are exact: no two contexts share one. They are dealt out by the last
  three bytes of the context and never gathered, so they grow with the corpus; only those of orders 1 and 2, which all
  buckets need, are broadcast (at most 2^24 by their form).
* Mixer: the predictors' logits are summed with weights from two sets, each chosen by a gate, and the two sums are
  averaged. One gate is the bit's place and the highest order that has seen the context often, seldom or never, the other
  the bit's place and the last byte. All learning documents teach it: they are dealt into folds, and a fold's bytes meet
  counts without that fold, so that predictors don't meet what they have counted. Each bucket learns online; then weights
  are averaged by the number of bits that chose them.
* Refinement: an adaptive probability map from the mixer's logit and the last byte, counted while the mixer learns; the
  result is the mean of both.

For scoring the model is frozen. The probability of a byte then depends on the seven bytes before it alone, so it is found
once for each distinct sequence of eight bytes, where its counts are, and sent to the documents that have it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kobza.llm.common import durable, durable_by, free_shuffles, shuffle_width, trimmed
from kobza.llm.jaccard import LOWER, Shingler, blocks, from_planes, mix, planes

ORDERS = [1, 2, 3, 4, 5, 7]
DEPTH = max(ORDERS)
#: Orders up to this one have their counts broadcast; parts in which they are added up, and grams of a task that wait for it.
LOW, LOW_PARTS, LOW_WAITING = 2, 16, 1 << 20
#: Folds of the learning documents.
FOLDS = 4
END = b"\n"
BLOCK = 3 << 19  # bytes of a block; each has some hundred bytes of intermediate numbers
SOURCE = 16 << 20  # bytes of texts whose sequences are sent, and whose costs come back, together
BUCKET = 16 << 20  # bytes of texts for each bucket of contexts, or more buckets where the session has more partitions
BUCKETS = 33  # of the adaptive map, by logit
PRIOR = 0.05  # zeros and ones that a context has before any is counted
START, RATE, HITS = 0.3, 0.03, 30  # weights at the start, step of learning, and bits that the start counts as
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # times a number: its hash is in the first bits
SETS = [len(ORDERS) * 2 + 1, 256]
MAP = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, BUCKETS))), (256, 1))


def canonical(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def n_tokens(parts: list[bytes]) -> np.ndarray:
    """Words and the end of each text."""
    return np.array([p.count(b" ") + 2 if p else 1 for p in parts], np.int64)


def context_of(keys: np.ndarray, order: int) -> np.ndarray:
    return (keys >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)


def grams_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Key of every byte of the texts and of their ends (DEPTH bytes before it, then itself), and each text's first key."""
    before = END * DEPTH
    data = np.frombuffer(before + before.join(p + END for p in parts), np.uint8).astype(np.uint64)
    keys = np.zeros(len(data) - DEPTH, np.uint64)
    for i in range(DEPTH + 1):
        keys = (keys << np.uint64(8)) | data[i : i + len(keys)]
    lengths = np.array([len(p) + 1 for p in parts])
    starts = np.cumsum([0, *(lengths + DEPTH)])[:-1]
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return keys[inside], np.concatenate([[0], np.cumsum(lengths)[:-1]])


def pack(x: np.ndarray | bytes) -> bytes:
    """Compressed, as checkpoints are not; numbers by byte place."""
    data = x if isinstance(x, bytes) else planes(x)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unpack(data: bytes, kind: type = bytes):
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return raw if kind is bytes else from_planes(raw, kind)


def uniques(x: np.ndarray) -> np.ndarray:
    """As np.unique, which takes far longer for numbers without order."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their counts (one row each) added up, and each key's place among them."""
    order = np.argsort(keys)
    first = np.diff(keys[order], prepend=~keys[order[:1]]) != 0
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    return keys[order[starts]], np.add.reduceat(counts[order], starts, axis=0) if len(keys) else counts, at


def dealt(swapped: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a source's distinct grams (last byte first, sorted) are sent, and their buckets in this order."""
    bucket = (mix(context_of(swapped.byteswap(), 3)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 65536 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order].astype(np.int64)


def sources(df: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """Per source (some documents of a task): their texts in blocks, with the learning documents and their tokens, and by bucket
    of the last three context bytes the distinct grams, with counts by fold of learning documents. Grams are sent last byte
    first, sorted: so they compress best. home: a bucket for grams and a source for texts, by which they are needed together."""

    def counted(waiting: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        by_fold = [(fold, *np.unique(np.concatenate([g for f, g in waiting if f == fold]), return_counts=True)) for fold in sorted({f for f, _ in waiting})]
        keys = uniques(np.concatenate([k for _, k, _ in by_fold]))
        counts = np.zeros((FOLDS, len(keys)), np.uint32)
        for fold, k, n in by_fold:
            if fold < FOLDS:
                counts[fold, np.searchsorted(keys, k)] = n
        return keys, counts

    def packed(source: int, waiting: list[tuple]) -> Iterator[tuple]:
        keys, counts = counted(waiting)
        order, bucket = dealt(keys, buckets)
        keys, counts = keys[order], counts[:, order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            yield int(bucket[a]), source, int(bucket[a]), pack(keys[a:b]), pack(counts[:, a:b].ravel()), *[None] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, waiting, size, kind = TaskContext.get().partitionId() << 32, [], 0, None
        block = source

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            types = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.list_(kind), pa.list_(pa.bool_()), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["home", "source", "bucket", "grams", "counts", "texts", "keys", "held", "block", "tokens", "documents"])

        for batch in batches:
            at, kind = 0, batch.schema.field(0).type
            for keys, texts in blocks(iter([batch]), BLOCK):
                parts = [b" ".join(canonical(t)) for t in texts]
                held, fold = (batch.column(i).slice(at, len(keys)).to_numpy(zero_copy_only=False) for i in (2, 3))
                at += len(keys)
                learning = ~held.astype(bool)
                yield batch_of([(source, source, None, None, None, pack(END.join(parts)), keys.to_pylist(), held.tolist(), block, int(n_tokens(parts)[learning].sum()), int(learning.sum()))])
                block += 1
                fold = np.where(learning, fold, FOLDS)
                for f in np.unique(fold):
                    own = [parts[i] for i in np.flatnonzero(fold == f)]
                    waiting.append((int(f), grams_of(own)[0].byteswap()))
                size += sum(map(len, parts)) + len(parts)
                if size > SOURCE:
                    for row in packed(source, waiting):
                        yield batch_of([row])
                    source, waiting, size = source + 1, [], 0
        if waiting:
            for row in packed(source, waiting):
                yield batch_of([row])

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, text, "held_out", "fold").mapInArrow(trimmed(run), f"home long, source long, bucket int, grams binary, counts binary, texts binary, keys array<{key_type}>, held array<boolean>, block long, tokens long, documents long")


def counts_of(data: bytes) -> np.ndarray:
    return unpack(data, np.uint32).reshape(FOLDS, -1).T.astype(np.int64)


def low_counts(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams of order LOW with their counts by fold, over all sources."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, shift = [(np.zeros(0, np.uint64), np.zeros((0, FOLDS), np.int64))], 0, np.uint64(8 * (DEPTH - LOW))
        for batch in batches:
            for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = unpack(g, np.uint64) >> shift  # last byte first and sorted: equal ones stand together
                starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                found.append(((own[starts] << shift).byteswap(), np.add.reduceat(counts_of(c), starts, axis=0)))
                size += len(starts)
                if size > LOW_WAITING:
                    found, size = [merged(*map(np.concatenate, zip(*found, strict=True)))[:2]], 0
        keys, counts, _ = merged(*map(np.concatenate, zip(*found, strict=True)))
        where = mix(keys) % np.uint64(LOW_PARTS)
        rows = [(k, planes(keys[own]), counts[own].tobytes()) for k in range(LOW_PARTS) if (own := where == k).any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "grams", "counts"])

    def total(rows: pa.Table) -> pa.Table:
        keys, counts, _ = merged(np.concatenate([from_planes(x, np.uint64) for x in rows["grams"].to_pylist()]), np.concatenate([np.frombuffer(x, np.int64).reshape(-1, FOLDS) for x in rows["counts"].to_pylist()]))
        return pa.table([pa.array([planes(keys)], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["grams", "counts"])

    found = grams.select("grams", "counts").mapInArrow(part, "part int, grams binary, counts binary").groupBy("part").applyInArrow(total, "grams binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(from_planes(r.grams, np.uint64) for r in found)])
    counts = np.concatenate([np.zeros((0, FOLDS), np.int64), *(np.frombuffer(r["counts"], np.int64).reshape(-1, FOLDS) for r in found)])
    return merged(keys, counts)[:2]


def mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


class Counts:
    """Exact counts, by fold, of every context of the distinct grams of one bucket."""

    def __init__(self, low: tuple[np.ndarray, np.ndarray], keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts, self.grams, self.at = keys, counts, {}, {}
        self.last = context_of(keys, 1).astype(np.int64)
        for k in ORDERS:
            own = keys & mask(k)
            if k > LOW:
                distinct, total, self.at[k] = merged(own, counts)
            else:
                every, total, _ = merged(low[0] & mask(k), low[1])
                context = every >> np.uint64(8)
                used = np.isin(context, uniques(own >> np.uint64(8)))
                distinct, total = every[used], total[used]
                self.at[k] = np.searchsorted(distinct, own)
            self.at[k] = self.at[k].astype(np.int32)
            self.grams[k] = distinct, np.ascontiguousarray(total.T)

    def bits(self, d: int) -> np.ndarray:
        return ((self.keys >> np.uint64(7 - d)) & np.uint64(1)).astype(np.float64)

    def runs(self, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each gram's context of order k with the byte's bits before bit d; by fold the zeros and ones of bit d there."""
        keys, total = self.grams[k]
        before = keys >> np.uint64(8 - d)
        first = np.concatenate([[True], before[1:] != before[:-1]])
        starts = np.flatnonzero(first)
        bit = (keys >> np.uint64(7 - d)) & np.uint64(1) > 0
        ones = np.add.reduceat(np.where(bit, total, 0), starts, axis=1)
        return np.cumsum(first, dtype=np.int32) - np.int32(1), np.add.reduceat(total, starts, axis=1) - ones, ones

    def seen(self, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones of bit d in each context of order k with the byte's bits before, by fold."""
        run, zeros, ones = self.runs(k, d)
        return zeros.T[run], ones.T[run]

    def contexts(self, d: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per order: every gram's context with the bits before d, and by fold the zeros and ones there."""
        out = []
        for k in ORDERS:
            run, zeros, ones = self.runs(k, d)
            out.append((run[self.at[k]], zeros, ones))
        return out

    def tables(self, contexts: list, fold: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per order: logits and gates of the contexts, without a fold if one is given."""
        out = []
        for i, (_, *both) in enumerate(contexts):
            zeros, ones = (c.sum(0) - (0 if fold is None else c[fold]) for c in both)
            logits = np.log((ones + PRIOR) / (zeros + PRIOR)).astype(np.float32)
            out.append((np.clip(logits, -11.7, 11.7), np.array([0, 2 * i + 1, 2 * i + 2], np.int8)[(zeros + ones > 0).astype(np.int8) + (zeros + ones > 3)]))
        return out

    def inputs(self, rows: np.ndarray, contexts: list, tables: list) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all orders with a constant, and the gate of the highest order seen, of the grams."""
        x, gate = np.empty((len(rows), len(ORDERS) + 1), np.float32), np.zeros(len(rows), np.int8)
        x[:, -1] = 0.3
        for i, ((at, *_), (logits, gates)) in enumerate(zip(contexts, tables, strict=True)):
            own = at[rows]
            x[:, i] = logits[own]
            np.maximum(gate, gates[own], out=gate)
        return x, gate


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def added(at: np.ndarray, values: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values * c, n) for c in columns], axis=1)


class Mixer:
    """Mixer weights and the adaptive map."""

    def __init__(self) -> None:
        self.weights = [np.full((8 * sets, len(ORDERS) + 1), START) for sets in SETS]
        self.map = MAP

    @staticmethod
    def of_bit(sets: list[np.ndarray], d: int) -> list[np.ndarray]:
        """The rows that bit d chooses from, of each weight set or what belongs to it."""
        return [sets[0][d * SETS[0] : (d + 1) * SETS[0]], sets[1][d::8]]

    @staticmethod
    def sums(x: np.ndarray, weights: list[np.ndarray], gates: list[np.ndarray]) -> list[np.ndarray]:
        return [np.clip(np.einsum("ij,ij->i", x, np.take(w, g, axis=0)), -11, 11) for w, g in zip(weights, gates, strict=True)]

    @staticmethod
    def place(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (np.clip(logit, -7.999, 7.999) + 8) * ((BUCKETS - 1) / 16)
        return place.astype(np.int64), place % 1

    def costs(self, counts: Counts) -> np.ndarray:
        """log10 probabilities of the grams' last bytes."""
        out = np.zeros(len(counts.keys))
        for d in range(8):
            contexts, bit = counts.contexts(d), counts.bits(d)
            tables, weights = counts.tables(contexts), self.of_bit(self.weights, d)
            for a in range(0, len(out), 8192):
                rows = slice(a, min(a + 8192, len(out)))
                last = counts.last[rows]
                x, gate = counts.inputs(np.arange(rows.start, rows.stop), contexts, tables)
                sums = self.sums(x.astype(np.float64), weights, [gate, last])
                logit = (sums[0] + sums[1]) / 2
                low, part = self.place(logit)
                refined = self.map[last, low] * (1 - part) + self.map[last, low + 1] * part
                p = np.clip((squash(logit) + refined) / 2, 1e-6, 1 - 1e-6)
                out[rows] += np.log10(np.where(bit[rows] > 0, p, 1 - p))
        return out

    def learn(self, counts: Counts) -> list[np.ndarray]:
        """Learns online from all learning documents' grams. Returns what can be added up over buckets: for each weight set
        the bits that chose a row, and its weights times them; hits and ones of the map."""
        squares = [np.full(w.shape, 1e-6) for w in self.weights]
        chosen = [np.zeros(len(w)) for w in self.weights]
        hits, ones = np.zeros(256 * BUCKETS), np.zeros(256 * BUCKETS)
        rng = np.random.default_rng(len(counts.keys))
        for d in range(8):
            bit, contexts = counts.bits(d), counts.contexts(d)
            views = [self.of_bit(x, d) for x in (self.weights, squares, chosen)]
            for fold in rng.permutation(FOLDS):
                rows = np.flatnonzero(counts.counts[:, fold])
                if not len(rows):
                    continue
                size, turn = min(8192, max(128, len(rows) // 64)), rng.permutation(len(rows))
                rows = rows[np.concatenate([np.sort(turn[a : a + size]) for a in range(0, len(rows), size)])]
                inputs, gate = counts.inputs(rows, contexts, counts.tables(contexts, fold))
                last, times, b = (x[rows] for x in (counts.last, counts.counts[:, fold].astype(np.float64), bit))
                gates, near = [gate.astype(np.int64), last], np.empty(len(rows), np.int64)
                for n, g in zip(views[2], gates, strict=True):
                    n += np.bincount(g, times, len(n))
                for a in range(0, len(rows), size):
                    at = slice(a, a + size)
                    x, t, o, own = inputs[at].astype(np.float64), times[at], b[at], [g[at] for g in gates]
                    sums, columns = self.sums(x, views[0], own), np.ascontiguousarray(x.T)
                    low, part = self.place((sums[0] + sums[1]) / 2)
                    near[at] = own[1] * BUCKETS + low + (part > 0.5)
                    for w, q, g, s in zip(*views[:2], own, sums, strict=True):
                        step = added(g, t * (o - squash(s)), columns, len(w))
                        q += step * step
                        w += RATE * step / np.sqrt(q)
                hits += np.bincount(near, times, len(hits))
                ones += np.bincount(near, times * b, len(ones))
        return [*(x for w, n in zip(self.weights, chosen, strict=True) for x in (n, w * n[:, None])), hits, ones]

    def average(self, found: list[np.ndarray]) -> None:
        """Takes over what the buckets have learned."""
        for i, w in enumerate(self.weights):
            n, total = found[2 * i], found[2 * i + 1].reshape(w.shape)
            self.weights[i] = (total + HITS * w) / (n + HITS)[:, None]
        hits, ones = (x.reshape(MAP.shape) for x in found[4:])
        self.map = (ones + HITS * MAP) / (hits + HITS)


def counts_in(rows: pa.Table, low: tuple[np.ndarray, np.ndarray], folds: bool = True) -> tuple[Counts, list[np.ndarray]]:
    """Counts of a bucket's rows, by fold or (with low ones alike) in one sum, and the places of each row's grams in them."""
    grams = [unpack(x, np.uint64) for x in rows["grams"].to_pylist()]
    swapped = uniques(np.concatenate(grams))
    order = np.argsort(swapped.byteswap())
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    counts, at = np.zeros((FOLDS if folds else 1, len(order)), np.int64), []
    for own, packed in zip(grams, rows["counts"].to_pylist(), strict=True):
        at.append(place[np.searchsorted(swapped, own)])
        number = unpack(packed, np.uint32).reshape(FOLDS, -1)
        for total, n in zip(counts, number if folds else [number.sum(0)], strict=True):
            total[at[-1]] += n.astype(np.int64)  # a row has no gram twice
    return Counts(low, swapped.byteswap()[order], np.ascontiguousarray(counts.T)), at


def fit_mixer(grams: DataFrame, low, buckets: int) -> Mixer:
    mixer = Mixer()
    shapes = [n for sets in SETS for n in (8 * sets, 8 * sets * (len(ORDERS) + 1))] + [MAP.size] * 2
    width = int(np.ceil(np.sqrt(buckets)))  # buckets whose sums are added before they come to the driver

    def learn(rows: pa.Table) -> pa.Table:
        found = np.concatenate([x.ravel() for x in Mixer().learn(counts_in(rows.sort_by("source"), low.value)[0])])
        bucket = rows["bucket"][0].as_py()
        return pa.table([pa.array([bucket], pa.int32()), pa.array([bucket // width], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["bucket", "part", "found"])

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        return pa.table([rows["part"].slice(0, 1).combine_chunks(), pa.array([sum(np.frombuffer(x) for x in rows["found"].to_pylist()).tobytes()], pa.binary())], names=["part", "found"])

    parts = grams.groupBy("bucket").applyInArrow(learn, "bucket int, part int, found binary").groupBy("part").applyInArrow(add, "part int, found binary").collect()
    if parts:
        total = sum(np.frombuffer(r.found) for r in sorted(parts, key=lambda r: r.part))
        mixer.average(np.split(total, np.cumsum(shapes)[:-1]))
    return mixer


def gram_costs(grams: DataFrame, low, mixer) -> DataFrame:
    """Per source and bucket: the cost of each gram, in the order in which they were sent."""

    def run(rows: pa.Table) -> pa.Table:
        keys, total = low.value
        counts, at = counts_in(rows, (keys, total.sum(1, keepdims=True)), False)
        costs = mixer.value.costs(counts).astype(np.float32)
        found = [pack(costs[own]) for own in at]
        return pa.table([rows["source"].combine_chunks(), rows["bucket"].combine_chunks().cast(pa.int32()), pa.array(found, pa.binary())], names=["source", "bucket", "costs"])

    return grams.groupBy("bucket").applyInArrow(run, "source long, bucket int, costs binary")


def text_scores(read: DataFrame, costs: DataFrame, key: str, key_type: str, buckets: int) -> DataFrame:
    """Per document: key, held_out, n_tokens, score, block and place there. Each source's texts meet the costs of their grams."""

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        texts = rows["texts"].to_pylist()
        keys = uniques(np.concatenate([uniques(grams_of(unpack(t).split(END))[0].byteswap()) for t in texts]))
        order = np.argsort(sent["bucket"].to_numpy())
        cost, packed = np.empty(len(keys)), sent["costs"].to_pylist()
        cost[dealt(keys, buckets)[0]] = np.concatenate([unpack(packed[i], np.float32) for i in order])
        shift = np.uint64(64 - min(24, 2 + len(keys).bit_length()))
        slots = np.zeros(1 << (64 - int(shift)), np.int32)  # the place of a gram that has this hash; the others are searched
        slots[(keys * SPREAD >> shift).astype(np.int64)] = np.arange(len(keys), dtype=np.int32)
        number, scores = [], []
        for t in texts:
            parts = unpack(t).split(END)
            grams, starts = grams_of(parts)
            grams = grams.byteswap()
            at = slots[(grams * SPREAD >> shift).astype(np.int64)]
            lost = np.flatnonzero(keys[at] != grams)
            at[lost] = np.searchsorted(keys, grams[lost])
            number.append(n_tokens(parts))
            scores.append(np.add.reduceat(cost[at], starts))
        sizes = [len(x) for x in number]
        of = [pa.array([x for part in rows[c].to_pylist() for x in part], t) for c, t in (("keys", rows["keys"].type.value_type), ("held", pa.bool_()))]
        places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        return pa.table([*of, *(pa.array(np.concatenate(x)) for x in (number, scores)), pa.array(np.repeat(rows["block"].to_numpy(), sizes)), pa.array(places)], names=[key, "held_out", "n_tokens", "score", "block", "place"])

    texts = read.where("bucket is null").select("home", "block", "texts", "keys", "held")
    return texts.groupBy("home").cogroup(costs.groupBy("source")).applyInArrow(run, f"{key} {key_type}, held_out boolean, n_tokens long, score double, block long, place int")


def word_blocks(read: DataFrame, bits: int) -> DataFrame:
    """Rows of one block of texts and bucket of word hashes: the distinct words, their count in learning documents, and for every
    document which of them it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for block, text, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts, held = unpack(text).split(END), np.array(held, bool)
                n = n_tokens(parts) - 1
                hashes, _ = shingler.word_hashes(np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8))
                owner = np.repeat(np.arange(len(n), dtype=np.uint32), n)
                words, inverse = np.unique(hashes, return_inverse=True)
                learned = np.bincount(inverse[~held[owner]], minlength=len(words)).astype(np.uint32)
                bucket = (words >> np.uint64(64 - bits)).astype(np.int32)
                order = np.argsort(bucket[inverse], kind="stable")
                token, owner = inverse[order], owner[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(cuts[1:], len(bucket)) if len(cuts) else cuts
                token_cuts = np.searchsorted(bucket[token], bucket[cuts], "left")
                token_ends = np.searchsorted(bucket[token], bucket[cuts], "right")
                rows = []
                for a, b, c, d in zip(cuts, ends, token_cuts, token_ends, strict=True):
                    kind = np.uint16 if b - a < 65536 else np.uint32
                    rows.append((planes(words[a:b]), planes(learned[a:b]), planes(np.bincount(owner[c:d], minlength=len(n)).astype(np.uint32)), planes((token[c:d] - a).astype(kind))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([block] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=["bucket", "block", "words", "learned", "counts", "tokens"])

    return read.where("bucket is null").select("block", "texts", "held").mapInArrow(trimmed(run), "bucket int, block long, words binary, learned binary, counts binary, tokens binary")


def block_sums(sent: DataFrame) -> DataFrame:
    """Back to each block: for its documents the sum of log10(c + 1) and the known tokens of one bucket. Each bucket's first
    row has its number of distinct learned words."""

    def run(rows: pa.Table) -> pa.Table:
        counts, learned, tokens = (rows[c].to_pylist() for c in ("counts", "learned", "tokens"))
        hashes = [from_planes(x, np.uint64) for x in rows["words"].to_pylist()]
        words, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([from_planes(x, np.uint32) for x in learned]), minlength=len(words))
        at, out = 0, []
        for i, h in enumerate(hashes):
            c = total[inverse[at : at + len(h)]]
            at += len(h)
            number = from_planes(counts[i], np.uint32)
            token = from_planes(tokens[i], np.uint16 if len(h) < 65536 else np.uint32)
            has = np.flatnonzero(number)
            starts = np.concatenate([[0], np.cumsum(number[has])[:-1]]).astype(np.int64)
            logs, known = np.log10(c + 1)[token], (c > 0)[token].astype(np.int64)
            out.append((has.astype(np.uint32).tobytes(), np.add.reduceat(logs, starts).tobytes(), np.add.reduceat(known, starts).astype(np.uint32).tobytes(), int((total > 0).sum()) if i == 0 else 0))
        arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)]
        return pa.table([rows["block"].combine_chunks(), *arrays], names=["block", "owner", "logs", "known", "distinct"])

    return sent.groupBy("bucket").applyInArrow(run, "block long, owner binary, logs binary, known binary, distinct long")


def score_texts(df: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows where held_out is false. A null text is an empty one: only its end is a token. Repeated rows are
    counted and scored as often as they occur; further columns are not read. Where nothing can be learned all counts are
    0 and the model's probabilities are those of its start. Texts and grams are sent where they are needed once, and what one
    phase has sent is deleted before the next one: base scores, learning, scores.
    """
    spark = df.sparkSession
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(key, text, held_out.alias("held_out"), F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int").alias("fold"))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(shuffle_width(spark), -(-size // BUCKET))
    read = durable_by(sources(rows, key, text, buckets), buckets, "home")
    free_shuffles(spark)
    bits = max(3, min(30, (buckets - 1).bit_length()))
    sums = durable(block_sums(word_blocks(read, bits)))
    free_shuffles(spark)
    number = sums.agg(F.sum("distinct")).first()[0] or 0
    tokens, documents = (x or 0 for x in read.agg(F.sum("tokens"), F.sum("documents")).first())
    grams = read.where("bucket is not null").select(F.col("home").alias("bucket"), "source", "grams", "counts")
    low = spark.sparkContext.broadcast(low_counts(grams))
    mixer = spark.sparkContext.broadcast(fit_mixer(grams, low, buckets))
    free_shuffles(spark)
    floor = float(np.log10(tokens + number + (1 if documents else 0) + 1))

    def gather(rows: pa.Table, sent: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        n = rows["n_tokens"].to_numpy()
        logs, known = np.zeros(len(n)), np.zeros(len(n), np.int64)
        for o, x, k in zip(*(sent[c].to_pylist() for c in ("owner", "logs", "known")), strict=True):
            at = np.frombuffer(o, np.uint32)
            logs[at] += np.frombuffer(x, np.float64)
            known[at] += np.frombuffer(k, np.uint32)
        logs += np.log10(documents + 1)
        known += documents > 0
        return pa.table([rows[key], rows["held_out"], rows["n_tokens"], pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(logs - n * floor), rows["score"]], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scores = text_scores(read, gram_costs(grams, low, mixer), key, key_type, buckets)
    return scores.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(gather, f"{key} {key_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
