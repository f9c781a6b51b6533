"""Best-fit packing of tokenized documents into sequences of a fixed length.

A document is its token ids and a separator; one longer than a sequence is cut into pieces of full length, whose first
may be shorter. Which pieces share a sequence depends on their lengths alone, and there are no more lengths than a
sequence has tokens. So the driver plans on the histogram of lengths (bounded by the sequence length, whatever the
number of pieces), and pieces find their place from their rank among those of their length.

The plan is a bin completion. Best-fit decreasing is the first incumbent. While it needs more sequences than the bound
(all tokens by capacity, and what pieces beyond half a sequence force), sequences are completed around the largest length
left: undominated fillings come in the order of their waste, found by the sums that the lengths left can reach, so that
no branch is followed to a sum out of reach. A branch is pruned when its waste exceeds what one sequence less than the
incumbent allows; each better plan becomes the incumbent. The search first repeats each sequence's best filling while its
lengths last. Then it branches over all undominated fillings of the sequences in which waste arises, and as many full ones.
Bin packing is NP-hard: the branching search ends after NODES fillings, and best_plan says whether the result is proven.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kobza.llm.common import durable, trimmed

#: Distinct chunks that one task remembers; beyond it the memory is emptied, which costs time only.
MEMORY = 400_000
#: Fillings looked at by the branching search; sequences that it rearranges at a time, from the most wasteful on.
NODES, TAIL = 30_000, 64
NONE: set[str] = set()
PIECES = "piece int, start long, length long, ids_crc32 long"


class Chunks(dict):
    """Ids by chunk, found at the first lookup."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = ids = self.encode(chunk, NONE)
        return ids


class ChunkEncoder:
    """Ids of whole texts by a byte-level BPE vocabulary, found once for each distinct chunk.

    Byte-level BPE with the usual pattern never joins a space to what stands before it, so a text without runs of spaces
    can be cut before each space, and its ids are those of its chunks. Chunks are encoded from the same vocabulary's
    ranks (ranks: that file), the texts that can't be cut by the tokenizers library; a test holds one against the other.
    """

    def __init__(self, path: str, ranks: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(ranks, "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encode = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})._core_bpe.encode_to_tiktoken_buffer
        self.chunks = Chunks(encode)
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = []
        for t in texts:
            if "  " in t or "\0" in t or any([m in t for m in self.marks]):
                out.append(self.whole(t))
                continue
            if len(self.chunks) > MEMORY:
                self.chunks.clear()
            out.append(b"".join(map(self.chunks.__getitem__, t.replace(" ", "\0 ").split("\0"))))
        return out


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """start, length and crc32 of a document's pieces."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for s, e in zip(starts, [*starts[1:], n], strict=True)]


def tokenize_pieces(df: DataFrame, path: str, ranks: str, capacity: int, separator: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document's pieces. A null text is an empty one: its only piece is the separator."""
    key_type = df.schema[key].dataType.simpleString()
    tail = np.array([separator], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                encoder = encoder or ChunkEncoder(path, ranks)
                rows, out = [], []
                for i, ids in enumerate(encoder.encode_all([t or "" for t in batch.column(1).to_pylist()])):
                    for piece, x in enumerate(cut(ids + tail, capacity)):
                        rows.append(i)
                        out.append((piece, *x))
                piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[key, "piece", "start", "length", "ids_crc32"])

    return df.select(key, text).mapInArrow(trimmed(run), f"{key} {key_type}, {PIECES}")


def best_fit(counts: list[int], room: int) -> list[int]:
    """The largest lengths that still fit, one after the other. counts: by length."""
    out = []
    length = min(room, len(counts) - 1)
    while length > 0:
        if counts[length] > out.count(length):
            out.append(length)
            room -= length
            length = min(room, length)
        else:
            length -= 1
    return out


def bound(counts: list[int], capacity: int) -> int:
    """Sequences that no plan can do without: for each small size k, pieces beyond capacity - k need one each, and the
    tokens of the others down to k fill what pieces beyond half a sequence leave."""
    total = sum(x * n for x, n in enumerate(counts))
    best = -(-total // capacity)
    for k in range(1, capacity // 2 + 1):
        alone = sum(counts[capacity - k + 1 :])
        big, room = 0, 0
        for x in range(capacity // 2 + 1, capacity - k + 1):
            big, room = big + counts[x], room + counts[x] * (capacity - x)
        small = sum(x * counts[x] for x in range(k, capacity // 2 + 1))
        best = max(best, alone + big + max(0, -(-(small - room) // capacity)))
    return best


def dominated(filling: list[int], counts: list[int], slack: int) -> bool:
    """Whether one unused piece could take the place of some of the filling's, or of its waste, and leave them for later."""
    sums = {0: 0}  # sum of a part of the filling: the fewest pieces that give it
    for x in filling:
        for total, number in list(sums.items()):
            sums[total + x] = min(number + 1, sums.get(total + x, number + 1))
    for total, number in sums.items():
        for y in range(max(1, total), min(total + slack, len(counts) - 1) + 1):
            if counts[y] > filling.count(y) and (y > total or number > 1):
                return True
    return False


def fillings(counts: list[int], room: int, most: int) -> Iterator[list[int]]:
    """Undominated fillings of the room with a waste of most at the utmost, least waste first, larger lengths first."""
    lengths = [x for x in range(min(room, len(counts) - 1), 0, -1) if counts[x]]
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(lengths) + 1)  # bit s: the lengths from here on can sum to s
    for i in range(len(lengths) - 1, -1, -1):
        x, bits = lengths[i], reach[i + 1]
        left, step = min(counts[x], room // x), 1
        while left > 0:  # multiples by doubling
            take = min(step, left)
            bits |= (bits << (x * take)) & mask
            left, step = left - take, step * 2
        reach[i] = bits
    for waste in range(min(most, room) + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        stack = [(0, room - waste, ())]
        while stack:
            i, left, chosen = stack.pop()
            if not left:
                if not dominated(list(chosen), counts, waste):
                    yield list(chosen)
                continue
            x = lengths[i]
            if reach[i + 1] >> left & 1:
                stack.append((i + 1, left, chosen))
            n = 1
            while n <= counts[x] and n * x <= left:
                if reach[i + 1] >> (left - n * x) & 1:
                    stack.append((i + 1, left - n * x, chosen + (x,) * n))
                n += 1


def counts_of(histogram: dict[int, int], capacity: int) -> list[int]:
    return [histogram.get(x, 0) for x in range(capacity + 1)]


Plan = list[tuple[list[int], int]]


def plan(histogram: dict[int, int], capacity: int, search: bool = True) -> Plan:
    """Fillings (lengths of one sequence, descending) and how many sequences have each; each one's best is repeated."""
    counts = counts_of(histogram, capacity)
    out = []
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            counts[largest] -= 1
            room = capacity - largest
            filling = [largest, *(next(fillings(counts, room, room)) if search else best_fit(counts, room))]
            counts[largest] += 1
            times = min(counts[x] // filling.count(x) for x in set(filling))
            for x in filling:
                counts[x] -= times
            out.append((filling, times))
    return out


def used(found: Plan) -> int:
    return sum(times for _, times in found)


def branch_and_bound(counts: list[int], capacity: int, incumbent: int, nodes: int) -> tuple[list[list[int]] | None, int]:
    """A plan with fewer sequences than the incumbent, or None; and the nodes left (0: the search was not finished)."""
    counts, total, least = list(counts), sum(x * n for x, n in enumerate(counts)), bound(counts, capacity)
    if least >= incumbent:
        return None, nodes
    spare = (incumbent - 1) * capacity - total  # waste that a better plan may have

    def open_sequence(waste: int) -> Iterator[list[int]]:
        largest = next(x for x in range(capacity, 0, -1) if counts[x])
        counts[largest] -= 1
        for rest in fillings(counts, capacity - largest, spare - waste):
            counts[largest] += 1
            yield [largest, *rest]
            counts[largest] -= 1
        counts[largest] += 1

    path: list[list[int]] = []
    wastes, trail = [0], [open_sequence(0)]
    while trail and nodes:
        filling = next(trail[-1], None)
        if filling is None:
            trail.pop()
            wastes.pop()
            if path:
                for x in path.pop():
                    counts[x] += 1
            continue
        nodes -= 1
        path.append(filling)
        for x in filling:
            counts[x] -= 1
        if not any(counts):
            return path, nodes
        wastes.append(wastes[-1] + capacity - sum(filling))
        trail.append(open_sequence(wastes[-1]))
    return None, nodes


def best_plan(histogram: dict[int, int], capacity: int, nodes: int = NODES) -> tuple[Plan, bool]:
    """The plan, and whether it is proven that none has fewer sequences."""
    counts = counts_of(histogram, capacity)
    least = bound(counts, capacity)
    best = plan(histogram, capacity, search=False)
    if used(best) > least:
        best = min(best, plan(histogram, capacity), key=used)
    proven = used(best) == least
    size = TAIL
    while not proven and nodes:
        # The most wasteful sequences, and as many others, whose pieces are dealt anew.
        order = sorted(best, key=lambda f: sum(f[0]))
        tail, kept, left = [], [], size
        for filling, times in order:
            some = min(times, left)
            left -= some
            if some:
                tail.append((filling, some))
            if times > some:
                kept.append((filling, times - some))
        own = [0] * (capacity + 1)
        for filling, times in tail:
            for x in filling:
                own[x] += times
        found, after = branch_and_bound(own, capacity, used(tail), min(nodes, NODES // 4))
        nodes -= min(nodes, NODES // 4) - after
        if found:
            best = kept + [(f, 1) for f in found]
            proven = used(best) == least
        elif not kept:
            proven = after > 0
            break
        else:
            size *= 2
    return best, proven


def places(fillings: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int, list[int]]]]:
    """By length, in the order of ranks: first rank, pieces a sequence, first sequence, their offsets."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for filling, times in fillings:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in filling:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, own in offsets.items():
            out.setdefault(x, []).append((ranks.get(x, 0), len(own), first, own))
            ranks[x] = ranks.get(x, 0) + times * len(own)
        first += times
    return out


def pack_pieces(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to capacity. order: columns that tell rows apart."""
    spark = pieces.sparkSession
    dealt = durable(pieces).withColumn("_part", F.spark_partition_id())
    counted = dealt.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    found = spark.sparkContext.broadcast({x: (own, [o[0] for o in own]) for x, own in places(best_plan(histogram, capacity)[0]).items()})
    own_rank = F.row_number().over(Window.partitionBy("_part", "length").orderBy(*order)) - 1
    ranked = dealt.withColumn("_own", own_rank).join(starts, ["_part", "length"]).withColumn("_rank", F.col("_before") + F.col("_own"))
    kept = [c for c in pieces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("_rank").to_pylist(), strict=True):
                own, firsts = found.value[length]
                start, each, first, at = own[bisect_right(firsts, rank) - 1]
                sequences.append(first + (rank - start) // each)
                offsets.append(at[(rank - start) % each])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*kept, "_rank").mapInArrow(trimmed(run), schema)


def pack_documents(df: DataFrame, path: str, ranks: str, capacity: int = 1024, separator: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts give one piece of the separator alone; a very long text gives as many pieces as it needs. Repeated
    rows are packed as often as they occur, and ties (pieces of one length) are ranked within their partition by key and
    piece. Columns besides key and text are not read, whatever their names; an empty table gives an empty one.
    """
    return pack_pieces(tokenize_pieces(df, path, ranks, capacity, separator, text, key), capacity, [key, "piece", "ids_crc32"])
