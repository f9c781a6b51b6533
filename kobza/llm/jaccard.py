"""Exact Jaccard self-join on word shingles by a grouped prefix join, for components of linked documents.

1. Documents with equal sets form a class, which its smallest key stands for.
2. Every document's distinct shingles are hashed in blocks of documents; copies within a block are sent once. Hashes are
   dealt by value, packed. Each bucket counts in how many classes a shingle occurs and answers each block with its shared
   ones only: a shingle of one class can't be part of an intersection with another. A shingle that many documents of a
   block have is counted there, and only its count is dealt, so that a very common one is no hot key. A document with too
   few shared shingles to reach the threshold leaves; most do.
3. Shingles are ordered by count, rare ones first. Two sets that reach the threshold share one of the first
   ``n - ceil(t * n) + 1``, the prefix. Representatives with identical prefixes and sizes form one group; posting lists
   from prefix shingles hold groups. Group pairs are filtered by size and by place (what two sets have from the shared
   shingle on must suffice for the threshold), then expanded, and members are verified.
4. What is asked for is components, so a list is not expanded into all its pairs. In the first round every list's first
   document is a pivot: it is compared with every member of the list. Later, only lists with members in several
   components are open; there, documents outside the component that has most of the list are pivots, and a pivot is
   compared with the members in other components. Once all of them have been pivots, no unknown link can join two
   documents of the list, and it is closed. Up to LIMIT pivots of a list serve in the second round, LIMIT times as many
   in each further one. Equal labels mean connected documents in every round; only the last labels are full components.
5. A pivot's set is sent once to each bucket of partners, not once a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kobza.llm.common import durable, release, semi_join, shrink_executors, shuffle_width, trimmed
from kobza.llm.components import connected_components, star

WIDTH, PERCENT = 5, 75
#: Documents and bytes of a block; a longer document is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 2000, 4 << 20
#: Bytes whose words are hashed together.
PIECE = 256 << 10
#: Bytes of text for each bucket of shingles, and bytes of sets for each bucket of partners.
BUCKET_BYTES, SPOT_BYTES = 4 << 20, 8 << 20
#: A shingle of more than this share of a block's classes is counted in the block.
COMMON = 1 / 32
#: Pivots of one list in the second round.
LIMIT = 256
LOW = np.uint64((1 << 48) - 1)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEPARATOR = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
PRIME = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(PRIME))
PLACE_VALUES = mix(np.arange(1001, 1001 + WIDTH, dtype=np.uint64) * np.uint64(PRIME)) | np.uint64(1)


class Shingler:
    """Distinct 64-bit shingle hashes of many texts at once."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            steps = np.full(n, PRIME, np.uint64), np.full(n, pow(PRIME, -1, 1 << 64), np.uint64)
            for s in steps:
                s[0] = 1
            self.powers, self.inverses = (np.multiply.accumulate(s) for s in steps)

    def word_hashes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of every word. data begins and ends with a separator. It is read in pieces that end at one, as a
        byte takes some sixty bytes of intermediate numbers; only a longer word is a piece of its own."""
        hashes, places, at = [], [], 0
        while at < len(data) - 1:
            stop = min(at + PIECE, len(data) - 1)
            while not SEPARATOR[data[stop]]:
                ahead = np.flatnonzero(SEPARATOR[data[stop : stop + PIECE]])
                stop = stop + int(ahead[0]) if len(ahead) else min(stop + PIECE, len(data) - 1)
            piece = data[at : stop + 1]
            self.grow(len(piece))
            word = ~SEPARATOR[piece]
            edge = np.flatnonzero(word[1:] != word[:-1]) + 1
            starts, ends = edge[::2], edge[1::2]
            sums = np.cumsum(BYTE_VALUES[piece] * self.powers[: len(piece)], dtype=np.uint64)
            hashes.append(mix((sums[ends - 1] - sums[starts - 1]) * self.inverses[starts]))
            places.append(starts + at)
            at = stop
        return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *places])

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [(t or "").encode("utf-8", "replace").translate(LOWER) for t in texts]
        offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
        hashes, starts = self.word_hashes(np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8))
        bounds = np.searchsorted(starts, offsets + 1)
        with np.errstate(over="ignore"):
            windows = np.zeros(max(0, len(hashes) - WIDTH + 1), np.uint64)
            for i, c in enumerate(PLACE_VALUES):
                windows += hashes[i : i + len(windows)] * c
            windows = mix(windows)
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a >= WIDTH:
                    out.append(np.unique(windows[a : b - WIDTH + 1]))
                elif b > a:
                    out.append(mix(np.array([(hashes[a:b] * PLACE_VALUES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)])))
                else:
                    out.append(np.zeros(0, np.uint64))
        return out


def short(x: np.ndarray) -> np.ndarray:
    """The low six bytes of each number."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6]


def from_short(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return raw.view(np.uint64).ravel()


def planes(x: np.ndarray) -> bytes:
    """Numbers by byte place: sorted and small ones compress well like that."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def blocks(batches: Iterator[pa.RecordBatch], longest: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, list]]:
    """Keys and texts (strings or bytes) of some rows of a batch at a time; only these rows' texts are Python objects."""
    for batch in batches:
        lengths, at, size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 0, 0
        for i, n in enumerate(lengths):
            if i > at and (i - at == BLOCK_ROWS or size + n > longest):
                yield batch.column(0).slice(at, i - at), batch.column(1).slice(at, i - at).to_pylist()
                at, size = i, 0
            size += n
        if lengths:
            yield batch.column(0).slice(at), batch.column(1).slice(at).to_pylist()


def codes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits + 48 bits of hashes; the first bits of them are the bucket."""
    return hashes >> np.uint64(16 - bits)


def packed_blocks(df: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """Rows of one block and bucket: classes with their digests and counts, the low 48 bits of their codes, and those of common
    shingles with their counts. One row of each block also has its keys, set sizes and set digests, each document's
    place of its class, and where the common shingles occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, partition = Shingler(), TaskContext.get().partitionId()
        for number, (keys, texts) in enumerate(blocks(batches)):
            sets = shingler.sets(texts)
            sizes = np.array([len(s) for s in sets], np.int32)
            every = np.concatenate(sets)
            digests = np.zeros((2, len(sets)), np.uint64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            with np.errstate(over="ignore"):
                for row, salt in enumerate((np.uint64(PRIME), np.uint64(0xD1B54A32D192ED03))):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(every ^ salt), dtype=np.uint64)])
                    digests[row] = sums[ends[1:]] - sums[ends[:-1]]
            _, first, place = np.unique(np.stack([digests[0], digests[1], sizes.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
            place = first[place.ravel()].astype(np.int32)  # the document that stands for each one's class in this block
            stands = place == np.arange(len(sets))
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
            sent = stands[owner]
            owner, every = owner[sent], codes(every[sent], bits)
            values, back, times = np.unique(every, return_inverse=True, return_counts=True)
            common = times > max(8, COMMON * stands.sum())
            hot = common[back]
            hot_order = np.argsort(back[hot], kind="stable")
            hot_values, hot_times, hot_owner = values[common], times[common].astype(np.uint32), owner[hot][hot_order].astype(np.uint32)
            owner, every = owner[~hot], every[~hot]
            bucket, hot_bucket = (every >> np.uint64(48)).astype(np.int32), (hot_values >> np.uint64(48)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, owner, raw = bucket[order], owner[order], short(every[order])
            hot_raw = short(hot_values)
            block = (partition << 32) | number
            rows = []
            used = np.union1d(bucket, hot_bucket)
            cuts, hot_cuts = ((np.searchsorted(x, used), np.searchsorted(x, used, "right")) for x in (bucket, hot_bucket))
            for b, start, stop, hot_start, hot_stop in zip(used.tolist(), *cuts, *hot_cuts, strict=True):
                count = np.bincount(owner[start:stop], minlength=len(sets))
                has = np.flatnonzero(count)
                common_here = (hot_raw[hot_start:hot_stop].tobytes(), planes(hot_times[hot_start:hot_stop])) if hot_stop > hot_start else (None, None)
                rows.append((b, planes(np.concatenate([has, count[has]]).astype(np.uint32)), short(digests[0][has]).tobytes(), raw[start:stop].tobytes(), *common_here, *[None] * 7))
            meta = keys.to_pylist(), sizes.tolist(), digests[0].view(np.int64).tolist(), digests[1].view(np.int64).tolist(), place.tolist()
            rows.append((block % (1 << bits), *[None] * 5, *meta, hot_values.tobytes() + hot_times.tobytes(), planes(hot_owner)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), *[pa.binary()] * 5, pa.list_(keys.type), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([arrays[0], pa.array([block] * len(rows), pa.int64()), *arrays[1:]], names=["bucket", "block", "counts", "digests", "low", "common", "times", *META])

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(trimmed(run), f"bucket int, block long, counts binary, digests binary, low binary, common binary, times binary, {meta_schema(key_type)}")


META = ["keys", "sizes", "h1", "h2", "place", "hot", "hot_owner"]


def meta_schema(key_type: str) -> str:
    return f"keys array<{key_type}>, sizes array<int>, h1 array<long>, h2 array<long>, place array<int>, hot binary, hot_owner binary"


def answers(dealt: DataFrame, key_type: str) -> DataFrame:
    """Back to each block: owner, code and class count of its shared shingles, counts of its common ones, and its meta."""

    def count(rows: pa.Table) -> pa.Table:
        block, counts, digests, low, common, times = (rows[c].to_pylist() for c in ("block", "counts", "digests", "low", "common", "times"))
        bucket = np.uint64(rows["bucket"][0].as_py()) << np.uint64(48)
        own = [i for i, c in enumerate(counts) if c is not None]
        out_owner, out_hash, out_df, out_common = ([None] * len(block) for _ in range(4))
        if own:
            parts, owners, sides = [], [], []
            for i in own:
                parts.append(from_short(low[i]))
                has, number = from_planes(counts[i], np.uint32).reshape(2, -1)
                owners.append(np.repeat(has, number))
                sides.append(np.repeat(from_short(digests[i]), number))
            hots = {i: (from_short(common[i]), from_planes(times[i], np.uint32)) for i in own if common[i]}
            hashes, side = np.concatenate(parts), np.concatenate(sides)
            order = np.lexsort((side, hashes))
            h, c = hashes[order], side[order]
            values = np.unique(np.concatenate([h, *(v for v, _ in hots.values())]))
            total = np.zeros(len(values), np.uint32)
            new_class = np.ones(len(h), bool)
            new_class[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            total += np.bincount(np.searchsorted(values, h[new_class]), minlength=len(values)).astype(np.uint32)
            for v, t in hots.values():
                total[np.searchsorted(values, v)] += t
            for i, part, owner in zip(own, parts, owners, strict=True):
                df = total[np.searchsorted(values, part)]
                shared = df > 1
                if shared.any():
                    out_owner[i], out_hash[i], out_df[i] = planes(owner[shared]), (part[shared] | bucket).tobytes(), planes(df[shared])
            for i, (v, _) in hots.items():
                out_common[i] = (v | bucket).tobytes() + total[np.searchsorted(values, v)].tobytes()
        table = pa.table([pa.array(block, pa.int64()), *(pa.array(c, pa.binary()) for c in (out_owner, out_hash, out_df, out_common)), *(rows[c].combine_chunks() for c in META)], names=["block", "owner", "hash", "df", "common", *META])
        has = [k is not None or bool(h) or bool(c) for k, h, c in zip(rows["keys"].to_pylist(), out_hash, out_common, strict=True)]
        return table.filter(pa.array(has, pa.bool_()))

    return dealt.groupBy("bucket").applyInArrow(count, f"block long, owner binary, hash binary, df binary, common binary, {meta_schema(key_type)}")


def counted(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, offset=8 * n)


def profiles(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: key, n, h1, h2, and where it can have a link and is its class's first in its block: shared (its shared
    shingles, sorted, as bytes), tokens (its prefix, in the order of prefixes), g (digest of size and prefix)."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(8, min(16, (size // BUCKET_BYTES).bit_length()))
    key_type = df.schema[key].dataType.simpleString()

    def gather(rows: pa.Table) -> pa.Table:
        meta = next(r for r in rows.select(META).to_pylist() if r["keys"] is not None)
        n, place = np.array(meta["sizes"], np.int64), np.array(meta["place"])
        owner, df_ = (np.concatenate([np.zeros(0, np.uint32), *(from_planes(x, np.uint32) for x in rows[c].to_pylist() if x)]) for c in ("owner", "df"))
        hashes = np.frombuffer(b"".join(x for x in rows["hash"].to_pylist() if x), np.uint64)
        hot, times = counted(meta["hot"])
        if len(hot):
            found = [counted(x) for x in rows["common"].to_pylist() if x]
            value, number = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(value)
            number = number[order][np.searchsorted(value[order], hot)]
            owner, hashes, df_ = np.concatenate([owner, from_planes(meta["hot_owner"], np.uint32)]), np.concatenate([hashes, np.repeat(hot, times)]), np.concatenate([df_, np.repeat(number, times)])
        order = np.lexsort((hashes, df_, owner))
        hashes, bounds = hashes[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])
        needed = -(-n * PERCENT // 100)
        shared, tokens, group = [], [], []
        for i, (a, b, k, m) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), needed.tolist(), n.tolist(), strict=True)):
            if not m or place[i] != i or b - a < k:
                shared.append(None), tokens.append(None), group.append(None)
                continue
            prefix = hashes[a : a + (b - a - k + 1)]
            shared.append(np.sort(hashes[a:b]).tobytes())
            tokens.append(prefix.view(np.int64))
            group.append(hashlib.blake2b(prefix.tobytes() + m.to_bytes(8, "little"), digest_size=16).digest())
        return pa.table([pa.array(meta["keys"], rows["keys"].type.value_type), pa.array(n), pa.array(meta["h1"], pa.int64()), pa.array(meta["h2"], pa.int64()), pa.array(shared, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(group, pa.binary())], names=[key, "n", "h1", "h2", "shared", "tokens", "g"])

    dealt = packed_blocks(df, key, text, bits).repartition(max(shuffle_width(df.sparkSession), size // (16 * BUCKET_BYTES)), "bucket")
    return answers(dealt, key_type).groupBy("block").applyInArrow(gather, f"{key} {key_type}, n long, h1 long, h2 long, shared binary, tokens array<long>, g binary")


def verified(pairs: DataFrame, sets: DataFrame, spots: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Each set goes to its spot, and a's set to the spots of its partners."""
    id_type = sets.schema["id"].dataType.simpleString()

    def spot(name: str) -> F.Column:
        return F.pmod(F.xxhash64(name), F.lit(spots)).cast("int").alias("spot")

    def check(asked: pa.Table, held: pa.Table) -> pa.Table:
        where = {k: i for i, k in enumerate(held["id"].to_pylist())}
        sets_here = [np.frombuffer(x, np.uint64) for x in held["shared"].to_pylist()]
        n_here = held["n"].to_numpy()
        found_a, found_b = [], []
        for a, n, data, partners in zip(asked["a"].to_pylist(), asked["na"].to_pylist(), asked["sa"].to_pylist(), asked["partners"].to_pylist(), strict=True):
            own = np.frombuffer(data, np.uint64)
            for at in range(0, len(partners), 256):
                part = partners[at : at + 256]
                places = [where[b] for b in part]
                them = [sets_here[i] for i in places]
                every = np.concatenate(them)
                hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
                overlap = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum([len(t) for t in them])[:-1]]))
                near = 100 * overlap >= PERCENT * (n + n_here[places] - overlap)
                found_b += [b for b, ok in zip(part, near.tolist(), strict=True) if ok]
                found_a += [a] * int(near.sum())
        kind = held.schema.field("id").type
        return pa.table([pa.array(found_a, kind), pa.array(found_b, kind)], names=["a", "b"])

    asked = pairs.groupBy("a", spot("b")).agg(F.collect_set("b").alias("partners"))
    sent = asked.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa")), "a").select("spot", "a", "na", "sa", "partners")
    held = sets.select(spot("id"), F.col("id").alias("id"), F.col("n").alias("n"), F.col("shared").alias("shared"))
    return sent.groupBy("spot").cogroup(held.groupBy("spot")).applyInArrow(check, f"a {id_type}, b {id_type}")


NEAR = f"100 * least(n, na) >= {PERCENT} * greatest(n, na) and {100 + PERCENT} * least(room, ra) >= {PERCENT} * (n + na)"


def links(sets: DataFrame) -> DataFrame:
    """Components of linked sets. sets: id (unique), n, shared, tokens, g. Returns id and component where they differ or link."""
    id_type = sets.schema["id"].dataType.simpleString()
    size = sets.agg(F.sum(F.octet_length("shared"))).first()[0] or 0
    spots = max(64, size // SPOT_BYTES)
    member = sets.select("g", F.col("id").alias("b"))
    groups = sets.groupBy("g").agg(F.min("id").alias("lead"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.count("*").alias("m"))
    # room: how many shared shingles a set has from this one on; each overlap that begins here has at most so many.
    reach = (F.size("tokens") + F.ceil(F.col("n") * PERCENT / 100) - 1).cast("int").alias("reach")
    postings = durable(groups.select("g", "lead", "n", "m", reach, F.posexplode("tokens").alias("place", "f")).select("f", "g", "lead", "n", "m", (F.col("reach") - F.col("place")).alias("room")))
    release(sets.sparkSession)
    heads = postings.groupBy("f").agg(F.min(F.struct("lead", "n", "room")).alias("p"), F.sum("m").alias("members")).where("members > 1")
    # A list row is a group, with the list's pivot of the first round.
    lists = durable(postings.join(heads, "f").select("f", "g", "n", "room", "members", F.col("p.lead").alias("a"), F.col("p.n").alias("na"), F.col("p.room").alias("ra")))
    first = lists.where(NEAR).select("a", "g").distinct().join(member, "g").where("a <> b").select("a", "b")
    edges = verified(first, sets, spots).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = durable(star(star(edges, True), False))
    release(sets.sparkSession)
    shrink_executors(sets.sparkSession)
    lists, limit, turn = lists.where("members > 2").select("f", "g", "n", "room"), LIMIT, 1
    while True:
        labels = stars.groupBy(F.col("u").alias("b")).agg(F.min("v").alias("c"))
        labelled = durable(member.join(labels, "b", "left").select("g", "b", F.coalesce("c", "b").alias("c")))
        rows = lists.join(labelled, "g")
        release(sets.sparkSession)
        shares = rows.groupBy("f", "c").agg(F.count("*").alias("k"))
        most = shares.groupBy("f").agg(F.max(F.struct("k", "c")).alias("most"), F.sum("k").alias("k"), F.count("*").alias("parts")).where("parts > 1")
        open_lists = durable(most.select("f", F.col("most.c").alias("main"), (F.col("k") - F.col("most.k")).alias("outside")))
        if open_lists.isEmpty():
            break
        rows = durable(lists.join(open_lists, "f"))
        pivots = rows.join(labelled, "g").where(f"c <> main and pmod(xxhash64(b, {turn}), ceil(outside / {limit})) = 0")
        pivots = pivots.select("f", F.col("b").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("room").alias("ra"))
        # Group pairs pass the filters of size and place before their members are expanded.
        near = rows.select("f", "g", "n", "room").join(pivots, "f").where(NEAR).select("a", "ca", "g").distinct()
        pairs = durable(near.join(labelled, "g").where("c <> ca").select("a", "b"))
        release(sets.sparkSession)
        if not pairs.isEmpty():
            ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
            fresh = verified(pairs, semi_join(sets, durable(ids), ["id"]), spots)
            stars = durable(star(star(stars.unionByName(fresh.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), True), False))
        lists = rows.where(F.col("outside") > limit).select("f", "g", "n", "room")
        if lists.isEmpty():
            break
        limit, turn = limit * LIMIT, turn + 1
        release(sets.sparkSession)
        shrink_executors(sets.sparkSession)
    return connected_components(stars.select(F.col("u").alias("a"), F.col("v").alias("b")))


def jaccard_components(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key that links reach, its own included).

    Words are case-folded over A-Z and separated by ASCII white space. A text with fewer than five words is one shingle;
    one without words, or null, has none and links with nothing, as does a row whose key is null (its component_id is null).
    Rows with equal texts always link (ties in similarity or size change nothing); repeated rows and rows of one key each
    give a row, with the component of all that share the key's texts. A very long text is a block of its own and is taken
    whole. An empty table gives an empty one. Further columns are not read, whatever their names. Sets are compared by
    hashes of 56 to 64 bits, so components are exact up to collisions of these.
    """
    profile = durable(profiles(df.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text")), "_id", "_text"))
    release(df.sparkSession)
    shrink_executors(df.sparkSession)
    classes = profile.where("n > 0 and _id is not null").groupBy("n", "h1", "h2").agg(F.min("_id").alias("id"), F.first("shared", True).alias("shared"), F.first("tokens", True).alias("tokens"), F.first("g", True).alias("g"))
    # A key whose rows differ is several vertices, which hashes stand for; else the key is the vertex.
    classes = durable(classes)
    repeated = not classes.groupBy("id").count().where("count > 1").isEmpty()
    classes = classes.withColumn("v", F.xxhash64("id", "n", "h1", "h2") if repeated else F.col("id"))
    # Only sets that differ from another class's can link further; the rest of a class follows its representative.
    component = links(classes.where("shared is not null").select(F.col("v").alias("id"), "n", "shared", "tokens", "g")).withColumnRenamed("id", "v")
    named = classes.select("n", "h1", "h2", "id", "v").join(component, "v", "left")
    if repeated:
        least = named.groupBy(F.coalesce("component", "v").alias("_c")).agg(F.min("id").alias("_component"))
        named = named.withColumn("_c", F.coalesce("component", "v")).join(least, "_c")
    named = named.select("n", "h1", "h2", "_component" if repeated else F.coalesce("component", "id").alias("_component"))
    out = profile.select("_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    return out.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id")).alias("component_id"))
