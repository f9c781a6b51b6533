"""Nearest neighbours by vantage-point trees, one for each shard.

Vectors are scaled to length one, so that nearness by cosine is nearness by distance. Equal vectors are one point that
carries its smallest keys. A tree splits its points at the median distance from a vantage point; a whole block of
queries walks it together, and a query skips a side when the triangle inequality puts all of that side beyond its present
radius. The bound is multiplied by a factor: above one sides are skipped sooner and neighbours may be lost, at one the
search is exact. Each shard's tree is built once for a lot of query blocks. In vectors without structure (as many
independent dimensions as these have) no bound skips a leaf at factor one; leaves are then read by products of matrices.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kobza.llm.common import durable, trim_memory
from kobza.llm.vectors import cosines, matrix, unit, usable

#: Points of a shard and queries of a block on average, points of a leaf, blocks that meet a shard together.
SHARD, BLOCK, LEAF, LOT = 16384, 1024, 512, 512
#: A larger table has larger shards, up to so many bytes of vectors, as every shard is sent all queries; shards that are enough.
SHARD_BYTES, SHARDS = 32 << 20, 64
TIES = 1e-9  # scores nearer than this are compared exactly


class VantageTree:
    """node: a leaf's points, or its vantage point with each side's least and largest distance and node."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self.build(np.arange(len(points)))

    def build(self, own: np.ndarray):
        if len(own) <= LEAF:
            return np.sort(own)
        spot = own[0]
        g = self.points[own[1:]] @ self.points[spot]
        far = own[1:][g.argmin()] if len(own) > 2 else spot  # a point at the rim splits better
        rest = own[own != far]
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.points[rest] @ self.points[far])))
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        sides = []
        for part in (order[:half], order[half:]):
            sides.append((float(d[part].min()), float(d[part].max()), self.build(rest[part])))
        return far, sides


class Search:
    """The k nearest points of a block of queries; skip: each query's own point, or -1."""

    def __init__(self, tree: VantageTree, queries: np.ndarray, k: int, skip: np.ndarray, factor: float):
        self.tree, self.queries, self.k, self.skip, self.factor = tree, queries, k, skip, factor
        self.best = np.full((len(queries), k), -2.0)  # cosines, the k-th first
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.walk(tree.root, np.arange(len(queries)))

    def offer(self, who: np.ndarray, points: np.ndarray) -> np.ndarray:
        queries = self.queries if len(who) == len(self.queries) else self.queries[who]
        g = queries @ self.tree.points[points].T
        if len(points) <= LEAF // 8:
            g[self.skip[who][:, None] == points[None, :]] = -3.0
        else:  # points are sorted
            at = np.minimum(np.searchsorted(points, self.skip[who]), len(points) - 1)
            own = np.flatnonzero(points[at] == self.skip[who])
            g[own, at[own]] = -3.0
        least = self.best[who, 0]
        if g.shape[1] >= self.k and (least <= -2.0).any():  # at first most of a leaf is nearer than nothing
            least = np.maximum(least, np.partition(g, g.shape[1] - self.k, axis=1)[:, -self.k])
        i, j = np.divmod(np.flatnonzero(g >= np.maximum(least - TIES, -2.5)[:, None]), g.shape[1])
        if len(i):
            near = g[i, j]
            self.found.append((who[i], points[j], near))
            rows, times = np.unique(i, return_counts=True)
            both = np.full((len(rows), self.k + times.max()), -3.0)
            both[:, : self.k] = self.best[who[rows]]
            both[np.repeat(np.arange(len(rows)), times), self.k + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)] = near
            self.best[who[rows]] = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :], axis=1)
        return g

    def walk(self, node, who: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            if len(node) and len(who):
                self.offer(who, node)
            return
        spot, sides = node
        g = self.queries[who] @ self.tree.points[spot]
        self.offer(who, np.array([spot]))
        d = np.sqrt(np.maximum(0, 2 - 2 * g))
        nearer_first = (0, 1) if (d <= sides[0][1]).mean() >= 0.5 else (1, 0)
        for s in nearer_first:
            low, high, child = sides[s]
            bound = np.maximum(0, np.maximum(d - high, low - d)) * self.factor
            radius = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(self.best[who, 0], -1.0))) + 1e-7
            go = bound <= radius
            if go.any():
                self.walk(child, who[go])

    def results(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries and points that may be among the k nearest."""
        who, points, g = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = g >= self.best[who, 0] - TIES
        return who[keep], points[keep]


def shards_of(points: int, n: int, size: int) -> int:
    """The number of shards for so many points of n components of so many bytes."""
    return math.ceil(points / min(max(SHARD, points // SHARDS), max(LEAF, SHARD_BYTES // (n * size))))


def packed(rows: DataFrame, group: str, kind: str, id_type: str) -> DataFrame:
    dtype = np.float32 if "float" in kind else np.float64

    def run(table: pa.Table) -> pa.Table:
        x = matrix(table["vector"]).astype(dtype)
        return pa.table([pa.array([table[group][0].as_py()], pa.int32()), table["n"][:1].combine_chunks(), pa.array([table["ids"].to_pylist()], pa.list_(pa.list_(table["ids"].type.value_type))), pa.array([x.tobytes()], pa.binary())], names=[group, "n", "ids", "vectors"])

    return rows.groupBy("n", group).applyInArrow(run, f"{group} int, n int, ids array<array<{id_type}>>, vectors binary")


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 5, factor: float = 1.0, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Per query and rank: query_id, rank (from 1), vec_id, score (the cosine); equal scores by the smaller key.

    Every row but the query's own is a candidate. Vectors that are null, empty, zero or hold a null or non-finite
    component are neither query nor candidate; vectors of different lengths are not compared. Repeated rows (of other
    keys) are candidates each. Further columns are not read; an empty table gives an empty one.
    """
    rows = df.where(usable(F.col(vector))).select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.size(vector).alias("n"), F.coalesce(is_query, F.lit(False)).alias("q"))
    kind, id_type = dict(rows.dtypes)["vector"], dict(rows.dtypes)["id"]
    # The k + 1 smallest keys of equal vectors are all that an answer can hold: taken in two steps, so that no group meets whole.
    salted = rows.groupBy("n", "vector", F.pmod(F.xxhash64("id"), F.lit(16)).alias("salt"), "id").agg(F.max("q"))
    rank = Window.partitionBy("vector", "salt").orderBy("id")
    few = salted.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k + 1)
    again = few.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = durable(again.groupBy("n", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    queries = durable(rows.where("q").select("n", "vector", F.array("id").alias("ids")).distinct())
    sizes = {r.n: (r.k, r.m) for r in classes.groupBy("n").agg(F.count("*").alias("k")).join(queries.groupBy("n").agg(F.count("*").alias("m")), "n").collect()}  # a row for each length
    empty = df.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    if not sizes:
        return empty
    dtype = np.float32 if "float" in kind else np.float64
    parts = F.create_map(*[x for n, (c, _) in sizes.items() for x in (F.lit(n), F.lit(shards_of(c, n, np.dtype(dtype).itemsize)))])
    blocks = F.create_map(*[x for n, (_, m) in sizes.items() for x in (F.lit(n), F.lit(math.ceil(m / BLOCK)))])
    shards = packed(classes.withColumn("shard", F.pmod(F.xxhash64("vector"), parts[F.col("n")]).cast("int")).where("shard is not null"), "shard", kind, id_type)
    asked = packed(queries.withColumn("block", F.pmod(F.xxhash64("ids"), blocks[F.col("n")]).cast("int")), "block", kind, id_type)
    # The stated query set meets every shard, in lots of blocks; a lot's blocks walk the one tree of a shard.
    lots = F.ceil(blocks[F.col("n")] / LOT).cast("int")
    held = shards.withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1)))
    sent = asked.withColumn("lot", F.floor(F.col("block") / LOT).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), parts[F.col("n")] - 1)))

    def run(shard: pa.Table, blocks: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if shard.num_rows:
            n, ids = shard["n"][0].as_py(), shard["ids"][0].as_py()
            x = np.frombuffer(shard["vectors"][0].as_buffer(), dtype).reshape(-1, n)
            place = {v.tobytes(): i for i, v in enumerate(x)}
            x = x.astype(np.float64)
            tree = VantageTree(unit(x))
        for b in range(blocks.num_rows if shard.num_rows else 0):
            y = np.frombuffer(blocks["vectors"][b].as_buffer(), dtype).reshape(-1, n)
            q_ids = [i[0] for i in blocks["ids"][b].as_py()]
            own = np.array([place.get(v.tobytes(), -1) for v in y], np.int64)
            y = y.astype(np.float64)
            who, point = Search(tree, unit(y), k, own, factor).results()
            has = np.flatnonzero(own >= 0)
            who, point = np.concatenate([who, has]), np.concatenate([point, own[has]])
            out: list[list[tuple]] = [[] for _ in q_ids]
            for w, p, s in zip(who.tolist(), point.tolist(), cosines(y[who], x[point]).tolist(), strict=True):
                out[w] += [(-s, i) for i in ids[p] if i != q_ids[w]]
            for q, o in zip(q_ids, out, strict=True):
                for s, i in sorted(o)[:k]:
                    found[0].append(q), found[1].append(i), found[2].append(-s)
        id_arrow = shard.schema.field("ids").type.value_type.value_type
        trim_memory()
        return pa.table([pa.array(c, t) for c, t in zip(found, (id_arrow, id_arrow, pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    on = ["n", "shard", "lot"]
    found = held.groupBy(*on).cogroup(sent.groupBy(*on)).applyInArrow(run, f"query_id {id_type}, vec_id {id_type}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
