"""Exact near-duplicate vectors by dual traversal of cover trees.

Vectors are scaled to length one, so that a cosine threshold is a distance threshold. Equal vectors are one point with a
weight. Points are dealt to cells of the nearest of sampled pivots, whose number grows with the table; a cell beyond the
size of a shard (where the number of pivots has met its bound) is cut by hash. Two cells whose covering radii keep them
farther apart than the threshold are no pair, and nothing of them is shuffled. Each shard's cover tree is built once: one
root of radius two, which covers the sphere, and nested levels of half the radius each, down to single points. For each
pair of shards left a task walks pairs of nodes of both trees from the roots: a pair is pruned when the distance of its
centres exceeds the threshold by more than both covering radii, taken whole when even the farthest two members are within
it, and otherwise split. While a level prunes little, both sides go one level down; from there on all pairs of two
frontiers are pruned by matrix products with each pair's own radii, and what is left is walked pair by pair. Single pairs
are decided by their cosine in double precision. Links are counted where they are found and handed on as a spanning
forest, never as all pairs.

In vectors without structure (as many independent dimensions as these have) no bound by the triangle inequality prunes
whole shards, so exact search compares all of them there; products of frontiers keep that cheap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kobza.llm.common import durable, trimmed
from kobza.llm.components import connected_components
from kobza.llm.vectors import cosines, matrix, unit, usable

#: Points of a shard (on average over a cell's hash parts) and its bytes at most, pivots at most, node pairs looked at together.
SHARD, SHARD_BYTES, PIVOTS, FRONTIER = 8192, 16 << 20, 1024, 1 << 20
#: From a radius that covers the sphere, halved at each level.
RADII = [2.0 * 0.5**k for k in range(24)]
#: Nodes of each side by which a level is judged, and the part of the next level's pairs from which on it is skipped.
JUDGED, SKIPPED = 512, 0.05
#: Distances are trusted to this much; pairs nearer to the threshold are split until single cosines decide.
SLACK = 1e-6


class CoverTree:
    """Nodes in arrays: centre (a point), radius (to its farthest member), children from .. to, members from .. to."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.centre, self.radius, self.child, self.member = [], [], [], []
        self.roots = self.cover(np.arange(len(points)), 0, 0)
        self.centre, self.radius = np.array(self.centre, np.int64), np.array(self.radius)
        self.child, self.member = np.array(self.child, np.int64).reshape(-1, 2), np.array(self.member, np.int64).reshape(-1, 2)

    def packed(self) -> bytes:
        """The nodes without the points."""
        whole = np.concatenate([[len(self.centre), *self.roots], self.order, self.centre, self.child.ravel(), self.member.ravel()])
        return whole.astype(np.int32).tobytes() + self.radius.tobytes()

    @classmethod
    def unpacked(cls, data: bytes, points: np.ndarray) -> CoverTree:
        tree = cls.__new__(cls)
        k, first, last = np.frombuffer(data, np.int32, 3).tolist()
        n = len(points)
        numbers = np.frombuffer(data, np.int32, n + 5 * k, offset=12).astype(np.int64)
        tree.points, tree.roots, tree.order = points, (first, last), numbers[:n]
        tree.centre, tree.child, tree.member = numbers[n : n + k], numbers[n + k : n + 3 * k].reshape(-1, 2), numbers[n + 3 * k :].reshape(-1, 2)
        tree.radius = np.frombuffer(data, np.float64, k, offset=12 + 4 * (n + 5 * k))
        return tree

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of nodes; a node without any stays."""
        number = self.child[nodes, 1] - self.child[nodes, 0]
        first, number = np.where(number > 0, self.child[nodes, 0], nodes), np.maximum(number, 1)
        return np.repeat(first - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())

    def centres_of(self, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Greedy cover of the points: places of the centres in own, and each point's centre."""
        x = self.points[own]
        least = 1 - radius * radius / 2  # as a cosine
        centres: list[int] = []
        place = np.empty(len(own), np.int64)
        for at in range(0, len(own), 256):
            part = x[at : at + 256]
            best, near = np.full(len(part), -2.0), np.zeros(len(part), np.int64)
            if centres:
                g = part @ x[centres].T
                near = g.argmax(axis=1)
                best = g[np.arange(len(part)), near]
            inner = part @ part.T
            for i in range(len(part)):
                if best[i] < least:
                    near[i], best[i] = len(centres), 1.0
                    centres.append(at + i)
                    closer = inner[i, i + 1 :] > best[i + 1 :]
                    near[i + 1 :][closer], best[i + 1 :][closer] = near[i], inner[i, i + 1 :][closer]
            place[at : at + len(part)] = near
        return np.array(centres, np.int64), place

    def cover(self, own: np.ndarray, level: int, first: int) -> tuple[int, int]:
        """Adds the nodes of one level over the points; returns from .. to. first: place of the points in the order."""
        if level < len(RADII):
            centres, place = self.centres_of(own, RADII[level])
        else:
            centres, place = np.arange(len(own)), np.arange(len(own))
        sort = np.argsort(place, kind="stable")
        own, place = own[sort], place[sort]
        self.order[first : first + len(own)] = own
        cuts = np.searchsorted(place, np.arange(len(centres) + 1))
        start = len(self.centre)
        for j, c in enumerate(centres):
            a, b = cuts[j], cuts[j + 1]
            centre = self.first_of(sort[a:b], c, own[a:b])
            away = self.points[own[a:b]] - self.points[centre]
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(np.einsum("ij,ij->i", away, away).max())) if b - a > 1 else 0.0)
            self.child.append((0, 0))
            self.member.append((first + a, first + b))
        end = len(self.centre)
        for j in range(len(centres)):
            a, b = cuts[j], cuts[j + 1]
            if b - a > 1:
                self.child[start + j] = self.cover(own[a:b].copy(), level + 1, first + a)
        return start, end

    @staticmethod
    def first_of(places: np.ndarray, centre: int, own: np.ndarray) -> int:
        """The centre stays a centre of the level below if it is its first point; centres come first in their part."""
        return int(own[np.flatnonzero(places == centre)[0]])


class Links:
    """Counts and a spanning forest of the links between points of two sides, which are numbered one after the other."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.weights = ids, weights
        self.count, self.label = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != self.label[self.label]).any():
                self.label = self.label[self.label]

    def pairs(self, u: np.ndarray, v: np.ndarray) -> None:
        np.add.at(self.count, u, self.weights[v])
        np.add.at(self.count, v, self.weights[u])
        self.join(u, v)

    def whole(self, u: np.ndarray, v: np.ndarray) -> None:
        """Every one of u with every one of v, which have no point in common."""
        self.count[u] += self.weights[v].sum()
        self.count[v] += self.weights[u].sum()
        self.join(np.concatenate([u, np.full(len(v), u[0])]), np.concatenate([np.full(len(u), v[0]), v]))


    def within(self, u: np.ndarray) -> None:
        """Every two of u."""
        self.count[u] += self.weights[u].sum() - self.weights[u]
        self.join(u[1:], np.full(len(u) - 1, u[0]))


def kept_pairs(a: CoverTree, b: CoverTree, na: np.ndarray, nb: np.ndarray, reach: float) -> np.ndarray:
    """Which pairs of nodes can't be pruned, as a matrix. In single precision, with room for its errors."""
    g = a.points[a.centre[na]].astype(np.float32) @ b.points[b.centre[nb]].astype(np.float32).T
    ra, rb = a.radius[na].astype(np.float32), b.radius[nb].astype(np.float32)
    if not ra.any() and not rb.any():
        return g >= np.float32(1 - reach * reach / 2 - 1e-4)
    far = np.add.outer(ra + np.float32(reach), rb)
    far *= far
    far *= np.float32(-0.5)
    far += np.float32(1 - 1e-4)
    return g >= far


def frontiers(a: CoverTree, b: CoverTree, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """The first level of both trees whose pairs are worth pruning, judged by some nodes of each side."""
    na, nb = np.arange(*a.roots), np.arange(*b.roots)
    while True:
        next_a, next_b = a.below(na), b.below(nb)
        if len(next_a) == len(na) and len(next_b) == len(nb):
            return na, nb
        some_a, some_b = (x[:: max(1, len(x) // JUDGED)] for x in (na, nb))
        children_a, children_b = (np.maximum(1, t.child[x, 1] - t.child[x, 0]) for t, x in ((a, some_a), (b, some_b)))
        left = children_a @ kept_pairs(a, b, some_a, some_b, reach) @ children_b
        if left <= SKIPPED * children_a.sum() * children_b.sum() or len(na) == len(nb) == 1 and max(a.radius[na[0]], b.radius[nb[0]]) < reach:
            return na, nb
        na, nb = next_a, next_b


def dual_traversal(a: CoverTree, b: CoverTree, same: bool, exact_a: np.ndarray, exact_b: np.ndarray, threshold: float, links: Links) -> None:
    """Links of points of a with points of b (numbered after a's, unless both are the same)."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    shift = 0 if same else len(a.points)

    def decide(na: np.ndarray, nb: np.ndarray, d: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Prunes and takes; what is to be split comes back as pairs of child ranges expanded."""
        ra, rb = a.radius[na], b.radius[nb]
        keep = d <= reach + ra + rb + SLACK
        na, nb, d, ra, rb = na[keep], nb[keep], d[keep], ra[keep], rb[keep]
        single = (a.child[na, 1] == 0) & (b.child[nb, 1] == 0)
        if single.any():
            u, v = a.centre[na[single]], b.centre[nb[single]]
            if same:
                apart = u != v
                u, v = u[apart], v[apart]
            near = cosines(exact_a[u], exact_b[v]) >= threshold if len(u) else np.zeros(0, bool)
            links.pairs(u[near], v[near] + shift)
        inside = ~single & (d + ra + rb <= reach - SLACK) & (na != nb if same else True)
        for i, j in zip(na[inside], nb[inside], strict=True):
            links.whole(a.order[slice(*a.member[i])], b.order[slice(*b.member[j])] + shift)
        rest = ~single & ~inside
        return split(na[rest], nb[rest])

    def split(na: np.ndarray, nb: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        if not len(na):
            return out
        if same:  # a pair of a node with itself is taken whole, or becomes the pairs of its children, in order
            own = na == nb
            for i in na[own]:
                if 2 * a.radius[i] <= reach - SLACK:
                    links.within(a.order[slice(*a.member[i])])
                    continue
                c = np.arange(*a.child[i])
                for k in range(len(c)):
                    out.append((np.full(len(c) - k, c[k]), c[k:]))
            na, nb = na[~own], nb[~own]
        first = (a.radius[na] >= b.radius[nb]) & (a.child[na, 1] > 0) | (b.child[nb, 1] == 0)
        for x, y, tree, swap in ((na[first], nb[first], a, False), (nb[~first], na[~first], b, True)):
            if len(x):
                number = tree.child[x, 1] - tree.child[x, 0]
                children = np.repeat(tree.child[x, 0] - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())
                other = np.repeat(y, number)
                out.append((other, children) if swap else (children, other))
        return out

    front_a, front_b = frontiers(a, b, reach)
    # Nodes without extent apart, so that one limit serves them all.
    parts_a, parts_b = ([x for x in (f[t.radius[f] == 0], f[t.radius[f] > 0]) if len(x)] for t, f in ((a, front_a), (b, front_b)))
    for own_a, own_b in ((x, y) for x in parts_a for y in parts_b):
        rows = max(1, 8 * FRONTIER // len(own_b))
        for at in range(0, len(own_a), rows):
            i, j = np.nonzero(kept_pairs(a, b, own_a[at : at + rows], own_b, reach))
            na, nb = own_a[at : at + rows][i], own_b[j]
            if same:
                na, nb = na[na <= nb], nb[na <= nb]
            walk([(na, nb)], a, b, decide)


def walk(stack: list[tuple[np.ndarray, np.ndarray]], a: CoverTree, b: CoverTree, decide) -> None:
    """Decides pairs of nodes, and those that come back for them, until none is left."""
    while stack:
        na, nb = stack.pop()
        if len(na) > FRONTIER // 16:
            stack += [(na[k : k + FRONTIER // 16], nb[k : k + FRONTIER // 16]) for k in range(0, len(na), FRONTIER // 16)]
            continue
        away = a.points[a.centre[na]] - b.points[b.centre[nb]]
        stack += merge_small(decide(na, nb, np.sqrt(np.einsum("ij,ij->i", away, away))))


def merge_small(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Many short lists of node pairs as few."""
    return [(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))] if parts else []


def packed_shards(points: DataFrame, kind: str) -> DataFrame:
    """One row a shard: its ids, weights, vectors and tree. points: shard columns cell and part, id, weight, vector."""
    dtype = np.float32 if "float" in kind else np.float64

    def run(rows: pa.Table) -> pa.Table:
        x = matrix(rows["vector"]).astype(dtype)
        return pa.table([rows["cell"][:1].combine_chunks(), rows["part"][:1].combine_chunks(), pa.array([rows["id"].to_pylist()], pa.list_(rows["id"].type)), pa.array([rows["weight"].to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([CoverTree(unit(x.astype(np.float64))).packed()], pa.binary())], names=["cell", "part", "ids", "weights", "vectors", "tree"])

    id_type = points.schema["id"].dataType.simpleString()
    return points.groupBy("cell", "part").applyInArrow(run, f"cell int, part int, ids array<{id_type}>, weights array<long>, vectors binary, tree binary")


def nearest_cells(points: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell (of the nearest pivot of the same length) and away (the distance to it)."""
    held = points.sparkSession.sparkContext.broadcast(pivots)
    first = dict(zip(sorted(pivots), np.cumsum([0, *(len(pivots[n]) for n in sorted(pivots))])[:-1].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                g = unit(matrix(batch.column(2).take(pa.array(own)))) @ held.value[n].T
                cell[own] = g.argmax(axis=1) + first[n]
                away[own] = np.sqrt(np.maximum(0, 2 - 2 * g.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=["id", "weight", "vector", "cell", "away"])

    types = dict(points.dtypes)
    return points.select("id", "weight", "vector").mapInArrow(trimmed(run), f"id {types['id']}, weight long, vector {types['vector']}, cell int, away double")


def near_duplicates(df: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Per row: key, n_links (other rows linked directly), component_id (the smallest key reached), kept.

    Rows whose vector is null, empty, zero or has a null or non-finite component link with nothing, and vectors of
    different lengths don't link. Equal vectors (repeated rows too) link with each other; ties in cosine change nothing.
    Rows of one key are rows of their own, each with its component's smallest key; a row whose key is null links with
    nothing, its component_id is null and kept false. Very long vectors make smaller shards. Further columns are not read,
    whatever their names; an empty table gives an empty one.
    """
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.withColumn("ok", usable(F.col("vector")) & F.col("id").isNotNull())
    sound = rows.where("ok")
    classes = durable(sound.groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("weight")))
    repeated = not classes.groupBy("least").count().where("count > 1").isEmpty()
    classes = classes.select(F.xxhash64("least", "vector").alias("id") if repeated else F.col("least").alias("id"), "least", "weight", "vector")
    sizes = {r.n: r.k for r in classes.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("k")).collect()}  # a row for each length
    if not sizes:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    pivots, limits = {}, {}
    for n, k in sizes.items():
        limits[n] = max(64, min(SHARD, SHARD_BYTES // (8 * n)))
        sample = classes.where(F.size("vector") == n).orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, math.ceil(k / limits[n]))).collect()
        pivots[n] = unit(np.array([r.vector for r in sample], np.float64))
    near = durable(nearest_cells(classes, pivots))
    cells = {r.cell: r for r in near.groupBy("cell").agg(F.count("*").alias("k"), F.max("away").alias("r")).collect()}  # a row for each pivot
    reach, first, allowed, parts = math.sqrt(max(0.0, 2 - 2 * threshold)), 0, [], {}
    for n in sorted(pivots):
        own = np.array([c for c in range(first, first + len(pivots[n])) if c in cells])
        parts |= {int(c): math.ceil(cells[c].k / limits[n]) for c in own}
        radius, x = np.array([cells[c].r for c in own]), pivots[n][own - first]
        apart = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
        i, j = np.nonzero(np.triu(apart <= reach + np.add.outer(radius, radius) + 1e-4))
        allowed += zip(own[i].tolist(), own[j].tolist(), strict=True)
        first += len(pivots[n])
    count = F.create_map(*[x for c, k in parts.items() for x in (F.lit(c), F.lit(k))])
    packs = durable(packed_shards(near.withColumn("part", F.pmod(F.xxhash64("id"), count[F.col("cell")]).cast("int")), dict(near.dtypes)["vector"]))
    # Partners of a cell as literals: a pair of cells for each two of at most PIVOTS.
    spark = df.sparkSession
    partners = spark.createDataFrame([(c, e, parts[e]) for c, e in allowed] + [(e, c, parts[c]) for c, e in allowed if c != e], "cell int, other int, parts int")
    dealt = packs.join(F.broadcast(partners), "cell").withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    me, you = F.struct("cell", "part"), F.struct(F.col("other").alias("cell"), F.col("other_part").alias("part"))
    dealt = dealt.select(F.least(me, you).alias("one"), F.greatest(me, you).alias("two"), (me == F.least(me, you)).alias("is_one"), "ids", "weights", "vectors", "tree")
    dtype = np.float32 if "float" in dict(near.dtypes)["vector"] else np.float64

    def run(table: pa.Table) -> pa.Table:
        shards = sorted(table.to_pylist(), key=lambda r: not r["is_one"])
        exact = [np.frombuffer(s["vectors"], dtype).reshape(len(s["ids"]), -1).astype(np.float64) for s in shards]
        trees = [CoverTree.unpacked(s["tree"], unit(x)) for s, x in zip(shards, exact, strict=True)]
        ids, weights = ([v for s in shards for v in s[c]] for c in ("ids", "weights"))
        links = Links(np.array(ids), np.array(weights, np.int64))
        dual_traversal(trees[0], trees[-1], len(trees) == 1, exact[0], exact[-1], threshold, links)
        linked = np.flatnonzero(links.count)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, links.label[linked], links.ids[linked])
        return pa.table([pa.array(links.ids[linked], table.schema.field("ids").type.value_type), pa.array(links.count[linked]), pa.array(least[links.label[linked]], table.schema.field("ids").type.value_type)], names=["id", "n", "other"])

    id_type = dict(near.dtypes)["id"]
    found = durable(dealt.groupBy("one", "two").applyInArrow(run, f"id {id_type}, n long, other {id_type}"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    linked = classes.join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    if repeated:
        linked = linked.join(linked.groupBy("component").agg(F.min("least").alias("first")), "component").withColumn("component", F.col("first"))
    by_class = linked.select("vector", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("component").alias("component_id"))
    good = sound.join(by_class, "vector").select("id", "n_links", "component_id")
    bad = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
