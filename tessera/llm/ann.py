"""Approximate nearest neighbours: one vantage-point tree per shard, searched with relaxed pruning.

A vantage-point tree over a bounded sample (`SAMPLE` vectors, those of the least hashes) deals all rows to its
leaves, the shards, of about `shard_rows` rows; a leaf that gets more (one very common vector) is several
shards. Each shard builds a tree of its own. A query first visits the leaf it falls into, which bounds its k-th
distance, and then, with that bound, only leaves that the triangle inequality leaves open. The far side of a
node, in a shard as between them, is left out when the inequality puts it beyond the current k-th distance
divided by `factor`: factor 1 is exact search, larger ones prune more.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as
queries nor as candidates; vectors meet only those of their own dimension. Candidates with the query's
own id are left out. Repeated rows of one id count once, at their smallest distance (a query id given
more than once is asked once, with its least vector). Ties go to the smaller id. An empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import staged

QUERY_BLOCK = 256
#: Vectors that the tree over shards is made from, and the most leaves it has.
SAMPLE, LEAVES = 20_000, 1 << 16


@dataclass
class Node:
    at: int  # place of the vantage point, or start of a leaf
    end: int  # end of a leaf, 0 for inner nodes
    radius: float = 0.0
    near: "Node | None" = None
    far: "Node | None" = None


class VpTree:
    """Vantage-point tree over the rows of a matrix."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = 128, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[order].astype(np.float64), ids[order]
        self.places, self.leaf, self.rng = np.arange(len(ids)), leaf, np.random.default_rng(seed)
        self.root = self._build(0, len(ids))
        self.squares = (self.vectors**2).sum(axis=1)

    def _build(self, a: int, b: int) -> Node:
        if b - a <= self.leaf:
            return Node(a, b)
        some = int(self.rng.integers(a, b))
        self.places[[a, some]] = self.places[[some, a]]
        rest = self.places[a + 1 : b]
        d = distances(self.vectors[self.places[a]][None], self.vectors[rest])[0]
        order = np.argsort(d, kind="stable")
        self.places[a + 1 : b] = rest[order]
        half = len(rest) // 2
        if d[order[0]] == d[order[-1]]:  # all alike: a leaf is as good
            return Node(a, b)
        return Node(a, 0, float(d[order[half]]), self._build(a + 1, a + 1 + half), self._build(a + 1 + half, b))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0, cap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids) of the k nearest of each query, (inf, -1) where there are fewer. cap: distances
        beyond which a query needs none."""
        q = queries.astype(np.float64)
        top = np.full((len(q), 1), np.inf) if cap is None else np.asarray(cap, float).reshape(-1, 1)
        # Places not yet filled stand at the cap, behind all ids.
        best_d, best_i = np.repeat(top, k, axis=1), np.full((len(q), k), np.iinfo(np.int64).max)

        squares = (q**2).sum(axis=1)
        slack = 1e-9 * (float(self.squares.max(initial=0.0)) + float(squares.max(initial=0.0)) + 1e-300)

        def meet(who: np.ndarray, places: np.ndarray) -> None:
            """Offers those pairs that may be among a query's k nearest: found by one matrix product, with
            slack for its rounding, so that only these need exact distances."""
            rough = squares[who][:, None] - 2 * q[who] @ self.vectors[places].T + self.squares[places]
            may = rough <= (best_d[who, -1] ** 2 * (1 + 1e-9) + slack)[:, None]
            rows, cols = may.any(axis=1), may.any(axis=0)
            if rows.any():
                who, places, may = who[rows], places[cols], may[np.ix_(rows, cols)]
                r, c = np.nonzero(may)
                d = np.full(may.shape, np.inf)
                for at in range(0, len(r), 1 << 15):
                    i, j = r[at : at + (1 << 15)], c[at : at + (1 << 15)]
                    gap = q[who[i]] - self.vectors[places[j]]
                    np.multiply(gap, gap, out=gap)
                    d[i, j] = np.sqrt(gap.sum(axis=-1))
                offer(who, places, d)

        def offer(who: np.ndarray, places: np.ndarray, d: np.ndarray) -> None:
            ids = np.broadcast_to(self.ids[places], d.shape)
            d = np.where(ids == own[who][:, None], np.inf, d)
            some = (d <= best_d[who, -1][:, None]).any(axis=0)
            if some.any():
                alld, alli = np.concatenate([best_d[who], d[:, some]], axis=1), np.concatenate([best_i[who], ids[:, some]], axis=1)
                first = np.lexsort((alli, alld), axis=-1)[:, :k]
                best_d[who], best_i[who] = np.take_along_axis(alld, first, 1), np.take_along_axis(alli, first, 1)

        def visit(node: Node | None, who: np.ndarray) -> None:
            if node is None or not len(who):
                return
            if node.end:
                places = self.places[node.at : node.end]
                for at in range(0, len(places), 256):
                    meet(who, places[at : at + 256])
                return
            point = self.places[node.at : node.at + 1]
            d = distances(q[who], self.vectors[point])
            offer(who, point, d)
            inside = d[:, 0] < node.radius
            gap = np.abs(d[:, 0] - node.radius)
            visit(node.near, who[inside])
            visit(node.far, who[~inside])
            open_ = gap * factor <= best_d[who, -1] * (1 + 1e-9)
            visit(node.far, who[inside & open_])
            visit(node.near, who[~inside & open_])

        if len(self.ids):
            visit(self.root, np.arange(len(q)))
        none = np.isinf(best_d) | (best_i == np.iinfo(np.int64).max)
        return np.where(none, np.inf, best_d), np.where(none, -1, best_i)


class Router:
    """Vantage-point tree over a sample, whose leaves number the shards of one dimension."""

    def __init__(self, sample: np.ndarray, leaves: int, first: int, seed: int = 3):
        self.points, self.radii, self.sides, self.first = [], [], [], first
        rng = np.random.default_rng(seed)
        self.leaves = 0

        def build(rows: np.ndarray, n: int, path: tuple[tuple[int, bool], ...]) -> int:
            """Negative numbers are leaves."""
            point = rows[int(rng.integers(len(rows)))]
            d = distances(point[None], rows)[0]
            # The middle of the sample, so that sides are of the sizes their numbers of leaves ask for.
            radius = float(np.quantile(d, (n // 2) / n)) if n > 1 else 0.0
            near = d < radius
            if n == 1 or not near.any() or near.all():
                self.sides.append(path)
                self.leaves += 1
                return -self.leaves
            me = len(self.points)
            self.points.append(point)
            self.radii.append(radius)
            self.children.append((0, 0))
            self.children[me] = (build(rows[near], n // 2, (*path, (me, True))), build(rows[~near], n - n // 2, (*path, (me, False))))
            return me

        self.children: list[tuple[int, int]] = []
        self.root = build(sample, leaves, ())

    def leaf(self, v: np.ndarray) -> np.ndarray:
        """The shard of each vector."""
        out, todo = np.empty(len(v), np.int64), [(self.root, np.arange(len(v)))]
        while todo:
            node, who = todo.pop()
            if node < 0:
                out[who] = -node - 1
            elif len(who):
                near = distances(v[who], self.points[node][None])[:, 0] < self.radii[node]
                todo += [(self.children[node][0], who[near]), (self.children[node][1], who[~near])]
        return out + self.first

    def reach(self, v: np.ndarray) -> np.ndarray:
        """Lower bounds on the distances from each vector to the vectors of each leaf."""
        out = np.zeros((len(v), self.leaves))
        if self.points:
            gap = distances(v, np.array(self.points)) - np.array(self.radii)
            for j, path in enumerate(self.sides):
                for node, near in path:
                    np.maximum(out[:, j], gap[:, node] if near else -gap[:, node], out=out[:, j])
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; equal pairs of vectors give equal bits."""
    d = a[:, None, :] - b[None, :, :]
    np.multiply(d, d, out=d)
    return np.sqrt(d.sum(axis=-1))


def valid(vector: str = "embedding") -> "F.Column":
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard_rows: int = 16384) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of vectors for each row of queries; both have
    (vec_id, embedding). Memory of a task: one shard and one block of queries."""
    # Floats travel as they are; distances are of doubles.
    kind = "array<float>" if all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (vectors, queries)) else "array<double>"
    shape = lambda df: df.where(valid() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"), F.size("embedding").alias("dim"))
    rows, asked = shape(vectors), shape(queries).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("m")).select("vec_id", "m.v", "m.dim")
    routers = _routers(rows, shard_rows)
    one = len(routers) == 1 and next(iter(routers.values())).leaves == 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                some = b.slice(at, 2048)
                leaf = np.full(some.num_rows, -1, np.int64)
                for dim, who, mat in _by_dim(some):
                    # A dimension that the sample does not have is one leaf, below all others.
                    leaf[who] = routers[dim].leaf(mat) if dim in routers else -dim
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *(some.column(c) for c in ("vec_id", "v"))], ["leaf", "vec_id", "v"])

    laid = rows.mapInArrow(deal, f"leaf long, vec_id long, v {kind}")
    home = asked.mapInArrow(deal, f"leaf long, vec_id long, v {kind}")
    if not one:
        laid = staged(laid, "dealt_vectors")
    # One row for each leaf, at most LEAVES of them and one for each rare dimension.
    splits = laid.groupBy("leaf").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    splits = staged(splits, "leaves") if not one else splits
    # The input partition is in the hash so that one id with very many rows spreads as well.
    base = laid.join(F.broadcast(splits), "leaf").select("leaf", F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), "parts").alias("part"), "vec_id", "v")
    everywhere = lambda df: df.join(F.broadcast(splits), "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "vec_id", "v", "cap")
    infinite = F.lit(float("inf"))
    near = _visited(base, everywhere(home.withColumn("cap", infinite)), k, factor)
    if one:
        return _ranked(near, k)
    near = staged(_ranked(near, k), "nearest_at_home")
    caps = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cap"))

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query at all leaves but its own that may hold one of its k nearest."""
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                cap = some.column("cap").to_numpy(zero_copy_only=False)
                for dim, who, mat in _by_dim(some):
                    if dim not in routers:
                        continue
                    r = routers[dim]
                    ok = r.reach(mat) * factor <= cap[who][:, None] * (1 + 1e-9)
                    ok[np.arange(len(who)), r.leaf(mat) - r.first] = False
                    i, j = np.nonzero(ok)
                    for lo in range(0, len(i), 4096):
                        pick = pa.array(who[i[lo : lo + 4096]])
                        yield pa.RecordBatch.from_arrays([pa.array(j[lo : lo + 4096] + r.first), *(some.column(c).take(pick) for c in ("vec_id", "v", "cap"))], ["leaf", "vec_id", "v", "cap"])

    bounded = asked.join(caps, "vec_id", "left").withColumn("cap", F.coalesce("cap", infinite))
    sent = bounded.mapInArrow(open_, f"leaf long, vec_id long, v {kind}, cap double")
    far = _visited(base, everywhere(sent), k, factor)
    return _ranked(near.select("query_id", "vec_id", "score").unionByName(far), k)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, matrix) of the vectors v of a batch."""
    v = b.column("v")
    lengths = np.diff(v.offsets.to_numpy())
    for dim in np.unique(lengths).tolist():
        who = np.flatnonzero(lengths == dim)
        yield dim, who, v.take(pa.array(who)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(who), dim)


def _routers(rows: DataFrame, shard_rows: int) -> dict[int, Router]:
    """A router for each dimension in the sample, with leaves by its share of all rows."""
    n = rows.count()
    drawn = rows.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect()
    by_dim: dict[int, list[list[float]]] = {}
    for r in drawn:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    out, first = {}, 0
    for dim, some in sorted(by_dim.items()):
        share = n * len(some) / len(drawn)
        out[dim] = Router(np.array(some), max(1, min(LEAVES, -(-int(share) // shard_rows), len(some))), first)
        first += out[dim].leaves
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visited(base: DataFrame, sent: DataFrame, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score) of the nearest that queries find at the shards (leaf, part) they are sent to."""
    place = F.struct("leaf", "part").alias("place")
    held = base.select(place, F.lit(0).alias("kind"), "vec_id", "v", F.lit(0.0).alias("cap"))
    both = held.unionByName(sent.select(place, F.lit(1).alias("kind"), "vec_id", "v", "cap")).select("place.leaf", "place.part", "kind", "vec_id", "v", "cap")
    laid = both.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, tree, wide = None, [], None, k
        for batch in batches:
            places = list(zip(batch.column("leaf").to_pylist(), batch.column("part").to_pylist(), strict=True))
            kinds, caps = batch.column("kind").to_numpy(), batch.column("cap").to_numpy()
            ids, at = batch.column("vec_id").to_numpy(), 0
            while at < batch.num_rows:
                end = at + 1
                while end < batch.num_rows and places[end] == places[at] and kinds[end] == kinds[at] and (kinds[at] == 0 or end - at < QUERY_BLOCK):
                    end += 1
                part = batch.column("v").slice(at, end - at)
                mat = part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(end - at, -1)
                if places[at] != place:
                    place, held, tree = places[at], [], None
                if kinds[at] == 0:
                    held.append((mat, ids[at:end]))
                elif held or tree is not None:
                    if tree is None:
                        mats, own = np.concatenate([m for m, _ in held]), np.concatenate([i for _, i in held])
                        if len(np.unique(own)) < len(own):
                            both = np.unique(np.concatenate([own[:, None].view(np.float64), mats], axis=1).view(np.int64), axis=0)
                            own, mats = both[:, 0].copy(), both[:, 1:].copy().view(np.float64)
                            wide = k * int(np.unique(own, return_counts=True)[1].max())
                        else:
                            wide = k
                        tree, held = VpTree(mats, own), []
                    d, i = tree.search(mat, ids[at:end], min(wide, len(tree.ids)), factor, caps[at:end])
                    ok = np.isfinite(d)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at:end], ok.sum(axis=1))), pa.array(i[ok]), pa.array(d[ok])], ["query_id", "vec_id", "score"])
                at = end

    return laid.mapInArrow(run, "query_id long, vec_id long, score double")
