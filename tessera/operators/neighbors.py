"""Nearest neighbours, shared-neighbour graphs and label transfer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, digits: int | None, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, dist2) of the k nearest of each query, ties to smaller ids."""
    d = (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :]
    d = np.maximum(d, 0)
    if digits is not None:
        d = np.round(d, digits)
    if same:
        d[q_ids[:, None] == ids[None, :]] = np.inf
    first = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=-1)[:, :k]
    got = np.take_along_axis(d, first, 1)
    ok = np.isfinite(got)
    return np.repeat(np.arange(len(q)), ok.sum(1)), ids[first][ok], got[ok]


def _blocks(df: DataFrame, name: str) -> DataFrame:
    """Rows packed into blocks of at most BLOCK vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("cell_idx").to_numpy().astype("<i8").tobytes()]), pa.array([_matrix(part, "v").tobytes()])], [f"{name}_ids", f"{name}_v"])

    return df.select("cell_idx", F.col("v").cast("array<double>").alias("v")).mapInArrow(pack, f"{name}_ids binary, {name}_v binary")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("cell_idx").orderBy("dist2", "nbr_idx")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("cell_idx", "rank", "nbr_idx", "dist2")


def knn_exact(vectors: DataFrame, k: int, reference: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(cell_idx, rank, nbr_idx, dist2) of exact squared-Euclidean neighbours. Every block of queries meets
    every block of references in one matrix product, which keeps k of each query. Without a reference
    the rows search themselves, their own id left out."""
    same = reference is None
    blocks = _blocks(vectors, "q").crossJoin(_blocks(vectors if same else reference, "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q_ids, ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["x_ids"], "<i8")
                q, x = np.frombuffer(r["q_v"]).reshape(len(q_ids), -1), np.frombuffer(r["x_v"]).reshape(len(ids), -1)
                row, nbr, d = _nearest(q, q_ids, x, ids, k, digits, same)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(nbr), pa.array(d)], ["cell_idx", "nbr_idx", "dist2"])

    return _top(blocks.mapInArrow(run, "cell_idx long, nbr_idx long, dist2 double"), k)


def kmeans(vectors: DataFrame, k: int, *, seed: int = 0, max_iter: int = 20, tolerance: float = 1e-3, plus: bool = False) -> np.ndarray:
    """Centroids by Lloyd iterations: tasks sum their partitions in integers, the driver holds k centroids.
    Start: k rows of least hash (plus: the farthest-first choice among 20 k such rows). A cluster that is
    left empty moves to the row farthest from its centroid."""
    unit = float(1 << 24)
    rows = vectors.select("cell_idx", F.col("v").cast("array<double>").alias("v"))
    start = rows.orderBy(F.xxhash64("cell_idx", F.lit(seed)), "cell_idx").limit(20 * k if plus else k).collect()
    pool = np.array([r["v"] for r in start])
    if plus and len(pool) > k:
        chosen, d = [0], ((pool - pool[0]) ** 2).sum(1)
        while len(chosen) < k:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, ((pool - pool[chosen[-1]]) ** 2).sum(1))
        pool = pool[chosen]
    c, before = pool[:k].copy(), None
    for _ in range(max_iter):

        def step(batches: Iterator[pa.RecordBatch], c: np.ndarray = c) -> Iterator[pa.RecordBatch]:
            sums, far = np.zeros((len(c), c.shape[1] + 2)), None
            for b in batches:
                x = _matrix(b, "v")
                d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)
                own = d.argmin(1)
                best = d[np.arange(len(x)), own]
                np.add.at(sums, own, np.rint(np.column_stack([x, best, np.ones(len(x))]) * unit))
                i = int(best.argmax()) if len(best) else 0
                if len(best) and (far is None or best[i] > far[0]):
                    far = (float(best[i]), x[i].tolist())
            n = len(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(list(sums.astype(np.int64)), pa.list_(pa.int64())), pa.array([far[0] if far and i == 0 else None for i in range(n)], pa.float64()), pa.array([far[1] if far and i == 0 else None for i in range(n)], pa.list_(pa.float64()))], ["i", "s", "far", "at"])

        got = rows.mapInArrow(step, "i int, s array<bigint>, far double, at array<double>")
        dims = c.shape[1] + 2
        out = got.groupBy("i").agg(*(F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dims)), F.max(F.struct("far", "at")).alias("f")).collect()
        total = 0.0
        spare = next((r["f"]["at"] for r in out if r["f"]["at"] is not None), None)
        for r in out:
            s = np.array([r[f"s{j}"] for j in range(dims)]) / unit
            total += s[-2]
            if s[-1] > 0:
                c[r["i"]] = s[:-2] / s[-1]
            elif spare is not None:
                c[r["i"]], spare = spare, None
        if before is not None and before - total <= tolerance * before:
            break
        before = total
    return c


#: Most clusters of an inverted file, whose centroids the driver holds, and rows of one that meet in a task.
CLUSTERS, PART = 1 << 14, 1 << 16


def _probes(rows: DataFrame, c: np.ndarray, n: int) -> DataFrame:
    """(cell_idx, v, cluster) for the n nearest centroids of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, "v")
            d = (c * c).sum(1) - 2 * x @ c.T
            near = np.argsort(d, axis=1, kind="stable")[:, :n]
            at = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column("cell_idx").take(at), b.column("v").take(at), pa.array(near.ravel().astype(np.int32))], ["cell_idx", "v", "cluster"])

    return rows.select("cell_idx", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "cell_idx long, v array<double>, cluster int")


def neighbors(vectors: DataFrame, k: int = 20, *, reference: DataFrame | None = None, num_clusters: int | None = None, num_clusters_searched: int | None = None, seed: int = 0, kmeans_barbar: bool = False) -> DataFrame:
    """Approximate neighbours by an inverted file: k-means over the reference, each query visits its
    nearest clusters, which hold about sqrt(n) rows each (there are CLUSTERS at most). A cluster with more than
    PART references or queries meets in several tasks. (cell_idx, rank, nbr_idx, dist2)."""
    same, ref = reference is None, vectors if reference is None else reference
    n = ref.count()
    clusters = num_clusters or max(1, min(CLUSTERS, round(n**0.5)))
    c = kmeans(ref, min(clusters, n), seed=seed, plus=kmeans_barbar)
    searched = min(len(c), num_clusters_searched or max(1, round(len(c) ** 0.5) + 4))

    def meet(key: tuple, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"cell_idx": [], "nbr_idx": [], "dist2": []}).astype({"cell_idx": "int64", "nbr_idx": "int64", "dist2": "float64"})
        ids, m, parts = x["cell_idx"].to_numpy(), np.stack(x["v"].to_numpy()), []
        for at in range(0, len(q), BLOCK):
            some = q.iloc[at : at + BLOCK]
            q_ids = some["cell_idx"].to_numpy()
            row, nbr, d = _nearest(np.stack(some["v"].to_numpy()), q_ids, m, ids, k, None, same)
            parts.append(pd.DataFrame({"cell_idx": q_ids[row], "nbr_idx": nbr, "dist2": d}))
        return pd.concat(parts)

    held, asked = _probes(ref, c, 1), _probes(vectors, c, searched)
    sizes = lambda df, name: df.groupBy("cluster").agg(F.ceil(F.count("*") / PART).alias(name))
    parts = F.broadcast(sizes(held, "held_parts").join(sizes(asked, "asked_parts"), "cluster"))
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{name}_parts") - 1)).alias(name)
    own = lambda name: F.pmod(F.xxhash64("cell_idx"), f"{name}_parts").alias(name)
    held = held.join(parts, "cluster").select("cluster", own("held"), each("asked"), "cell_idx", "v")
    asked = asked.join(parts, "cluster").select("cluster", each("held"), own("asked"), "cell_idx", "v")
    place = ("cluster", "held", "asked")
    found = held.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(meet, "cell_idx long, nbr_idx long, dist2 double")
    return _top(found, k)


def shared_neighbors(knn: DataFrame, *, min_shared_neighbors: int = 1) -> DataFrame:
    """(src, dst, weight): neighbour sets with the cell itself in them; weight = s / (2 (K + 1) - s)."""
    sets = knn.select("cell_idx", "nbr_idx").unionByName(knn.select("cell_idx", F.col("cell_idx").alias("nbr_idx")).distinct())
    k = knn.agg(F.coalesce(F.max("rank"), F.lit(0)).alias("k"))
    a, b = sets.select(F.col("cell_idx").alias("src"), "nbr_idx"), sets.select(F.col("cell_idx").alias("dst"), "nbr_idx")
    both = a.join(b, "nbr_idx").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("s")).where(F.col("s") >= min_shared_neighbors)
    return both.crossJoin(F.broadcast(k)).select("src", "dst", (F.col("s") / (2 * (F.col("k") + 1) - F.col("s"))).alias("weight"))


def label_transfer(knn: DataFrame, labels: DataFrame, *, label: str = "label", next_best: bool = False) -> DataFrame:
    """(cell_idx, label, confidence[, next_best_label, next_best_confidence]) by majority of a query's
    reference neighbours; ties go to the label more common in the reference. labels: (cell_idx, label)."""
    common = labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("f"))
    votes = knn.select("cell_idx", "nbr_idx").join(labels.select(F.col("cell_idx").alias("nbr_idx"), label), "nbr_idx").groupBy("cell_idx", label).agg(F.count("*").alias("n"))
    k = knn.groupBy("cell_idx").agg(F.count("*").alias("k"))
    order = Window.partitionBy("cell_idx").orderBy(F.col("n").desc(), F.col("f").desc(), label)
    ranked = votes.join(F.broadcast(common), label).withColumn("r", F.row_number().over(order)).join(k, "cell_idx")
    best = ranked.where("r = 1").select("cell_idx", label, (F.col("n") / F.col("k")).alias("confidence"))
    if not next_best:
        return best
    second = ranked.where("r = 2").select("cell_idx", F.col(label).alias(f"next_best_{label}"), (F.col("n") / F.col("k")).alias("next_best_confidence"))
    return best.join(second, "cell_idx", "left").na.fill(0.0, ["next_best_confidence"])
