"""Batch integration by soft clusters with diversity and linear correction (Harmony)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.neighbors import _matrix, kmeans

UNIT = float(1 << 24)


def harmonize(vectors: DataFrame, batches: DataFrame, batch: str, *, num_clusters: int | None = None, sigma: float = 0.1, theta: float = 2.0, tau: float = 0.0, alpha: float = 0.2, max_iter: int = 10, max_cluster_iter: int = 20, tolerance: float = 1e-4, seed: int = 0, history: list[float] | None = None) -> DataFrame:
    """(cell_idx, v): batch-corrected components.

    The driver holds centroids and (cluster, batch) tables; each pass recomputes every cell's soft
    assignment from them in its task and sums moments in integers, so results do not depend on
    partitions. A cell's correction is the ridge solution of its clusters' batch moments.
    """
    rows = vectors.join(batches.select("cell_idx", F.col(batch).cast("string").alias("batch")).where(F.col(batch).isNotNull()), "cell_idx").select("cell_idx", "batch", F.col("v").cast("array<double>").alias("v"))
    sizes = {r["batch"]: r["count"] for r in rows.groupBy("batch").count().collect()}
    names = sorted(sizes)
    n_b = np.array([sizes[b] for b in names], float)
    n = n_b.sum()
    pr = n_b / n
    place = {b: i for i, b in enumerate(names)}
    unit = rows.select("cell_idx", F.expr("transform(v, x -> x / greatest(sqrt(aggregate(v, 0D, (a, y) -> a + y * y)), 1e-12))").alias("v"))
    k = num_clusters or int(max(2, min(100, round(n / 30))))
    y = kmeans(unit, k, seed=seed).T
    y /= np.maximum(np.linalg.norm(y, axis=0), 1e-12)
    th = theta * (1 - np.exp(-((n_b / (k * tau)) ** 2))) if tau > 0 else np.full(len(names), theta)
    dims = y.shape[0]
    fixes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # what earlier rounds assigned and corrected
    o, e = np.zeros((k, len(names))), np.zeros((k, len(names)))

    def assign(z: np.ndarray, b: np.ndarray, y: np.ndarray, o: np.ndarray, e: np.ndarray) -> np.ndarray:
        r = np.exp(-2 / sigma * (1 - z @ y)) * (((e + 1) / (o + e + 1)) ** th).T[b]
        return r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300)

    def corrected(x: np.ndarray, b: np.ndarray, fixes: list) -> np.ndarray:
        out = x
        for yy, oo, ee, w in fixes:
            z = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            r = assign(z, b, yy, oo, ee)
            out = x - np.einsum("nk,nkd->nd", r, w[:, b].transpose(1, 0, 2))
        return out

    def moments(fixes: list, y: np.ndarray, o: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """O, sums of r z, sums of r x, and the clustering part of the objective."""

        def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((k, len(names), 1 + 2 * dims))
            cost = 0.0
            for bt in batches_:
                x = _matrix(bt, "v")
                b = np.array([place[v] for v in bt.column("batch").to_pylist()], int)
                c = corrected(x, b, fixes)
                z = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
                r = assign(z, b, y, o, e)
                for i in range(len(names)):
                    mine = b == i
                    acc[:, i, 0] += np.rint(r[mine] * UNIT).sum(axis=0)
                    acc[:, i, 1 : 1 + dims] += np.rint(r[mine].T @ z[mine] * UNIT)
                    acc[:, i, 1 + dims :] += np.rint(r[mine].T @ x[mine] * UNIT)
                cost += float(np.rint((r * (2 * (1 - z @ y) + sigma * np.log(np.maximum(r, 1e-300)))).sum() * UNIT))
            flat = np.append(acc.ravel(), cost).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "x"])

        got = rows.mapInArrow(run, "i int, x long").groupBy("i").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(k * len(names) * (1 + 2 * dims) + 1)
        for g in got:
            flat[g["i"]] = g["x"] / UNIT
        acc = flat[:-1].reshape(k, len(names), 1 + 2 * dims)
        return acc[:, :, 0], acc[:, :, 1 : 1 + dims], acc[:, :, 1 + dims :], flat[-1]

    before = None
    for _ in range(max_iter):
        last = None
        for _ in range(max_cluster_iter):
            used = (y, o, e)
            o2, rz, rx, cost = moments(fixes, y, o, e)
            e2 = o2.sum(axis=1, keepdims=True) * pr
            obj = cost + sigma * float((th * o2 * np.log((o2 + e2 + 1) / (e2 + 1))).sum())
            o, e = o2, e2
            y = rz.sum(axis=1).T
            y /= np.maximum(np.linalg.norm(y, axis=0), 1e-12)
            if last is not None and last - obj < tolerance * abs(last):
                break
            last = obj
        if history is not None:
            history.append(obj)
        w = np.zeros((k, len(names), dims))
        for c in range(k):
            ok = o[c] >= 1e-5 * n_b
            a = np.zeros((1 + len(names),) * 2)
            a[0, 0] = o[c].sum()
            a[0, 1:] = a[1:, 0] = o[c]
            a[1:, 1:] = np.diag(o[c] + alpha * e[c] + 1e-8)
            rhs = np.vstack([rx[c].sum(axis=0), rx[c]])
            w[c] = np.linalg.solve(a + 1e-8 * np.eye(len(a)), rhs)[1:] * ok[:, None]
        fixes = [(*used, w)]
        if before is not None and before - obj < tolerance * abs(before):
            break
        before = obj

    def fix(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bt in batches_:
            b = np.array([place[v] for v in bt.column("batch").to_pylist()], int)
            yield pa.RecordBatch.from_arrays([bt.column("cell_idx"), pa.array(list(corrected(_matrix(bt, "v"), b, fixes)), pa.list_(pa.float64()))], ["cell_idx", "v"])

    return rows.mapInArrow(fix, "cell_idx long, v array<double>")
