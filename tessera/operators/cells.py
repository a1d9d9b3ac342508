"""Cell-level analytics: QC, normalization, variable genes, principal components, doublets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import aggregates as ag

METHODS = ("log1pPF", "logCP10k", "PFlog1pPF")


def qc_flags(metrics: DataFrame, counts: DataFrame, *, max_mito_fraction: float | None = 0.05, min_genes: int | None = 100, required_gene: int | None = None) -> DataFrame:
    """(cell_idx, passed_QC): mitochondrial share, detected genes, and a stored entry of the required gene.
    Empty cells fail the mitochondrial filter."""
    good = F.lit(True)
    if max_mito_fraction is not None:
        good &= (F.col("num_counts") > 0) & (F.col("mito_fraction") <= max_mito_fraction) & ~F.isnan("mito_fraction")
    if min_genes is not None:
        good &= F.col("num_genes") >= min_genes
    rows = metrics
    if required_gene is not None:
        have = counts.where(F.col("gene_idx") == required_gene).select("cell_idx", F.lit(True).alias("_have")).distinct()
        rows = rows.join(have, "cell_idx", "left")
        good &= F.coalesce("_have", F.lit(False))
    return rows.select("cell_idx", good.alias("passed_QC"))


def normalize(counts: DataFrame, passed: DataFrame, method: str = "log1pPF") -> DataFrame:
    """(cell_idx, gene_idx, value): log1p(x f / s) for every cell; f is the mean size over passing cells (or
    10,000). PFlog1pPF scales the result by its own cells' sums once more."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    sizes = counts.groupBy("cell_idx").agg(F.sum(ag.whole()).alias("s"))
    good = passed.where("passed_QC").select("cell_idx")
    if method == "logCP10k":
        factor = sizes.sparkSession.range(1).select(F.lit(10_000.0).alias("f"))
    else:
        # Empty passing cells count in the mean.
        factor = good.join(sizes, "cell_idx", "left").agg((F.sum(F.coalesce("s", F.lit(0))) / F.count("*")).alias("f"))
    rows = counts.join(sizes, "cell_idx").crossJoin(F.broadcast(factor))
    y = F.log1p(F.col("value") * F.col("f") / F.col("s"))
    out = rows.where("s > 0").select("cell_idx", "gene_idx", y.alias("value"))
    if method != "PFlog1pPF":
        return out
    again = out.groupBy("cell_idx").agg(F.sum("value").alias("t"))
    mean = good.join(again, "cell_idx", "left").agg((F.sum(F.coalesce("t", F.lit(0.0))) / F.count("*")).alias("g"))
    return out.join(again, "cell_idx").crossJoin(F.broadcast(mean)).select("cell_idx", "gene_idx", (F.col("value") * F.col("g") / F.col("t")).alias("value"))


def hvg(counts: DataFrame, genes: DataFrame, cells: DataFrame, *, num_genes: int = 2000, batch: str | None = None, span: float = 0.3) -> DataFrame:
    """(gene_idx, highly_variable, highly_variable_rank): variance of clipped standardized counts, with the
    trend of log variance on log mean by local regression; with batches, genes are ranked by the number of
    batches that have them among the first num_genes, then by median rank."""
    own = cells.select("cell_idx", (F.lit(0) if batch is None else F.col(batch)).alias("_b")).where("_b is not null")
    sizes = {r["_b"]: r["count"] for r in own.groupBy("_b").count().collect()}
    grouped = counts.join(own, "cell_idx")
    # One plan for all batches; genes x batches rows come back.
    sums = grouped.groupBy("_b", "gene_idx").agg(F.sum(ag.whole()).alias("s"), F.sum(ag.whole() * ag.whole()).alias("q")).toPandas()
    ids = np.array([r[0] for r in genes.select("gene_idx").orderBy("gene_idx").collect()])
    trends, clips = {}, []
    for b, n in sorted(sizes.items()):
        mine = sums[sums["_b"] == b].set_index("gene_idx")[["s", "q"]].reindex(ids).fillna(0).astype("int64").astype(object)
        mean = (mine["s"] / n).to_numpy(float)
        var = ((n * mine["q"] - mine["s"] * mine["s"]) / (n * max(1, n - 1))).to_numpy(float)
        ok = var > 0
        if ok.sum() < 4:
            raise ValueError("LOESS model fitting failed: too few genes vary")
        sd = np.zeros(len(ids))
        sd[ok] = np.sqrt(10 ** stats.loess(np.log10(mean[ok]), np.log10(var[ok]), span))
        trends[b] = (n, mean, sd, ok)
        clips += [(b, int(g), float(c)) for g, c in zip(ids[ok], (mean + sd * np.sqrt(n))[ok], strict=True)]
    kind = own.schema["_b"].dataType.simpleString()
    table = counts.sparkSession.createDataFrame(clips, f"_b {kind}, gene_idx int, clip double")
    clipped = ag.clipped_sums(grouped, F.broadcast(table), "_b").toPandas()
    ranked: list[np.ndarray] = []
    for b, (n, mean, sd, ok) in trends.items():
        c = clipped[clipped["_b"] == b].set_index("gene_idx").reindex(ids).fillna(0.0)
        norm = np.zeros(len(ids))
        norm[ok] = ((n * mean**2 + c["clipped_square_sum"].to_numpy() - 2 * mean * c["clipped_sum"].to_numpy())[ok]) / ((n - 1) * sd[ok] ** 2)
        rank = np.empty(len(ids))
        rank[np.lexsort((ids, -norm))] = np.arange(len(ids))
        ranked.append(rank)
    r = np.array(ranked)
    among, median = (r < num_genes).sum(axis=0), np.median(r, axis=0)
    final = np.empty(len(ids), np.int64)
    final[np.lexsort((ids, median, -among))] = np.arange(1, len(ids) + 1)
    rows = [(int(g), bool(k <= num_genes), int(k)) for g, k in zip(ids, final, strict=True)]
    return counts.sparkSession.createDataFrame(rows, "gene_idx int, highly_variable boolean, highly_variable_rank int")


BLOCK = 512
#: Rows of a Gram matrix that travel together.
STRIPE = 256
STRIPES = "i int, rows binary"


def _stripe(i: list[int], rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(rows, pa.binary())], ["i", "rows"])


def _dense(batch: pa.RecordBatch, column: np.ndarray) -> np.ndarray:
    """Rows of (idx, val) arrays as a matrix over the chosen genes."""
    idx, val = batch.column("idx"), batch.column("val")
    rows = np.repeat(np.arange(batch.num_rows), np.diff(idx.offsets.to_numpy()))
    out = np.zeros((batch.num_rows, int(column.max()) + 1))
    out[rows, column[idx.flatten().to_numpy()]] = val.flatten().to_numpy(zero_copy_only=False)
    return out


def pca(values: DataFrame, cells: DataFrame, genes: DataFrame, num_pcs: int = 50) -> tuple[DataFrame, DataFrame]:
    """Principal components of standardized genes: (cell_idx, v) and loadings (gene_idx, v).

    The Gram matrix of the chosen genes (at most a few thousand) is summed from partial products of blocks
    of cells, entries rounded to integers so that the sum does not depend on task order; centring and
    scaling are applied to it, and cells are projected with the eigenvectors. The largest loading of a
    component is positive.
    """
    ids = [r[0] for r in genes.select("gene_idx").orderBy("gene_idx").collect()]
    if not ids:
        raise ValueError("no genes are chosen")
    place = np.full(max(ids) + 1, -1)
    place[ids] = np.arange(len(ids))
    g, n = len(ids), cells.count()
    chosen = values.join(F.broadcast(genes.select("gene_idx")), "gene_idx", "left_semi")
    packed = chosen.groupBy("cell_idx").agg(F.array_sort(F.collect_list(F.struct("gene_idx", F.col("value").cast("double").alias("value")))).alias("r"))
    packed = packed.select("cell_idx", F.col("r.gene_idx").alias("idx"), F.col("r.value").alias("val"))
    unit = float(1 << 20)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((g, g)), np.zeros(g)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                m = _dense(b.slice(at, BLOCK), place)
                m = np.pad(m, ((0, 0), (0, g - m.shape[1])))
                total += np.rint(m.T @ m * unit)
                sums += np.rint(m.sum(axis=0) * unit)
        full = np.vstack([total, sums]).astype("<i8")
        for i in range(0, g + 1, STRIPE):
            yield _stripe([i], [full[i : i + STRIPE].tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column("i").to_pylist(), b.column("rows").to_pylist(), strict=True):
                x = np.frombuffer(raw, "<i8")
                held[i] = held[i] + x if i in held else x
        for i, x in held.items():
            yield _stripe([i], [x.tobytes()])

    # Stripes of the matrix, added up in two steps so that no task gets those of all others.
    stripes = -(-(g + 1) // STRIPE)
    made = packed.mapInArrow(gram, STRIPES).withColumn("lane", F.spark_partition_id() % 32)
    once = made.repartition(min(200, 32 * stripes), "i", "lane").select("i", "rows").mapInArrow(add, STRIPES)
    total = np.zeros((g + 1, g))
    for r in once.repartition(stripes, "i").mapInArrow(add, STRIPES).collect():
        x = np.frombuffer(r["rows"], "<i8").reshape(-1, g)
        total[r["i"] : r["i"] + len(x)] = x
    total /= unit
    mean = total[g] / n
    cov = (total[:g] - n * np.outer(mean, mean)) / max(1, n - 1)
    std = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), 1e-8)
    value, vector = np.linalg.eigh(cov / np.outer(std, std))
    k = min(num_pcs, g)
    vector = vector[:, np.argsort(-value)[:k]]
    vector *= np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(k)])
    scaled = vector / std[:, None]
    shift = -(mean / std) @ vector

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                m = _dense(part, place)
                out = m @ scaled[: m.shape[1]] + shift
                yield pa.RecordBatch.from_arrays([part.column("cell_idx"), pa.array(list(out), pa.list_(pa.float64()))], ["cell_idx", "v"])

    found = packed.mapInArrow(project, "cell_idx long, v array<double>")
    zero = F.array(*(F.lit(float(x)) for x in shift))
    scores = cells.select("cell_idx").join(found, "cell_idx", "left").select("cell_idx", F.coalesce("v", zero).alias("v"))
    loadings = values.sparkSession.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vector, strict=True)], "gene_idx int, v array<double>")
    return scores, loadings


def detection(counts: DataFrame, n_cells: int, num_genes: int) -> DataFrame:
    """The num_genes genes whose detection is closest to one half; never those in no cell or in all."""
    d = counts.where("value <> 0").groupBy("gene_idx").agg(F.count("*").alias("d")).where((F.col("d") > 0) & (F.col("d") < n_cells))
    return d.orderBy(F.abs(F.col("d") / n_cells - 0.5), "gene_idx").limit(num_genes)


def cooccurrence(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """(g1, g2, both), g1 < g2: cells that have both genes, of the chosen genes."""
    c = counts.where("value <> 0").join(F.broadcast(genes.select("gene_idx")), "gene_idx", "left_semi").select("cell_idx", "gene_idx")
    a = c.groupBy("cell_idx").agg(F.sort_array(F.collect_set("gene_idx")).alias("g"))
    first = a.select("g", F.posexplode("g").alias("i", "g1"))
    return first.select("g1", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("g2")).groupBy("g1", "g2").agg(F.count("*").alias("both"))


def find_doublets(counts: DataFrame, cells: DataFrame, *, num_genes: int = 500, doublet_fraction: float | None = None, seed: int = 0) -> DataFrame:
    """(cell_idx, doublet, doublet_score) by co-expression of exclusive gene pairs.

    Pair score: log P(at least as many cells with exactly one of the two genes) under independence; a
    cell's score is minus the sum over pairs it has both of. Doublets exceed the median score of simulated
    ones (pairs of cells drawn by hash), or are the top floor(n * fraction).
    """
    n = cells.count()
    genes = detection(counts, n, num_genes)
    d = {r["gene_idx"]: r["d"] for r in genes.collect()}
    pairs = cooccurrence(counts, genes).toPandas()  # gene-sized: num_genes squared at most
    have = {(a, b): k for a, b, k in pairs.itertuples(index=False)}
    ids = sorted(d)
    p = np.array([d[i] / n for i in ids])
    both = np.zeros((len(ids), len(ids)))
    at = {g: i for i, g in enumerate(ids)}
    for (a, b), k in have.items():
        both[at[a], at[b]] = both[at[b], at[a]] = k
    dd = np.array([d[i] for i in ids], float)
    seen = dd[:, None] + dd[None, :] - 2 * both
    q = p[:, None] * (1 - p[None, :]) + (1 - p[:, None]) * p[None, :]
    s = np.where(seen > 0, stats.binom_log_sf(seen - 1, n, q), 0.0)
    np.fill_diagonal(s, 0.0)
    packed = counts.where("value <> 0").join(F.broadcast(genes.select("gene_idx")), "gene_idx", "left_semi").groupBy("cell_idx").agg(F.array_sort(F.collect_list(F.struct("gene_idx", F.col("value").cast("double").alias("value")))).alias("r"))
    packed = packed.select("cell_idx", F.col("r.gene_idx").alias("idx"), F.col("r.value").alias("val"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [-float(s[np.ix_(i := [at[g] for g in gs], i)].sum()) / 2 for gs in b.column("idx").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("cell_idx"), pa.array(out, pa.float64())], ["cell_idx", "doublet_score"])

    scores = cells.select("cell_idx").join(packed.mapInArrow(score, "cell_idx long, doublet_score double"), "cell_idx", "left").na.fill(0.0, ["doublet_score"])
    if doublet_fraction is not None:
        k = int(n * doublet_fraction)
        top = scores.orderBy(F.col("doublet_score").desc(), "cell_idx").limit(k).select("cell_idx", F.lit(True).alias("_d"))
        return scores.join(top, "cell_idx", "left").select("cell_idx", F.coalesce("_d", F.lit(False)).alias("doublet"), "doublet_score")
    # Partners are neighbours in a hashed order, so simulation needs no all-pairs.
    order = Window.partitionBy("_b").orderBy(F.xxhash64("cell_idx", F.lit(seed)), "cell_idx")
    mated = packed.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "cell_idx"), F.lit(max(1, n // 2000)))).withColumns({"idx2": F.lead("idx").over(order), "val2": F.lead("val").over(order)}).where("idx2 is not null")

    def simulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cell, i1, v1, i2, v2 in zip(*(b.column(c).to_pylist() for c in ("cell_idx", "idx", "val", "idx2", "val2")), strict=True):
                rng = np.random.default_rng((seed, cell & 0xFFFFFFFF))
                a, z = dict(zip(i1, v1, strict=True)), dict(zip(i2, v2, strict=True))
                gs = [g for g in {*a, *z} if (g in a and g in z) or (a.get(g) or z.get(g)) > 1 or rng.random() < 0.5]
                i = sorted(at[g] for g in gs)
                out.append(-float(s[np.ix_(i, i)].sum()) / 2)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["score"])

    cut = mated.mapInArrow(simulate, "score double").agg(F.percentile("score", F.lit(0.5)).alias("cut")).first()["cut"]
    return scores.select("cell_idx", (F.col("doublet_score") >= F.lit(cut if cut is not None else float("inf"))).alias("doublet"), "doublet_score")


def is_mito(name: str = "gene_name") -> Column:
    """Mitochondrial genes by the usual name prefix."""
    return F.lower(F.col(name)).startswith("mt-")
