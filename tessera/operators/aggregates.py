"""Aggregates over counts (cell_idx, gene_idx, value): partial and final hash aggregates in integers, so that
results do not depend on the order of tasks. Counts are truncated towards zero first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def nan() -> Column:
    return F.lit(float("nan"))


def whole(value: str = "value") -> Column:
    return F.col(value).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles: x/0 is infinite, 0/0 is NaN."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(a == 0, nan()).when(a > 0, F.lit(float("inf"))).otherwise(F.when(a < 0, F.lit(float("-inf"))))


def qc_metrics(counts: DataFrame, cells: DataFrame, mito: DataFrame) -> DataFrame:
    """(cell_idx, num_counts, num_genes, mito_fraction) of every cell. mito: gene_idx of mitochondrial
    genes. Stored entries count as genes; an empty cell has fraction NaN."""
    flagged = counts.join(mito.select("gene_idx", F.lit(True).alias("_m")), "gene_idx", "left")
    per = flagged.groupBy("cell_idx").agg(F.sum(whole()).alias("t"), F.count("*").alias("n"), F.sum(F.when(F.col("_m"), whole()).otherwise(0)).alias("m"))
    out = cells.select("cell_idx").join(per, "cell_idx", "left")
    t, m = F.coalesce("t", F.lit(0)), F.coalesce("m", F.lit(0))
    return out.select("cell_idx", t.alias("num_counts"), F.coalesce("n", F.lit(0)).alias("num_genes"), ratio(m, t).alias("mito_fraction"))


def gene_stats(counts: DataFrame, genes: DataFrame, n_cells: int) -> DataFrame:
    """(gene_idx, nonzero, mean, variance) over all n cells: var = (n*S2 - S*S) / (n (n - 1)), sums exact."""
    per = counts.groupBy("gene_idx").agg(F.sum(whole()).alias("s"), F.sum(whole() * whole()).alias("q"), F.count("*").alias("nonzero"))
    out = genes.select("gene_idx").join(per, "gene_idx", "left").na.fill(0, ["s", "q", "nonzero"])
    above = (F.lit(n_cells).cast("decimal(20,0)") * F.col("q").cast("decimal(18,0)") - F.col("s").cast("decimal(19,0)") * F.col("s").cast("decimal(19,0)")).cast("double")
    return out.select("gene_idx", "nonzero", (F.col("s") / F.lit(float(n_cells))).alias("mean"), (above / F.lit(float(n_cells) * max(1, n_cells - 1))).alias("variance"))


def clipped_sums(counts: DataFrame, clips: DataFrame, *by: str) -> DataFrame:
    """([by,] gene_idx, clipped_sum, clipped_square_sum) with values over a gene's clip taken as the clip. Whole
    parts are summed exactly; clipped ones are a count times the clip."""
    keys = [*by, "gene_idx"]
    j = counts.join(clips, keys)
    over = whole() > F.col("clip")
    per = j.groupBy(*keys, "clip").agg(F.sum(F.when(~over, whole()).otherwise(0)).alias("s"), F.sum(F.when(~over, whole() * whole()).otherwise(0)).alias("q"), F.count_if(over).alias("k"))
    return per.select(*keys, (F.col("s") + F.col("k") * F.col("clip")).alias("clipped_sum"), (F.col("q") + F.col("k") * F.col("clip") * F.col("clip")).alias("clipped_square_sum"))


def gene_std(counts: DataFrame, genes: DataFrame, n_cells: int, floor: float = 1e-8) -> DataFrame:
    """(gene_idx, std): unbiased, over all cells, floored."""
    return gene_stats(counts, genes, n_cells).select("gene_idx", F.greatest(F.sqrt(F.greatest("variance", F.lit(0.0))), F.lit(floor)).alias("std"))


def grouped_sum(counts: DataFrame, groups: DataFrame, *by: str) -> DataFrame:
    """Sum of counts for each (group, gene); cells without a group are left out."""
    known = groups.select("cell_idx", *by).na.drop(subset=list(by))
    return counts.join(known, "cell_idx").groupBy(*by, "gene_idx").agg(F.sum(whole()).alias("value"))


def grouped_detection(counts: DataFrame, groups: DataFrame, by: str, genes: DataFrame | None = None) -> DataFrame:
    """(group, gene_idx, detected, total): cells with a stored entry, and the sum of values in doubles."""
    if genes is not None:
        counts = counts.join(genes.select("gene_idx"), "gene_idx", "left_semi")
    known = groups.select("cell_idx", by).na.drop(subset=[by])
    return counts.join(known, "cell_idx").groupBy(by, "gene_idx").agg(F.count("*").alias("detected"), F.sum(F.col("value").cast("double")).alias("total"))


def sums_at_least(counts: DataFrame, axis: str, threshold: float, what: str = "sum") -> DataFrame:
    """(axis, passed) for rows or columns whose sum (or number of stored entries) reaches a threshold."""
    total = F.sum("value") if what == "sum" else F.count("*")
    return counts.groupBy(axis).agg((total >= threshold).alias("passed"))


def bin_count(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    return df.groupBy(label).agg((F.count("*") if weight is None else F.sum(weight)).alias("count"))


def all_zero_genes(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes without any nonzero value."""
    return genes.select("gene_idx").join(counts.where("value <> 0").select("gene_idx").distinct(), "gene_idx", "left_anti")


def quantiles(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """Linear-interpolation quantile of each group; zeros must be rows."""
    return df.groupBy(by).agg(F.percentile(value, F.lit(q)).alias("quantile"))


def crosstab(df: DataFrame, rows: str, columns: str, normalize: bool = False) -> DataFrame:
    """Contingency table in long form (rows, columns, count[, fraction of the row])."""
    out = df.groupBy(rows, columns).agg(F.count("*").alias("count"))
    if normalize:
        out = out.withColumn("fraction", F.col("count") / F.sum("count").over(Window.partitionBy(rows)))
    return out
