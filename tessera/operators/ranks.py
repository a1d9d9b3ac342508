"""Windowed computations: multiple-testing corrections, ranks, top-k and the Pareto front."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fdr(df: DataFrame, p: str, by: Sequence[str] = (), order: str | None = None, name: str = "FDR") -> DataFrame:
    """Benjamini-Hochberg: from the largest p down, the running minimum of p n / rank; nulls stay null and
    do not count."""
    part = Window.partitionBy(*by)
    down = part.orderBy(F.col(p).desc_nulls_last(), *([order] if order else []))
    n = F.count(p).over(part)
    rank = n - F.row_number().over(down) + 1
    some = df.withColumn("_q", F.when(F.col(p).isNotNull(), F.col(p) * n / rank))
    low = F.min("_q").over(down.rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn(name, F.when(F.col(p).isNotNull(), low)).drop("_q")


def bonferroni(df: DataFrame, p: str, by: Sequence[str] = (), name: str = "Bonferroni") -> DataFrame:
    return df.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.count(p).over(Window.partitionBy(*by)))))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Ascending rank, ties at their average."""
    part = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(name, F.rank().over(part.orderBy(value)) + (ties - 1) / F.lit(2.0))


def ordinal_rank(df: DataFrame, value: str, tie: str, by: Sequence[str] = (), descending: bool = False, name: str = "rank") -> DataFrame:
    order = F.col(value).desc() if descending else F.col(value).asc()
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order, tie)))


def group_size(df: DataFrame, by: Sequence[str], name: str = "size") -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*by)))


def top_k(df: DataFrame, value: str, tie: str, k: int, by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Bounded top-k of each group (partial limits before the shuffle)."""
    return ordinal_rank(df, value, tie, by, descending, "_r").where(F.col("_r") <= k).drop("_r")


def top_fraction(df: DataFrame, value: str, tie: str, fraction: float, by: Sequence[str] = (), name: str = "chosen") -> DataFrame:
    """Marks the floor(n * fraction) highest of each group."""
    part = Window.partitionBy(*by)
    rank = F.row_number().over(part.orderBy(F.col(value).desc(), tie))
    return df.withColumn(name, rank <= F.floor(F.count("*").over(part) * fraction))


def pareto_front(df: DataFrame, by: Sequence[str], x: str, y: str, tie: str) -> DataFrame:
    """Rows that no other of the group beats or equals on both x and y; of exact ties the highest `tie`
    stays. A skyline needs no pairs: by descending x, keep what exceeds the running maximum of y."""
    order = Window.partitionBy(*by).orderBy(F.col(x).desc(), F.col(y).desc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("_best", F.max(y).over(order))
    return marked.where(F.col("_best").isNull() | (F.col(y) > F.col("_best"))).drop("_best")


def find_markers(detected: DataFrame, sizes: DataFrame, by: str, *, all_genes: bool = False, min_detection_rate: float = 0.25, min_fold_change: float = 2.0, pareto: bool = True) -> DataFrame:
    """Markers of each cell type from detection counts (by, gene_idx, detected) and sizes (by, n).

    rate = detected / n; fold = rate * (N - n) / (detected elsewhere): infinite where no other type has the
    gene. Candidates pass both minima; `pareto` keeps those not dominated on (rate, fold).
    """
    total = sizes.agg(F.sum("n").alias("all_n"))
    every = Window.partitionBy("gene_idx")
    from tessera.operators.aggregates import ratio

    rows = detected.join(sizes.select(by, "n"), by).crossJoin(F.broadcast(total)).withColumn("all_d", F.sum("detected").over(every))
    rate = F.col("detected") / F.col("n")
    rows = rows.withColumn("detection_rate", rate).withColumn("fold_change", ratio(F.col("detection_rate") * (F.col("all_n") - F.col("n")), F.col("all_d") - F.col("detected")))
    good = rows.where((F.col("detection_rate") >= min_detection_rate) & (F.col("fold_change") >= min_fold_change))
    front = pareto_front(good, [by], "detection_rate", "fold_change", "gene_idx") if pareto else good
    cols = [by, "gene_idx", "detection_rate", "fold_change"]
    if not all_genes:
        return front.select(*cols)
    marks = front.select(by, "gene_idx", F.lit(True).alias("_m"))
    return rows.join(marks, [by, "gene_idx"], "left").select(*cols, F.coalesce("_m", F.lit(False)).alias("marker"))


def get_hits(table: DataFrame, significance_column: str = "FDR", threshold: float = 0.05, num_top_hits: int | None = None) -> DataFrame:
    """Rows strictly below the threshold, the first num_top_hits of each cell type if given."""
    good = table.where(F.col(significance_column) < threshold)
    if num_top_hits is not None:
        good = top_k(good, significance_column, "gene", num_top_hits, ["cell_type"], descending=False)
    return good.orderBy(significance_column, "cell_type", "gene")


def get_num_hits(table: DataFrame, significance_column: str = "FDR", threshold: float = 0.05) -> DataFrame:
    """Number of hits of each cell type that has any."""
    return table.where(F.col(significance_column) < threshold).groupBy("cell_type").agg(F.count("*").alias("num_hits")).orderBy("cell_type")
