"""Incremental sums over a stream of counts: what is decomposable in QC and pseudobulk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import ratio, whole


def qc_sums(stream: DataFrame, mito: DataFrame) -> DataFrame:
    """Running (cell_idx, num_counts, num_genes, mito_counts) of a stream (cell_idx, gene_idx, value); each
    entry may come once. mito: a static frame of gene_idx."""
    flagged = stream.join(F.broadcast(mito.select("gene_idx", F.lit(True).alias("_m"))), "gene_idx", "left")
    return flagged.groupBy("cell_idx").agg(F.sum(whole()).alias("num_counts"), F.count("*").alias("num_genes"), F.sum(F.when(F.col("_m"), whole()).otherwise(0)).alias("mito_counts"))


def with_fraction(sums: DataFrame) -> DataFrame:
    return sums.withColumn("mito_fraction", ratio(F.col("mito_counts"), F.col("num_counts")))


def pseudobulk_sums(stream: DataFrame, cells: DataFrame) -> DataFrame:
    """Running (cell_type, sample, gene_idx, value) of a stream of counts; cells: static (cell_idx, cell_type,
    sample), null groups left out."""
    known = cells.select("cell_idx", "cell_type", "sample").na.drop()
    return stream.join(known, "cell_idx").groupBy("cell_type", "sample", "gene_idx").agg(F.sum(whole()).alias("value"))
