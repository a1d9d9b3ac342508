"""Parquet layout of a dataset, and MatrixMarket text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def write(df: DataFrame, path: str, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_json(spark: SparkSession, value: dict, path: str, overwrite: bool = False) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """Entries (row, col, value), 0-based, of a MatrixMarket coordinate file (.mtx, .mtx.gz); the header's
    size line is told from entries by being the first line that is no comment."""
    lines = spark.read.text(path).where("value not like '\\%%' and trim(value) <> ''")
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    head = spark.read.text(path).where("value not like '\\%%' and trim(value) <> ''").limit(1).first()
    if head is None:
        raise ValueError(f"{path} is no MatrixMarket file")
    size = head[0].split()
    rows = parts.select(F.col("p")[0].cast("bigint").alias("r"), F.col("p")[1].cast("bigint").alias("c"), F.coalesce(F.get("p", F.lit(2)), F.lit("1")).cast("double").alias("v"), F.concat_ws(" ", "p").alias("line"))
    total = " ".join(size)
    # The size line has the matrix's own dimensions; an entry of the same text can only repeat its corner.
    counted = rows.where(F.col("line") == total).count()
    body = rows.where(F.col("line") != total)
    if counted > 1:
        extra = spark.range(counted - 1).select(F.lit(int(size[0])).alias("r"), F.lit(int(size[1])).alias("c"), F.lit(float(size[2])).alias("v"), F.lit(total).alias("line"))
        body = body.unionByName(extra)
    return body.select((F.col("r") - 1).alias("row"), (F.col("c") - 1).alias("col"), F.col("v").alias("value"))


def write_mtx(entries: DataFrame, n_rows: int, n_cols: int, path: str, overwrite: bool = False, gzip: bool = False) -> None:
    """A folder with one MatrixMarket part (the format has one header)."""
    spark = entries.sparkSession
    body = entries.select(F.concat_ws(" ", F.col("row") + 1, F.col("col") + 1, F.col("value")).alias("value"), F.lit(1).alias("o"), "row", "col")
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general", 0, -2, 0), (f"{n_rows} {n_cols} {entries.count()}", 0, -1, 0)], "value string, o int, row long, col long")
    one = head.unionByName(body.select("value", "o", F.col("row").cast("long"), F.col("col").cast("long"))).coalesce(1).sortWithinPartitions("o", "row", "col").select("value")
    one.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "gzip" if gzip else "none").text(path)
