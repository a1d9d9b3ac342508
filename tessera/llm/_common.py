"""Shared helpers: staging in the cluster's shared folder, document input, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset a session on one machine gets a
    temporary folder; a cluster has none that all of it can read, so that is an error there."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


#: Spark's setting that removes an execution's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and a lost
    executor costs no recomputation of what came before. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the table stands for what was shuffled
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what came from them is staged itself."""
    for df in frames:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def doc_input(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), text (null: empty) and a key that tells rows of one doc_id with unlike texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)


def row_key() -> "F.Column":
    """Key of a document row: rows with equal key have the same id and text, and so the same result."""
    return F.xxhash64("doc_id", "text")


def slots(df: DataFrame) -> int:
    """Shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table (DataFrame operations only).

    Returns (node, root) with root the smallest node that can be reached, for every node that has an
    edge to another one. Alternates large-star and small-star rounds (Kiveris et al., 2014): each is
    one partially aggregated minimum and one equi-join, so a hub never meets in a single task's
    memory, and AQE splits its join partition. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    star = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(low.alias("u"), high.alias("v")).distinct()
    star = staged(star, "edges")
    before = None
    while True:
        n, mark = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not n or (n, mark) == before:
            return star.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(star.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = (n, mark)
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = star.join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        wide = staged(wide, "wide")
        unstage(star)
        least = wide.groupBy("v").agg(F.min("u").alias("m"))
        near = wide.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v")))).alias("e")).select("e.u", "e.v")
        star = staged(near.where("u <> v").distinct(), "star")
        unstage(wide)
