from pyspark.sql import functions as F

from tessera.operators import aggregates as ag
from tessera.streaming import incremental


def test_running_sums_equal_batch_sums(spark, tmp_path):
    rows = [(0, 0, 2), (0, 1, 3), (1, 1, 5), (2, 2, 1), (2, 0, 4)]
    x = spark.createDataFrame(rows, "cell_idx long, gene_idx int, value int")
    for i in range(2):
        x.where(F.col("gene_idx") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    mito = spark.createDataFrame([(0,)], "gene_idx int")
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.qc_sums(stream, mito).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = incremental.with_fraction(spark.table("sums")).select("cell_idx", "num_counts", "num_genes", "mito_fraction")
    want = ag.qc_metrics(x, spark.range(3).withColumnRenamed("id", "cell_idx"), mito)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
