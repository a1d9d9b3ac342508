"""Named queries over the test tables, and DuckDB SQL for the same rows.

Mapping: a customer is a cell (its market segment the cell type, its nation the sample, its region the
batch), brand/type of a part is a gene, and the quantity ordered is the count; PROMO parts stand for
mitochondrial genes. Embeddings stand for principal components.
"""



from collections.abc import Callable

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.dataset import SingleCell, concat_obs, concat_var
from tessera.functions import stats
from tessera.operators import aggregates as ag
from tessera.operators import bulk, graphs, integration, neighbors, ranks
from tessera.operators import cells as cl
from tessera.operators import tables as tb
from tessera.pseudobulk import DE, Pseudobulk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, fine: bool = False) -> SingleCell:
    """fine: every part is a gene of its own, so that samples miss some genes at any scale."""
    t = lambda n: table(spark, sf_dir, n)
    gene = F.col("p_partkey").cast("string") if fine else F.concat_ws("/", "p_brand", "p_type")
    part = t("part").select("p_partkey", gene.alias("gene"), (F.col("p_type") == "PROMO").alias("mito"))
    genes = part.groupBy("gene").agg(F.max("mito").alias("mito"))
    var = genes.select((F.row_number().over(Window.orderBy("gene")) - 1).alias("gene_idx"), "gene", "mito")
    nation = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("batch"))
    obs = t("customer").join(F.broadcast(nation), "c_nationkey").select(F.col("c_custkey").alias("cell_idx"), F.col("c_name").alias("cell"), F.col("c_mktsegment").alias("cell_type"), F.col("c_nationkey").alias("sample"), "batch", F.col("c_acctbal").alias("balance"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("o_custkey").alias("cell_idx"), "gene").agg(F.sum("l_quantity").cast("bigint").alias("value"))
    x = named.join(F.broadcast(var.select("gene", "gene_idx")), "gene").select("cell_idx", "gene_idx", "value")
    return SingleCell(x, obs, var, check=False)


BASE = """WITH part_genes AS (SELECT p_partkey, p_brand || '/' || p_type AS gene, p_type = 'PROMO' AS mito FROM part),
genes AS (SELECT gene, bool_or(mito) AS mito FROM part_genes GROUP BY gene),
cells AS (SELECT c_custkey AS cell, c_name, c_mktsegment AS cell_type, c_nationkey AS sample, n_regionkey AS batch, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey),
counts AS (SELECT o_custkey AS cell, gene, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part_genes ON l_partkey = p_partkey GROUP BY 1, 2),
metrics AS (SELECT c.cell, CAST(coalesce(sum(value), 0) AS BIGINT) AS num_counts, count(value) AS num_genes, CAST(coalesce(sum(CASE WHEN g.mito THEN value END), 0) AS BIGINT) AS m FROM cells c LEFT JOIN counts USING (cell) LEFT JOIN genes g USING (gene) GROUP BY c.cell),
flags AS (SELECT cell, num_counts > 0 AND CAST(m AS DOUBLE) / nullif(num_counts, 0) <= 0.2 AND num_genes >= 20 AS passed FROM metrics)"""


def gene_names(s: SingleCell, df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.join(F.broadcast(s.var.select("gene_idx", "gene")), "gene_idx").select("gene", *columns)


def passing(s: SingleCell) -> SingleCell:
    return s.qc(max_mito_fraction=0.2, min_genes=20, nonzero_MALAT1=False, mito=F.col("mito"))


@query("qc_metrics", BASE + " SELECT cell, num_counts, num_genes, CASE WHEN num_counts = 0 THEN CAST('NaN' AS DOUBLE) ELSE round(CAST(m AS DOUBLE) / num_counts, 9) END AS mito_fraction FROM metrics")
def _(spark, sf):
    s = dataset(spark, sf)
    m = ag.qc_metrics(s.X, s.obs, s.var.where("mito"))
    return m.select(F.col("cell_idx").alias("cell"), "num_counts", "num_genes", F.round("mito_fraction", 9).alias("mito_fraction"))


@query("qc_pass", BASE + " SELECT cell, coalesce(passed, false) AS passed_qc FROM flags")
def _(spark, sf):
    return passing(dataset(spark, sf)).obs.select(F.col("cell_idx").alias("cell"), F.col("passed_QC").alias("passed_qc"))


@query("qc_required_gene", BASE + ", one AS (SELECT min(gene) AS gene FROM genes) SELECT cell, coalesce(passed, false) AND cell IN (SELECT cell FROM counts WHERE gene = (SELECT gene FROM one)) AS passed_qc FROM flags")
def _(spark, sf):
    s = dataset(spark, sf)
    gene = s.var.agg(F.min("gene")).first()[0]
    return s.qc(max_mito_fraction=0.2, min_genes=20, required_gene=gene, mito=F.col("mito")).obs.select(F.col("cell_idx").alias("cell"), F.col("passed_QC").alias("passed_qc"))


@query("skip_qc", BASE + " SELECT count(*) AS cells, true AS qced FROM cells")
def _(spark, sf):
    s = dataset(spark, sf).skip_qc()
    return s.obs.agg(F.count("*").alias("cells"), F.lit(s.uns["QCed"]).alias("qced"))


_NORM = BASE + ", sizes AS (SELECT cell, CAST(sum(value) AS DOUBLE) AS s FROM counts GROUP BY cell), f AS (SELECT sum(coalesce(s, 0)) / count(*) AS f FROM flags LEFT JOIN sizes USING (cell) WHERE passed)"


@query("normalize_log1ppf", _NORM + " SELECT cell, gene, round(ln(1 + value * f / s), 6) AS value FROM counts JOIN sizes USING (cell), f")
def _(spark, sf):
    s = passing(dataset(spark, sf)).normalize("log1pPF")
    return gene_names(s, s.X, F.col("cell_idx").alias("cell"), F.round("value", 6).alias("value"))


@query("normalize_logcp10k", _NORM + " SELECT cell, gene, round(ln(1 + value * 10000.0 / s), 6) AS value FROM counts JOIN sizes USING (cell)")
def _(spark, sf):
    s = passing(dataset(spark, sf)).normalize("logCP10k")
    return gene_names(s, s.X, F.col("cell_idx").alias("cell"), F.round("value", 6).alias("value"))


@query("normalize_pflog1ppf", _NORM + ", y AS (SELECT cell, gene, ln(1 + value * f / s) AS y FROM counts JOIN sizes USING (cell), f), t AS (SELECT cell, sum(y) AS t FROM y GROUP BY cell), g AS (SELECT sum(coalesce(t, 0)) / count(*) AS g FROM flags LEFT JOIN t USING (cell) WHERE passed) SELECT cell, gene, round(y * g / t, 6) AS value FROM y JOIN t USING (cell), g")
def _(spark, sf):
    s = passing(dataset(spark, sf)).normalize("PFlog1pPF")
    return gene_names(s, s.X, F.col("cell_idx").alias("cell"), F.round("value", 6).alias("value"))


_STATS = BASE + ", n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells), stats AS (SELECT gene, count(value) AS nonzero, coalesce(sum(CAST(value AS DOUBLE)), 0) AS s, coalesce(sum(CAST(value AS DOUBLE) * value), 0) AS q FROM genes LEFT JOIN counts USING (gene) GROUP BY gene)"


@query("gene_mean_var", _STATS + " SELECT gene, nonzero, round(s / n, 6) AS mean, round((n * q - s * s) / (n * (n - 1)), 6) AS variance FROM stats, n")
def _(spark, sf):
    s = dataset(spark, sf)
    g = ag.gene_stats(s.X, s.var, s.obs.count())
    return gene_names(s, g, "nonzero", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("gene_std", _STATS + " SELECT gene, round(greatest(sqrt(greatest((n * q - s * s) / (n * (n - 1)), 0)), 1e-8), 6) AS std FROM stats, n")
def _(spark, sf):
    s = dataset(spark, sf)
    return gene_names(s, ag.gene_std(s.X, s.var, s.obs.count()), F.round("std", 6).alias("std"))


@query("clipped_sums", BASE + " SELECT gene, CAST(sum(least(value, 40)) AS DOUBLE) AS clipped_sum, CAST(sum(least(value, 40) * least(value, 40)) AS DOUBLE) AS clipped_square_sum FROM counts GROUP BY gene")
def _(spark, sf):
    s = dataset(spark, sf)
    return gene_names(s, ag.clipped_sums(s.X, s.var.select("gene_idx", F.lit(40.0).alias("clip"))), "clipped_sum", "clipped_square_sum")


@query("detection_counts", BASE + " SELECT cell_type, gene, count(*) AS detected, CAST(sum(value) AS DOUBLE) AS total FROM counts JOIN cells USING (cell) GROUP BY 1, 2")
def _(spark, sf):
    s = dataset(spark, sf)
    return gene_names(s, ag.grouped_detection(s.X, s.obs, "cell_type"), "cell_type", "detected", "total")


@query("detection_counts_subset", BASE + " SELECT cell_type, gene, count(*) AS detected, CAST(sum(value) AS DOUBLE) AS total FROM counts JOIN cells USING (cell) JOIN genes USING (gene) WHERE mito GROUP BY 1, 2")
def _(spark, sf):
    s = dataset(spark, sf)
    return gene_names(s, ag.grouped_detection(s.X, s.obs, "cell_type", s.var.where("mito")), "cell_type", "detected", "total")


@query("sums_at_least", BASE + " SELECT cell, sum(value) >= 500 AS passed FROM counts GROUP BY cell")
def _(spark, sf):
    s = dataset(spark, sf)
    return ag.sums_at_least(s.X, "cell_idx", 500).withColumnRenamed("cell_idx", "cell")


@query("entries_at_least", BASE + " SELECT gene, count(*) >= 100 AS passed FROM counts GROUP BY gene")
def _(spark, sf):
    s = dataset(spark, sf)
    return gene_names(s, ag.sums_at_least(s.X, "gene_idx", 100, "entries"), "passed")


@query("bin_count", BASE + " SELECT sample, count(*) AS count FROM cells GROUP BY sample")
def _(spark, sf):
    return ag.bin_count(dataset(spark, sf).obs, "sample")


@query("weighted_bin_count", BASE + " SELECT cell_type, CAST(sum(value) AS BIGINT) AS count FROM counts JOIN cells USING (cell) GROUP BY cell_type")
def _(spark, sf):
    s = dataset(spark, sf)
    return ag.bin_count(s.X.join(s.obs, "cell_idx"), "cell_type", "value")


@query("all_zero_genes", BASE + " SELECT gene FROM genes WHERE gene NOT IN (SELECT gene FROM counts WHERE value <> 0)")
def _(spark, sf):
    s = dataset(spark, sf)
    return gene_names(s, ag.all_zero_genes(s.X, s.var))


@query("obs_aggregate", BASE + " SELECT cell_type, batch, count(*) AS cells, round(avg(balance), 4) AS mean_balance FROM cells GROUP BY 1, 2")
def _(spark, sf):
    return dataset(spark, sf).obs.groupBy("cell_type", "batch").agg(F.count("*").alias("cells"), F.round(F.avg("balance"), 4).alias("mean_balance"))


@query("crosstab", BASE + ", c AS (SELECT cell_type, batch, count(*) AS count FROM cells GROUP BY 1, 2) SELECT *, round(count / sum(count) OVER (PARTITION BY cell_type), 9) AS fraction FROM c")
def _(spark, sf):
    return dataset(spark, sf).heatmap_data("cell_type", "batch", normalize=True).withColumn("fraction", F.round("fraction", 9))


@query("dot_plot", BASE + ", k AS (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1) SELECT cell_type, gene, round(CAST(count(*) AS DOUBLE) / any_value(n), 9) AS detection_rate, round(CAST(sum(value) AS DOUBLE) / any_value(n), 6) AS mean FROM counts JOIN cells USING (cell) JOIN k USING (cell_type) WHERE gene LIKE 'Brand#11/%' GROUP BY 1, 2")
def _(spark, sf):
    s = dataset(spark, sf)
    genes = [r[0] for r in s.var.where("gene like 'Brand#11/%'").select("gene").collect()]
    return s.marker_data(genes, "cell_type").select("cell_type", "gene", F.round("detection_rate", 9).alias("detection_rate"), F.round("mean", 6).alias("mean"))


# --- windows, ranks, top-k

_P = "WITH p AS (SELECT o_orderkey AS id, o_orderpriority AS grp, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE ((o_orderkey * 7919) % 10007 + 1) / 10008.0 END::DOUBLE AS p FROM orders)"


def p_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = F.when(k % 17 != 0, ((k * 7919) % 10007 + 1) / F.lit(10008.0))
    return table(spark, sf, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("grp"), p.alias("p"))


@query("fdr_bonferroni", _P + ", r AS (SELECT *, count(p) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY p DESC NULLS LAST, id) AS d FROM p) SELECT id, grp, round(CASE WHEN p IS NOT NULL THEN min(p * n / (n - d + 1)) OVER (PARTITION BY grp ORDER BY d ROWS UNBOUNDED PRECEDING) END, 9) AS fdr, round(least(1.0, p * n), 9) AS bonferroni FROM r WHERE p IS NOT NULL UNION ALL SELECT id, grp, NULL, NULL FROM p WHERE p IS NULL")
def _(spark, sf):
    d = ranks.bonferroni(ranks.fdr(p_values(spark, sf), "p", ["grp"], "id"), "p", ["grp"])
    return d.select("id", "grp", F.round("FDR", 9).alias("fdr"), F.round("Bonferroni", 9).alias("bonferroni"))


@query("average_rank", "SELECT p_partkey AS id, p_brand AS brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank FROM part")
def _(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), "p_size")
    return ranks.average_rank(d, "p_size", ["brand"]).select("id", "brand", "rank")


@query("ordinal_rank", "SELECT c_custkey AS id, c_mktsegment AS seg, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS size FROM customer")
def _(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    return ranks.group_size(ranks.ordinal_rank(d, "c_acctbal", "id", ["seg"], True), ["seg"]).select("id", "seg", "rank", "size")


@query("top_k", "SELECT * FROM (SELECT c_custkey AS id, c_mktsegment AS seg, c_acctbal AS balance FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 5)")
def _(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("balance"))
    return ranks.top_k(d, "balance", "id", 5, ["seg"])


@query("top_fraction", "SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.1) AS chosen FROM customer")
def _(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("balance"))
    return ranks.top_fraction(d, "balance", "id", 0.1, ["seg"]).select("id", "chosen")


_DE = "WITH d AS (SELECT c_mktsegment AS cell_type, c_name AS gene, ((c_custkey * 7919) % 10007 + 1) / 10008.0::DOUBLE AS fdr FROM customer)"


def de_table(spark: SparkSession, sf: str) -> DE:
    k = F.col("c_custkey")
    p = ((k * 7919) % 10007 + 1) / F.lit(10008.0)
    zero = [F.lit(0.0).alias(c) for c in ("logFC", "SE", "LCI", "UCI", "AveExpr")]
    return DE(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("cell_type"), F.lit("group").alias("coefficient"), F.col("c_name").alias("gene"), *zero, p.alias("p"), p.alias("Bonferroni"), p.alias("FDR")))


@query("get_hits", _DE + " SELECT cell_type, gene, round(fdr, 9) AS fdr FROM d WHERE fdr < 0.1 QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY fdr, gene) <= 10")
def _(spark, sf):
    return de_table(spark, sf).get_hits(threshold=0.1, num_top_hits=10).select("cell_type", "gene", F.round("FDR", 9).alias("fdr"))


@query("get_num_hits", _DE + " SELECT cell_type, count(*) AS num_hits FROM d WHERE fdr < 0.1 GROUP BY cell_type")
def _(spark, sf):
    return de_table(spark, sf).get_num_hits(threshold=0.1)


_MARK = BASE + """, k AS (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1), d AS (SELECT cell_type, gene, count(*) AS det FROM counts JOIN cells USING (cell) GROUP BY 1, 2),
r AS (SELECT cell_type, gene, CAST(det AS DOUBLE) / n AS rate, (SELECT sum(n) FROM k) AS all_n, n, det, sum(det) OVER (PARTITION BY gene) AS all_d FROM d JOIN k USING (cell_type)),
f AS (SELECT cell_type, gene, rate, CASE WHEN all_d = det THEN CAST('Infinity' AS DOUBLE) ELSE rate * (all_n - n) / (all_d - det) END AS fold FROM r),
c AS (SELECT * FROM f WHERE rate >= 0.1 AND fold >= 1.05)"""


@query("markers", _MARK + " SELECT cell_type, gene, round(rate, 9) AS detection_rate, round(fold, 6) AS fold_change FROM c")
def _(spark, sf):
    m = dataset(spark, sf).find_markers("cell_type", min_detection_rate=0.1, min_fold_change=1.05, pareto=False)
    return m.select("cell_type", "gene", F.round("detection_rate", 9).alias("detection_rate"), F.round("fold_change", 6).alias("fold_change"))


_FRONT = " c2 AS (SELECT *, max(fold) OVER (PARTITION BY cell_type ORDER BY rate DESC, fold DESC, gene DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c)"


@query("markers_pareto", _MARK + "," + _FRONT + " SELECT cell_type, gene, round(rate, 9) AS detection_rate, round(fold, 6) AS fold_change FROM c2 WHERE best IS NULL OR fold > best")
def _(spark, sf):
    m = dataset(spark, sf).find_markers("cell_type", min_detection_rate=0.1, min_fold_change=1.05)
    return m.select("cell_type", "gene", F.round("detection_rate", 9).alias("detection_rate"), F.round("fold_change", 6).alias("fold_change"))


@query("markers_all_genes", _MARK + "," + _FRONT + " SELECT f.cell_type, f.gene, round(f.rate, 9) AS detection_rate, round(f.fold, 6) AS fold_change, coalesce(best IS NULL OR c2.fold > best, false) AND c2.gene IS NOT NULL AS marker FROM f LEFT JOIN c2 USING (cell_type, gene)")
def _(spark, sf):
    m = dataset(spark, sf).find_markers("cell_type", min_detection_rate=0.1, min_fold_change=1.05, all_genes=True)
    return m.select("cell_type", "gene", F.round("detection_rate", 9).alias("detection_rate"), F.round("fold_change", 6).alias("fold_change"), "marker")


def _hvg(batch: str) -> str:
    """SQL for the variable genes: trend by local quadratic regression, solved by its normal equations."""
    return BASE + f""", own AS (SELECT cell, {batch} AS b FROM flags JOIN cells USING (cell) WHERE passed),
n AS (SELECT b, CAST(count(*) AS DOUBLE) AS n FROM own GROUP BY b),
pc AS (SELECT b, gene, CAST(value AS DOUBLE) AS v FROM counts JOIN own USING (cell)),
mv AS (SELECT n.b, n, gene, coalesce(sum(v), 0) AS s, coalesce(sum(v * v), 0) AS q FROM genes CROSS JOIN n LEFT JOIN pc USING (b, gene) GROUP BY 1, 2, 3),
st AS (SELECT b, n, gene, s / n AS mean, (n * q - s * s) / (n * (n - 1)) AS var FROM mv),
x AS (SELECT b, gene, log10(mean) AS x, log10(var) AS y FROM st WHERE var > 0),
k AS (SELECT b, least(count(*), greatest(3, ceil(0.3 * count(*)))) AS k FROM x GROUP BY b),
near AS (SELECT l.b, l.gene, r.x - l.x AS z, r.y, row_number() OVER (PARTITION BY l.b, l.gene ORDER BY abs(r.x - l.x)) AS rank FROM x l JOIN x r ON l.b = r.b),
w AS (SELECT near.b, gene, z, y, pow(1 - pow(abs(z) / max(abs(z)) OVER (PARTITION BY near.b, gene), 3), 3) AS w FROM near JOIN k ON near.b = k.b AND rank <= k),
m AS (SELECT b, gene, sum(w) AS s0, sum(w * z) AS s1, sum(w * z * z) AS s2, sum(w * pow(z, 3)) AS s3, sum(w * pow(z, 4)) AS s4, sum(w * y) AS t0, sum(w * z * y) AS t1, sum(w * z * z * y) AS t2 FROM w GROUP BY 1, 2),
f AS (SELECT b, gene, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) AS fit FROM m),
c AS (SELECT b, n, gene, mean, sqrt(pow(10, fit)) AS sd, mean + sqrt(pow(10, fit)) * sqrt(n) AS clip FROM st JOIN f USING (b, gene)),
e AS (SELECT c.b, gene, (n * mean * mean + coalesce(sum(least(v, clip) * least(v, clip)), 0) - 2 * mean * coalesce(sum(least(v, clip)), 0)) / ((n - 1) * sd * sd) AS norm FROM c LEFT JOIN pc USING (b, gene) GROUP BY c.b, gene, n, mean, sd),
r AS (SELECT st.b, st.gene, row_number() OVER (PARTITION BY st.b ORDER BY coalesce(norm, 0) DESC, st.gene) - 1 AS r FROM st LEFT JOIN e USING (b, gene)),
o AS (SELECT gene, count(CASE WHEN r < 30 THEN 1 END) AS among, median(r) AS mid FROM r GROUP BY gene),
final AS (SELECT gene, row_number() OVER (ORDER BY among DESC, mid, gene) AS highly_variable_rank FROM o)
SELECT gene, highly_variable_rank <= 30 AS highly_variable, highly_variable_rank FROM final"""


@query("hvg_rank", _hvg("0"))
def _(spark, sf):
    s = passing(dataset(spark, sf)).hvg(num_genes=30)
    return s.var.select("gene", "highly_variable", "highly_variable_rank")


@query("hvg_batches", _hvg("batch"))
def _(spark, sf):
    s = passing(dataset(spark, sf)).hvg(num_genes=30, batch_column="batch")
    return s.var.select("gene", "highly_variable", "highly_variable_rank")


@query("pca")
def _(spark, sf):
    s = passing(dataset(spark, sf)).hvg(num_genes=30).normalize().pca(num_PCs=10)
    return s.obsm["pca"].select(F.col("cell_idx").alias("cell"), F.posexplode("v").alias("pc", "value")).withColumn("value", F.round("value", 4))


# --- pseudobulk

_PB = BASE + ", pb AS (SELECT cell_type, sample, gene, CAST(sum(value) AS BIGINT) AS value FROM counts JOIN cells USING (cell) GROUP BY 1, 2, 3), pobs AS (SELECT cell_type, sample, any_value(batch) AS batch, count(*) AS num_cells FROM cells GROUP BY 1, 2)"


def bulked(spark: SparkSession, sf: str) -> Pseudobulk:
    return dataset(spark, sf).pseudobulk("sample", "cell_type")


@query("pseudobulk", _PB + " SELECT cell_type, sample, gene, value FROM pb")
def _(spark, sf):
    return bulked(spark, sf).X


@query("pseudobulk_obs", _PB + " SELECT cell_type, sample, num_cells, batch FROM pobs")
def _(spark, sf):
    return bulked(spark, sf).obs.select("cell_type", "sample", "num_cells", "batch")


_FULL = _PB + ", grid AS (SELECT cell_type, sample, gene, coalesce(value, 0) AS value FROM pobs CROSS JOIN (SELECT gene FROM genes) LEFT JOIN pb USING (cell_type, sample, gene)), lib AS (SELECT cell_type, sample, CAST(sum(value) AS DOUBLE) AS library_size FROM pb GROUP BY 1, 2)"


def sized(spark: SparkSession, sf: str) -> Pseudobulk:
    p = bulked(spark, sf)
    lib = p.X.groupBy("cell_type", "sample").agg(F.sum("value").cast("double").alias("library_size"))
    return p._with(obs=p.obs.join(lib, ["cell_type", "sample"], "left"))


@query("cpm", _FULL + " SELECT cell_type, sample, gene, round(value / library_size * 1e6, 4) AS value FROM pb JOIN lib USING (cell_type, sample)")
def _(spark, sf):
    x = sized(spark, sf).cpm().X
    return x.withColumn("value", F.round("value", 4))


@query("log_cpm", _FULL + ", m AS (SELECT cell_type, sample, library_size, 2 * library_size / avg(library_size) OVER (PARTITION BY cell_type) AS a FROM lib) SELECT cell_type, sample, gene, round(log2(value + a) - log2(library_size + 2 * a) + log2(1e6), 6) AS value FROM grid JOIN m USING (cell_type, sample)")
def _(spark, sf):
    return sized(spark, sf).log_cpm().X.withColumn("value", F.round("value", 6))


@query("sample_quantiles", _FULL + " SELECT cell_type, sample, quantile_cont(CAST(value AS DOUBLE), 0.75) AS quantile FROM grid GROUP BY 1, 2")
def _(spark, sf):
    p = bulked(spark, sf)
    rows = bulk.full(p.X, p.obs, p.var).withColumn("key", F.struct("cell_type", "sample"))
    return ag.quantiles(rows, "key", "value", 0.75).select("key.cell_type", "key.sample", "quantile")


_QC = _FULL.replace("p_brand || '/' || p_type AS gene", "CAST(p_partkey AS VARCHAR) AS gene") + """, o1 AS (SELECT * FROM pobs WHERE num_cells >= 2),
t1 AS (SELECT cell_type FROM (SELECT cell_type, batch, count(*) AS n FROM o1 GROUP BY 1, 2) GROUP BY cell_type HAVING min(n) >= 2 AND count(*) > 1),
z AS (SELECT cell_type, sample, batch, num_cells, sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS zeros FROM grid JOIN o1 USING (cell_type, sample) WHERE cell_type IN (SELECT cell_type FROM t1) GROUP BY 1, 2, 3, 4),
l AS (SELECT cell_type, avg(zeros) + 3 * stddev_pop(zeros) AS most FROM z GROUP BY 1),
o2 AS (SELECT z.* FROM z JOIN l USING (cell_type) WHERE zeros < most),
t2 AS (SELECT cell_type FROM (SELECT cell_type, batch, count(*) AS n FROM o2 GROUP BY 1, 2) GROUP BY cell_type HAVING min(n) >= 2 AND count(*) > 1),
o3 AS (SELECT * FROM o2 WHERE cell_type IN (SELECT cell_type FROM t2)),
q AS (SELECT cell_type, batch, gene, quantile_cont(CAST(value AS DOUBLE), 0.9) AS q FROM grid JOIN o3 USING (cell_type, sample) GROUP BY 1, 2, 3),
v AS (SELECT cell_type, gene FROM q GROUP BY 1, 2 HAVING min(q) > 0)"""


def checked(spark: SparkSession, sf: str) -> Pseudobulk:
    return dataset(spark, sf, fine=True).pseudobulk("sample", "cell_type").qc("batch", min_cells=2, min_nonzero_fraction=0.1)


@query("pseudobulk_qc", _QC + " SELECT cell_type, sample, gene, value FROM pb JOIN o3 USING (cell_type, sample) JOIN v USING (cell_type, gene)")
def _(spark, sf):
    return checked(spark, sf).X


@query("pseudobulk_qc_samples", _QC + " SELECT cell_type, sample, num_cells FROM o3")
def _(spark, sf):
    return checked(spark, sf).obs.select("cell_type", "sample", "num_cells")


_TMM = _FULL + """, g AS (SELECT cell_type, sample, gene, CAST(value AS DOUBLE) AS x, library_size AS l, max(value) OVER (PARTITION BY cell_type, gene) AS m FROM grid JOIN lib USING (cell_type, sample)),
y AS (SELECT * FROM g WHERE m > 0),
f AS (SELECT cell_type, sample, quantile_cont(x, 0.75) / any_value(l) AS f75 FROM y GROUP BY 1, 2),
ref AS (SELECT cell_type, sample AS ref FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY abs(f75 - m), CAST(sample AS VARCHAR)) AS k FROM (SELECT *, avg(f75) OVER (PARTITION BY cell_type) AS m FROM f)) WHERE k = 1),
p AS (SELECT a.cell_type, a.sample, a.x, a.l, b.x AS x0, b.l AS l0, log2((a.x / a.l) / (b.x / b.l)) AS r, 1 / ((a.l - a.x) / a.l / a.x + (b.l - b.x) / b.l / b.x) AS w, a.x / b.x AS ratio, a.x * b.x AS product FROM y a JOIN ref USING (cell_type) JOIN y b ON b.cell_type = a.cell_type AND b.sample = ref AND b.gene = a.gene WHERE a.x > 0 AND b.x > 0),
k AS (SELECT *, count(*) OVER t AS n, rank() OVER (PARTITION BY cell_type, sample ORDER BY ratio) + (count(*) OVER (PARTITION BY cell_type, sample, ratio) - 1) / 2.0 AS rr, rank() OVER (PARTITION BY cell_type, sample ORDER BY product) + (count(*) OVER (PARTITION BY cell_type, sample, product) - 1) / 2.0 AS rs FROM p WINDOW t AS (PARTITION BY cell_type, sample)),
c AS (SELECT cell_type, sample, CASE WHEN max(abs(r)) < 1e-6 THEN 1.0 ELSE pow(2, coalesce(sum(CASE WHEN kept THEN w * r END) / sum(CASE WHEN kept THEN w END), 0)) END AS factor FROM (SELECT *, rr BETWEEN floor(n * 0.3) + 1 AND n - floor(n * 0.3) AND rs BETWEEN floor(n * 0.05) + 1 AND n - floor(n * 0.05) AS kept FROM k) GROUP BY 1, 2)"""


@query("library_size", _TMM + " SELECT cell_type, sample, round(library_size * factor / exp(avg(ln(factor)) OVER (PARTITION BY cell_type)), 4) AS library_size FROM c JOIN lib USING (cell_type, sample)")
def _(spark, sf):
    return bulked(spark, sf).library_size().obs.select("cell_type", "sample", F.round("library_size", 4).alias("library_size"))


@query("regress_out", _FULL + """, m AS (SELECT cell_type, sample, library_size, 2 * library_size / avg(library_size) OVER (PARTITION BY cell_type) AS a FROM lib),
y AS (SELECT cell_type, sample, gene, CAST(num_cells AS DOUBLE) AS x, log2(value + a) - log2(library_size + 2 * a) + log2(1e6) AS y FROM grid JOIN m USING (cell_type, sample) JOIN pobs USING (cell_type, sample))
SELECT cell_type, sample, gene, round(y - avg(y) OVER t - regr_slope(y, x) OVER t * (x - avg(x) OVER t), 6) AS value FROM y WINDOW t AS (PARTITION BY cell_type, gene)""")
def _(spark, sf):
    p = sized(spark, sf).log_cpm()
    p = p.regress_out("~ num_cells", error_if_int=False)
    return p.X.withColumn("value", F.round("value", 6))


def tested(spark: SparkSession, sf: str) -> Pseudobulk:
    p = bulked(spark, sf).library_size()
    return p.with_columns_obs(side=F.when(F.col("batch") < 2, F.lit("a")).otherwise(F.lit("b")))


@query("de")
def _(spark, sf):
    d = tested(spark, sf).cast_obs({"num_cells": "double"}).de("~ side + num_cells", group=False)
    return d.table.select("cell_type", "coefficient", "gene", *(F.round(c, 5).alias(c) for c in DE.COLUMNS[3:]))


@query("de_by_group")
def _(spark, sf):
    d = tested(spark, sf).de("~ side")
    return d.table.select("cell_type", "coefficient", "gene", *(F.round(c, 5).alias(c) for c in DE.COLUMNS[3:]))


@query("de_contrasts")
def _(spark, sf):
    d = tested(spark, sf).de("~ 0 + side", contrasts={"b_a": "sideb - sidea"}, group=False)
    return d.table.select("cell_type", "coefficient", "gene", *(F.round(c, 5).alias(c) for c in DE.COLUMNS[3:]))


# --- metadata

@query("filter_obs", BASE + " SELECT cell, gene, value FROM counts JOIN cells USING (cell) WHERE balance > 5000 AND cell_type = 'BUILDING'")
def _(spark, sf):
    s = dataset(spark, sf).filter_obs(F.col("balance") > 5000, cell_type="BUILDING")
    return gene_names(s, s.X, F.col("cell_idx").alias("cell"), "value")


@query("filter_var", BASE + " SELECT cell, gene, value FROM counts JOIN genes USING (gene) WHERE mito")
def _(spark, sf):
    s = dataset(spark, sf).filter_var("mito")
    return gene_names(s, s.X, F.col("cell_idx").alias("cell"), "value")


@query("obs_columns", BASE + " SELECT cell, c_name AS name, upper(cell_type) AS kind, balance / 2 AS half, CAST(sample AS VARCHAR) AS sample FROM cells")
def _(spark, sf):
    s = dataset(spark, sf).with_columns_obs(half=F.col("balance") / 2, kind=F.upper("cell_type")).drop_obs("batch", "cell_type").cast_obs({"sample": "string"})
    s = s.select_obs("kind", "half", "sample").rename_obs({"cell": "name"})
    return s.obs.withColumnRenamed("cell_idx", "cell")


@query("cast_x", BASE + " SELECT cell, gene, CAST(value AS DOUBLE) AS value FROM counts")
def _(spark, sf):
    s = dataset(spark, sf).cast_X("double").tocsc().tocsr()
    return gene_names(s, s.X, F.col("cell_idx").alias("cell"), "value")


@query("getitem_slice", BASE + ", o AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS i FROM cells), g AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS i FROM genes) SELECT cell, gene, value FROM counts JOIN o USING (cell) JOIN g USING (gene) WHERE o.i >= 10 AND o.i < 50 AND g.i IN (0, 3, (SELECT count(*) - 1 FROM g))")
def _(spark, sf):
    s = dataset(spark, sf)[10:50, [0, 3, -1]]
    return gene_names(s, s.X, F.col("cell_idx").alias("cell"), "value")


@query("gene_vector", BASE + ", one AS (SELECT min(gene) AS gene FROM genes) SELECT c_name AS cell, coalesce(value, 0) AS value FROM cells LEFT JOIN (SELECT * FROM counts WHERE gene = (SELECT gene FROM one)) c USING (cell)")
def _(spark, sf):
    s = dataset(spark, sf)
    return s.gene(s.var.agg(F.min("gene")).first()[0])


@query("cell_vector", BASE + ", one AS (SELECT cell FROM cells WHERE c_name = (SELECT min(c_name) FROM cells)) SELECT gene, coalesce(value, 0) AS value FROM genes LEFT JOIN (SELECT * FROM counts WHERE cell = (SELECT cell FROM one)) c USING (gene)")
def _(spark, sf):
    s = dataset(spark, sf)
    return s.cell(s.obs.agg(F.min("cell")).first()[0])


@query("filter_columns", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.lit(1).alias("one"))
    return tb.filter_columns(d, lambda c: F.count_distinct(c) > 1)


@query("sample_covariates", BASE + " SELECT sample, any_value(batch) AS batch FROM cells GROUP BY sample")
def _(spark, sf):
    return dataset(spark, sf).get_sample_covariates("sample").select("sample", "batch")


@query("peek_obs", BASE + ", c AS (SELECT * FROM cells ORDER BY cell LIMIT 1) SELECT 'cell' AS column, c_name AS value FROM c UNION ALL SELECT 'cell_type', cell_type FROM c UNION ALL SELECT 'sample', CAST(sample AS VARCHAR) FROM c UNION ALL SELECT 'batch', CAST(batch AS VARCHAR) FROM c")
def _(spark, sf):
    return dataset(spark, sf).drop_obs("balance").peek_obs(0)


@query("join_obs", BASE + " SELECT cell, sample, n_name AS nation FROM cells LEFT JOIN nation ON sample = n_nationkey AND n_regionkey < 3")
def _(spark, sf):
    other = table(spark, sf, "nation").where("n_regionkey < 3").select("n_nationkey", F.col("n_name").alias("nation"))
    s = dataset(spark, sf).join_obs(other, left_on="sample", right_on="n_nationkey", validate="m:1")
    return s.obs.select(F.col("cell_idx").alias("cell"), "sample", "nation")


@query("gene_alignment", BASE + ", w AS (SELECT gene, row_number() OVER (ORDER BY gene DESC) - 1 AS request FROM genes WHERE mito), g AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS gene_idx FROM genes) SELECT request, gene, gene_idx FROM w JOIN g USING (gene)")
def _(spark, sf):
    s = dataset(spark, sf)
    wanted = s.var.where("mito").select("gene", (-F.col("gene_idx")).alias("place"))
    return tb.align(s.var, "gene", wanted, "place").select("request", "gene", "gene_idx")


@query("recode_levels", "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS code FROM customer")
def _(spark, sf):
    old = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    code = tb.recode(tb.encode(F.col("c_mktsegment"), old), old, ("MACHINERY", "BUILDING"), other=2)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), code.alias("code"))


@query("concat_obs", BASE + " SELECT c_name AS name, CASE WHEN batch < 2 THEN 'low' ELSE 'high' END AS part, gene, value FROM cells JOIN counts USING (cell)")
def _(spark, sf):
    s = dataset(spark, sf)
    both = concat_obs([s.filter_obs(F.col("batch") < 2), s.filter_obs(F.col("batch") >= 2)], dataset_column="part", dataset_labels=["low", "high"])
    x = both.X.join(both.obs.select("cell_idx", F.col("cell").alias("name"), "part"), "cell_idx")
    return gene_names(both, x, "name", "part", "value")


@query("concat_var", BASE + " SELECT c_name AS name, gene, value FROM cells JOIN counts USING (cell)")
def _(spark, sf):
    s = dataset(spark, sf)
    both = concat_var([s.filter_var(F.col("mito")), s.filter_var(~F.col("mito"))])
    x = both.X.join(both.obs.select("cell_idx", F.col("cell").alias("name")), "cell_idx")
    return gene_names(both, x, "name", "value")


@query("split_by_obs", BASE + " SELECT cell_type, count(*) AS cells FROM cells GROUP BY 1")
def _(spark, sf):
    parts = dataset(spark, sf).split_by_obs("cell_type")
    return tb.concat_rows([p.obs.agg(F.count("*").alias("cells")).select(F.lit(k).alias("cell_type"), "cells") for k, p in parts.items()])


@query("names_unique", "SELECT p_partkey AS id, p_name || CASE WHEN r = 0 THEN '' ELSE '-' || r END AS name FROM (SELECT p_partkey, p_brand AS p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r FROM part)")
def _(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    return tb.unique_names(d, "name", "id")


@query("to_df", _FULL + " SELECT cell_type, sample, max(CASE WHEN gene = 'Brand#11/PROMO' THEN value END) AS a, max(CASE WHEN gene = 'Brand#12/PROMO' THEN value END) AS b FROM grid GROUP BY 1, 2")
def _(spark, sf):
    d = bulked(spark, sf).to_df(genes=["Brand#11/PROMO", "Brand#12/PROMO"])
    return d.select("cell_type", "sample", F.col("`Brand#11/PROMO`").alias("a"), F.col("`Brand#12/PROMO`").alias("b"))


@query("rename_cell_types", _PB + " SELECT CASE cell_type WHEN 'BUILDING' THEN 'house' ELSE cell_type END AS cell_type, sum(value)::BIGINT AS value FROM pb WHERE cell_type <> 'MACHINERY' GROUP BY 1")
def _(spark, sf):
    p = bulked(spark, sf).drop_cell_types("MACHINERY").rename_cell_types({"BUILDING": "house"})
    return p.X.groupBy("cell_type").agg(F.sum("value").alias("value"))


@query("map_x", _PB + " SELECT cell_type, sample, gene, value - CAST(min(value) OVER (PARTITION BY cell_type) AS BIGINT) AS value FROM pb")
def _(spark, sf):
    return bulked(spark, sf).map_X(lambda pdf: pdf.assign(value=pdf["value"] - pdf["value"].min())).X


@query("pipe", BASE + " SELECT count(*) AS n FROM counts WHERE value > 10")
def _(spark, sf):
    return dataset(spark, sf).pipe_X(lambda x: x.where("value > 10")).pipe(lambda s: s.X.agg(F.count("*").alias("n")))


_DRAW = "(o_orderkey * 2654435761) % 4294967296"


@query("subsample", f"SELECT id FROM (SELECT o_orderkey AS id FROM orders ORDER BY {_DRAW}, o_orderkey LIMIT 100)")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return tb.subsample(d, "id", n=100, draw=(F.col("id") * F.lit(2654435761)) % F.lit(4294967296))


@query("subsample_stratified", f"""WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS grp, {_DRAW} AS draw FROM orders),
n AS (SELECT grp, count(*) AS size, round_even(100.0 * count(*) / (SELECT count(*) FROM o WHERE grp IS NOT NULL), 0) AS q FROM o WHERE grp IS NOT NULL GROUP BY grp),
f AS (SELECT 100 - sum(q) AS missing FROM n),
t AS (SELECT grp, q + CASE WHEN row_number() OVER (ORDER BY sign(missing) * size, grp) <= abs(missing) THEN sign(missing) ELSE 0 END AS q FROM n, f)
SELECT id, grp FROM (SELECT id, grp, q, row_number() OVER (PARTITION BY grp ORDER BY draw, id) AS k FROM o JOIN t USING (grp)) WHERE k <= q""")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"))
    return tb.subsample(d, "id", n=100, by="grp", draw=(F.col("id") * F.lit(2654435761)) % F.lit(4294967296))


# --- neighbours, graphs, integration

def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_idx"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))


_KNN = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS VARCHAR) AS label FROM embeddings),
pairs AS (SELECT a.vec_id AS cell, b.vec_id AS nbr, round(list_distance(a.v, b.v) * list_distance(a.v, b.v), 6) AS dist2 FROM e a, e b WHERE a.vec_id <> b.vec_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY dist2, nbr) AS rank FROM pairs) WHERE rank <= 10)"""


def knn(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.knn_exact(vectors(spark, sf), 10, digits=6)


@query("knn_exact", _KNN + " SELECT cell, rank, nbr, dist2 FROM knn")
def _(spark, sf):
    return knn(spark, sf).select(F.col("cell_idx").alias("cell"), "rank", F.col("nbr_idx").alias("nbr"), "dist2")


_SNN = _KNN + ", u AS (SELECT cell, nbr FROM knn UNION ALL SELECT DISTINCT cell, cell FROM knn), s AS (SELECT a.cell AS src, b.cell AS dst, count(*) AS s FROM u a JOIN u b ON a.nbr = b.nbr WHERE a.cell <> b.cell GROUP BY 1, 2)"


@query("snn", _SNN + " SELECT src, dst, round(s / (22.0 - s), 9) AS weight FROM s WHERE s >= 3")
def _(spark, sf):
    return neighbors.shared_neighbors(knn(spark, sf), min_shared_neighbors=3).withColumn("weight", F.round("weight", 9))


@query("label_transfer", _KNN.replace("a.vec_id <> b.vec_id", "a.vec_id % 2 = 1 AND b.vec_id % 2 = 0") + ", f AS (SELECT label, count(*) AS f FROM e WHERE vec_id % 2 = 0 GROUP BY 1), votes AS (SELECT cell, label, count(*) AS n FROM knn JOIN e ON nbr = vec_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, f DESC, label) AS r FROM votes JOIN f USING (label)) SELECT a.cell, a.label, round(a.n / 10.0, 9) AS confidence, b.label AS next_best_label, round(coalesce(b.n, 0) / 10.0, 9) AS next_best_confidence FROM r a LEFT JOIN r b ON a.cell = b.cell AND b.r = 2 WHERE a.r = 1")
def _(spark, sf):
    v = vectors(spark, sf)
    ref = v.where("cell_idx % 2 = 0")
    k = neighbors.knn_exact(v.where("cell_idx % 2 = 1"), 10, ref, digits=6)
    out = neighbors.label_transfer(k, ref.select("cell_idx", "label"), next_best=True)
    return out.select(F.col("cell_idx").alias("cell"), "label", F.round("confidence", 9).alias("confidence"), "next_best_label", F.round("next_best_confidence", 9).alias("next_best_confidence"))


@query("knn_ivf")
def _(spark, sf):
    return neighbors.neighbors(vectors(spark, sf), 10, seed=1)


@query("cooccurrence", BASE + ", d AS (SELECT gene, count(*) AS d FROM counts GROUP BY gene), top AS (SELECT gene FROM d WHERE d < (SELECT count(*) FROM cells) ORDER BY abs(d / (SELECT count(*) FROM cells) - 0.5), gene LIMIT 20) SELECT a.gene AS g1, b.gene AS g2, count(*) AS both FROM counts a JOIN counts b ON a.cell = b.cell AND a.gene < b.gene WHERE a.gene IN (SELECT gene FROM top) AND b.gene IN (SELECT gene FROM top) GROUP BY 1, 2")
def _(spark, sf):
    s = dataset(spark, sf)
    pairs = cl.cooccurrence(s.X, cl.detection(s.X, s.obs.count(), 20))
    g = s.var.select("gene_idx", "gene")
    return pairs.join(g.select(F.col("gene_idx").alias("g1"), F.col("gene").alias("a")), "g1").join(g.select(F.col("gene_idx").alias("g2"), F.col("gene").alias("b")), "g2").select(F.col("a").alias("g1"), F.col("b").alias("g2"), "both")


@query("find_doublets", BASE + """, size AS (SELECT count(*) AS n FROM cells),
d AS (SELECT gene, count(*) AS d FROM counts GROUP BY gene),
top AS (SELECT gene, d FROM d, size WHERE d < n ORDER BY abs(CAST(d AS DOUBLE) / n - 0.5), gene LIMIT 50),
own AS (SELECT cell, gene FROM counts WHERE gene IN (SELECT gene FROM top)),
together AS (SELECT a.gene AS g1, b.gene AS g2, count(*) AS k FROM own a JOIN own b ON a.cell = b.cell AND a.gene < b.gene GROUP BY 1, 2),
pairs AS (SELECT a.gene AS g1, b.gene AS g2, n, a.d + b.d - 2 * coalesce(k, 0) AS seen, (CAST(a.d AS DOUBLE) / n) * (1 - CAST(b.d AS DOUBLE) / n) + (1 - CAST(a.d AS DOUBLE) / n) * (CAST(b.d AS DOUBLE) / n) AS q FROM top a JOIN top b ON a.gene < b.gene CROSS JOIN size LEFT JOIN together ON g1 = a.gene AND g2 = b.gene),
terms AS (SELECT g1, g2, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(q) + (n - i) * ln(1 - q) AS t FROM (SELECT *, unnest(range(seen, n + 1)) AS i FROM pairs WHERE seen > 0)),
most AS (SELECT g1, g2, max(t) AS m FROM terms GROUP BY 1, 2),
score AS (SELECT g1, g2, m + ln(sum(exp(t - m))) AS s FROM terms JOIN most USING (g1, g2) GROUP BY g1, g2, m),
cell_score AS (SELECT a.cell, -sum(s) AS s FROM own a JOIN own b ON a.cell = b.cell AND a.gene < b.gene JOIN score ON g1 = a.gene AND g2 = b.gene GROUP BY a.cell),
every AS (SELECT cells.cell, coalesce(s, 0) AS s FROM cells LEFT JOIN cell_score USING (cell))
SELECT cell, row_number() OVER (ORDER BY s DESC, cell) <= floor(n * 0.05) AS doublet, round(s, 5) AS doublet_score FROM every, size""")
def _(spark, sf):
    s = dataset(spark, sf).find_doublets(num_genes=50, doublet_fraction=0.05)
    return s.obs.select(F.col("cell_idx").alias("cell"), "doublet", F.round("doublet_score", 5).alias("doublet_score"))


@query("cluster")
def _(spark, sf):
    v = vectors(spark, sf)
    graph = neighbors.shared_neighbors(knn(spark, sf), min_shared_neighbors=2)
    return graphs.cluster(graph, v, [0.5, 1.0], min_cluster_size=3)


@query("harmonize")
def _(spark, sf):
    v = vectors(spark, sf)
    out = integration.harmonize(v, v.withColumn("batch", (F.col("cell_idx") % 3).cast("string")), "batch", num_clusters=8, max_iter=3)
    return out.select(F.col("cell_idx").alias("cell"), F.posexplode("v").alias("pc", "value")).withColumn("value", F.round("value", 3))


@query("pacmap")
def _(spark, sf):
    return graphs.pacmap(vectors(spark, sf), knn(spark, sf), iters=(30, 30, 60))


@query("localmap")
def _(spark, sf):
    return graphs.localmap(vectors(spark, sf), knn(spark, sf), iters=(30, 30, 60))


@query("umap")
def _(spark, sf):
    return graphs.umap(vectors(spark, sf), knn(spark, sf), epochs=60)


@query("binomial_tail", "SELECT p_size, round(ln(sum(exp(lgamma(101) - lgamma(i + 1) - lgamma(101 - i) + i * ln(0.2) + (100 - i) * ln(0.8)))), 9) AS log_sf FROM (SELECT DISTINCT p_size FROM part), range(0, 101) r(i) WHERE i > p_size GROUP BY p_size")
def _(spark, sf):
    d = table(spark, sf, "part").select("p_size").distinct()

    @F.pandas_udf("double")
    def tail(k: pd.Series) -> pd.Series:
        return pd.Series(stats.binom_log_sf(k.to_numpy(), 100.0, 0.2))

    return d.select("p_size", F.round(tail("p_size"), 9).alias("log_sf"))
