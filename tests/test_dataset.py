"""Edge cases of datasets: empty cells, stored zeros, ties, nulls, clashing names, stale neighbours."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import DE, Pseudobulk, SingleCell, concat_obs
from tessera.operators import aggregates as ag
from tessera.operators import graphs, integration, neighbors, ranks
from tessera.operators import tables as tb
from tessera.sources import store


@pytest.fixture(scope="module")
def tiny(spark):
    obs = spark.createDataFrame([(0, "c0", "a", 1), (1, "c1", "b", 1), (2, "c2", None, 2), (3, "c3", "a", 2)], "cell_idx long, cell string, cell_type string, sample int")
    var = spark.createDataFrame([(0, "MT-A"), (1, "G1"), (2, "G2")], "gene_idx int, gene string")
    x = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (1, 1, 2), (2, 2, 5), (2, 0, 0)], "cell_idx long, gene_idx int, value int")
    return SingleCell(x, obs, var)


def test_empty_cell_and_stored_zero(tiny):
    m = {r["cell"]: r for r in tiny.qc_metrics().obs.collect()}
    assert m["c0"]["mito_fraction"] == 0.25 and m["c2"]["num_genes"] == 1
    assert math.isnan(m["c3"]["mito_fraction"]) and m["c3"]["num_counts"] == 0
    q = tiny.qc(max_mito_fraction=0.5, min_genes=1, nonzero_MALAT1=False)
    assert {r["cell"] for r in q.obs.where("passed_QC").collect()} == {"c0", "c1", "c2"} and q.uns["QCed"]


def test_guards(tiny, spark):
    with pytest.raises(TypeError, match="double"):
        tiny.cast_X("double").qc_metrics()
    with pytest.raises(TypeError):
        SingleCell(tiny.X, tiny.obs.drop("cell_idx"), tiny.var)
    with pytest.raises(TypeError):
        tiny.with_slot("uns", bad={1, 2})
    with pytest.raises(ValueError, match="key"):
        tiny.drop_obs("cell")
    with pytest.raises(ValueError, match="no column"):
        tiny.filter_obs("nope")
    assert tiny.filter_obs(F.lit(False)).shape[0] == 0


def test_subset_equals_mask(tiny):
    a = tiny.filter_obs(F.col("cell") != "c2")
    assert a.X.where("cell_idx = 2").count() == 0
    assert tiny[["c0", "c1"]].shape == (2, 3) and tiny["c0":"c1"].shape == (2, 3) and tiny[-1].obs.first()["cell"] == "c3"
    assert tiny[:, "G1"].shape == (4, 1) and tiny == tiny.copy()
    with pytest.raises(IndexError):
        tiny[9]


def test_join_guards(tiny, spark):
    two = spark.createDataFrame([(1, "x"), (1, "y")], "sample int, z string")
    with pytest.raises(ValueError, match="unique"):
        tiny.join_obs(two, on="sample")
    clash = spark.createDataFrame([(1, "x")], "sample int, cell_type string")
    out = tiny.join_obs(clash, on="sample").obs
    assert out.columns[-1] == "cell_type_right" and out.where("cell_type_right is null").count() == 2
    nulls = spark.createDataFrame([(None, "n")], "cell_type string, w string")
    assert tiny.join_obs(nulls, on="cell_type").obs.where("w = 'n'").count() == 0
    assert tiny.join_obs(nulls, on="cell_type", nulls_equal=True).obs.where("w = 'n'").count() == 1


def test_names_unique_passes_over_taken(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a-1"), (3, "a")], "i int, n string")
    out = [r["n"] for r in tb.unique_names(df, "n", "i").orderBy("i").collect()]
    assert len(set(out)) == 4 and out[0] == "a" and out[2] == "a-1"


def test_concat(tiny, spark):
    with pytest.raises(ValueError, match="unique"):
        concat_obs([tiny, tiny])
    renamed = tiny._with(obs=tiny.obs.withColumn("cell", F.concat(F.lit("x"), "cell")))
    both = concat_obs(tiny, renamed, dataset_column="set")
    assert both.shape == (8, 3) and both.X.count() == 8
    less = renamed.filter_var(F.col("gene") != "G2").drop_obs("sample")
    with pytest.raises(ValueError, match="genes differ"):
        concat_obs(tiny, less)
    flexible = concat_obs(tiny, less, flexible=True)
    assert flexible.shape == (8, 2) and "sample" not in flexible.obs.columns


def test_subsample_is_exact_and_stratified(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), F.when(F.col("id") < 700, F.lit("a")).when(F.col("id") < 990, F.lit("b")).alias("g"))
    got = tb.subsample(df, "i", n=101, by="g")
    n = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
    assert sum(n.values()) == 101 and None not in n
    again = tb.subsample(df.repartition(7), "i", n=101, by="g")
    assert tb.same_rows(got, again)


def test_save_and_load(tiny, spark, tmp_path):
    p = str(tmp_path / "d")
    s = tiny.with_slot("uns", a={"b": [1, 2.5, "x"]})
    s.save(p)
    back = SingleCell.load(spark, p)
    assert back == s and back.uns["a"]["b"] == [1, 2.5, "x"]
    assert SingleCell.ls(spark, p).count() == 3
    with pytest.raises(Exception):
        s.save(p)
    s.save(p, overwrite=True)
    assert SingleCell.read_obs(spark, p, ["sample"]).columns == ["cell_idx", "cell", "sample"]


def test_mtx_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 1.0), (2, 1, 2.5)], "row long, col long, value double")
    p = str(tmp_path / "m")
    store.write_mtx(rows, 3, 2, p)
    assert tb.same_rows(store.read_mtx(spark, p).select("row", "col", "value"), rows)


def test_pareto_ties_and_infinities(spark):
    rows = [("t", 1, 0.5, 3.0), ("t", 2, 0.5, 3.0), ("t", 3, 0.4, float("inf")), ("t", 4, 0.4, 2.0), ("t", 5, 0.9, 1.0)]
    df = spark.createDataFrame(rows, "k string, g int, x double, y double")
    assert {r["g"] for r in ranks.pareto_front(df, ["k"], "x", "y", "g").collect()} == {2, 3, 5}


def test_knn_ivf_is_the_same_with_split_clusters(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(200, 3)))], "cell_idx long, v array<double>")
    rows = lambda: sorted(tuple(r) for r in neighbors.neighbors(df, 4, num_clusters=3, num_clusters_searched=3).collect())
    whole = rows()
    monkeypatch.setattr(neighbors, "PART", 17)
    assert rows() == whole and len(whole) == 800


def test_knn_ivf_recall_and_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "cell_idx long, v array<double>")
    exact = neighbors.knn_exact(df, 5).collect()
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(600) for j in np.argsort(d[i])[:5]}
    assert {(r["cell_idx"], r["nbr_idx"]) for r in exact} == want
    ivf = {(r["cell_idx"], r["nbr_idx"]) for r in neighbors.neighbors(df, 5).collect()}
    assert len(ivf & want) / len(want) > 0.85


def test_leiden_finds_planted_blocks():
    rng = np.random.default_rng(2)
    block = np.repeat(np.arange(4), 25)
    a = np.triu(rng.random((100, 100)) < np.where(block[:, None] == block, 0.5, 0.01), 1)
    src, dst = np.nonzero(a | a.T)
    labels = graphs.leiden(100, src, dst, np.ones(len(src)))
    assert len({tuple(sorted(set(labels[block == b]))) for b in range(4)}) == 4
    assert graphs.modularity(labels, src, dst, np.ones(len(src))) > 0.6


def test_harmony_objective_and_mixing(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(240, 6)) + 4 * np.eye(6)[np.arange(240) % 3]
    batch = np.arange(240) % 2
    v[batch == 1] += 1.5
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "cell_idx long, v array<double>")
    b = spark.createDataFrame([(i, str(k)) for i, k in enumerate(batch)], "cell_idx long, batch string")
    out = integration.harmonize(df, b, "batch", num_clusters=6, max_iter=4)
    z = np.array([r["v"] for r in out.orderBy("cell_idx").collect()])
    gap = lambda m: np.linalg.norm(m[batch == 0].mean(0) - m[batch == 1].mean(0))
    assert np.isfinite(z).all() and gap(z) < 0.7 * gap(v)


def test_embeddings_are_finite_and_repeat(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=5)]) for i in range(80)], "cell_idx long, v array<double>")
    knn = neighbors.knn_exact(df, 10)
    for f in (graphs.pacmap, graphs.localmap):
        a = f(df, knn, iters=(10, 10, 20)).orderBy("cell_idx").toPandas()
        assert np.isfinite(a[["x", "y"]]).all().all() and a.equals(f(df, knn, iters=(10, 10, 20)).orderBy("cell_idx").toPandas())
    assert np.isfinite(graphs.umap(df, knn, epochs=20).toPandas()[["x", "y"]]).all().all()


def test_stale_neighbours_are_refused(tiny, spark):
    knn = spark.createDataFrame([(0, 1, 99, 1.0)], "cell_idx long, rank int, nbr_idx long, dist2 double")
    with pytest.raises(ValueError, match="no longer"):
        tiny.with_slot("obsm", neighbors=knn).shared_neighbors()


def test_partition_count_does_not_matter(tiny):
    a = ag.gene_stats(tiny.X.repartition(1), tiny.var, 4)
    assert tb.same_rows(a, ag.gene_stats(tiny.X.repartition(17), tiny.var, 4))


def test_pseudobulk_interface(spark, tiny, tmp_path):
    p = tiny.pseudobulk("sample", "cell_type")
    assert p.keys() == ["a", "b"] and len(p) == 2 and "a" in p
    assert p.obs.where("cell_type is null").count() == 0
    assert {tuple(r) for r in p.gene("a", "G1").collect()} == {(1, 3), (2, 0)}
    assert (p.select_cell_types("a") | p.select_cell_types("b")) == p
    with pytest.raises(ValueError, match="overlap"):
        p | p
    with pytest.raises(ValueError, match="left"):
        p.drop_cell_types(["a", "b"])
    p.save(str(tmp_path / "p"))
    assert Pseudobulk.load(spark, str(tmp_path / "p")).X.count() == p.X.count()
    with pytest.raises(ValueError, match="no cell type"):
        p.qc(None, min_samples=5)
    with pytest.raises(TypeError):
        DE(p.X)
