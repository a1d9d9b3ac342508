"""Alignment, recoding, names, and the data behind voom weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import tables as tb
from tessera.pseudobulk import DE, Pseudobulk


def test_align(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "gene_idx int, gene string")
    rows = lambda d: sorted((r["request"], r["gene"], r["gene_idx"]) for r in d.collect())
    assert rows(tb.align(df, "gene", ["c", "a", "c"])) == [(0, "c", 2), (1, "a", 0), (2, "c", 2)]
    with pytest.raises(ValueError, match="zz"):
        tb.align(df, "gene", ["a", "zz"])
    assert rows(tb.align(df, "gene", ["zz", "b"], missing="drop")) == [(1, "b", 1)]
    assert rows(tb.align(df, "gene", ["zz"], missing="null")) == [(0, "zz", None)]
    asked = spark.createDataFrame([("b", 9), ("a", 20)], "gene string, place long")
    assert rows(tb.align(df, "gene", asked, "place")) == [(0, "b", 1), (1, "a", 0)]
    assert rows(tb.align(df, "gene", [])) == []


def test_recode(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",), (None,), ("other",)], "v string")
    old, new = ["x", "y", "z"], ["z", "x"]
    got = [tuple(r) for r in df.select(tb.encode(F.col("v"), old), tb.recode(tb.encode(F.col("v"), old), old, new), tb.recode(tb.encode(F.col("v"), old), old, new, other=9)).collect()]
    assert got == [(0, 1, 1), (1, None, 9), (2, 0, 0), (None, None, 9), (None, None, 9)]
    assert df.select(tb.encode(F.col("v"), []), tb.recode(F.lit(0), [], new)).first() == (None, None)
    with pytest.raises(ValueError):
        tb.recode(F.lit(0), old, ["x", "x"])


def test_names():
    for good in ("a", ".x", "x.y_1", "..a", "é"):
        names.check_variable(good)
        assert names.quoted(good) == good
    for bad in ("", ".1x", "1a", "a b", "a-b", "if", "..1", "..."):
        with pytest.raises(ValueError):
            names.check_variable(bad)
    assert names.quoted("a b`c") == "`a b\\`c`" and names.file_name("CD4/CD8") == "CD4-CD8"


def test_voom_data(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = [("t", f"s{i}", f"g{j}", int(v)) for i in range(8) for j, v in enumerate(rng.poisson(rng.uniform(5, 200, 40)))]
    X = spark.createDataFrame(x, "cell_type string, sample string, gene string, value long")
    obs = spark.createDataFrame([("t", f"s{i}", 10, "ab"[i % 2]) for i in range(8)], "cell_type string, sample string, num_cells long, side string")
    p = Pseudobulk(X, obs, X.select("cell_type", "gene").distinct()).library_size()
    both, one = p.de("~ side"), p.de("~ side", group=False)
    assert both.groups == {"t": ("a", "b")} and one.groups == {"t": None}
    d = one.voom_data("t").toPandas()
    assert len(d) == 40 and (np.diff(d["mean"]) >= 0).all() and np.isfinite(d["fit"]).all() and both.voom_data("t").count() == 80
    bare = p.de("~ side", return_voom_info=False)
    assert bare.groups is None
    with pytest.raises(ValueError):
        bare.voom_data("t")
    path = f"file://{tmp_path}/de"
    both.save(path)
    back = DE.load(spark, path)
    assert back == both and back.groups == both.groups
