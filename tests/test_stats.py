"""Closed forms and known values of the special functions, smoothers and linear models."""

import math

import numpy as np
import pandas as pd
import pytest

from tessera.functions import stats
from tessera.operators import bulk


def test_gammaln_and_polygamma():
    x = np.array([0.1, 0.5, 1.0, 2.5, 10.0, 170.0])
    assert np.allclose(stats.gammaln(x), [math.lgamma(v) for v in x], rtol=1e-12)
    assert np.isclose(stats.digamma(1.0), -0.5772156649015329)
    assert np.isclose(stats.trigamma(1.0), math.pi**2 / 6)
    assert np.isclose(stats.trigamma_inverse(float(stats.trigamma(3.3))), 3.3)


def test_log_erfc_continues_into_the_tail():
    assert np.isclose(stats.log_erfc(1.0), math.log(math.erfc(1.0)))
    assert np.isclose(stats.log_erfc(25.0), math.log(math.erfc(25.0)), rtol=1e-10)
    assert np.isfinite(stats.log_erfc(100.0))


@pytest.mark.parametrize(("n", "p"), [(20, 0.3), (50, 0.01), (7, 0.9)])
def test_binomial_tail(n, p):
    for k in range(-1, n + 1):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))
        got = float(stats.binom_log_sf(k, n, p))
        assert (got == -np.inf and want == 0) or np.isclose(math.exp(got), want, rtol=1e-9)


def test_student_t():
    assert np.isclose(stats.t_quantile(0.975, np.array([10.0])), 2.2281388519649385, rtol=1e-7)
    assert np.isclose(stats.t_quantile(0.975, np.array([np.inf])), 1.959963984540054, rtol=1e-7)
    assert np.isclose(stats.t_sf2(2.0, 1.0), 2 * (0.5 - math.atan(2.0) / math.pi))


def test_local_fit_reproduces_its_polynomials():
    x = np.linspace(0, 3, 40)
    assert np.allclose(stats.loess(x, 1 + 2 * x - x * x), 1 + 2 * x - x * x)
    assert np.allclose(stats.lowess(x, 3 - x), 3 - x)


def test_tmm_of_proportional_samples_is_one():
    x = np.outer([1, 2, 5], np.arange(1, 200)).astype(float)
    assert np.allclose(bulk.tmm(x), 1)
    x[1, -3:] *= 50
    f = bulk.tmm(x)
    assert np.isclose(np.prod(f), 1) and f[1] < 1


def test_design_treatment_interaction_and_no_intercept():
    d = pd.DataFrame({"g": ["a", "b", "a", "b", "c", "c"], "x": [1.0, 2, 3, 4, 5, 7], "n": [1, 2, 1, 2, 1, 2]})
    m = bulk.Design("~ g + x", d)
    assert m.names == ["(Intercept)", "gb", "gc", "x"]
    assert bulk.Design("~ 0 + g", d).names == ["ga", "gb", "gc"]
    assert bulk.Design("~ g * x", d).names == ["(Intercept)", "gb", "gc", "x", "gb:x", "gc:x"]
    assert np.allclose(bulk.Design("~ log2(x)", d).matrix[:, 1], np.log2(d["x"]))
    with pytest.raises(ValueError, match="integer"):
        bulk.Design("~ n", d)
    poly = bulk.Design("~ g", d, ordinal=["g"])
    assert poly.names == ["(Intercept)", "g.L", "g.Q"]
    assert np.isclose(poly.matrix[0, 1], -math.sqrt(0.5))


def test_contrasts():
    c = bulk.contrast_matrix({"d": "gb - ga", "m": "(ga + gb) / 2"}, ["ga", "gb"])
    assert np.allclose(c, [[-1, 0.5], [1, 0.5]])
    with pytest.raises(ValueError, match="unknown"):
        bulk.contrast_matrix({"d": "gz"}, ["ga"])


def test_fit_finds_planted_effects():
    rng = np.random.default_rng(0)
    group = np.repeat([0, 1], 8)
    mean = rng.uniform(20, 400, 300)
    y = rng.poisson(np.outer(rng.uniform(0.7, 1.3, 16), mean) * np.where((np.arange(300) < 20) & (group[:, None] == 1), 4.0, 1.0)).astype(float)
    design = np.column_stack([np.ones(16), group])
    lib = y.sum(axis=1) * bulk.tmm(y)  # the planted genes alone shift plain totals
    f = bulk.fit_de(y, design, lib, np.array([[0.0], [1.0]]))
    assert (f["p"][:20, 0] < 1e-6).all() and (f["p"][20:, 0] < 0.001).mean() < 0.05
    assert ((f["LCI"] < f["logFC"]) & (f["logFC"] < f["UCI"])).all()
    by = bulk.fit_de(y, design, lib, np.array([[0.0], [1.0]]), group)
    assert (by["p"][:20, 0] < 1e-5).all()


def test_fdr_matches_definition(spark):
    from tessera.operators import ranks

    p = [0.01, 0.04, None, 0.03, 0.5, 0.03]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "id int, p double")
    got = {r["id"]: r["FDR"] for r in ranks.fdr(df, "p", order="id").collect()}
    known = sorted(v for v in p if v is not None)
    n = len(known)
    for i, v in enumerate(p):
        want = None if v is None else min(1.0, *(x * n / (j + 1) for j, x in enumerate(known) if x >= v))
        assert got[i] == want or np.isclose(got[i], want)
