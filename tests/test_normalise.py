"""Fitted Box-Cox / Yeo-Johnson lambdas and the QQ fit."""

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute import llf
from sporeframe.operators import normalise as nm


def brute_lambda(x, method):
    grid = np.round(np.arange(-5, 5.00001, 0.0005), 6)
    vals = llf(x, grid, method)
    return grid[int(np.argmax(vals))]


def test_fitted_lambda_is_the_likelihood_maximum(spark):
    rng = np.random.default_rng(5)
    groups = {"lognormal": np.exp(rng.normal(1, 0.5, 400)), "sqrt": rng.normal(4, 0.6, 400) ** 2,
              "skewed": rng.gamma(2.0, 2.0, 300)}
    pdf = pd.concat([pd.DataFrame({"g": k, "x": v}) for k, v in groups.items()])
    df = spark.createDataFrame(pdf)
    for method in ("boxcox", "yeojohnson"):
        got = {r["g"]: r["lam"] for r in nm.fit_lambda(df, ["g"], "x", method).collect()}
        for k, x in groups.items():
            assert abs(got[k] - brute_lambda(x, method)) < 1e-3
            # and no better value nearby
            assert llf(x, np.array([got[k]]), method)[0] >= llf(x, np.array([got[k] - 1e-3, got[k] + 1e-3]), method).max()
    assert abs(dict((r["g"], r["lam"]) for r in nm.fit_lambda(df, ["g"], "x").collect())["lognormal"]) < 0.15


def test_boxcox_needs_positive_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("b", 2.0), ("b", 3.0)], "g string, x double")
    assert [r["g"] for r in nm.fit_lambda(df, ["g"], "x", "boxcox").collect()] == ["b"]


def test_norm_ppf_and_qq_fit(spark):
    ps = [1e-6, 0.01, 0.02425, 0.2, 0.5, 0.7, 0.98, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(nm.norm_ppf(F.col("p"))).collect()]
    for p, g in zip(ps, got):
        assert g == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9, abs=1e-9)
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, 101)
    r = nm.qq_fit(spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "i": range(101)})), ["g"], "x", ["i"]).first()
    n = len(x)
    m = np.array([(i - 0.3175) / (n + 0.365) for i in range(1, n + 1)])
    m[-1] = 0.5 ** (1 / n)
    m[0] = 1 - m[-1]
    osm = np.array([NormalDist().inv_cdf(v) for v in m])
    slope, intercept = np.polyfit(osm, np.sort(x), 1)
    assert r["slope"] == pytest.approx(slope, rel=1e-7) and r["intercept"] == pytest.approx(intercept, rel=1e-7)
    assert r["r"] == pytest.approx(np.corrcoef(osm, np.sort(x))[0, 1], rel=1e-9)
