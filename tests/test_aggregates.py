"""Histograms, KDE, row statistics, pivots."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sporeframe.operators import aggregates as ag
from sporeframe.operators.reshape import array_to_columns, columns_to_array, pivot_wider


def test_kde_close_to_exact_gaussian_kde(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(5, 0.5, 1000)])
    got = ag.kde(spark.createDataFrame(pd.DataFrame({"x": x})), "x").orderBy("point").toPandas()
    q1, q3 = np.percentile(x, [25, 75])
    bw = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 512)
    exact = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], grid)
    assert np.max(np.abs(got["density"] - exact)) < 0.01 * exact.max()


def test_histograms(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 5.0, 20.0, 21.0, 39.9, 40.0, 1500.0]], "x double")
    w = {r["bin"]: r["count"] for r in ag.histogram_width(df, "x", 20.0).collect()}
    assert w == {0: 3, 1: 3, 74: 1}  # the first bin is closed on both sides
    b = ag.histogram_bins(df, "x", 5, (0, 100)).orderBy("bin").collect()
    assert [r["count"] for r in b] == [4, 2, 0, 0]  # width (100 - 0) / (5 - 1) = 25


def test_row_stats_and_pivot(spark):
    df = spark.createDataFrame([("g1", "c1", 1.0), ("g1", "c2", 3.0), ("g1", "c2", 5.0), ("g2", "c1", 2.0)],
                               "gene string, cond string, v double")
    wide = pivot_wider(df, ["gene"], "cond", "v", ["c1", "c2"])
    rows = {r["gene"]: r for r in wide.select("*", ag.row_mean(["c1", "c2"]).alias("m"),
                                               ag.row_sd(["c1", "c2"]).alias("s")).collect()}
    assert rows["g1"]["c2"] == 4.0 and rows["g1"]["m"] == 2.5 and rows["g2"]["m"] == 2.0 and rows["g2"]["s"] is None
    assert rows["g1"]["s"] == pytest.approx(np.std([1.0, 4.0], ddof=1))
    lists = {r["gene"]: r["c2"] for r in pivot_wider(df, ["gene"], "cond", "v", ["c1", "c2"], dup="list").collect()}
    assert lists["g1"] == [3.0, 5.0]
    with pytest.raises(Exception):
        pivot_wider(df, ["gene"], "cond", "v", ["c1", "c2"], dup="error").collect()
    arr = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "id string, f array<double>")
    back = columns_to_array(array_to_columns(arr, "f", 3), "embed_", "f").first()
    assert back["f"] == [1.0, 2.0, 3.0]


def test_spearman_with_ties(spark):
    a = [1, 2, 2, 3, 5, 4, 7]
    b = [2, 1, 4, 4, 6, 5, 9]
    df = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))],
                               "g string, id int, a double, b double")
    got = ag.spearman(df, ["g"], "a", "b", "id").first()["spearman"]
    ra, rb = pd.Series(a).rank(), pd.Series(b).rank()
    assert got == pytest.approx(np.corrcoef(ra, rb)[0, 1])
