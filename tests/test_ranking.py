"""The skew-safe ranking primitive and what is built on it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sporeframe.operators import ranking as rk
from sporeframe.operators.ranking import nested_percentiles
from sporeframe.operators.split import group_kfold, holdout_split


@pytest.fixture(scope="module")
def skewed(spark):
    # group 'hot' holds a third of the rows; values have ties
    rng = np.random.default_rng(3)
    n = 3000
    g = np.where(np.arange(n) < n // 3, "hot", rng.choice(["a", "b", "c", "d"], n))
    v = rng.integers(0, 200, n).astype(float)
    pdf = pd.DataFrame({"g": g, "id": np.arange(n), "v": v})
    return spark.createDataFrame(pdf).repartition(7)


def test_row_number_equals_window(spark, skewed):
    w = Window.partitionBy("g").orderBy("v", "id")
    want = {r["id"]: r["rn"] for r in skewed.select("id", F.row_number().over(w).alias("rn")).collect()}
    got = rk.group_row_number(skewed, ["g"], ["v", "id"], "rn", count_name="n").collect()
    assert {r["id"]: r["rn"] for r in got} == want
    sizes = skewed.groupBy("g").count().collect()
    assert {r["g"]: r["n"] for r in got} == {r["g"]: r["count"] for r in sizes}


def test_hot_group_spreads_over_partitions(spark, skewed):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = skewed.repartitionByRange(8, "g", "v", "id").withColumn("pid", F.spark_partition_id())
        hot_parts = ranked.where(F.col("g") == "hot").select("pid").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert hot_parts >= 3  # the hot group is not confined to one task


@pytest.mark.parametrize("k", [1, 3, 5, 6])
def test_ntile_of_matches_sql_ntile(spark, k):
    df = spark.range(1, 40).select(F.col("id").alias("n")).select("n", F.explode(F.sequence(F.lit(1), "n")).alias("rn"))
    w = Window.partitionBy("n").orderBy("rn")
    bad = df.select(rk.ntile_of("rn", "n", k).alias("a"), F.ntile(k).over(w).alias("b")).where("a != b").count()
    assert bad == 0


def test_exact_percentiles_and_median(spark, skewed):
    got = {r["g"]: r for r in rk.exact_percentiles(skewed, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    pdf = skewed.toPandas()
    for g, part in pdf.groupby("g"):
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert got[g][name] == pytest.approx(np.percentile(part["v"], p * 100))


def test_average_rank_matches_pandas(spark, skewed):
    got = {r["id"]: r["avg_rank"] for r in rk.average_rank(skewed, ["g"], "v", ["id"]).collect()}
    pdf = skewed.toPandas()
    pdf["r"] = pdf.groupby("g")["v"].rank(method="average")
    assert all(got[i] == r for i, r in zip(pdf["id"], pdf["r"]))


def test_first_per_key_and_repeats(spark):
    df = spark.createDataFrame([("g1", 2, "x"), ("g1", 1, "y"), ("g2", 5, "z"), ("g3", 1, "w"), ("g3", 1, "v")],
                               "k string, o int, val string")
    first = {r["k"]: r["val"] for r in rk.first_per_key(df, ["k"], ["o", "val"]).collect()}
    assert first == {"g1": "y", "g2": "z", "g3": "v"}
    assert sorted(r["k"] for r in rk.keep_repeated(df, ["k"]).collect()) == ["g1", "g1", "g3", "g3"]
    kept = [r["k"] for r in rk.drop_position(df.select("k").distinct(), ["k"], 2).collect()]
    assert sorted(kept) == ["g1", "g3"]


def test_splits_are_partition_independent(spark, skewed):
    a = {r["id"]: (r["is_test"], r["fold"]) for r in holdout_split(skewed, ["g"], "id", 0.1, 42, 5).collect()}
    b = {r["id"]: (r["is_test"], r["fold"]) for r in holdout_split(skewed.repartition(3), ["g"], "id", 0.1, 42, 5).collect()}
    assert a == b
    pdf = skewed.toPandas().assign(t=[a[i][0] for i in skewed.toPandas()["id"]])
    for g, part in pdf.groupby("g"):
        assert part["t"].sum() == int(np.ceil(0.1 * len(part)))


def test_group_kfold_never_splits_a_group(spark, skewed):
    f = group_kfold(skewed.withColumn("blk", (F.col("id") % 37).cast("string")).withColumn("all", F.lit(1)),
                    ["all"], "blk", 10)
    per_block = f.groupBy("blk").agg(F.countDistinct("fold").alias("n")).where("n > 1").count()
    assert per_block == 0
    assert f.select("fold").distinct().count() == 10


@pytest.mark.parametrize("buckets, few", [(64, 3), (1024, 4096)])
def test_nested_percentiles_by_refinement(spark, buckets, few):
    rng = np.random.default_rng(7)
    rows = [("a", int(rng.integers(-1, 3)), float(v)) for v in rng.lognormal(0, 3, 700)] + [("a", 2, 0.25)] * 300  # a heavy tie
    rows += [(None, 0, float(v)) for v in rng.normal(size=7)] + [("one", 1, 5.0), ("same", 2, -1.5), ("same", 0, -1.5)]
    rows += [("wide", 0, 1e300), ("wide", 0, -1e300), ("wide", 1, 1e-300), ("wide", 1, 0.0), ("nothing", -1, 3.0), ("a", 1, None), ("a", 1, float("nan"))]
    df = spark.createDataFrame(rows, "g string, lev int, v double")
    probs = {"p0": 0.0, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}
    got = {(r["g"], r["level"]): r for r in nested_percentiles(df, ["g"], "lev", "v", probs, 3, buckets, few).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for t in range(3):
            vals = [v for x, lev, v in rows if x == g and lev >= t and v is not None and v == v]
            if vals:
                want[g, t] = np.percentile(vals, [100 * p for p in probs.values()])
    assert set(got) == set(want)
    for k, w in want.items():
        assert [got[k][p] for p in probs] == pytest.approx(w.tolist(), rel=1e-12)
    assert nested_percentiles(df.limit(0), ["g"], "lev", "v", probs, 3).collect() == []


def test_running_total_over_partitions(spark):
    from sporeframe.operators.ranking import running_total

    df = spark.range(5000).selectExpr("id AS k", "id % 7 AS v", "'x' AS s").repartition(9)
    got = {r["k"]: r["before"] for r in running_total(df, ["k"], "v").collect()}
    assert got == {k: before for k, before in zip(range(5000), np.cumsum([0, *(k % 7 for k in range(4999))]).tolist())}
    assert running_total(df.limit(0), ["k"], "v").collect() == []


def test_exact_percentiles_shuffle_a_value_not_its_rows(spark):
    """Rows of a value that a whole group shares do not meet in one task; null keys and NaN, as before."""
    nan = float("nan")
    rows = [("a", 4.0)] * 5000 + [("a", 1.0)] * 3 + [("b", v) for v in (2.0, 7.0, 7.0, 9.0)] + [(None, 1.0), (None, 2.0), ("c", None), ("d", nan), ("d", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    placed, kept = [], rk.reliable_checkpoint
    rk.reliable_checkpoint = lambda d: placed.append(kept(d)) or placed[-1]
    try:
        got = {r["g"]: (r["q1"], r["m"], r["q3"]) for r in rk.exact_percentiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}).collect()}
    finally:
        rk.reliable_checkpoint = kept
    assert max(d.count() for d in placed) == 9
    assert got["a"] == (4.0, 4.0, 4.0) and got["b"] == (5.75, 7.0, 7.5) and got[None] == (1.25, 1.5, 1.75) and "c" not in got
    assert got["d"][0] != got["d"][0]
