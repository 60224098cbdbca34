"""Splits with doubled and NULL keys, greedy group folds, far-from-zero ridge, histogram and density edges."""

import heapq
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sporeframe.functions import seq as sq
from sporeframe.operators import aggregates as ag
from sporeframe.operators.ridge import ridge_cv
from sporeframe.operators.split import group_kfold, holdout_split, kfold
from sporeframe.plans import features as fe
from sporeframe.plans.validate import three_way_r

ROWS = [("s", "a", 1), ("s", "b", 2), ("s", "b", 3), ("s", None, 4), ("s", None, 5), ("t", "a", 6), (None, "z", 7)] + [("s", f"k{i}", 10 + i) for i in range(20)]


def test_splits_return_exactly_their_rows(spark):
    df = spark.createDataFrame(ROWS, "g string, id string, v int")
    out = holdout_split(df, ["g"], "id", 0.2, n_folds=3)
    assert Counter((r["g"], r["id"], r["v"]) for r in out.collect()) == Counter(ROWS)
    for split in (out, kfold(df, ["g"], ["id"], 4), kfold(df, ["g"], ["id"], 4, where=F.col("v") > 3)):
        rows = split.collect()
        assert Counter((r["g"], r["id"], r["v"]) for r in rows) == Counter(ROWS)
    place = {r["v"]: (r["is_test"], r["fold"]) for r in out.collect()}
    assert place[2] == place[3] and place[4] == place[5]


def test_group_kfold_is_greedy(spark):
    sizes = [100, 30, 30, 30] + [10] * 6 + [5] * 5
    rows = [(f"b{i:02d}", j) for i, n in enumerate(sizes) for j in range(n)] + [(None, 0)]
    got = group_kfold(spark.createDataFrame(rows, "block string, v int").withColumn("g", F.lit(1)), ["g"], "block", 3).collect()
    assert len(got) == len(rows)
    loads = [(0, f) for f in (1, 2, 3)]
    want = {}
    for n, name in sorted(((n, f"b{i:02d}") for i, n in enumerate(sizes)), key=lambda x: (-x[0], x[1])) + [(1, None)]:
        load, fold = heapq.heappop(loads)
        want[name] = fold
        heapq.heappush(loads, (load + n, fold))
    assert {(r["block"], r["fold"]) for r in got} == set(want.items())


def test_ridge_far_from_zero(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.05 * rng.standard_normal(400)
    scores = []
    for offset in (0.0, 1e6, 1e8):
        rows = [(1, int(i % 6), (x[i] + offset).tolist(), float(y[i])) for i in range(400)]
        df = spark.createDataFrame(rows, "m int, cell int, features array<double>, y double").repartition(3)
        scores.append(ridge_cv(df, ["m"], "cell", "features", "y", alphas=[1e-3]).first()["test_r2"])
    assert all(abs(s - scores[0]) < 1e-6 for s in scores) and scores[0] > 0.99
    with pytest.raises(ValueError):
        ridge_cv(df, ["m"], "cell", "features", "y", cv_metric="mae")


def test_histograms_at_the_edges(spark):
    df = spark.createDataFrame([("a", v) for v in (2.0, 2.0, 2.5, 4.0)] + [("b", 0.0), ("b", 2.0)], "g string, v double")
    got = {(r["g"], r["bin"]): r["count"] for r in ag.histogram_width(df, "v", 2.0, 0.0, ["g"]).collect()}
    assert got == {("a", 1): 4, ("b", 0): 2}
    flat = spark.createDataFrame([(3.0,)] * 5, "v double")
    assert sum(r["count"] for r in ag.histogram_bins(flat, "v", 10).collect()) == 5
    assert ag.histogram_bins(flat.limit(0), "v", 10).collect() == []
    assert ag.histogram_width(flat.limit(0), "v", 1.0).collect() == []
    assert len(ag.kde(flat, "v", 16).collect()) == 16 and ag.kde(flat.limit(0), "v", 16).collect() == []
    assert len(ag.kde(flat.limit(1), "v", 16).collect()) == 16


def test_three_way_takes_any_number_of_replicates(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 4))
    rows = [(k, f"g{i}", float(a[i, k]), float(a[i, k] + rng.standard_normal())) for i in range(30) for k in range(4) if (i, k) != (0, 3)]
    m = spark.createDataFrame(rows, "replicate int, geneId string, log_Pipeline_TPM double, log_Published_TPM double")
    for reps in ([0, 1], [0, 1, 2, 3]):
        genes = [f"g{i}" for i in range(30) if all((k, f"g{i}") in {(r[0], r[1]) for r in rows} for k in reps)]
        r = {k: np.corrcoef(*np.array([x[2:] for x in rows if x[0] == k and x[1] in genes]).T)[0, 1] for k in reps}
        got = three_way_r(m, reps).first()
        assert got["n_genes"] == len(genes) and got["pearson_r_last"] == pytest.approx(r[reps[-1]]) and got["pearson_r_mean"] == pytest.approx(np.mean(list(r.values())))


def test_kmer_pairs_equal_the_dense_vector(spark):
    texts = [None, "", "A", "ACGTNACGTTTTTTT", "NNNN", "ACGT" * 500, "GATTACA"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, s string")
    for k, overlap in ((1, True), (3, True), (3, False), (12, True)):
        want = Counter()
        for i, t in enumerate(texts):
            for a in range(0, len(t or "") - k + 1, 1 if overlap else k):
                if "N" not in t[a : a + k]:
                    want[i, sum("ACGT".index(c) * 4 ** (k - 1 - j) for j, c in enumerate(t[a : a + k]))] += 1
        assert {(r["id"], r["kmer_index"]): r["n"] for r in sq.kmer_pairs(df, "id", "s", k, overlap).collect()} == want
        if k <= 3:
            vec = df.select("id", sq.kmer_vector("s", k, overlap).alias("v")).collect()
            assert {(r["id"], i): n for r in vec if r["v"] for i, n in enumerate(r["v"]) if n} == want
    bad = spark.createDataFrame([(1, "ACXT")], "id int, s string")
    for job in (sq.kmer_pairs(bad, "id", "s", 2), sq.kmer_pairs(bad, "id", "s", 12), bad.select(sq.kmer_vector("s", 2))):
        with pytest.raises(Exception, match="letters other than"):
            job.collect()
    loo = df.where("id = 3").select(sq.kmer_vector("s", 2, leave_one_out=True).alias("v")).first()["v"]
    assert len(loo) == 16 and loo[15] == 0


def test_dealing_runs_equals_dealing_blocks():
    import heapq
    import random

    from sporeframe.operators.split import deal_runs

    rng = random.Random(3)
    for _ in range(400):
        k = rng.randrange(1, 8)
        runs = sorted({rng.randrange(1, 40): rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))}.items(), reverse=True)
        loads, want = [(0, f) for f in range(1, k + 1)], []
        for size, count in runs:
            for _ in range(count):
                load, fold = heapq.heappop(loads)
                want.append(fold)
                heapq.heappush(loads, (load + size, fold))
        got = []
        for (_, count), segments in zip(runs, deal_runs(runs, k)):
            assert len(segments) <= k
            for (first, folds), end in zip(segments, [*(s[0] for s in segments[1:]), count]):
                got += [folds[i % len(folds)] for i in range(end - first)]
        assert got == want
    assert deal_runs([(1, 10 ** 12)], 3) == [[(0, [1, 2, 3])]]


def test_with_kmer_vectors_is_kmer_vector_in_small_batches(spark):
    rows = [(i, None if i % 7 == 3 else "ACGTN"[i % 5] * (i % 9) + "GATTACA" * (i % 4), "" if i % 5 else "ACGTACGT" * i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a string, `b c` string").coalesce(1)
    vectors = {"a2": ("a", 2), "b2": ("b c", 2), "a5": ("a", 5)}
    made = sq.with_kmer_vectors(df, vectors, keep=["id"])
    assert made.columns == ["id", "a2", "b2", "a5"] and sq.with_kmer_vectors(df, vectors).columns == ["id", "a", "b c", "a2", "b2", "a5"]
    want = df.select("id", sq.kmer_vector("a", 2).alias("a2"), sq.kmer_vector(F.col("`b c`"), 2).alias("b2"), sq.kmer_vector("a", 5).alias("a5"))
    assert {r["id"]: r for r in made.collect()} == {r["id"]: r for r in want.collect()}


def test_feature_registry_has_no_python_column_of_whole_batches(spark):
    df = spark.createDataFrame([("g", "ACGT", "GGTA")], "gene_id string, five_prime_seq string, three_prime_seq string")
    plan = fe.feature_registry(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
