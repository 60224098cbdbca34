import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brute import pearson_r2, r2, ridge_cv as np_ridge_cv
from conftest import SF01
from sporeframe.plans import models as md
from sporeframe.sources import tables as tb


def _order(gene_id: str) -> tuple:
    return (hashlib.md5(f"42:{gene_id}".encode()).hexdigest(), gene_id)


def test_species_ridge_matches_numpy(spark):
    data = tb.ridge_input(spark, SF01)
    models, preds = md.species_ridge(data)
    got = {(r["end"], r["species"]): r for r in models.collect()}
    rows = data.toPandas()
    assert len(got) == rows.groupby(["end", "species"]).ngroups
    for (end, sp), g in rows.groupby(["end", "species"]):
        g = g.assign(o=g["gene_id"].map(_order)).sort_values("o")
        n_test = int(np.ceil(0.1 * len(g)))
        test, train = g.iloc[:n_test], g.iloc[n_test:]
        X, y = np.stack(train["features"]), train["y"].to_numpy()
        alpha, beta, b0, cv = np_ridge_cv(X, y, [10.0, 100.0, 1000.0], 5)
        m = got[(end, sp)]
        assert m["alpha"] == alpha
        assert m["cv_score"] == pytest.approx(cv, rel=1e-7, abs=1e-9)
        assert np.allclose(m["coef"], beta, rtol=1e-6, atol=1e-9)
        assert m["intercept"] == pytest.approx(b0, rel=1e-7, abs=1e-9)
        p = np.stack(test["features"]) @ beta + b0
        assert m["test_r2"] == pytest.approx(r2(test["y"].to_numpy(), p), rel=1e-6, abs=1e-9)
        assert m["test_pearson_r2"] == pytest.approx(pearson_r2(test["y"].to_numpy(), p), rel=1e-6, abs=1e-9)
    # predictions agree with the statistics-only test R2
    r2p = {(r["end"], r["species"]): r["R2"] for r in md.r2_from_predictions(preds, ["end", "species"]).collect()}
    for k, m in got.items():
        assert r2p[k] == pytest.approx(m["test_r2"], rel=1e-6, abs=1e-9)


def test_ridge_statistics_survive_repartition(spark):
    data = tb.ridge_input(spark, SF01)
    a = {(r["end"], r["species"]): r["coef"] for r in md.species_ridge(data)[0].collect()}
    b = {(r["end"], r["species"]): r["coef"] for r in md.species_ridge(data.repartition(3))[0].collect()}
    for k in a:
        assert np.allclose(a[k], b[k], rtol=1e-9, atol=1e-12)


def test_salted_statistics_equal_unsalted(spark):
    from sporeframe.operators import ridge

    data = tb.ridge_input(spark, SF01).withColumn("fold", (F.abs(F.hash("gene_id")) % 6).cast("int"))
    few = ridge.ridge_cv(data, ["end", "species"], "fold", "features", "y")
    many = ridge.ridge_cv(data, ["end", "species"], "fold", "features", "y", rows_per_task=3)
    # ~3 rows per salt and fan-in 2: several merge levels run before the solve
    levels = ridge.ridge_cv(data, ["end", "species"], "fold", "features", "y", rows_per_task=1, fanin=2)
    a = {(r["end"], r["species"]): r for r in few.collect()}
    for other in (many, levels):
        rows = other.collect()
        assert len(rows) == len(a)
        for r in rows:
            k = (r["end"], r["species"])
            assert r["alpha"] == a[k]["alpha"] and r["n_train"] == a[k]["n_train"]
            assert np.allclose(r["coef"], a[k]["coef"], rtol=1e-8, atol=1e-10)


def test_group_kfold_ridge_matches_numpy(spark):
    emb = tb.read_table(spark, SF01, "embeddings").select(
        F.lit("emb").alias("feature_set"), F.col("vec_id").cast("string").alias("gene_id"),
        F.col("vec_id").alias("row_order"), F.concat(F.lit("b"), (F.col("vec_id") % 13).cast("string")).alias("block"),
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
        (F.col("label") + 20.0 * F.col("embedding")[0]).alias("y"))
    got = {r["fold"]: r for r in md.group_kfold_ridge(emb)[0].collect()}
    preds = {r["gene_id"]: r for r in md.group_kfold_ridge(emb)[1].collect()}
    pdf = emb.toPandas().sort_values("row_order").reset_index(drop=True)
    sizes = pdf.groupby("block").size().reset_index(name="n").sort_values(["n", "block"], ascending=[False, True])
    fold_of, loads = {}, [0] * 10
    for b, n in zip(sizes["block"], sizes["n"]):  # the largest block to the lightest fold
        fold_of[b] = loads.index(min(loads)) + 1
        loads[fold_of[b] - 1] += n
    pdf["fold"] = pdf["block"].map(fold_of)
    for f in range(1, 11):
        tr, te = pdf[pdf["fold"] != f], pdf[pdf["fold"] == f]
        alpha, beta, b0, _ = np_ridge_cv(np.stack(tr["features"]), tr["y"].to_numpy(), [10.0, 100.0, 1000.0], 3)
        pred = np.stack(te["features"]) @ beta + b0
        assert got[f]["alpha"] == alpha
        assert got[f]["r2"] == pytest.approx(pearson_r2(te["y"].to_numpy(), pred), rel=1e-6)
        assert [preds[g]["pred"] for g in te["gene_id"]] == pytest.approx(pred.tolist(), rel=1e-6)
        assert [(preds[g]["fold"], preds[g]["true"]) for g in te["gene_id"]] == [(f, y) for y in te["y"]]
    assert len(preds) == len(pdf)


def test_bootstrap_replicate_equals_fit_on_repeated_rows(spark):
    from brute import ridge_fit, scaler
    from sporeframe.operators.ridge import ridge_bootstrap
    from sporeframe.operators.split import bootstrap_weights

    emb = tb.read_table(spark, SF01, "embeddings").select(
        F.lit("emb").alias("feature_set"), F.col("vec_id").cast("string").alias("gene_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
        (F.col("label") + 20.0 * F.col("embedding")[0]).alias("y"), (F.col("label") == 3).alias("is_test"))
    train = bootstrap_weights(emb.where("not is_test"), ["feature_set"], ["gene_id"], 3, name="w")
    test = emb.where("is_test").withColumn("w", F.lit(None).cast("array<double>"))
    d = train.unionByName(test).withColumn("alpha", F.lit(100.0)).withColumn("cell", F.when(F.col("is_test"), 0).otherwise(1))
    got = {r["replicate"]: r["pearson_r2"] for r in ridge_bootstrap(d, ["feature_set"], "cell", "features", "y", "w", "alpha", block=20).collect()}
    pdf = d.toPandas()
    tr, te = pdf[pdf["cell"] == 1], pdf[pdf["cell"] == 0]
    X, y = np.stack(tr["features"]), tr["y"].to_numpy()
    W = np.stack(tr["w"])
    assert (W.sum(axis=0) == len(tr)).all()  # n out of n
    for b in range(3):
        reps = W[:, b].astype(int)
        Xr, yr = np.repeat(X, reps, axis=0), np.repeat(y, reps)
        mu, sd = scaler(Xr)
        beta, b0 = ridge_fit((Xr - mu) / sd, yr, 100.0)
        pred = ((np.stack(te["features"]) - mu) / sd) @ beta + b0
        assert got[b + 1] == pytest.approx(pearson_r2(te["y"].to_numpy(), pred), rel=1e-6)


def test_draws_are_exact_and_uniform(spark):
    from sporeframe.operators.split import bootstrap_weights, leaves_from, multinomial_draws

    for n in (1, 2, 7, 1000):
        parts = [multinomial_draws(n, a, b, 50, 1, "g", 8) for a, b in leaves_from(n, 8, 0, n)]
        w = np.concatenate(parts)
        assert w.shape == (n, 50) and (w.sum(axis=0) == n).all()
        cut = n // 3
        assert sorted([*leaves_from(n, 8, 0, cut), *leaves_from(n, 8, cut, n)]) == sorted(leaves_from(n, 8, 0, n))
    assert abs(w.var() - 1) < 0.05 and abs(w.mean(axis=1).std() - 1 / 50 ** 0.5) < 0.02  # as Poisson(1) nearly, no place preferred
    rows = [(g, k) for g, n in (("a", 300), (None, 40), ("b", 1)) for k in range(n)]
    df = spark.createDataFrame(rows + [("a", 5)], "g string, k int")
    first, again = (bootstrap_weights(x, ["g"], ["k"], 4, leaf=2).collect() for x in (df, df.repartition(7)))
    assert sorted(first, key=str) == sorted(again, key=str) and len(first) == 342
    for g, n in (("a", 300), (None, 40), ("b", 1)):
        once = {r["k"]: r["weights"] for r in first if r["g"] == g}
        assert [sum(c) for c in zip(*once.values())] == [n] * 4


def test_null_model_keys_and_blocks(spark):
    """A model whose key is NULL is a model, and the block width changes nothing."""
    from sporeframe.operators import ridge

    rng = np.random.default_rng(3)
    rows = [(k, i, int(i % 6), rng.normal(size=9).tolist(), float(rng.normal())) for k in ("a", None) for i in range(60)]
    rows += [("zeros", i, 1 + i % 5, [0.0] * 9, float(i % 3)) for i in range(40)]  # constant features, equal rows
    df = spark.createDataFrame(rows, "k string, id long, cell int, x array<double>, y double")
    whole = {r["k"]: r for r in ridge.ridge_cv(df, ["k"], "cell", "x", "y").collect()}
    assert set(whole) == {"a", None, "zeros"} and whole["zeros"]["n_train"] == 40
    for options in ({"block": 4}, {"block": 1}, {"block": 4, "rows_per_task": 2, "fanin": 3, "id_col": "id"}):
        for r in ridge.ridge_cv(df, ["k"], "cell", "x", "y", **options).collect():
            assert r["alpha"] == whole[r["k"]]["alpha"] and np.allclose(r["coef"], whole[r["k"]]["coef"], rtol=1e-9, atol=1e-12)
    models = ridge.ridge_cv(df, ["k"], "cell", "x", "y")
    assert ridge.predict(df, models, ["k"], "x").where("k is null").count() == 60
    with pytest.raises(ValueError):
        ridge.ridge_cv(df, ["k"], "cell", "x", "y", cv_metric="nonsense")


def test_a_scorer_of_the_users_own(spark):
    from brute import ridge_fit, scaler
    from sporeframe.operators import ridge

    rng = np.random.default_rng(4)
    X, y = rng.normal(size=(80, 3)), rng.normal(size=80) * 3
    y += X[:, 0]
    cell = np.arange(80) % 4
    df = spark.createDataFrame([("m", int(c), x.tolist(), float(v)) for c, x, v in zip(cell, X, y)], "k string, cell int, x array<double>, y double")
    got, = ridge.ridge_cv(df, ["k"], "cell", "x", "y", n_folds=3, cv_metric=lambda t, p: -F.avg(F.abs(t - p))).collect()
    mu, sd = scaler(X[cell > 0])
    Z, errors = (X - mu) / sd, {}
    for a in (10.0, 100.0, 1000.0):
        each = []
        for f in (1, 2, 3):
            beta, b0 = ridge_fit(Z[(cell > 0) & (cell != f)], y[(cell > 0) & (cell != f)], a)
            each.append(np.abs(y[cell == f] - Z[cell == f] @ beta - b0).mean())
        errors[a] = np.mean(each)
    best = min(errors, key=errors.get)
    beta, b0 = ridge_fit(Z[cell > 0], y[cell > 0], best)
    assert got["alpha"] == best and got["cv_score"] == pytest.approx(-errors[best])
    assert got["test_score"] == pytest.approx(-np.abs(y[cell == 0] - Z[cell == 0] @ beta - b0).mean())


def test_moments_copy_a_piece_at_a_time_and_make_one_partial_of_a_set(spark, monkeypatch):
    from sporeframe.operators import ridge

    rng = np.random.default_rng(4)
    x, y = rng.normal(5.0, 2.0, (200, 4)), rng.normal(size=200)
    sizes = []
    matrix = ridge._feature_matrix
    monkeypatch.setattr(ridge, "PIECE_VALUES", 64)
    monkeypatch.setattr(ridge, "_feature_matrix", lambda col: sizes.append(len(col)) or matrix(col))
    made = {}

    class Frame:
        """Runs the fold here on one batch."""

        schema = ridge.T.StructType([ridge.T.StructField("k", ridge.T.StringType()), ridge.T.StructField("cell", ridge.T.IntegerType())])

        def select(self, *_):
            return self

        where = select

        def mapInArrow(self, fold, schema):
            batch = pa.RecordBatch.from_pydict({"k": ["m"] * 200, "cell": pa.array([1] * 150 + [2] * 50, pa.int32()), "f": list(x), "y": y})
            made["rows"] = [r for b in fold(iter([batch.slice(at, 40) for at in range(0, 200, 40)])) for r in b.to_pylist()]

    ridge.moment_partials(Frame(), ["k"], "cell", "f", "y")
    # copies are small, and a set is one partial however many batches it comes in
    assert max(sizes) <= 16 and [(r["cell"], r["n"]) for r in made["rows"]] == [(1, 150.0), (2, 50.0)]
    for r, part in zip(made["rows"], (slice(0, 150), slice(150, 200))):
        z = np.column_stack([x, y])[part]
        c = z - z.mean(axis=0)
        assert r["n"] == len(z) and np.allclose(r["mi"], z.mean(axis=0)) and np.allclose(np.reshape(r["q"], (5, 5)), c.T @ c)


def test_features_of_a_source_are_made_behind_the_shuffle(spark):
    """The same models as from rows of features; no exchange carries a vector."""
    from sporeframe.operators import ridge

    rng = np.random.default_rng(6)
    n = 240
    x, cell = rng.normal(size=(n, 4)), np.arange(n) % 6
    y = x[:, 0] + 0.3 * rng.normal(size=n)
    rows = [(f"g{i}", int(c), None if i % 40 == 7 else float(v), *map(float, r)) for i, (c, v, r) in enumerate(zip(cell, y, x))]
    rows += [rows[5], (None, 2, 1.0, 0.5, 0.5, 0.5, 0.5), ("nan", 3, float("nan"), 1.0, 1.0, 1.0, 1.0)]
    narrow = spark.createDataFrame(rows, "id string, cell int, y double, a double, b double, c double, d double").repartition(3)

    def make(df, keep):
        sets = F.array(F.struct(F.lit("two").alias("k"), F.array("a", "b").alias("x")), F.struct(F.lit(None).alias("k"), F.array("a", "b", "c", "d").alias("x")))
        return df.select(*keep, F.explode(sets).alias("s")).select("s.k", "s.x", *keep)

    def one(df, keep):
        return df.select(F.lit("one").alias("k"), F.array("d").alias("x"), *keep)

    sources = [ridge.Source(narrow, make), ridge.Source(narrow.where("id <> 'g3'"), one)]
    wide = make(sources[0].rows, ["id", "cell", "y"]).unionByName(one(sources[1].rows, ["id", "cell", "y"]))
    want = {r["k"]: r for r in ridge.ridge_cv(wide, ["k"], "cell", "x", "y", id_col="id").collect()}
    assert set(want) == {"one", "two", None}
    for options in ({}, {"id_col": "id", "rows_per_task": 7, "fanin": 2, "block": 2}):
        got = ridge.ridge_cv(sources, ["k"], "cell", "x", "y", **options).collect()
        assert len(got) == 3
        for r in got:
            w = want[r["k"]]
            assert (r["alpha"], r["n_train"], r["n_test"]) == (w["alpha"], w["n_train"], w["n_test"])
            assert np.allclose(r["coef"], w["coef"], rtol=1e-9, atol=1e-12) and r["test_r2"] == pytest.approx(w["test_r2"], rel=1e-9)
    error = lambda t, p: -F.avg(F.abs(t - p))
    scored = {r["k"]: r["test_score"] for r in ridge.ridge_cv(sources, ["k"], "cell", "x", "y", cv_metric=error).collect()}
    assert scored == pytest.approx({r["k"]: r["test_score"] for r in ridge.ridge_cv(wide, ["k"], "cell", "x", "y", cv_metric=error).collect()})
    plan = ridge.source_statistics(sources[0], ["k"], "cell", "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionBy") :]
    assert "Generate explode" in plan[: plan.index("RepartitionBy")] and "explode" not in below and "array(" not in below


def test_feature_sets_write_no_vectors(spark, monkeypatch):
    """What the job of all feature sets checkpoints before the fits are narrow rows."""
    from conftest import SF001
    from sporeframe.operators import ranking, ridge
    from sporeframe.plans import catalog

    written = []

    def keep(df):
        written.append(df.schema)
        return checkpoint(df)

    checkpoint = ridge.reliable_checkpoint
    for module in (catalog, ranking, ridge, md):
        monkeypatch.setattr(module, "reliable_checkpoint", keep)
    rows = catalog.QUERIES["feature_set_ridge_metrics"](spark, SF001).collect()
    assert len(rows) == 12 and len({r["model"] for r in rows}) == 12
    assert written and not [s for s in written if "features" in s.names]
