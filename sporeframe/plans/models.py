"""Model jobs: ridge per species and end (M6), per feature set (M7), group
k-fold (M8), bootstrap (M9), and the R2-per-species trend (M13).

Species, feature sets, outer folds and replicates are keys of one grouped
job each, not loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeframe.functions.metrics import line_fit, r2_score
from sporeframe.operators.joins import small_side
from sporeframe.operators.ranking import group_row_number, ntile_of
from sporeframe.operators.ridge import REFERENCE_ALPHAS, Scorer, Source, nested_ridge, predict, ridge_bootstrap, ridge_cv, with_keys
from sporeframe.operators.split import bootstrap_weights, group_kfold, holdout_split, kfold
from sporeframe.session import reliable_checkpoint


def species_ridge(data: DataFrame, key_cols: Sequence[str] = ("end", "species"), id_col: str = "gene_id",
                  test_size: float = 0.1, n_folds: int = 5, alphas: Sequence[float] = REFERENCE_ALPHAS,
                  seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M6: per (end, species) hold out ``test_size`` (M2), choose alpha by
    ``n_folds``-fold CV on the rest (M3), predict the held-out rows (M5).

    Returns ``(models, predictions)``; ``models`` carries ``test_r2`` (A18).
    Rows without a target are dropped first (P7).
    """
    d = data.where(F.col("y").isNotNull() & ~F.isnan("y"))
    split = holdout_split(d, key_cols, id_col, test_size, seed, n_folds)
    # one row per model: materialised once, read by predictions and reports
    models = reliable_checkpoint(ridge_cv(split, key_cols, "fold", "features", "y", alphas, n_folds, id_col=id_col))
    test_rows = split.where(F.col("is_test"))
    preds = predict(test_rows, models, key_cols, "features").select(
        *key_cols, id_col, F.col("y").alias("True_Value"), "Predicted_Value")
    return models, preds


def skipped_models(data: DataFrame, key_cols: Sequence[str] = ("end", "species"), y: str = "y", min_rows: int = 10) -> DataFrame:
    """M6's skip table ``(keys, n_rows, n_targets, reason)``: models that have no target, or fewer than ``min_rows``."""
    n = F.count(F.when(F.col(y).isNotNull() & ~F.isnan(y), 1))
    sizes = data.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n_rows"), n.alias("n_targets"))
    reason = F.when(F.col("n_targets") == 0, F.lit("no target")).when(F.col("n_targets") < min_rows, F.lit("too few rows"))
    return sizes.withColumn("reason", reason).where(F.col("reason").isNotNull())


def r2_from_predictions(preds: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """A18 over a predictions table: one R2 per key."""
    return preds.groupBy(*key_cols).agg(r2_score("True_Value", "Predicted_Value").alias("R2"))


def feature_set_ridge(data: DataFrame | Sequence[Source], id_col: str = "gene_id", order_col: str = "row_order", n_folds: int = 5,
                      alphas: Sequence[float] = REFERENCE_ALPHAS, cv_metric: str | Scorer = "r2") -> tuple[DataFrame, DataFrame]:
    """M7: per feature set, train on non-test genes (``is_test`` from J7)
    with contiguous CV folds in table order, score Pearson r2 on the test
    genes.  Returns ``(metrics(model, r2, alpha), models)``.

    ``data`` may be sources: all sets of one have the same rows, so these are folded once."""
    if isinstance(data, DataFrame):
        folded = kfold(data, ["feature_set"], [order_col, id_col], n_folds, where=~F.col("is_test"))
    else:
        folded = [s._replace(rows=kfold(s.rows, [], [order_col, id_col], n_folds, where=~F.col("is_test"))) for s in data]
    models = ridge_cv(folded, ["feature_set"], "fold", "features", "y", alphas, n_folds, cv_metric, id_col)
    metrics = models.select(F.col("feature_set").alias("model"), F.col("test_pearson_r2").alias("r2"), "alpha")
    return metrics, models


def feature_set_predictions(data: DataFrame, models: DataFrame, id_col: str = "gene_id") -> DataFrame:
    """M7's predictions table ``(model, id, y_pred, y_true)`` of the test genes."""
    preds = predict(data.where(F.col("is_test") & F.col("y").isNotNull()), models, ["feature_set"], "features", "y_pred")
    return preds.select(F.col("feature_set").alias("model"), id_col, "y_pred", F.col("y").alias("y_true"))


def nested_cells(data: DataFrame, block: str, id_col: str, order_col: str, outer: int, inner: int) -> DataFrame:
    """``data`` with ``outer_fold`` (W7) and ``cell`` (see ``ridge.nested_plan``).

    Only narrow rows are numbered: each outer fold's training rows in table order, and the places in the
    table where its inner folds end.  A row's cell is its outer fold and, for every outer fold,
    between which of these ends its place lies.
    """
    keys = ["feature_set", order_col, id_col]
    g = group_kfold(data, ["feature_set"], block, outer, "outer_fold")
    narrow = group_row_number(g.select(*keys, "outer_fold").distinct(), ["feature_set"], [order_col, id_col], "_place")
    narrow = reliable_checkpoint(narrow)
    others = narrow.select("feature_set", "_place", F.explode(F.expr(f"filter(sequence(1, {outer}), f -> f <> outer_fold)")).alias("_f"))
    ranked = group_row_number(others, ["feature_set", "_f"], ["_place"], "_rn", count_name="_n")
    ends = ranked.groupBy("feature_set", "_f", ntile_of("_rn", "_n", inner).alias("_fold")).agg(F.max("_place").alias("_end"))
    # an array of ends for each outer fold, the last inner fold being open: a row for each feature set
    ends = ends.where(F.col("_fold") < inner).groupBy("feature_set").agg(F.collect_list(F.struct("_f", "_end")).alias("_ends"))
    digits = F.transform(F.sequence(F.lit(1), F.lit(outer)), lambda f: (F.lit(1) + F.size(
        F.filter("_ends", lambda e: (e["_f"] == f) & (e["_end"] < F.col("_place"))))).cast("string"))
    named = with_keys(narrow, small_side(ends), ["feature_set"], "left").withColumn("_ends", F.coalesce("_ends", F.array().cast("array<struct<_f: int, _end: bigint>>")))
    cells = named.select(*keys, "outer_fold", F.concat(F.col("outer_fold").cast("string"), F.lit(":"), F.array_join(digits, "")).alias("cell"))
    return with_keys(data, small_side(cells), keys)


def group_kfold_ridge(data: DataFrame, block: str = "block", id_col: str = "gene_id", order_col: str = "row_order",
                      outer: int = 10, inner: int = 3, alphas: Sequence[float] = REFERENCE_ALPHAS) -> tuple[DataFrame, DataFrame]:
    """M8: ``outer`` group folds (W7); for each, a ridge with ``inner``-fold
    CV on the other folds' rows in table order, Pearson r2 on the fold.

    Returns ``(metrics(model, fold, r2, alpha), predictions(model, fold, id, pred, true))``: every row is predicted once, by the
    model of the folds that don't hold it.  No row is copied: training sets are sums of cells (``nested_cells``).
    """
    d = reliable_checkpoint(nested_cells(data.where(F.col("y").isNotNull() & ~F.isnan("y")), block, id_col, order_col, outer, inner))
    models = reliable_checkpoint(nested_ridge(d, ["feature_set"], "cell", "features", "y", outer, inner, alphas, id_col))
    models = models.withColumnRenamed("outer", "outer_fold")
    metrics = models.select(F.col("feature_set").alias("model"), F.col("outer_fold").alias("fold"), F.col("pearson_r2").alias("r2"), "alpha")
    preds = predict(d, models, ["feature_set", "outer_fold"], "features", "pred")
    return metrics, preds.select(F.col("feature_set").alias("model"), F.col("outer_fold").alias("fold"), id_col, "pred", F.col("y").alias("true"))


def bootstrap_ridge(data: DataFrame, models: DataFrame, id_col: str = "gene_id", replicates: int = 100,
                    seed: int = 42, name_filter=None) -> DataFrame:
    """M9: per feature set, ``replicates`` resamples of the training genes (as many
    draws with replacement as there are genes, see ``split.bootstrap_weights``), ridge
    with the alpha M7 chose, Pearson r2 on the test genes.  ``name_filter``
    is a Column predicate on ``feature_set`` (P14)."""
    # the alpha table (one row per model) is computed once, not per reading job
    d = with_keys(data, reliable_checkpoint(models.select("feature_set", "alpha")), ["feature_set"])
    if name_filter is not None:
        d = d.where(name_filter)
    cols = ["feature_set", id_col, "features", "y", "alpha"]
    train = bootstrap_weights(d.where(~F.col("is_test")), ["feature_set"], [id_col], replicates, seed, "w")
    test = d.where("is_test").select(*cols, F.lit(None).cast("array<double>").alias("w"), F.lit(0).alias("cell"))
    d = train.select(*cols, "w", F.lit(1).alias("cell")).unionByName(test)
    return ridge_bootstrap(d, ["feature_set"], "cell", "features", "y", "w", "alpha", id_col)


def bootstrap_spread(boot: DataFrame) -> DataFrame:
    """A24 + O1: 2 x sample std of r2 per model, sorted by it."""
    return (boot.groupBy(F.col("feature_set").alias("model"))
            .agg((F.lit(2.0) * F.stddev_samp("pearson_r2")).alias("r2")).orderBy("r2"))


def r2_trend(r2: DataFrame, order_cols: Sequence[str] = ("species",), group_cols: Sequence[str] = ()) -> DataFrame:
    """Index species in order (W3) and fit a straight line R2 ~ index (A19), per group (such as the end)."""
    numbered = group_row_number(r2.withColumn("_all", F.lit(1)), ["_all", *group_cols], list(order_cols), "_pos")
    x = (F.col("_pos") - 1).cast("double")
    return numbered.select(*group_cols, x.alias("x"), F.col("R2").alias("y")).groupBy(*group_cols).agg(*line_fit("y", "x"))
