"""Fitted power transforms and normal QQ fits.

Lambda is chosen per group by maximum likelihood, as ``boxcox`` /
``yeojohnson`` without a given lambda do: a scan of -5..5 in steps of 0.1,
then two refinements around the best value (steps 0.005 and 0.0001), each a
grouped aggregate in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sporeframe.functions.metrics import line_fit
from sporeframe.operators.joins import small_side
from sporeframe.operators.ranking import group_row_number
from sporeframe.session import reliable_checkpoint

STAGES = ((-5.0, 5.0, 0.1), (-0.1, 0.1, 0.005), (-0.005, 0.005, 0.0001))


def power_transform(x: Column, lam: Column, method: str) -> Column:
    """Box-Cox or Yeo-Johnson of ``x`` (``expm1`` keeps lambda near 0 exact)."""
    def one(log: Column, power: Column) -> Column:
        return F.when(F.abs(power) < 1e-12, log).otherwise(F.expm1(power * log) / power)

    if method == "boxcox":
        return one(F.log(x), lam)
    size = F.log1p(F.abs(x))
    return F.when(x >= 0, one(size, lam)).otherwise(-one(size, 2 - lam))


def fit_lambdas(df: DataFrame, group_cols: Sequence[str], value: str, methods: dict[str, str]) -> DataFrame:
    """Maximum-likelihood lambdas per group, one column for each of ``methods`` (column name -> ``boxcox`` or
    ``yeojohnson``): ``(group..., <name>..., <name>_llf...)``.

    Box-Cox needs positive values: its lambda is NULL in a group holding x <= 0.  Groups with fewer than two
    values get no row.  Each stage is one grouped aggregate over (value, method, candidate) rows, combined
    before the shuffle, so a group of any size spreads over all tasks; only
    (group, method, lambda) rows pass from stage to stage, for all methods at once.
    """
    group_cols = list(group_cols)
    x, name = F.col("_x"), F.col("_name")
    d = df.select(*group_cols, F.col(value).cast("double").alias("_x")).where(x.isNotNull())
    # read by every stage; dealt evenly, as each row becomes a hundred candidates that few small partitions would compute
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = reliable_checkpoint(d.repartition(parts))
    slope = {"boxcox": F.log(x), "yeojohnson": F.signum(x) * F.log1p(F.abs(x))}
    groups = d.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_least"), *[F.sum(slope[m]).alias(f"_jac_{m}") for m in set(methods.values())])
    each = [F.when(F.col("_least") > 0 if m == "boxcox" else F.lit(True), F.struct(F.lit(k).alias("name"), F.col(f"_jac_{m}").alias("jac"))) for k, m in methods.items()]
    groups = groups.where(F.col("_n") >= 2)
    best = groups.select(*group_cols, "_n", F.explode(F.filter(F.array(*each), lambda e: e.isNotNull())).alias("_e"))
    best = reliable_checkpoint(best.select(*group_cols, "_n", F.col("_e.name").alias("_name"), F.col("_e.jac").alias("_jac"), F.lit(0.0).alias("_center")))

    def transformed(lam: Column) -> Column:
        out = F.lit(None).cast("double")
        for k, m in methods.items():
            out = F.when(name == k, power_transform(x, lam, m)).otherwise(out)
        return out

    for lo, hi, step in STAGES:
        grid = [round(lo + step * i, 10) for i in range(int(round((hi - lo) / step)) + 1)]
        # rounded, so a candidate that should be 0 is exactly 0 (the log case)
        lams = F.transform(F.array(*[F.lit(g) for g in grid]), lambda g: F.round(F.col("_center") + g, 10))
        now = best.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], "_name", "_n", "_jac", "_center")
        on = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group_cols], F.lit(True))
        keys = [*group_cols, "_name", "_n", "_jac"]
        pairs = d.join(small_side(now), on).select(*keys, "_x", F.explode(lams).alias("_lam"))
        var = pairs.groupBy(*keys, "_lam").agg(F.var_pop(transformed(F.col("_lam"))).alias("_var"))
        llf = (F.col("_lam") - 1) * F.col("_jac") - F.col("_n") / 2 * F.log("_var")
        # likelihoods equal to 9 decimals are ties (flat ones of tiny groups differ by rounding noise): the smaller |lambda| wins
        order = F.struct(F.round(F.coalesce(llf, F.lit(float("-inf"))), 9).alias("l"), (-F.abs("_lam")).alias("a"), (-F.col("_lam")).alias("b"))
        top = var.groupBy(*keys).agg(F.max(order).alias("_best"))
        best = reliable_checkpoint(top.select(*keys, (-F.col("_best.b")).alias("_center"), F.col("_best.l").alias("_llf")))
    outs = [F.max(F.when(name == k, F.col(c))).alias(k + tail) for tail, c in (("", "_center"), ("_llf", "_llf")) for k in methods]
    return best.groupBy(*group_cols).agg(*outs)


def fit_lambda(df: DataFrame, group_cols: Sequence[str], value: str, method: str = "boxcox",
               name: str = "lam") -> DataFrame:
    """`fit_lambdas` for one method: ``(group..., <name>, llf)``; a group without a lambda gets no row."""
    return fit_lambdas(df, group_cols, value, {name: method}).withColumnRenamed(f"{name}_llf", "llf")


def apply_fitted(df: DataFrame, lambdas: DataFrame, group_cols: Sequence[str], value: str, method: str,
                 lam: str = "lam", out: str | None = None) -> DataFrame:
    """Transform ``value`` with each group's fitted lambda."""
    from sporeframe.functions.transform import boxcox, yeojohnson

    j = df.join(lambdas.select(*group_cols, lam), list(group_cols), "left")
    f = boxcox if method == "boxcox" else yeojohnson
    return j.withColumn(out or f"{method}_{value}", f(value, F.col(lam))).drop(lam)


# Coefficients of Acklam's rational approximation of the
# inverse normal CDF (relative error below 1.2e-9), in the published order.
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
      -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
      -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
      4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
_P_LOW = 0.02425


def _horner(coefs: Sequence[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def norm_ppf(p: Column) -> Column:
    """Inverse standard normal CDF as a column expression (Acklam)."""
    q_lo = F.sqrt(-2 * F.log(p))
    low = _horner(_C, q_lo) / (_horner(_D, q_lo) * q_lo + 1)
    q_hi = F.sqrt(-2 * F.log(1 - p))
    high = -_horner(_C, q_hi) / (_horner(_D, q_hi) * q_hi + 1)
    q = p - 0.5
    r = q * q
    mid = _horner(_A, r) * q / (_horner(_B, r) * r + 1)
    return F.when(p < _P_LOW, low).when(p > 1 - _P_LOW, high).otherwise(mid)


def qq_points(df: DataFrame, group_cols: Sequence[str], value: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Ordered values against normal quantiles at Filliben's medians
    (``probplot``): ``(group..., i, osm, osr)``."""
    d = df.where(F.col(value).isNotNull())
    r = group_row_number(d, group_cols, [value, *tiebreak], "i", count_name="_n")
    n = F.col("_n").cast("double")
    i = F.col("i").cast("double")
    last = F.pow(F.lit(0.5), 1 / n)
    m = (F.when(F.col("i") == F.col("_n"), last)
         .when(F.col("i") == 1, 1 - last)
         .otherwise((i - 0.3175) / (n + 0.365)))
    return r.select(*group_cols, "i", norm_ppf(m).alias("osm"), F.col(value).alias("osr"))


def qq_fit(df: DataFrame, group_cols: Sequence[str], value: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """W5 + A19: slope, intercept and r of the QQ line per group."""
    return qq_points(df, group_cols, value, tiebreak).groupBy(*group_cols).agg(*line_fit("osr", "osm"))
