"""Aggregate expressions used as scores and spreads.

Each is an ordinary aggregate column, so Spark computes it with partial
(map-side) aggregation and a hot group costs no more than a cold one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rsd(x: ColumnOrName) -> Column:
    """Relative standard deviation: sample std / mean (A5); NULL for one row or mean 0."""
    return F.try_divide(F.stddev_samp(_c(x)), F.avg(_c(x)))


def normality_score(x: ColumnOrName) -> Column:
    """|population skewness| + |excess population kurtosis|."""
    return F.abs(F.skewness(_c(x))) + F.abs(F.kurtosis(_c(x)))


def pearson_r2(y: ColumnOrName, p: ColumnOrName) -> Column:
    """Squared Pearson correlation."""
    return F.pow(F.corr(_c(y), _c(p)), 2)


def r2_score(y: ColumnOrName, p: ColumnOrName) -> Column:
    """Coefficient of determination 1 - SSE / SST (A18).  Not ``regr_r2``,
    which is the squared correlation."""
    sse = F.sum(F.pow(_c(y) - _c(p), 2))
    return F.lit(1.0) - sse / F.regr_syy(_c(y), _c(p))


def line_fit(y: ColumnOrName, x: ColumnOrName) -> list[Column]:
    """Least-squares line (A19): slope, intercept and r."""
    return [
        F.regr_slope(_c(y), _c(x)).alias("slope"),
        F.regr_intercept(_c(y), _c(x)).alias("intercept"),
        F.corr(_c(y), _c(x)).alias("r"),
    ]


def user_aggregate(func, return_type: str = "double"):
    """Wrap a Python reducer ``pandas.Series -> scalar`` as a grouped
    aggregate for ``agg`` (Arrow batches, partial results are not merged,
    so use it on bounded groups; prefer the built-in expressions above).
    Spark does not mix such aggregates with built-in ones in one ``agg``.

    ``groupBy(k).agg(user_aggregate(my_rsd)("TPM"))``
    """
    @F.pandas_udf(return_type)
    def _agg(s: pd.Series) -> float:
        return func(s)

    return _agg
