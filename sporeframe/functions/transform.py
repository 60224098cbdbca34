"""Value transforms as column expressions (F27, F28, and the Yeo-Johnson map)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lam(lam: float | Column) -> Column:
    return lam if isinstance(lam, Column) else F.lit(float(lam))


def log10p1(x: ColumnOrName) -> Column:
    """``log10(x + 1)``."""
    return F.log10(_c(x) + F.lit(1.0))


def boxcox(x: ColumnOrName, lam: float | Column) -> Column:
    """Box-Cox with a given lambda (F28); NULL for x <= 0 (undefined there).

    ``lam`` may be a column, so a per-group fitted lambda joined in works.
    """
    v, lm = _c(x).cast("double"), _lam(lam)
    return (
        F.when(v <= 0, F.lit(None).cast("double"))
        .when(lm == 0, F.log(v))
        .otherwise((F.pow(v, lm) - F.lit(1.0)) / lm)
    )


def yeojohnson(x: ColumnOrName, lam: float | Column) -> Column:
    """Yeo-Johnson with a given lambda (defined for every real x)."""
    v, lm = _c(x).cast("double"), _lam(lam)
    pos = F.when(lm == 0, F.log1p(v)).otherwise((F.pow(v + 1, lm) - 1) / lm)
    two = F.lit(2.0) - lm
    neg = F.when(two == 0, -F.log1p(-v)).otherwise(-(F.pow(F.lit(1.0) - v, two) - 1) / two)
    return F.when(v >= 0, pos).otherwise(neg)
