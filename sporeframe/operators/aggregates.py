"""Grouped statistics beyond the plain built-ins.

Whole-table constants (min / max / bandwidth) are computed by one aggregate
each and enter the next plan as literals (a few numbers reach the driver;
no join with a one-row table is needed).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sporeframe.operators.ranking import average_rank, exact_percentiles


def group_to_list(df: DataFrame, key: str, value: str, name: str = "items") -> DataFrame:
    """Sorted list of values per key (A11).  Use only where a key's list is
    small by nature (folders per dataset); it is held in one row."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(name))


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean of the non-null values of several columns (A23, ``rowMeans(na.rm=TRUE)``)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    total = sum((F.coalesce(c.cast("double"), F.lit(0.0)) for c in cs), F.lit(0.0))
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    return F.when(count > 0, total / count)


def row_sd(cols: Sequence[str | Column]) -> Column:
    """Sample standard deviation of the non-null values of several columns."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    mean = row_mean(cs)
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs), F.lit(0))
    ss = sum((F.coalesce(F.pow(c.cast("double") - mean, 2), F.lit(0.0)) for c in cs), F.lit(0.0))
    return F.when(count > 1, F.sqrt(ss / (count - 1)))


def spearman(df: DataFrame, group_cols: Sequence[str], a: str, b: str, tiebreak: str) -> DataFrame:
    """Spearman correlation per group (A17): Pearson of average ranks."""
    ra = average_rank(df, group_cols, a, [tiebreak], "_ra")
    rb = average_rank(ra, group_cols, b, [tiebreak], "_rb")
    return rb.groupBy(*group_cols).agg(F.corr("_ra", "_rb").alias("spearman"))


def histogram_width(df: DataFrame, value: str, width: float, boundary: float = 0.0,
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """Fixed-width bins with an edge at ``boundary``, closed on the right.

    Bin k is ``(boundary + k*w, boundary + (k+1)*w]``, and a group's first bin
    is closed on the left too: smallest values that lie on an edge count in
    the bin to its right.  Only bins holding rows are returned (``count``).
    """
    place = (F.col(value) - F.lit(boundary)) / F.lit(width)
    k = (F.ceil(place) - 1).cast("long")
    binned = df.where(F.col(value).isNotNull()).select(*group_cols, k.alias("bin"), F.floor(place).cast("long").alias("_left"))
    counts = binned.groupBy(*group_cols, "bin").agg(F.count(F.lit(1)).alias("count"), F.min("_left").alias("_left"))
    # one row per bin from here on: the first bin's rows move if its smallest value is an edge
    first = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
    moved = F.greatest("bin", F.min("_left").over(first))
    counts = counts.withColumn("bin", moved).groupBy(*group_cols, "bin").agg(F.sum("count").alias("count"))
    return counts.select(
        *group_cols, "bin",
        (F.lit(boundary) + F.col("bin") * F.lit(width)).alias("bin_lo"),
        (F.lit(boundary) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
        "count",
    )


def histogram_bins(df: DataFrame, value: str, bins: int, limits: tuple[float, float] | None = None,
                   boundary: float = 0.0) -> DataFrame:
    """``bins`` bins over the range or the given limits (A21, ggplot2 rule).

    Rows outside ``limits`` are removed; the width is range / (bins - 1)
    with an edge at ``boundary``; empty bins are reported with count 0.
    The bin table is generated from the bin count (bounded), then left
    joined to the counts.
    """
    v = F.col(value)
    data = df.where(v.isNotNull())
    if limits is not None:
        lo, hi = float(limits[0]), float(limits[1])
        data = data.where((v >= lo) & (v <= hi))
        lo_c, hi_c = F.lit(lo), F.lit(hi)
    else:
        lo_c = data.select(F.min(v).cast("double")).scalar()
        hi_c = data.select(F.max(v).cast("double")).scalar()
    # a constant column has one bin of width 1; an empty one has no limits and no bins
    width = F.when(hi_c > lo_c, (hi_c - lo_c) / F.lit(float(max(1, bins - 1)))).when(hi_c == lo_c, F.lit(1.0))
    # first edge at or below the low end, aligned to the boundary
    first = F.lit(boundary) + F.floor((lo_c - F.lit(boundary)) / width) * width
    k = F.greatest(F.ceil((v - first) / width) - 1, F.lit(0)).cast("long")
    counts = data.select(k.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    last = F.greatest(F.ceil((hi_c - first) / width), F.when(hi_c.isNotNull(), F.lit(1))).cast("long")
    all_bins = spark.range(0, bins + 1).select(F.col("id").alias("bin")).where(F.col("bin") < last)
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (first + F.col("bin") * width).alias("bin_lo"),
        (first + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def nrd0_bandwidth(df: DataFrame, value: str) -> float:
    """R's default bandwidth 0.9 * min(sd, IQR / 1.34) * n^(-1/5); one
    aggregate for sd and n, the quartiles from the distributed exact
    percentile; only the resulting number reaches the driver."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), F.lit(1).alias("_g"))
    mom = v.agg(F.stddev_samp("_v").alias("sd"), F.count(F.lit(1)).alias("n"), F.min("_v").alias("least")).first()
    if not mom["n"]:
        return float("nan")
    q = exact_percentiles(v, ["_g"], "_v", {"q1": 0.25, "q3": 0.75}).first()
    sd, iqr = mom["sd"] or 0.0, (q["q3"] - q["q1"]) / 1.34
    # a column without spread takes its value's size, or 1
    return 0.9 * (min(sd, iqr) or sd or abs(mom["least"]) or 1.0) * mom["n"] ** -0.2


def kde(df: DataFrame, value: str, n_points: int = 512, n_bins: int = 1024) -> DataFrame:
    """Gaussian kernel density on ``n_points`` between min and max.

    As R's ``density`` does, rows are first linearly binned onto
    ``n_bins`` grid points (one aggregate, bounded output), then each bin
    spreads its weight onto the output points.  The work after the
    aggregate is ``n_bins x n_points`` whatever the row count.  A constant
    column gives ``n_points`` equal points, an empty one none.
    """
    v = F.col(value).cast("double")
    data = df.where(F.col(value).isNotNull())
    # whole-column constants: one aggregate, a handful of numbers to the driver
    st = data.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, n = (F.lit(float(st[c] or 0.0)) for c in ("lo", "hi", "n"))
    bw = F.lit(nrd0_bandwidth(data, value))
    step = (hi - lo) / F.lit(float(n_bins - 1))
    pos = F.when(step > 0, (v - lo) / step).otherwise(F.lit(0.0))
    left = F.least(F.floor(pos), F.lit(n_bins - 2)).cast("int")
    frac = pos - left
    weights = data.select(F.explode(F.array(
        F.struct(left.alias("b"), (F.lit(1.0) - frac).alias("w")),
        F.struct((left + 1).alias("b"), frac.alias("w")),
    )).alias("e")).groupBy(F.col("e.b").alias("b")).agg(F.sum("e.w").alias("w"))
    out_step = (hi - lo) / F.lit(float(n_points - 1))
    spread = weights.select(
        F.posexplode(F.array_repeat(F.lit(0), n_points)).alias("j", "_z"), "b", "w"
    ).select(
        "j",
        (F.col("w") * F.exp(-F.pow(((lo + F.col("j") * out_step) - (lo + F.col("b") * step)) / bw, 2) / 2)).alias("k"),
    )
    dens = spread.groupBy("j").agg(F.sum("k").alias("s"))
    norm = F.lit(1.0 / math.sqrt(2 * math.pi)) / (n * bw)
    return dens.select(
        F.col("j").alias("point"),
        (lo + F.col("j") * out_step).alias("x"),
        (F.col("s") * norm).alias("density"),
    )
