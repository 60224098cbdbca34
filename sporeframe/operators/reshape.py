"""Set operations and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    """``pd.concat`` / ``rbind`` (U1): columns matched by name, missing ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def pivot_wider(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
                values: Sequence[str] | None = None, dup: str = "mean") -> DataFrame:
    """Long to wide (U3, ``pivot_wider``).

    ``values`` lists the new columns (else Spark finds the distinct names in
    one extra job).  Several rows for one cell: ``dup="mean"`` averages,
    ``"first"`` takes the smallest value, ``"list"`` keeps a sorted list (R's
    list-column), ``"error"`` fails.
    """
    g = df.groupBy(*ids).pivot(names_from, list(values) if values is not None else None)
    v = F.col(values_from)
    if dup == "mean":
        return g.agg(F.avg(v))
    if dup == "first":
        return g.agg(F.min(v))
    if dup == "list":
        return g.agg(F.sort_array(F.collect_list(v)))
    if dup == "error":
        return g.agg(F.when(F.count(v) <= 1, F.first(v)).otherwise(F.raise_error(F.lit("duplicate cell in pivot"))))
    raise ValueError(f"unknown dup rule {dup!r}")


def concat_features(*arrays: str | Column) -> Column:
    """Side-by-side feature vectors (U4, ``np.concatenate(axis=1)``)."""
    return F.concat(*[F.col(a) if isinstance(a, str) else a for a in arrays])


def array_to_columns(df: DataFrame, col: str, width: int, prefix: str = "embed_") -> DataFrame:
    """``ARRAY`` column to ``prefix0..prefix{width-1}`` columns (U5), for CSV sinks."""
    others = [c for c in df.columns if c != col]
    return df.select(*[F.col(col)[i].alias(f"{prefix}{i}") for i in range(width)], *others)


def columns_to_array(df: DataFrame, prefix: str = "embed_", name: str = "features") -> DataFrame:
    """Columns named ``prefix<i>`` back into one ``ARRAY<DOUBLE>`` in index order."""
    cols = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()),
                  key=lambda c: int(c[len(prefix):]))
    others = [c for c in df.columns if c not in cols]
    return df.select(*others, F.array(*[F.col(c).cast("double") for c in cols]).alias(name))
