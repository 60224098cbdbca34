"""Join helpers (J1-J9).  Only equi-joins; Catalyst picks the strategy.

``F.broadcast`` is used only behind ``small_side``, which counts the bytes;
above the bound the join is left to the planner
(sort-merge, with AQE's runtime broadcast / skew-split).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes above which a lookup table is not broadcast by hand.
BROADCAST_MAX_BYTES = 64 << 20


def _field_bytes(col: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a broadcast row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            inner = F.aggregate(col, F.lit(0), lambda a, x: a + _field_bytes(x, kind.elementType).cast("int"))
            return F.coalesce(inner, F.lit(0)) + 24
        return F.greatest(F.size(col), F.lit(0)) * 8 + 24
    if isinstance(kind, T.StructType):
        return sum((_field_bytes(col[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def small_side(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when its rows take at most ``max_bytes`` in all (counted, wide rows as wide);
    else the planner decides."""
    width = sum((_field_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    size = df.select(width.cast("long").alias("b")).agg(F.sum("b")).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def inner_join_all(dfs: Sequence[DataFrame], key: str | Sequence[str], suffixes: Sequence[str] | None = None,
                   r_style: bool = True) -> DataFrame:
    """Inner-join several tables on ``key``.

    Non-key columns present in more than one table are renamed first.  With
    ``r_style`` the names follow R's nested ``merge``: the first two
    tables' clashing columns get ``.x`` / ``.y`` and the third keeps its
    plain name (later ones get ``.4``, ``.5``, ...); otherwise ``suffixes[i]`` is appended to table i's clashes.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts: dict[str, int] = {}
    for d in dfs:
        for c in d.columns:
            if c not in keys:
                counts[c] = counts.get(c, 0) + 1
    renamed = []
    for i, d in enumerate(dfs):
        if r_style:
            suffix = [".x", ".y", ""][i] if i < 3 else f".{i + 1}"
        else:
            suffix = (suffixes or [f"_{j}" for j in range(len(dfs))])[i]
        renamed.append(d.select(*keys, *[F.col(c).alias(c + suffix if counts[c] > 1 else c)
                                         for c in d.columns if c not in keys]))
    return reduce(lambda a, b: a.join(b, keys, "inner"), renamed)


def lookup(df: DataFrame, table: DataFrame, left_key: str, right_key: str, value: str, out: str,
           default: str | None = "") -> DataFrame:
    """Dictionary lookup with a default (J4: ``.map(d).fillna('')``).

    A key listed twice keeps one value, chosen deterministically (the
    largest), so reruns and retries give the same answer."""
    pairs = table.select(F.col(right_key).alias("_lk"), F.col(value).alias("_lv"))
    t = small_side(pairs.groupBy("_lk").agg(F.max("_lv").alias("_lv")))
    joined = df.join(t, df[left_key] == t["_lk"], "left")
    val = F.coalesce(F.col("_lv"), F.lit(default)) if default is not None else F.col("_lv")
    return joined.withColumn(out, val).drop("_lk", "_lv")


def membership_flag(df: DataFrame, ids: DataFrame, key: str, id_col: str, out: str = "is_test") -> DataFrame:
    """Boolean column: is ``key`` in the id table (J7, ``isin(set)``).  The
    ids are de-duplicated first so the left join cannot multiply rows."""
    distinct_ids = ids.select(F.col(id_col).alias("_mid")).distinct().withColumn("_hit", F.lit(True))
    joined = df.join(distinct_ids, df[key] == distinct_ids["_mid"], "left")
    return joined.withColumn(out, F.coalesce(F.col("_hit"), F.lit(False))).drop("_mid", "_hit")


def keep_present(df: DataFrame, other: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keep rows whose key exists in ``other`` (J6, semi join)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(other.select(*keys), keys, "left_semi")


def matching_key_count(a: DataFrame, b: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """Number of distinct keys found in both tables, per group."""
    cols = [*group, key]
    common = a.select(*cols).intersect(b.select(*cols))
    if group:
        return common.groupBy(*group).agg(F.count(F.lit(1)).alias("matching"))
    return common.agg(F.count(F.lit(1)).alias("matching"))


def positional_zip(left: DataFrame, right: DataFrame, group: Sequence[str], left_order: Sequence[str],
                   right_order: Sequence[str], how: str = "inner", check_counts: bool = True) -> DataFrame:
    """Pair the i-th row of ``left`` with the i-th row of ``right`` inside each
    group (J8), numbering both sides with the skew-safe ``group_row_number``.

    With ``check_counts`` a group whose two sides differ in size raises
    (quirk Q5: the reference silently misaligns).
    """
    from sporeframe.operators.ranking import group_row_number

    lz = group_row_number(left, group, left_order, "row_idx", count_name="_nl")
    rz = group_row_number(right, group, right_order, "row_idx", count_name="_nr")
    joined = lz.join(rz, [*group, "row_idx"], how)
    if check_counts:
        # a filter (not a dropped column) so the check cannot be pruned away
        same = F.col("_nl").isNull() | F.col("_nr").isNull() | (F.col("_nl") == F.col("_nr"))
        joined = joined.where(
            F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("positional zip: the two sides differ in length")))
        )
    return joined.drop("_nl", "_nr")
