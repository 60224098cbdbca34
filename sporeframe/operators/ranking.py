"""Row positions inside groups without sending a group to one task.

``Window.partitionBy(g).orderBy(o)`` puts every row of a group into a single
task; with one species holding a third of all rows that task would hold a
third of the data.  ``group_row_number`` instead range-partitions on
``(g, o)`` so a hot group is spread over many tasks, numbers rows inside each
sorted partition, and adds a per-(group, partition) offset computed on a
table whose size is bounded by partitions + groups, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.session import reliable_checkpoint

_LOW33 = (1 << 33) - 1


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def group_row_number(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    name: str = "rn",
    count_name: str | None = None,
) -> DataFrame:
    """Add ``name`` = 1-based position of the row in its group under ``order_cols``.

    ``order_cols`` must give a total order inside each group (add a unique
    tie-breaker), otherwise positions of tied rows are arbitrary, as they
    are for ``row_number()``.  ``count_name`` also adds the group size.

    Plan: one range shuffle on ``(group, order)``, a checkpoint that fixes the
    row ids (so the two reads below see identical ids, also after an
    executor loss), one small aggregate + window on the per-partition
    counts, and one join back on ``(group, partition)``.
    """
    group_cols = list(group_cols)
    keys = [*_cols(group_cols), *_cols(order_cols)]
    ranked = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_rid", F.monotonically_increasing_id())
    )
    ranked = reliable_checkpoint(ranked).withColumn("_pid", F.shiftright("_rid", 33))

    parts = ranked.groupBy(*group_cols, "_pid").agg(
        F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if count_name:
        parts = parts.withColumn(count_name, F.sum("_n").over(Window.partitionBy(*group_cols)))
    parts = parts.select(
        *[F.col(c).alias(f"_g_{c}") for c in group_cols], "_pid", "_first", "_off",
        *([count_name] if count_name else []),
    )
    on = reduce(
        lambda a, b: a & b,
        [ranked[c].eqNullSafe(parts[f"_g_{c}"]) for c in group_cols] + [ranked["_pid"] == parts["_pid"]],
    )
    out = ranked.join(parts, on).withColumn(
        name, (F.col("_rid") - F.col("_first") + F.col("_off") + 1).cast("long")
    )
    drop = ["_rid", "_pid", "_first", "_off"] + [f"_g_{c}" for c in group_cols]
    return out.drop(*drop)


def running_total(df: DataFrame, order_cols: Sequence[str | Column], value_col: str, name: str = "before") -> DataFrame:
    """Add ``name`` = the sum of ``value_col`` over all rows that come before the row under ``order_cols``.

    ``order_cols`` must give a total order.  One range shuffle on it; sums run inside each sorted
    partition (``mapInArrow``, a batch in memory at a time) and get the partitions before added, from a table of a row each.
    """
    keys = _cols(order_cols)
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_here", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(value_col).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(values)
            if len(values):
                total = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), part, dtype=np.int32)), pa.array(ends - values)], names=schema.names)

    placed = reliable_checkpoint(ordered.mapInArrow(run, schema))
    parts = placed.groupBy("_part").agg(F.sum(value_col).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = reliable_checkpoint(parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off")))
    out = placed.join(F.broadcast(parts), placed["_part"] == parts["_p"]).withColumn(name, F.col("_here") + F.col("_off"))
    return out.select(*[f"`{c}`" for c in df.columns], name)


def ntile_of(rn: Column | str, n: Column | str, k: int) -> Column:
    """``ntile(k)`` from a 1-based position and the group size: the first
    ``n mod k`` tiles hold one row more (the usual k-fold sizes)."""
    rn = F.col(rn) if isinstance(rn, str) else rn
    n = F.col(n) if isinstance(n, str) else n
    q = F.floor(n / F.lit(k))
    r = n - q * F.lit(k)
    big = r * (q + 1)
    return (
        F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1)
        .otherwise(r + F.floor((rn - big - 1) / q) + 1)
        .cast("int")
    )


def average_rank(df: DataFrame, group_cols: Sequence[str], value_col: str, tiebreak: Sequence[str],
                 name: str = "avg_rank") -> DataFrame:
    """Rank with ties given the mean of their positions (W4, the Spearman rank)."""
    ranked = group_row_number(df, group_cols, [value_col, *tiebreak], "_rn")
    ties = ranked.groupBy(*group_cols, value_col).agg(
        ((F.min("_rn") + F.max("_rn")) / F.lit(2.0)).alias(name)
    )
    return ranked.join(ties, [*group_cols, value_col]).drop("_rn")


def exact_percentiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: dict[str, float],
) -> DataFrame:
    """Exact linearly interpolated percentiles per group (same rule as
    ``percentile`` / ``quantile_cont``), with no group buffered in one task.

    Rows of a value are counted before the shuffle, so a value that most rows of a group
    have is one row.  Values are range-partitioned on (group, value); a value's places are its running count in
    its partition and the counts of the partitions before.  Only the
    values at the wanted places survive the filter: at most 2 x len(probs) rows per group.
    """
    group_cols = list(group_cols)
    names = [f"_g{i}" for i in range(len(group_cols))]
    counts = df.where(F.col(value_col).isNotNull()).groupBy(
        *[F.col(c).alias(k) for c, k in zip(group_cols, names)], F.col(value_col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    # fixed, as the partitions are read twice
    placed = reliable_checkpoint(counts.repartitionByRange(*names, "_v").withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy(*names).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*names, "_pid").agg(F.sum("_c").alias("_here"))
    parts = parts.select("*", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_off"), F.sum("_here").over(Window.partitionBy(*names)).alias("_n"))
    pos = {k: F.lit(1.0) + F.lit(float(p)) * (F.col("_n") - 1) for k, p in probs.items()}
    wanted = F.array(*[f(pos[k]) for k in probs for f in (F.floor, F.ceil)]).cast("array<long>")
    # only partitions of a group that hold a wanted place are read again
    parts = parts.where(F.exists(wanted, lambda w: (w > F.col("_off")) & (w <= F.col("_off") + F.col("_here"))))
    keys = [*names, "_pid"]
    parts = parts.drop("_here").withColumnsRenamed({k: f"{k}_" for k in keys})
    met = placed.join(parts, reduce(lambda x, y: x & y, [placed[k].eqNullSafe(parts[f"{k}_"]) for k in keys]))
    up_to = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_end", F.col("_off") + F.sum("_c").over(up_to))

    def holds(place: Column) -> Column:
        return (place > F.col("_end") - F.col("_c")) & (place <= F.col("_end"))

    near = met.where(F.exists(wanted, holds))
    aggs = [F.first("_n").alias("_n")]
    for k in probs:
        aggs.append(F.max(F.when(holds(F.floor(pos[k])), F.col("_v"))).alias(f"_lo_{k}"))
        aggs.append(F.max(F.when(holds(F.ceil(pos[k])), F.col("_v"))).alias(f"_hi_{k}"))
    agg = near.groupBy(*names).agg(*aggs)
    outs = []
    for k, p in probs.items():
        at = F.lit(1.0) + F.lit(float(p)) * (F.col("_n") - 1)
        frac = at - F.floor(at)
        outs.append((F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * frac).alias(k))
    return agg.select(*[F.col(k).alias(c) for c, k in zip(group_cols, names)], *outs)


def exact_median(df: DataFrame, group_cols: Sequence[str], value_col: str, name: str = "median") -> DataFrame:
    """Exact median per group for groups too large for one task (A1, whole-species)."""
    return exact_percentiles(df, group_cols, value_col, {name: 0.5})


def keep_repeated(df: DataFrame, key_cols: Sequence[str], min_count: int = 2) -> DataFrame:
    """Rows whose key occurs at least ``min_count`` times.

    A grouped count (partial aggregation, skew-safe) joined back, instead of
    ``count() over (partition by key)``.
    """
    counts = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_cnt")).where(F.col("_cnt") >= min_count)
    return df.join(counts.select(*key_cols), list(key_cols), "left_semi")


def first_per_key(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Keep the first row per key under ``order_cols`` (W2 ``keep='first'``, W8 arg-min).

    ``min_by`` over a struct is a partial aggregate: each task keeps one
    candidate per key, so a hot key costs no more than a cold one.
    """
    others = [c for c in df.columns if c not in key_cols]
    order_struct = F.struct(*[F.col(c) for c in order_cols])
    row_struct = F.struct(*[F.col(c) for c in others])
    best = df.groupBy(*key_cols).agg(F.min_by(row_struct, order_struct).alias("_best"))
    return best.select(*key_cols, *[F.col("_best")[c].alias(c) for c in others]).select(*df.columns)


def drop_position(df: DataFrame, order_cols: Sequence[str], position: int) -> DataFrame:
    """Drop the row at 1-based ``position`` under a total order (P13, R's ``x[-73, ]``).

    Meant for small aggregate tables (one row per species / genus); uses the
    distributed numbering so it stays valid on a large table too.
    """
    numbered = group_row_number(df.withColumn("_all", F.lit(1)), ["_all"], order_cols, "_pos")
    return numbered.where(F.col("_pos") != position).drop("_all", "_pos")


def nested_percentiles(df: DataFrame, group_cols: Sequence[str], level_col: str, value_col: str, probs: dict[str, float],
                       levels: int, buckets: int = 1024, few_rows: int = 4096) -> DataFrame:
    """Exact linearly interpolated percentiles for nested sets: ``(group..., level, <prob>...)``, where set ``level`` of a
    group has its rows with ``level_col >= level`` (0 .. levels - 1).

    Values are found by refinement: rows are counted by (group, level, bucket of the value's range), the buckets that
    hold a wanted rank of any set are kept, and their rows are counted again in the narrower range, until a
    bucket has one value or at most ``few_rows`` rows, which are sorted.  No group is buffered, rows are not copied for the sets, counts are combined
    before the shuffle, and every round reads only the rows of wanted buckets.  NULL and NaN are left out; values
    must be finite.
    """
    g = list(group_cols)
    names = [f"_g{i}" for i in range(len(g))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(g, names)], F.col(level_col).cast("int").alias("_level"), F.col(value_col).cast("double").alias("_v"))
    rows = reliable_checkpoint(rows.where((F.col("_level") >= 0) & F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_cell", F.lit(0).cast("long")))

    def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Null-safe join of `a` with the small table `b`."""
        from sporeframe.operators.joins import small_side

        renamed = b.withColumnsRenamed({k: f"{k}_" for k in keys})
        on = reduce(lambda p, q: p & q, [a[k].eqNullSafe(renamed[f"{k}_"]) for k in keys])
        return a.join(small_side(renamed), on).drop(*[f"{k}_" for k in keys])

    sets = rows.groupBy(*names, "_level").agg(F.count(F.lit(1)).alias("_c")).select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("_level"), F.lit(levels - 1)))).alias("_t"))
    sets = sets.groupBy(*names, "_t").agg(F.sum("_c").alias("_n"))
    at = {k: F.lit(float(p)) * (F.col("_n") - 1) for k, p in probs.items()}  # places from 0
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at.values()])))
    sizes = reliable_checkpoint(sets)
    wanted = (sizes.select(*names, "_t", F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_cell"), F.lit(0).cast("long").alias("_base")))
    bounds = reliable_checkpoint(rows.groupBy(*names, "_cell").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b")))
    cell = [*names, "_cell"]
    finds = []
    while True:
        # halves first, so the width of a range of any finite values is finite
        share = (F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)
        sub = F.when(F.col("_b") > F.col("_a"), F.least(F.floor(share * buckets), F.lit(buckets - 1))).otherwise(0).cast("long")
        placed = same(rows, bounds, cell).withColumn("_sub", sub).drop("_a", "_b")
        counts = reliable_checkpoint(placed.groupBy(*cell, "_sub", "_level").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        by_set = counts.withColumn("_all", F.sum("_c").over(Window.partitionBy(*cell, "_sub"))).select(
            "*", F.explode(F.sequence(F.lit(0), F.least(F.col("_level"), F.lit(levels - 1)))).alias("_t"))
        by_set = by_set.groupBy(*cell, "_sub", "_t").agg(F.sum("_c").alias("_c"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_all").alias("_all"))
        # a row for each bucket of a cell, at most `buckets`
        up_to = Window.partitionBy(*cell, "_t").orderBy("_sub").rowsBetween(Window.unboundedPreceding, 0)
        by_set = by_set.withColumn("_before", F.sum("_c").over(up_to) - F.col("_c"))
        renamed = by_set.withColumnsRenamed({k: f"{k}_" for k in [*cell, "_t"]})
        on = reduce(lambda p, q: p & q, [wanted[k].eqNullSafe(renamed[f"{k}_"]) for k in [*cell, "_t"]])
        hit = wanted.join(renamed, on).where((F.col("_rank") >= F.col("_base") + F.col("_before")) & (F.col("_rank") < F.col("_base") + F.col("_before") + F.col("_c")))
        hit = hit.select(*names, "_t", "_rank", "_cell", "_sub", (F.col("_base") + F.col("_before")).alias("_base"), "_lo", "_hi", "_all")
        hit = reliable_checkpoint(hit)
        finds.append(hit.where("_lo = _hi").select(*names, "_t", "_rank", F.col("_lo").alias("_v")))
        open_ = hit.where("_lo < _hi")
        # cells are numbered anew in each group: at most two a probability and set
        number = F.row_number().over(Window.partitionBy(*names).orderBy("_cell", "_sub")).cast("long")
        kept = reliable_checkpoint(open_.select(*cell, "_sub", "_all").distinct().withColumn("_new", number))
        few = kept.where(F.col("_all") <= few_rows).drop("_all")
        lists = same(placed, few, [*cell, "_sub"]).groupBy(*names, "_new").agg(F.sort_array(F.collect_list(F.struct("_v", "_level"))).alias("_list"))
        small = open_.where(F.col("_all") <= few_rows)
        small = same(small, few, [*cell, "_sub"]).select(*names, "_t", "_rank", "_base", "_new")
        lists = lists.withColumnsRenamed({k: f"{k}_" for k in [*names, "_new"]})
        on = reduce(lambda p, q: p & q, [small[k].eqNullSafe(lists[f"{k}_"]) for k in [*names, "_new"]])
        mine = F.filter("_list", lambda e: e["_level"] >= F.col("_t"))
        finds.append(small.join(lists, on).select(*names, "_t", "_rank", F.get(mine, F.col("_rank") - F.col("_base"))["_v"].alias("_v")))
        kept = kept.where(F.col("_all") > few_rows).drop("_all")
        if kept.isEmpty():
            break
        wanted = reliable_checkpoint(same(open_.where(F.col("_all") > few_rows), kept, [*cell, "_sub"]).select(*names, "_t", "_rank", F.col("_new").alias("_cell"), "_base"))
        rows = reliable_checkpoint(same(placed, kept, [*cell, "_sub"]).select(*names, "_level", "_v", F.col("_new").alias("_cell")))
        bounds = reliable_checkpoint(rows.groupBy(*cell).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b")))
    found = reduce(DataFrame.unionAll, finds)
    values = found.groupBy(*names, "_t").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))  # two entries a probability
    out = same(sizes, reliable_checkpoint(values), [*names, "_t"])
    outs = []
    for k, a in at.items():
        lo, hi = F.element_at("_m", F.floor(a)), F.element_at("_m", F.ceil(a))
        outs.append((lo + (hi - lo) * (a - F.floor(a))).alias(k))
    return out.select(*[F.col(k).alias(c) for c, k in zip(g, names)], F.col("_t").alias("level"), *outs)
