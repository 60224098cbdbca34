"""Repeatable splits and folds (M2, W6, W7, M9 weights).

Seeded permutations of the reference cannot be reproduced on a cluster;
ranks by ``md5(seed:key)`` can, on any partitioning and in the oracle, so
splits are ours and sizes are the reference's.  Positions come from the
skew-safe ``group_row_number``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.operators.ranking import group_row_number, ntile_of


def seeded_order(key: str | Column, seed: int = 42) -> Column:
    """``md5('<seed>:<key>')``: a repeatable pseudo-random order."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def _numbered(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """``df`` with ``_rn`` (1-based position of the row's key in its group) and ``_n`` (keys in the group).

    Only the distinct keys (group + order) are numbered and joined back null-safe, so wide rows are not
    range-shuffled, no row is lost or multiplied, and rows of one key (also a NULL one) share a position."""
    from sporeframe.operators.joins import small_side

    keys = [*group_cols, *order_cols]
    ranked = group_row_number(df.select(*keys).distinct(), group_cols, order_cols, "_rn", count_name="_n")
    pos = small_side(ranked.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_rn", "_n"))
    on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(pos[f"_k_{c}"]) for c in keys])
    return df.join(pos, on).drop(*[f"_k_{c}" for c in keys])


def holdout_split(df: DataFrame, group_cols: Sequence[str], key: str, test_size: float = 0.1, seed: int = 42,
                  n_folds: int | None = None) -> DataFrame:
    """M2 (+ W6): per group, the first ``ceil(test_size * n)`` keys in seeded
    order are test (``is_test``); with ``n_folds`` the remaining keys, in
    the same order, get contiguous folds 1..k (``fold``; 0 for test rows).
    Rows that share a key stay together, NULL keys too."""
    ranked = _numbered(df.withColumn("_ord", seeded_order(key, seed)), group_cols, ["_ord", key])
    n_test = F.ceil(F.lit(float(test_size)) * F.col("_n"))
    out = ranked.withColumn("is_test", F.col("_rn") <= n_test)
    if n_folds:
        out = out.withColumn(
            "fold",
            F.when(F.col("is_test"), F.lit(0)).otherwise(ntile_of(F.col("_rn") - n_test, F.col("_n") - n_test, n_folds)),
        )
    return out.drop("_ord", "_rn", "_n")


def kfold(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], n_folds: int,
          where: Column | None = None, name: str = "fold") -> DataFrame:
    """Contiguous k folds in ``order_cols`` order (KFold without
    shuffle), first ``n mod k`` folds one key larger.  Rows outside
    ``where`` get fold 0."""
    if where is None:
        return _numbered(df, group_cols, list(order_cols)).withColumn(name, ntile_of("_rn", "_n", n_folds)).drop("_rn", "_n")
    # one numbering over all rows, the in/out flag being part of the group
    flagged = df.withColumn("_in", F.coalesce(where, F.lit(False)))
    ranked = _numbered(flagged, [*group_cols, "_in"], list(order_cols))
    fold = F.when(F.col("_in"), ntile_of("_rn", "_n", n_folds)).otherwise(F.lit(0))
    return ranked.withColumn(name, fold).drop("_rn", "_n", "_in")


def deal_runs(runs: Sequence[tuple[int, int]], n_folds: int) -> list[list[tuple[int, list[int]]]]:
    """The greedy rule over runs of blocks of one size: ``(size, count)``, largest size first.

    For each run its segments ``(first, folds)``: from block ``first`` on (from 0), blocks go to ``folds`` in turn.
    A fold with load ``q * size + r`` takes its next block when the lightest folds have reached it, so folds join in
    the order of q, and inside a turn they go by (r, fold): at most ``n_folds`` segments a run, whatever its count.
    """
    loads, out = [0] * n_folds, []
    for size, count in runs:
        q, r = [x // size for x in loads], [x % size for x in loads]
        segments, at, level = [], 0, min(q)
        while at < count:
            active = sorted((f for f in range(n_folds) if q[f] <= level), key=lambda f: (r[f], f))
            joins = min((x for x in q if x > level), default=None)
            take = count - at if joins is None else min(count - at, (joins - level) * len(active))
            segments.append((at, [f + 1 for f in active]))
            turns, rest = divmod(take, len(active))
            for place, f in enumerate(active):
                loads[f] += size * (turns + (place < rest))
            at, level = at + take, joins
        out.append(segments)
    return out


def group_kfold(df: DataFrame, group_cols: Sequence[str], block: str, n_folds: int, name: str = "fold") -> DataFrame:
    """Folds 1..k that never split a block.  Blocks go, largest first
    (name breaks ties), to the fold that holds the fewest rows so far (the
    first of equal ones).

    The greedy rule is sequential, but blocks of equal size are dealt in closed form (``deal_runs``): one task a group sees a row
    for each distinct size, of which n rows have at most about sqrt(2 n); blocks are only numbered within their size."""
    keys = [*group_cols, block]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    numbered = group_row_number(sizes, [*group_cols, "_size"], [block], "_i", count_name="_count")
    runs = numbered.where("_i = 1").select(*group_cols, "_size", "_count")
    segment = T._parse_datatype_string("array<struct<first: long, folds: array<int>>>")
    schema = T.StructType([*[runs.schema[c] for c in group_cols], runs.schema["_size"], T.StructField("_segments", segment)])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_size", ascending=False)
        dealt = deal_runs(list(zip(pdf["_size"].tolist(), pdf["_count"].tolist())), n_folds)
        return pdf[[*group_cols, "_size"]].assign(_segments=[[{"first": a, "folds": f} for a, f in s] for s in dealt])

    dealt = runs.groupBy(*group_cols).applyInPandas(deal, schema).withColumnsRenamed({c: f"_g_{c}" for c in [*group_cols, "_size"]})
    on = reduce(lambda a, b: a & b, [numbered[c].eqNullSafe(dealt[f"_g_{c}"]) for c in [*group_cols, "_size"]])
    place = F.col("_i") - 1
    mine = F.element_at(F.filter("_segments", lambda s: s["first"] <= place), -1)
    fold = F.get(mine["folds"], F.pmod(place - mine["first"], F.size(mine["folds"])).cast("int"))
    assign = numbered.join(dealt, on).select(*[F.col(c).alias(f"_k_{c}") for c in keys], fold.alias(name))
    on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(assign[f"_k_{c}"]) for c in keys])
    return df.drop(name).join(assign, on).drop(*[f"_k_{c}" for c in keys])


def multinomial_draws(n: int, lo: int, hi: int, replicates: int, seed: int, group: str, leaf: int) -> np.ndarray:
    """How often each of the places ``lo..hi-1`` is drawn when ``n`` of the places ``0..n-1`` are, with replacement, by replicate:
    an array of (hi - lo, replicates).  ``lo`` and ``hi`` are the ends of one leaf of the tree of halves.

    The n draws run down a binary tree over the places: a part's draws split into its halves by a binomial
    whose generator is seeded by (seed, group, part), so every task that walks to a leaf draws the same numbers,
    and all leaves together have exactly n draws.
    """
    def generator(a: int, b: int) -> np.random.Generator:
        key = hashlib.blake2b(f"{seed}:{group}:{a}:{b}".encode(), digest_size=16).digest()
        return np.random.Generator(np.random.Philox(key=int.from_bytes(key, "little")))

    a, b, draws = 0, n, np.full(replicates, n, dtype=np.int64)
    while b - a > leaf:
        mid = (a + b) // 2
        left = generator(a, b).binomial(draws, (mid - a) / (b - a))
        a, b, draws = (a, mid, left) if lo < mid else (mid, b, draws - left)
    if (a, b) != (lo, hi):
        raise ValueError(f"{lo}..{hi} is not a leaf")
    rng = generator(a, b)
    return np.column_stack([np.bincount(rng.integers(0, b - a, k), minlength=b - a) for k in draws.tolist()])


def bootstrap_weights(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], replicates: int, seed: int = 42,
                      name: str = "weights", leaf: int = 1024) -> DataFrame:
    """M9: ``df`` with ``ARRAY<DOUBLE>``: how often each replicate draws the row when it draws, from the group's n
    distinct keys (group + order), n with replacement.  Rows of one key share their draws.

    Only narrow rows are numbered; the draws are made by the leaves of a tree of halves (``multinomial_draws``), one task row
    a leaf, and joined by place: no draw is a row of its own, and a lost task draws the same again.
    """
    keys = [*group_cols, *order_cols]
    ranked = group_row_number(df.select(*keys).distinct(), group_cols, order_cols, "_rn", count_name="_n")
    # a group of n places has at most 2 n / leaf leaves: a row for each stretch of them, cut by the task that walks it
    sizes = ranked.groupBy(*group_cols).agg(F.max("_n").alias("_n"))
    stretch = 64 * leaf
    parts = sizes.select(*group_cols, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / stretch))).alias("_part"))
    schema = T.StructType([sizes.schema[c] for c in group_cols] + [T.StructField("_rn", T.LongType()), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                group = "\x1f".join(repr(row[c]) for c in group_cols)
                n, first = int(row["_n"]), int(row["_part"]) * stretch
                for lo, hi in leaves_from(n, leaf, first, min(n, first + stretch)):
                    w = multinomial_draws(n, lo, hi, replicates, seed, group, leaf).astype(np.float64)
                    yield pd.DataFrame({**{c: [row[c]] * (hi - lo) for c in group_cols}, "_rn": np.arange(lo, hi) + 1, name: list(w)})

    parts = parts.repartition(*group_cols, "_part")
    drawn = parts.mapInPandas(draw, schema)
    drawn = drawn.withColumnsRenamed({c: f"_k_{c}" for c in group_cols}).withColumnRenamed("_rn", "_k_rn")
    on = reduce(lambda a, b: a & b, [ranked[c].eqNullSafe(drawn[f"_k_{c}"]) for c in group_cols], ranked["_rn"] == drawn["_k_rn"])
    placed = ranked.join(drawn, on).select(*[F.col(c).alias(f"_k_{c}") for c in keys], name)
    on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(placed[f"_k_{c}"]) for c in keys])
    return df.join(placed, on).drop(*[f"_k_{c}" for c in keys])


def leaves_from(n: int, leaf: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The leaves that begin in ``lo..hi-1``, by walking down to them only."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if b <= lo or a >= hi:
            continue
        if b - a <= leaf:
            if a >= lo:
                yield a, b
        else:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
