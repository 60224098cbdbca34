"""Operator 3, sharding by balanced label propagation (DataFrame and SQL functions only).

Documents with equal texts are linked.  Each starts in the shard its id's hash
names.  In every round a group's members look for the shard that holds most of
them; those elsewhere ask to move there, and as many go as the shard's quota of
linked documents allows (its free capacity plus what leaves it), picked by a hash
of the row, so a group larger than a shard fills it and the rest goes on to the next.  At the end the shards
are made exactly even: the rows beyond a shard's share, those without links and then the
smallest groups, move to the shards that lack rows.

Only narrow rows (id, size, checksums) are shuffled; votes are combined before
the shuffle, so a group of any size costs one row per task and shard, and the
driver sees one number per shard.  Positions come from a range shuffle over
(shard, group, row), so neither a shard nor a group lands in one task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sporeframe.llm.common import materialise, text_key
from sporeframe.operators.ranking import group_row_number

SHARDS, ROUNDS, OVERFULL = 8, 6, 1.5


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def _uniform(row: Column, salt: int) -> Column:
    """A number in 0..1 that a row's number and the round decide."""
    return F.shiftrightunsigned(F.xxhash64(row, F.lit(salt)), 11) / F.lit(float(1 << 53))


def _loads(df: DataFrame, n: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy("shard").count().collect()}  # one row per shard
    return [found.get(s, 0) for s in range(n)]


def propagate(nodes: DataFrame, n_shards: int, rounds: int, capacity: float) -> DataFrame:
    """Moves linked nodes ``(row, k1, k2, shard, ...)`` towards their group's main shard under quotas.

    A shard's quota is `capacity` linked nodes, more than its share at the end,
    when nodes without links and then the smallest groups give way.  A full
    shard takes no more; the rest of its groups gathers in the next best one.
    """
    for turn in range(rounds):
        load = _loads(nodes, n_shards)
        room = [s for s in range(n_shards) if load[s] < 0.99 * capacity]
        votes = nodes.groupBy("k1", "k2", "shard").agg(F.count(F.lit(1)).alias("n"))
        # ties go to the shard that the group's own hash prefers, so that they don't all pull one way
        order = F.struct("n", F.pmod(F.xxhash64("k1", "shard"), F.lit(1 << 20)).alias("tie"), "shard")
        best = votes.where(F.col("shard").isin(room)).groupBy("k1", "k2").agg(F.max(order).alias("best"))
        wishes = votes.join(best, ["k1", "k2"]).where((F.col("shard") != F.col("best.shard")) & (F.col("n") <= F.col("best.n")))
        wishes = materialise(wishes.select("k1", "k2", "shard", "n", F.col("best.shard").alias("to")), "shard-wishes")
        flows = {(r[0], r[1]): r[2] for r in wishes.groupBy("shard", "to").agg(F.sum("n")).collect()}  # a row per two shards
        if not flows:
            break
        asked = [sum(n for (_, to), n in flows.items() if to == s) for s in range(n_shards)]
        leaving = [sum(n for (at, _), n in flows.items() if at == s) for s in range(n_shards)]
        share = [1.0] * n_shards
        for _ in range(20):  # what leaves a shard depends on the quotas of others: iterate to the fixed point
            goes = sum(asked[s] * share[s] for s in range(n_shards)) / sum(asked)
            share = [min(1.0, max(0.0, capacity - load[s] + leaving[s] * goes) / max(1, asked[s])) for s in range(n_shards)]
        moved = nodes.join(wishes.drop("n"), ["k1", "k2", "shard"], "left")
        goes = F.col("to").isNotNull() & (_uniform(F.col("row"), turn) < _pick(share, F.col("to")))
        nodes = materialise(moved.withColumn("shard", F.when(goes, F.col("to")).otherwise(F.col("shard"))).drop("to"), "shard-round")
    return nodes


def shard_documents(
    docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """``(id, size, text_crc32, k1, k2, shard, slot)`` of every row; shard sizes are at most one row apart.

    ``size`` is the text's UTF-8 bytes plus one, ``slot`` the row's place in its
    shard (0 to the shard's rows less one), ``(k1, k2)`` names the group of equal texts.

    Defined cases: a null text counts as empty; null ids and equal rows are
    rows like any other; fewer rows than shards leave shards empty; an empty
    table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    nodes = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *text_key(F.col(text_col))
    )
    nodes = nodes.withColumn("row", F.monotonically_increasing_id())
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("id").cast("string"), "k1"), F.lit(n_shards)).cast("int"))
    nodes = materialise(nodes, "shard-nodes")
    total = nodes.count()
    # written out, so that both sides of the joins below are exchanges, of which Spark can split a hot group
    groups = materialise(nodes.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("members")).where("members > 1").drop("members"), "shard-groups")
    linked = materialise(nodes.join(groups, ["k1", "k2"], "left_semi"), "shard-linked")
    nodes = nodes.join(groups, ["k1", "k2"], "left_anti").unionByName(propagate(linked, n_shards, rounds, OVERFULL * total / n_shards))
    nodes = materialise(nodes, "shard-labels")

    # the smallest families of a shard give way first, each as a whole while it can
    here = materialise(nodes.groupBy("k1", "k2", "shard").agg((-F.count(F.lit(1))).alias("family")), "shard-families")
    ranked = group_row_number(nodes.join(here, ["k1", "k2", "shard"]), ["shard"], ["family", "k1", "k2", "row"], "place")
    load = _loads(nodes, n_shards)
    larger = sorted(range(n_shards), key=lambda s: (-load[s], s))[: total % n_shards]
    quota = [total // n_shards + (s in larger) for s in range(n_shards)]
    kept = [min(a, b) for a, b in zip(load, quota)]
    surplus = [0, *accumulate(a - b for a, b in zip(load, kept))]
    lack = [0, *accumulate(a - b for a, b in zip(quota, kept))]

    place, shard = F.col("place") - 1, F.col("shard")
    over = place - _pick(quota, shard) + _pick(surplus[:-1], shard)
    to = F.lit(n_shards - 1)
    for s in reversed(range(n_shards - 1)):
        to = F.when(over < lack[s + 1], s).otherwise(to)
    stays = place < _pick(quota, shard)
    placed = ranked.select("id", "size", "text_crc32", "k1", "k2", "shard", stays.alias("stays"), place.alias("place"), over.alias("over"), to.alias("to"))
    return placed.select(
        "id", "size", "text_crc32", "k1", "k2",
        F.when(F.col("stays"), shard).otherwise(F.col("to")).cast("int").alias("shard"),
        F.when(F.col("stays"), F.col("place")).otherwise(_pick(kept, F.col("to")) + F.col("over") - _pick(lack[:-1], F.col("to"))).cast("long").alias("slot"),
    )
