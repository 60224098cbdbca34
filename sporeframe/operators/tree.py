"""Taxonomy tree jobs over a parent-child edge table.

The reference asks a local taxonomy database for the topology of a taxon
list; here the taxonomy is an edge DataFrame ``(child, parent)`` and every
step is a join / aggregate.  Ancestors, new parents and depths come from
pointer doubling: jumps of 1, 2, 4, ... levels, so the number of rounds is the
logarithm of the depth and there is no limit on depth or width.  The text of a
tree (T3) is a table of ordered rows, placed by an Euler tour.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeframe.operators.ranking import running_total
from sporeframe.session import reliable_checkpoint

MAX_ROUNDS = 40  # 2^40 levels: more can only be a cycle


def _pointers(edges: DataFrame) -> DataFrame:
    """``(node, up)`` of every node with a parent."""
    up = edges.where(F.col("parent").isNotNull()).select(
        F.col("child").cast("string").alias("node"), F.col("parent").cast("string").alias("up"))
    return reliable_checkpoint(up.distinct())


def _rounds():
    yield from range(MAX_ROUNDS)
    raise ValueError("the parent-child table has a cycle")


def with_ancestors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``: the given nodes and all their ancestors, each once."""
    up = _pointers(edges)
    seen = nodes.select(F.col("node").cast("string").alias("node")).distinct()
    for _ in _rounds():
        seen = reliable_checkpoint(seen.union(seen.join(up, "node").select("up")).distinct())
        far = up.join(up.toDF("via", "far"), F.col("up") == F.col("via")).select("node", F.col("far").alias("up"))
        up = reliable_checkpoint(far)
        if up.isEmpty():
            return seen


def node_depths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, depth)``: levels from each node to its root (0 for a root)."""
    up = _pointers(edges)
    state = nodes.select(F.col("node").cast("string").alias("node")).distinct().join(up, "node", "left").select(
        "node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"))
    for _ in _rounds():
        state = reliable_checkpoint(state)
        if state.where("up IS NOT NULL").isEmpty():
            return state.select("node", "depth")
        via = state.toDF("via", "far", "more")
        state = state.join(via, F.col("up") == F.col("via"), "left").select(
            "node", F.col("far").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def nearest_kept(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """``(node, parent)``: each kept node's nearest proper ancestor among the kept ones, NULL if it has none."""
    flag = kept.select(F.col("node").alias("_kept"), F.lit(True).alias("_is"))
    up = _pointers(edges)
    nodes = up.select("node").union(up.select("up")).union(kept.select("node")).distinct()
    state = nodes.join(up, "node", "left").join(flag, F.col("up") == F.col("_kept"), "left").select(
        "node", "up", (F.col("up").isNull() | F.col("_is").isNotNull()).alias("done"))
    for _ in _rounds():
        state = reliable_checkpoint(state)
        if state.where("NOT done").isEmpty():
            return kept.select("node").join(state, "node").select("node", F.col("up").alias("parent"))
        via = state.toDF("via", "far", "ends")
        state = state.join(via, F.col("up") == F.col("via"), "left").select(
            "node", F.when(F.col("done"), F.col("up")).otherwise(F.col("far")).alias("up"),
            (F.col("done") | F.coalesce("ends", F.lit(True))).alias("done"))


def induced_subtree(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Topology of the chosen ids - all their ancestors, then every
    non-chosen node with a single child removed (its child moves up), and the
    chain above the lowest common ancestor dropped.  Returns ``(child,
    parent)`` edges of the kept nodes; the root has parent NULL."""
    chosen = chosen.select(F.col("node").cast("string").alias("node")).distinct()
    members = with_ancestors(edges, chosen)
    # children of each member inside the induced tree
    e = edges.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"))
    e = e.join(members.withColumnRenamed("node", "child"), "child").join(members.withColumnRenamed("node", "parent"), "parent")
    fan = e.groupBy("parent").agg(F.countDistinct("child").alias("_kids"))
    kept = (members.join(fan.withColumnRenamed("parent", "node"), "node", "left")
            .join(chosen.withColumn("_chosen", F.lit(True)), "node", "left")
            .where(F.col("_chosen").isNotNull() | (F.coalesce("_kids", F.lit(0)) >= 2))
            .select("node"))
    # the topology (one row per kept node) is read by every later step
    return reliable_checkpoint(nearest_kept(e, kept).select(F.col("node").alias("child"), "parent"))


def name_nodes(tree: DataFrame, names: DataFrame) -> DataFrame:
    """Attach ``name`` to each node of ``(child, parent)`` edges."""
    n = names.select(F.col("node").alias("child"), F.col("name"))
    return tree.join(n, "child", "left")


def subtree_totals(tree: DataFrame, value: str) -> DataFrame:
    """``(child, parent, total)``: sum of ``value`` over each node's subtree.

    By doubling: after round k a node holds the sum of the nodes less than 2^k levels below; each node
    2^k levels below then adds its own.  Rounds are the logarithm of the depth, rows never multiply, and a hot
    parent's children are summed before the shuffle."""
    own = reliable_checkpoint(tree.select("child", "parent", F.col(value).cast("long").alias("total")))
    live = own.where("parent IS NOT NULL").select("child", F.col("parent").alias("up"), "total")
    log = []
    for _ in _rounds():
        live = reliable_checkpoint(live)
        if live.isEmpty():
            break
        more = reliable_checkpoint(live.groupBy(F.col("up").alias("_to")).agg(F.sum("total").alias("_more")))
        log.append(more)
        # only nodes with an ancestor that far up go on: each round has those of twice the depth
        via = live.select(F.col("child").alias("_via"), F.col("up").alias("_far"))
        live = live.join(via, F.col("up") == F.col("_via")).join(more, F.col("child") == F.col("_to"), "left").select(
            "child", F.col("_far").alias("up"), (F.col("total") + F.coalesce("_more", F.lit(0))).alias("total"))
    if not log:
        return own
    added = reduce(DataFrame.unionAll, log).groupBy("_to").agg(F.sum("_more").alias("_more"))
    return own.join(added, F.col("child") == F.col("_to"), "left").select("child", "parent", (F.col("total") + F.coalesce("_more", F.lit(0))).alias("total"))


def path_totals(tree: DataFrame, value: str) -> DataFrame:
    """``(child, total)``: sum of ``value`` over each node and all its ancestors, by pointer doubling."""
    state = tree.select("child", F.col("parent").alias("up"), F.col(value).cast("long").alias("total"))
    for _ in _rounds():
        state = reliable_checkpoint(state)
        if state.where("up IS NOT NULL").isEmpty():
            return state.select("child", "total")
        via = state.select(F.col("child").alias("_via"), F.col("up").alias("_far"), F.col("total").alias("_more"))
        on = state.where("up IS NOT NULL").join(via, F.col("up") == F.col("_via"), "left")
        state = state.where("up IS NULL").unionAll(on.select("child", F.col("_far").alias("up"), (F.col("total") + F.coalesce("_more", F.lit(0))).alias("total")))


def newick_rows(tree: DataFrame, branch_length: str | None = "1") -> DataFrame:
    """The Newick text of a named tree ``(child, parent, name)`` as ordered rows ``(place, text)``.

    The texts in the order of ``place`` (0, 1, 2, ...) are the tree: ``(`` for each inner node, then its
    children, then ``)`` and its name; a leaf is its name; commas come before all children but the first.
    Children go by name, then id.  A root ends with ``;``; several roots follow one another.  ``branch_length``
    is written after every non-root node (the usual default length is 1); a node without a name shows its id,
    and brackets, commas, colons and semicolons in names become ``_``.

    A node's place is its place in the Euler tour: the steps from the root down to it, each 1 + the rows of the earlier
    siblings' subtrees.  Subtree sizes and path sums come from doubling, sibling sums from one running total, so
    no row holds more than one node's text and any depth, width and size will do.
    """
    label = F.regexp_replace(F.coalesce(F.col("name"), F.col("child").cast("string")), "[(),:;]", "_")
    t = reliable_checkpoint(tree.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"), label.alias("label")))
    inner = t.where("parent IS NOT NULL").select(F.col("parent").alias("_inner")).distinct()
    t = t.join(inner, F.col("child") == F.col("_inner"), "left").withColumn("rows", F.when(F.col("_inner").isNull(), 1).otherwise(2).cast("long")).drop("_inner")
    t = reliable_checkpoint(t)
    sized = t.drop("parent").join(subtree_totals(t, "rows"), "child")
    laid = reliable_checkpoint(running_total(sized, ["parent", "label", "child"], "total"))
    first = laid.groupBy("parent").agg(F.min("before").alias("_first")).withColumnRenamed("parent", "_parent")
    laid = laid.join(reliable_checkpoint(first), F.col("parent").eqNullSafe(F.col("_parent"))).withColumn("earlier", F.col("before") - F.col("_first"))
    laid = reliable_checkpoint(laid.withColumn("step", F.col("earlier") + F.when(F.col("parent").isNull(), 0).otherwise(1)))
    placed = laid.join(path_totals(laid, "step").toDF("_node", "place"), F.col("child") == F.col("_node"))
    root = F.col("parent").isNull()
    comma = F.when(root | (F.col("earlier") == 0), F.lit("")).otherwise(F.lit(","))
    end = F.when(root, F.lit(";")).otherwise(F.lit(f":{branch_length}" if branch_length else ""))
    leaf = F.array(F.struct(F.col("place"), F.concat(comma, "label", end).alias("text")))
    both = F.array(F.struct(F.col("place"), F.concat(comma, F.lit("(")).alias("text")),
                   F.struct((F.col("place") + F.col("total") - 1).alias("place"), F.concat(F.lit(")"), "label", end).alias("text")))
    return placed.select(F.explode(F.when(F.col("rows") == 1, leaf).otherwise(both)).alias("_r")).select("_r.place", "_r.text")


def write_newick(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``newick_rows`` as text files in order; each row is a line, and the files one after another are the tree
    (white space between the parts of a Newick text has no meaning)."""
    ordered = rows.repartitionByRange("place").sortWithinPartitions("place")
    ordered.select(F.col("text").alias("value")).write.mode(mode).text(path)


def newick(tree: DataFrame, branch_length: str | None = "1", most_rows: int = 1_000_000) -> DataFrame:
    """A small tree's ``newick_rows`` as one row and string; a tree of more than ``most_rows`` rows is an error."""
    rows = reliable_checkpoint(newick_rows(tree, branch_length))
    if rows.count() > most_rows:
        raise ValueError("the tree is too large for one row: use newick_rows")
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda r: r["text"]), "").alias("newick"))
