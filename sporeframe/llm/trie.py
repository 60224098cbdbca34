"""Operator 12, conversation prefix trie: subtree sums by centroid decomposition.

A node is a distinct sequence of a conversation's first turns; it is named by
its depth and its smallest member, which no other node shares.

1. `number_turns` hashes each turn and numbers it within its conversation; one
   range shuffle carries the texts, later steps only their hashes.
2. `prefix_rows` adds the hash of the turns up to each one: a polynomial modulo
   the prime 2^61 - 1 (two random bases), so that sums of a conversation's parts
   can be added up and a very long conversation may lie in many partitions.
3. `trie` groups equal prefixes to nodes and finds their parents.
4. `rollup` sums values over subtrees by centroid decomposition of the
   parent-edge forest.  A component is a connected part of the forest with one
   top node.  Its centroid is the deepest node that still has half of the
   component's weight below it; the total below it is added to every node
   on the path from it up to the top, then the component falls apart into
   the parts below the centroid's children and the part above.  Each has at most
   half the weight, so the depth of the recursion is the logarithm of the weight,
   for chains and stars alike.  Components of more than `component_rows`
   are split by joins; smaller ones go to tasks whole, and numpy splits all
   components of a task at once.

The weight of a node is the number of turn rows at and below it, which the
grouping of step 3 counts; a component never has more nodes than that.  Whether
a node lies below a centroid is looked up: the node's smallest member passes
through the centroid or doesn't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sporeframe.llm.common import PRIME, fold61, materialise, reduce61, span_hash, times61

COMPONENT_ROWS = 1 << 16
CHUNK_BYTES = 1 << 20
_SEEDS = 121, 122
_LONG = pa.int64()


# ---------------------------------------------------------------------------
# turns and prefixes
# ---------------------------------------------------------------------------

def _starts(ids: pa.Array, before: object) -> np.ndarray:
    """Which rows have another id than the row before them (`before`: the id of the last row seen)."""
    new = np.ones(len(ids), dtype=bool)
    if len(ids) > 1:
        new[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
    new[0] = before is None or ids[0].as_py() != before
    return new


def _turn_codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes and length of every turn, and its place among its conversation's turns in this partition."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        new = _starts(ids, last)
        row = np.arange(len(ids))
        begin = np.maximum.accumulate(np.where(new, row, -1))
        place = np.where(begin < 0, row + count, row - begin)
        last, count = ids[-1].as_py(), int(place[-1]) + 1
        codes = []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            role = role.encode()
            codes.append(hashlib.sha256(len(role).to_bytes(8, "big") + role + text.encode()).digest()[:16])
        codes = reduce61(np.frombuffer(b"".join(codes), dtype="<u8").reshape(-1, 2))
        yield pa.RecordBatch.from_arrays([
            ids, pa.array([part] * len(ids), pa.int32()), pa.array(place, _LONG), pa.array(codes[:, 0].astype(np.int64)), pa.array(codes[:, 1].astype(np.int64)),
            pc.utf8_length(batch.column("text")).cast(_LONG),
        ], names=["conv_id", "part", "place", "k1", "k2", "chars"])


def _id_type(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def number_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tie_chars: int = 64
) -> DataFrame:
    """``(conv_id, i, n, k1, k2, chars)`` of every turn: its place from 0 in its conversation of `n` turns, two
    hashes of role and text, and the text's code points.

    Turns go by number, null first, then by role and text; repeated rows are turns of their own.  Rows without a
    conversation id belong to no conversation and are left out.  One range shuffle by conversation, number and the
    first `tie_chars` characters spreads a conversation of any length over tasks; rows that agree in all of these
    stay in one.
    """
    empty = F.lit("")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text"))
    order = ["conv_id", "turn", F.substring("role", 1, tie_chars), F.substring("text", 1, tie_chars)]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {_id_type(rows)}, part int, place long, k1 long, k2 long, chars long"
    found = materialise(ordered.select("conv_id", "role", "text").mapInArrow(_turn_codes, schema), "trie-turns")
    parts = found.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("here"))
    whole = Window.partitionBy("conv_id")
    parts = parts.select(
        "conv_id", "part", F.sum("here").over(whole).alias("n"),
        (F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("before"))
    parts = materialise(parts, "trie-parts")  # a row a conversation; a hot one's turns meet it in a join that Spark can split
    return found.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("before")).alias("i"), "n", "k1", "k2", "chars")


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    out = np.ones(len(exponent), dtype=np.uint64)
    for bit in range(int(exponent.max(initial=0)).bit_length()):
        odd = exponent >> bit & 1 == 1
        out[odd] = times61(out[odd], np.uint64(pow(base, 1 << bit, PRIME)))
    return out


def _segment_sums(terms: np.ndarray, new: np.ndarray, carried: int) -> np.ndarray:
    """Running sums modulo `PRIME` that start anew where `new` is set; the first segment goes on from `carried`."""
    low, high = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (terms & np.uint64(0x7FFFFFFF), terms >> np.uint64(31)))
    at = np.maximum.accumulate(np.where(new, np.arange(len(terms)), 0))
    low, high = low[1:] - low[at], high[1:] - high[at]
    sums = fold61(fold61(times61(fold61(high), np.uint64(1 << 31))) + fold61(low))
    open_ = np.cumsum(new) == 0
    sums[open_] = fold61(sums[open_] + np.uint64(carried))
    return reduce61(sums)


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, carried = TaskContext.get().partitionId(), None, [0, 0]
    bases = [span_hash(s).base for s in _SEEDS]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, depth = batch.column("conv_id"), batch.column("depth").to_numpy()
        new = _starts(ids, last)
        out = {}
        for k, base in enumerate(bases):
            terms = reduce61(times61(batch.column(f"k{k + 1}").to_numpy().astype(np.uint64), _power(base, depth)))
            sums = _segment_sums(terms, new, carried[k])
            carried[k] = int(sums[-1])
            out[f"h{k + 1}"], out[f"p{k + 1}"] = sums, reduce61(sums + np.uint64(PRIME) - terms)
        last = ids[-1].as_py()
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([part] * len(ids), pa.int32()), batch.column("depth"), batch.column("last"), batch.column("chars")]
            + [pa.array(out[c].astype(np.int64)) for c in ("h1", "h2", "p1", "p2")],
            names=["conv_id", "part", "depth", "last", "chars", "h1", "h2", "p1", "p2"])


def prefix_rows(rows: DataFrame) -> DataFrame:
    """``(conv_id, depth, last, chars, h1, h2, p1, p2)``: hash of the first `depth` turns, and of those but the last.

    `rows`: ``(conv_id, depth, last, k1, k2, chars)``, a row for every depth from 0 (no turn: k1, k2 and chars 0)
    to ``last``, the conversation's number of turns.
    """
    ordered = rows.select("conv_id", "depth", "last", "k1", "k2", "chars").repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    schema = f"conv_id {_id_type(rows)}, part int, depth long, last long, chars long, h1 long, h2 long, p1 long, p2 long"
    found = materialise(ordered.mapInArrow(_prefixes, schema), "trie-prefixes")
    # conversations that lie in several partitions: what the earlier ones sum up to
    parts = found.groupBy("conv_id", "part").agg(F.max_by(F.struct("h1", "h2"), "depth").alias("h"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [(F.sum(F.col(f"h.{h}").cast("decimal(38,0)")).over(before) % F.lit(PRIME)).cast("long").alias(f"b_{h}") for h in ("h1", "h2")]
    parts = materialise(parts.select("conv_id", "part", *sums).where("b_h1 is not null"), "trie-parts")  # at most a row a partition
    joined = found.join(parts, ["conv_id", "part"], "left")
    whole = [((F.col(c) + F.coalesce(F.col(f"b_h{c[1]}"), F.lit(0))) % F.lit(PRIME)).alias(c) for c in ("h1", "h2", "p1", "p2")]
    return joined.select("conv_id", "depth", "last", "chars", *whole)


# ---------------------------------------------------------------------------
# nodes
# ---------------------------------------------------------------------------

def trie(rows: DataFrame, component_rows: int = COMPONENT_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All nodes of the trie of `rows` (see `prefix_rows`): ``(conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256)``, where ``conv_id`` is the smallest member and ``ends_sha256`` the digest
    of the comma-joined ids, in order, of the members that end at the node.

    No conversation: no node, not even a root.
    """
    found = materialise(prefix_rows(rows), "trie-rows")
    left = F.col("last") - F.col("depth") + 1
    nodes = found.groupBy("depth", "h1", "h2").agg(
        F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.sum(left).alias("weight"), F.first("chars").alias("chars"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    nodes = materialise(nodes, "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("node").alias("parent"))
    nodes = materialise(nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "trie-edges")
    named = nodes.select("depth", "h1", "h2", "node", "parent")
    passes = materialise(found.select("conv_id", "depth", "last", "h1", "h2").join(named, ["depth", "h1", "h2"]).drop("h1", "h2"), "trie-passes")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    forest = nodes.join(children, ["depth", "node"], "left").select(
        "node", "depth", "parent", "weight", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    summed = rollup(forest, passes, component_rows)
    ends = ends_digest(passes.where(F.col("depth") == F.col("last")).select("node", "depth", "conv_id"), chunk_bytes)
    return summed.join(ends, ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **options) -> DataFrame:
    """`trie` of a table of turns as it is.

    Defined cases: null roles and texts are empty; turns go by number (null first), role and text; repeated rows are
    turns of their own; rows without a conversation id are left out; an empty table gives no nodes; other columns are not read.
    """
    return trie(depth_rows(number_turns(conversations, conv_col, turn_col, role_col, text_col)), **options)


def depth_rows(turns: DataFrame) -> DataFrame:
    """Numbered turns as rows by depth, with the row of depth 0."""
    zero = F.lit(0).cast("long")
    roots = turns.where("i = 0").select("conv_id", zero.alias("depth"), F.col("n").alias("last"), *[zero.alias(c) for c in ("k1", "k2", "chars")])
    return turns.select("conv_id", (F.col("i") + 1).alias("depth"), F.col("n").alias("last"), "k1", "k2", "chars").unionAll(roots)


# ---------------------------------------------------------------------------
# centroid decomposition
# ---------------------------------------------------------------------------

_STATE = ["top", "top_depth", "node", "depth", "parent", "n_convs", "n_children", "weight", "leaves", "saved", "more_leaves", "more_saved"]


def rollup(forest: DataFrame, passes: DataFrame, component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """`forest` with ``leaves`` and ``saved`` summed over each node's subtree.

    `forest`: ``(node, depth, parent, n_convs, n_children, weight, leaves, saved)``, one tree, with the weight of whole subtrees;
    `passes`: ``(conv_id, depth, node, parent)``, the node that each conversation passes at each depth.
    """
    zero = F.lit(0).cast("long")
    root = forest.where("depth = 0").select("node").first()
    if root is None:
        return forest.drop("weight")
    top = F.lit(root[0]).cast(forest.schema["node"].dataType)
    live = forest.withColumns({"top": top, "top_depth": zero, "more_leaves": zero, "more_saved": zero})
    live = materialise(live.select(*_STATE), "trie-live")
    done, small = [], []
    while True:
        is_top = (F.col("node") == F.col("top")) & (F.col("depth") == F.col("top_depth"))
        large = materialise(live.where(is_top & (F.col("weight") > component_rows)).select("top", "top_depth", F.col("weight").alias("total")), "trie-large")
        if large.isEmpty():
            small.append(live)
            break
        small.append(live.join(large, ["top", "top_depth"], "left_anti").select(*_STATE))
        finished, live = _split(live.join(large, ["top", "top_depth"]), passes)
        done.append(finished)
    for df in small[1:]:
        small[0] = small[0].unionAll(df)
    out = _finish(small[0])
    for df in done:
        out = out.unionAll(df)
    return out


def _split(live: DataFrame, passes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes the centroid out of every component: its finished row, and the nodes left, in smaller components."""
    comp = ["top", "top_depth"]
    heavy = live.where(F.col("weight") * 2 >= F.col("total"))
    centroids = heavy.groupBy(*comp).agg(F.max_by(F.struct("node", "depth", "weight"), "depth").alias("c"))
    centroids = materialise(centroids.select(*comp, F.col("c.node").alias("c_node"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "trie-centroids")
    marked = live.join(centroids, comp)
    # the child of the centroid that a deeper node's smallest member passes, if it passes the centroid
    step = passes.select(F.col("conv_id").alias("node"), F.col("depth").alias("child_depth"), F.col("node").alias("child"), F.col("parent").alias("over"))
    marked = marked.withColumn("child_depth", F.when(F.col("depth") > F.col("c_depth"), F.col("c_depth") + 1))
    marked = marked.join(step, ["node", "child_depth"], "left").withColumns({
        "is_c": (F.col("node") == F.col("c_node")) & (F.col("depth") == F.col("c_depth")),
        "under": F.coalesce(F.col("over") == F.col("c_node"), F.lit(False))})
    marked = materialise(marked.select(*_STATE, "c_node", "c_depth", "c_weight", "child", "is_c", "under"), "trie-marked")
    totals = marked.where("is_c or under").groupBy("c_node", "c_depth").agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))
    totals = materialise(centroids.join(totals, ["c_node", "c_depth"]), "trie-totals")
    # nodes from the centroid's parent up to the top, which the centroid's smallest member passes
    way = passes.select(F.col("conv_id").alias("c_node"), "depth", "node")
    path = way.join(totals, "c_node").where((F.col("depth") >= F.col("top_depth")) & (F.col("depth") < F.col("c_depth")))
    path = path.select("node", "depth", F.col("c_weight").alias("less"), F.col("t_leaves").alias("a_leaves"), F.col("t_saved").alias("a_saved"))
    own = totals.select("c_node", "c_depth", "t_leaves", "t_saved")
    finished = marked.where("is_c").join(own, ["c_node", "c_depth"]).select(
        "node", "depth", "parent", "n_convs", "n_children", (F.col("t_leaves") + F.col("more_leaves")).alias("leaves"), (F.col("t_saved") + F.col("more_saved")).alias("saved"))

    def plus(c: str, a: str, sign: int = 1):
        return (F.col(c) + sign * F.coalesce(F.col(a), F.lit(0))).alias(c)

    left = marked.where("not is_c").join(path, ["node", "depth"], "left").select(
        F.when(F.col("under"), F.col("child")).otherwise(F.col("top")).alias("top"), F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        "node", "depth", "parent", "n_convs", "n_children", plus("weight", "less", -1), "leaves", "saved", plus("more_leaves", "a_leaves"), plus("more_saved", "a_saved"))
    return materialise(finished, "trie-finished"), materialise(left, "trie-live")


def split_all(parent: np.ndarray, weight: np.ndarray, values: list[np.ndarray], more: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree sums of `values` plus `more`, for whole components one after another, each by depth.

    `parent` is a row's number (-1: the row is a top), `weight` as in `rollup`; the same steps as `_split`, for all components at once.
    """
    n = len(parent)
    size, at = [1] * n, [0] * n
    up = parent.tolist()
    for i in range(n - 1, -1, -1):
        if up[i] >= 0:
            size[up[i]] += size[i]
    free, nexts = 0, [0] * n
    for i, p in enumerate(up):
        if p < 0:
            at[i], free = free, free + size[i]
        else:
            at[i] = nexts[p]
            nexts[p] += size[i]
        nexts[i] = at[i] + 1
    # from here on nodes go by their place in a walk of each tree: those below a node follow it
    place = np.array(at, dtype=np.int64)
    order = np.argsort(place)
    end = np.arange(n) + np.array(size, dtype=np.int64)[order]
    above = np.where(parent[order] >= 0, place[parent[order]], -1)
    weight, values, more = weight[order].copy(), [v[order] for v in values], [v[order].copy() for v in more]
    comp = np.maximum.accumulate(np.where(above < 0, np.arange(n), 0))
    out = [np.zeros(n, dtype=np.int64) for _ in values]
    live = np.arange(n)
    while len(live):
        first = np.flatnonzero(np.concatenate([[True], comp[live][1:] != comp[live][:-1]]))
        length = np.diff(np.append(first, len(live)))
        heavy = 2 * weight[live] >= weight[comp[live]]
        centre = np.maximum.reduceat(np.where(heavy, live, -1), first)  # heavy nodes are a path: the last one is the deepest
        mine = np.repeat(centre, length)
        below = (live >= mine) & (live < end[mine])
        path = live[(live < mine) & (end[live] > mine)]
        over = np.repeat(np.arange(len(first)), length)[(live < mine) & (end[live] > mine)]
        for v, m, o in zip(values, more, out):
            total = np.add.reduceat(np.where(below, v[live], 0), first)
            o[centre] = total + m[centre]
            m[path] += total[over]
        weight[path] -= weight[centre][over]
        under = below & (live != mine)
        child = np.maximum.accumulate(np.where(under & (above[live] == mine), np.arange(len(live)), 0))
        comp[live[under]] = live[child[under]]
        live = live[live != mine]
        live = live[np.argsort(comp[live], kind="stable")]
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    return [o[back] for o in out]


def _finish(live: DataFrame) -> DataFrame:
    """Sums of components that fit a task; a component's rows come in one piece."""
    names = ["node", "depth", "parent", "n_convs", "n_children", "leaves", "saved"]

    def solve(t: pa.Table) -> pa.RecordBatch:
        # numbers of a table's ids, and of its (depth, id) keys: a parent is one up in depth
        ids = pc.unique(pa.chunked_array(t["node"].chunks + t["parent"].chunks, t["node"].type))
        node, parent = (pc.index_in(t[c], ids).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("node", "parent"))
        depth = t["depth"].to_numpy()
        parent = np.where(np.isnan(parent), -1, parent).astype(np.int64)
        key = depth * (len(ids) + 1) + node.astype(np.int64)
        by_key = np.argsort(key)
        want = (depth - 1) * (len(ids) + 1) + parent
        at = by_key[np.minimum(np.searchsorted(key[by_key], want), len(key) - 1)]
        is_top = depth == t["top_depth"].to_numpy()
        up = np.where(is_top, -1, at)
        assert (key[at[~is_top]] == want[~is_top]).all(), "a component lacks a parent"
        col = {c: t[c].to_numpy() for c in ("weight", "leaves", "saved", "more_leaves", "more_saved")}
        sums = split_all(up, col["weight"], [col["leaves"], col["saved"]], [col["more_leaves"], col["more_saved"]])
        made = [t[c].combine_chunks() for c in names[:5]] + [pa.array(s) for s in sums]
        return pa.RecordBatch.from_arrays(made, names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # rows of one component follow one another: keep the last one, solve the others
            t = pa.Table.from_batches(held)
            if t.num_rows < 1 << 14:
                continue
            same = pc.and_(pc.equal(t["top"], t["top"][-1]), pc.equal(t["top_depth"], t["top_depth"][-1])).to_numpy()
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    ids = live.schema["node"].dataType.simpleString()
    schema = f"node {ids}, depth long, parent {ids}, n_convs long, n_children long, leaves long, saved long"
    return live.repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", "depth", "node").mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# digests of the members that end at a node
# ---------------------------------------------------------------------------

def ends_digest(ends: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(node, depth, ends_sha256)`` of ``(node, depth, conv_id)``: SHA-256 of each node's ids in order, joined by commas.

    A range shuffle spreads a node's ids over tasks, which join them to pieces of at most about `chunk_bytes`; a node
    that lies in one task whole is digested there, the pieces of the others are read in order by one
    task a node, as that hash can only be computed in order, with a piece in memory at a time.
    """
    ids = ends.schema["conv_id"].dataType.simpleString()
    names = ["node", "depth", "first", "ids", "ends_sha256"]

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size, rows, weight = None, None, [], 0, [], 0
        cut = True  # the partition's first node may have begun in another one
        types: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*types, pa.string(), pa.string()])], names=names)

        for batch in batches:
            types = [batch.column(c).type for c in ("node", "depth", "conv_id")]
            for node, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "conv_id"))):
                if (node, depth) != key or size >= chunk_bytes:
                    if key is not None:
                        same, text = (node, depth) == key, ",".join(held)
                        cut = cut or same
                        rows.append((*key, first, text, None) if cut else (*key, first, None, hashlib.sha256(text.encode()).hexdigest()))
                        weight += len(text) if cut else 200
                        cut = same
                        if weight >= chunk_bytes:
                            yield flush()
                            rows.clear()
                            weight = 0
                    key, first, held, size = (node, depth), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if key is not None:  # the last node may go on in another partition
            rows.append((*key, first, ",".join(held), None))
            yield flush()

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, rows = None, None, []
        types = None
        for batch in batches:
            types = [batch.column(c).type for c in ("node", "depth")]
            for node, depth, text in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids"))):
                if (node, depth) != key:
                    if key is not None:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = (node, depth), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
        if key is not None:
            rows.append((*key, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [*types, pa.string()])], names=["node", "depth", "ends_sha256"])

    ordered = ends.repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")
    found = materialise(ordered.mapInArrow(pieces, f"node {ids}, depth long, first {ids}, ids string, ends_sha256 string"), "trie-ends")
    rest = found.where("ids is not null").select("node", "depth", "first", "ids")
    joined = rest.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(join, f"node {ids}, depth long, ends_sha256 string")
    return found.where("ids is null").select("node", "depth", "ends_sha256").unionAll(joined)
