"""Operator 2, chat formatting as prefix trees.

A turn is formatted as ``### role: text </turn>`` and a line feed.  Inside roles
and texts a backslash goes before every backslash, ``#`` and ``<`` (and ``:`` in
roles), so no control string can occur in them and the parse is unique.

Conversations that share their initial turns share the nodes of a tree: a
node is a turn after all turns before it, named by a chained hash.  The nodes
of all trees are laid out depth-first, each once: a node starts after its parent's tokens and
the subtrees of its earlier siblings.  Subtree sizes and sums along paths come
from pointer doubling over the parents, sums over siblings from one range shuffle, so
a node's row has a fixed width however long its conversation is, and neither a
large tree nor a node's family lies in one task.  A node has its place in its tree's token sequence, the position id
of its first token (the tokens before it in its own conversations) and the
intervals of its ancestors, which its tokens attend to besides their own node
up to themselves.  The loss mask covers the (escaped) texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.llm.common import materialise
from sporeframe.operators.ranking import running_total
from sporeframe.operators.tree import path_totals, subtree_totals

# fixed values: the template's control strings
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
LEARNED_ROLE = "assistant"
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*) </turn>\n", re.DOTALL)


def escape(text: str, more: str = "") -> str:
    return re.sub(rf"[\\#<{more}]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises ValueError if it isn't one."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@cache
def _encoding(path: str, pattern: str):
    """A byte-level vocabulary of ranks, without special tokens: decoding gives back every byte."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Tree(NamedTuple):
    """``nodes``: ``tree, start, length, depth, position, parent_start, attends, ids, loss_from, loss_to``;
    ``conversations``: ``conv_id, tree, n_turns, path`` (the starts of its nodes in order)."""

    nodes: DataFrame
    conversations: DataFrame


_TURNS = T.StructType([
    T.StructField("conv", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("tree", T.BinaryType()), T.StructField("node", T.BinaryType()),
    T.StructField("parent", T.BinaryType()), T.StructField("position", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss_from", T.LongType()), T.StructField("loss_to", T.LongType()),
])


def _chain(vocabulary: str, pattern: str):
    """One row per turn of each conversation ``(conv, turns)``."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary, pattern).encode_ordinary
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(lo, 256).to_pylist():
                    node, position, tree = None, 0, None
                    for depth, t in enumerate(r["turns"]):
                        role, text = t["role"], t["text"]
                        parent = node
                        node = hashlib.blake2b(b"".join([parent or b"", len(role).to_bytes(8, "big"), role.encode(), text.encode()]), digest_size=16).digest()
                        tree = tree or node
                        head, body, tail = (encode(x) for x in (f"{OPEN}{escape(role, ':')}{MIDDLE}", escape(text), CLOSE))
                        ids = head + body + tail
                        loss = (len(head), len(head) + len(body)) if role == LEARNED_ROLE else (0, 0)
                        rows.append((r["conv"], depth, tree, node, parent, position, len(ids), ids, *loss))
                        position += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=_TURNS.names)

    return run


_ARROW = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64()]


def place_nodes(nodes: DataFrame) -> DataFrame:
    """``(node, start)``: tokens before each node in its tree when all are laid out depth-first, siblings by their names."""
    edges = materialise(nodes.select(F.col("node").alias("child"), "parent", "length"), "chat-edges")
    sized = subtree_totals(edges, "length")
    laid = running_total(sized.where("parent IS NOT NULL"), ["parent", "child"], "total")
    # a row for each parent: what its first child's running total and its own tokens make of a child's
    families = laid.groupBy("parent").agg(F.min("before").alias("first")).join(edges.select(F.col("child").alias("parent"), "length"), "parent")
    families = materialise(families.select("parent", (F.col("length") - F.col("first")).alias("shift")), "chat-families")
    steps = laid.join(families, "parent").select("child", "parent", (F.col("before") + F.col("shift")).alias("step"))
    roots = sized.where("parent IS NULL").select("child", "parent", F.lit(0).cast("long").alias("step"))
    return path_totals(materialise(roots.unionAll(steps), "chat-steps"), "step").toDF("node", "start")


def prefix_trees(
    conversations: DataFrame, vocabulary: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Tree:
    """All conversations as prefix trees of token ids (see `Tree`).

    Defined cases: null texts and roles count as empty; turns go by their
    number (null first), equal numbers by role and text, and repeated rows are
    turns of their own; rows without a conversation id are one conversation;
    an empty table gives empty tables; other columns are not read.
    """
    spark = conversations.sparkSession
    empty = F.lit("")
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("turns"))
    whole = materialise(turns.withColumn("conv", F.monotonically_increasing_id()), "chat-conversations", "zstd")
    chained = materialise(whole.select("conv", "turns").mapInArrow(_chain(vocabulary, pattern), _TURNS), "chat-turns", "zstd")
    nodes = chained.groupBy("node").agg(
        F.min("conv").alias("owner"), *[F.first(c).alias(c) for c in ("tree", "depth", "parent", "position", "length", "ids", "loss_from", "loss_to")]
    )
    nodes = materialise(nodes, "chat-nodes", "zstd")
    spots = materialise(nodes.select("node", "length", "owner").join(place_nodes(nodes), "node"), "chat-spots")
    met = chained.select("conv", "depth", "node").join(spots, "node")
    line = F.array_sort(F.collect_list(F.struct("depth", "start", "length", "node", (F.col("owner") == F.col("conv")).alias("owned"))))
    lines = materialise(met.groupBy("conv").agg(line.alias("line")), "chat-lines")

    def attend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for turns in batch.column("line").to_pylist():
                spans: list[tuple[int, int]] = []
                for t in turns:
                    if t["owned"]:
                        rows.append((t["node"], t["start"], turns[t["depth"] - 1]["start"] if t["depth"] else None, list(spans)))
                    end = t["start"] + t["length"]
                    if spans and spans[-1][1] == t["start"]:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((t["start"], end))
            if rows:
                node, start, parent, spans = zip(*rows)
                pairs = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(start, pa.int64()), pa.array(parent, pa.int64()), pairs],
                                                 names=["node", "start", "parent_start", "attends"])

    spans = lines.select("line").mapInArrow(attend, "node binary, start long, parent_start long, attends array<struct<start: long, end: long>>")
    out = nodes.join(spans, "node").select(
        F.hex("tree").alias("tree"), "start", "length", "depth", "position", "parent_start", "attends", "ids", "loss_from", "loss_to")
    tree = chained.where("depth = 0").select("conv", F.hex("tree").alias("tree"))
    convs = whole.select("conv", "conv_id").join(lines, "conv").join(tree, "conv").select(
        "conv_id", "tree", F.size("line").cast("long").alias("n_turns"), F.col("line.start").alias("path"))
    return Tree(materialise(out, "chat-tree", "zstd"), materialise(convs, "chat-paths"))


def _by_turn(a, b):
    """Order of two turns: number (null first), role, text."""
    out = F.lit(0)
    for c in ("text", "role", "turn"):
        x, y = a[c], b[c]
        out = F.when(x.eqNullSafe(y), out).when(x.isNull() | (x < y), F.lit(-1)).otherwise(F.lit(1))
    return out


def read_back(tree: Tree, vocabulary: str, pattern: str) -> DataFrame:
    """``(conv_id, n_turns, turns, formatted, learned)`` decoded from the trees: the parsed turns, the whole
    formatted text, and the unescaped text under the loss mask."""
    steps = tree.conversations.select("conv_id", "n_turns", "tree", F.posexplode("path").alias("k", "start"))
    steps = steps.join(tree.nodes.select("tree", "start", "ids", "loss_from", "loss_to"), ["tree", "start"])
    parts = steps.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("k", "ids", "loss_from", "loss_to"))).alias("parts"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _encoding(vocabulary, pattern).decode_bytes
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                turns, formatted, learned = [], [], []
                for steps in part.column("parts").to_pylist():
                    formatted.append(read([i for s in steps for i in s["ids"]]).decode())
                    learned.append("".join(unescape(read(s["ids"][s["loss_from"] : s["loss_to"]]).decode()) for s in steps))
                    turns.append([{"role": r, "text": t} for r, t in parse(formatted[-1])])
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("n_turns"), pa.array(turns, kind), pa.array(formatted), pa.array(learned)],
                                                 names=["conv_id", "n_turns", "turns", "formatted", "learned"])

    conv = tree.conversations.schema["conv_id"].dataType.simpleString()
    return parts.mapInArrow(decode, f"conv_id {conv}, n_turns long, turns array<struct<role: string, text: string>>, formatted string, learned string")
