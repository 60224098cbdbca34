"""Operator 5, embedding near-dedup by spherical-cap filters.

A random rotation spreads a vector over two blocks, each with a codebook of
random unit vectors; a filter direction is one codeword of each block, so
``codewords ** 2`` directions cost two small products.  A vector is list-decoded
to every direction whose inner product with it exceeds a height, found by
sorting one block's products against the other's.  The height is the one that
``filters`` of all directions exceed on average, and each vector has its best
``filters`` directions in any case.  All of this is done ``codes`` times with
rotations and codebooks of their own, so a pair is lost only where each code
loses it.  Two vectors of cosine 0.93 or more share several directions; random
ones almost never share any.  Equal filters under one label are joined and the
cosine is verified in double precision.

Equal vectors under one label are one node before the join, so a group of
copies costs one row; its size counts in ``n_links``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeframe.llm.common import components, materialise

THRESHOLD, CODEWORDS, FILTERS, CODES = 0.93, 1024, 48, 2


class Codes:
    """One code's rotation, codebooks and height for vectors of one length."""

    def __init__(self, size: int, codewords: int, filters: int, code: int = 0) -> None:
        rng = np.random.default_rng([size, codewords, filters, code])
        self.size, half = size, max(8, (size + 1) // 2)
        self.rotation = np.linalg.qr(rng.standard_normal((2 * half, 2 * half)))[0][:size]
        books = rng.standard_normal((2, codewords, half))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True) / np.sqrt(2)
        self.half, self.codewords, self.least, self.first = half, codewords, filters, code * codewords**2
        # the height that `filters` of all directions exceed, on average over random vectors
        trial = rng.standard_normal((16, size))
        sums = [np.add.outer(*x).ravel() for x in zip(*self.products(trial / np.linalg.norm(trial, axis=1, keepdims=True)))]
        most = min(16 * filters, 16 * codewords**2 - 1)
        self.height = float(-np.partition(-np.concatenate(sums), most)[most])

    def products(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotation
        return turned[:, : self.half] @ self.books[0].T, turned[:, self.half :] @ self.books[1].T

    def decode(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All directions whose sum of products exceeds the height; the `least` best ones in any case."""
        k = min(self.least, len(a))
        top = np.add.outer(np.partition(a, -k)[-k:], np.partition(b, -k)[-k:]).ravel()
        height = min(self.height, np.partition(top, -k)[-k])
        # a little lower, so that rounding of the differences keeps directions at the height itself
        first, second = np.flatnonzero(a >= height - b.max() - 1e-9), np.flatnonzero(b >= height - a.max() - 1e-9)
        i, j = np.nonzero(np.add.outer(a[first], b[second]) >= height)
        return self.first + first[i] * self.codewords + second[j]


@cache
def _codes(size: int, codewords: int, filters: int, codes: int) -> list[Codes]:
    return [Codes(size, codewords, filters, code) for code in range(codes)]


def filter_lists(unit: np.ndarray, codewords: int, filters: int, codes: int) -> list[np.ndarray]:
    """The filters of every row of `unit` (vectors of length 1), those of all codes together."""
    found = [[c.decode(a, b) for a, b in zip(*c.products(unit))] for c in _codes(unit.shape[1], codewords, filters, codes)]
    return [np.concatenate(x) for x in zip(*found)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def filter_rows(nodes: DataFrame, codewords: int, filters: int, codes: int) -> DataFrame:
    """``(node, label, size, filter)``: one row for each direction of each code that a node's vector exceeds."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for block in np.array_split(at, len(at) // 1024 + 1):
                    if not len(block):
                        continue
                    mine = batch.take(pa.array(block))
                    x = _matrix(mine.column("vector"))
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    lists = filter_lists(x, codewords, filters, codes)
                    rows = pa.array(np.repeat(np.arange(len(block)), [len(c) for c in lists]))
                    yield pa.RecordBatch.from_arrays(
                        [mine.column(c).take(rows) for c in ("node", "label", "size")] + [pa.array(np.concatenate(lists))], names=["node", "label", "size", "filter"]
                    )

    label = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "size", "vector").mapInArrow(run, f"node long, label {label}, size int, filter long")


def link_vectors(nodes: DataFrame, threshold: float, codewords: int, filters: int, codes: int) -> DataFrame:
    """Pairs ``a < b`` of nodes of one label whose cosine reaches the threshold, each once."""
    rows = filter_rows(nodes, codewords, filters, codes)
    x, y = rows.alias("x"), rows.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("label", "size", "filter")]
    met = x.join(y, [*same, F.col("x.node") < F.col("y.node")]).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    vectors = nodes.select("node", "vector")
    met = met.join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("size").to_numpy()
            for size in np.unique(lengths):  # a pair's vectors have one length
                mine = batch.take(pa.array(np.flatnonzero(lengths == size)))
                va, vb = _matrix(mine.column("va")), _matrix(mine.column("vb"))
                cosine = np.einsum("ij,ij->i", va, vb) / (np.linalg.norm(va, axis=1) * np.linalg.norm(vb, axis=1))
                yield mine.select(["a", "b"]).filter(pa.array(cosine >= threshold))

    return met.select("a", "b", F.size("va").alias("size"), "va", "vb").mapInArrow(verify, "a long, b long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    codewords: int = CODEWORDS, filters: int = FILTERS, codes: int = CODES,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row.

    ``n_links`` counts the other rows of the label within the threshold,
    ``component_id`` is the smallest id that links reach, ``kept`` marks rows of
    that id.

    Defined cases: vectors that are null, empty or zero, or hold null or
    non-finite components, and rows without a label link with nothing;
    vectors of different lengths don't link; equal rows link and count each
    other; a null id is a component's smallest id only if it has no other; an
    empty table gives no rows; other columns are not read.
    """
    v = F.col(vector_col).cast("array<double>")
    valid = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("vector"))
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    digest = [F.xxhash64("vector").alias("k1"), F.xxhash64("vector", F.lit(1)).alias("k2")]
    rows = materialise(rows.select("id", "label", "vector", "valid", *digest), "vectors")
    # vectors of one label with equal digests are one node
    nodes = rows.where("valid").groupBy("label", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("vector")), "vector-nodes")
    links = materialise(link_vectors(nodes, threshold, codewords, filters, codes), "vector-links")

    copies = nodes.select("node", "copies")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
    degree = ends.join(copies.toDF("other", "n"), "other").groupBy("node").agg(F.sum("n").alias("near"))
    joined = components(links)
    named = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(degree, "node", "left").join(least, "component").select(
        F.col("label").alias("_label"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"),
        (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id",
    )
    on = F.col("valid") & (F.col("label") == F.col("_label")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    out = rows.drop("vector").join(named, on, "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
