"""Shared helpers: scratch tables, vectorised scanning of UTF-8 text, link components.

Text work inside tasks runs on the byte buffer of a whole Arrow batch (numpy),
never per character and never on a prefix.  Slices of about ``SLICE_BYTES``
bound the memory of a task whatever the number of rows in a batch; one text
longer than that is a slice of its own.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeframe.session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 20

# ---------------------------------------------------------------------------
# tables
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, as Spark's Parquet scan splits it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, tag: str, compression: str = "none") -> DataFrame:
    """Write `df` to a table in the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but keeps Parquet's column pruning;
    a lost executor costs a re-read, not a recomputation.  Narrow tables are
    not compressed: a codec's native buffers per file cost more than they save.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: paths of this process's scratch tables, by application
_SCRATCH: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    """Removes a table that this process wrote, by the file system that holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(spark: SparkSession) -> int:
    """Removes the scratch tables of this application's finished operators; returns how many.

    To be called when results have been written: a DataFrame that an operator returned reads its scratch tables.
    """
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def forget(*tables: DataFrame) -> None:
    """Removes scratch tables that nothing will read again (`materialise`'s results, as they are)."""
    for df in tables:
        spark, folder = df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        known = _SCRATCH.get(spark.sparkContext.applicationId, [])
        for path in [p for p in known if any(f.endswith(p.rsplit("/", 1)[-1]) for f in folder)]:
            known.remove(path)
            _delete(spark, path)


def replace_columns(df: DataFrame, new: dict[str, Column], drop: tuple[str, ...] = ()) -> list[Column]:
    """Select list: the columns of `df` but those named in `new` or `drop`, then `new`."""
    gone = {c.lower() for c in [*new, *drop]}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in gone] + [v.alias(k) for k, v in new.items()]


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text; with the row's id they name its content."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(t, F.lit(1)).alias("k2")]


# ---------------------------------------------------------------------------
# byte scanning
# ---------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: member tables: which bytes belong to a word
NOT_SPACE = ~_SPACE
ALNUM = np.zeros(256, dtype=bool)  # after lower-casing A-Z: 0-9, a-z and every byte of a non-ASCII character
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def byte_slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes, and where each row's words begin
    in them (rows + 1 numbers).  A run never crosses two rows."""
    n = len(data)
    bounds = np.zeros(len(offsets), dtype=np.int64)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), bounds
    m = member[data]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = m[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = m[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Spans of `data`, one after another."""
    at = np.cumsum(lengths) - lengths
    return data[np.minimum(np.repeat(starts - at, lengths) + np.arange(int(lengths.sum())), max(len(data) - 1, 0))]


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow column of the byte strings of the given lengths that lie one after another in `data`."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def mix(z: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


#: modulus of the span hashes, a Mersenne prime
PRIME = (1 << 61) - 1
_M31, _M30, _P = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(PRIME)


def fold61(x: np.ndarray) -> np.ndarray:
    """Numbers below `PRIME` + 8, equal to any 64-bit numbers modulo `PRIME`."""
    return (x & _P) + (x >> np.uint64(61))


def reduce61(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo `PRIME`."""
    x = fold61(x)
    return x - _P * (x >= _P)


def times61(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Products modulo `PRIME` (folded) of folded numbers, from their halves of 31 and 30 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _M31, b >> np.uint64(31), b & _M31
    mid = a0 * b1 + a1 * b0
    return fold61(((a1 * b1) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & _M30) << np.uint64(31)) + a0 * b0)


def _times_2_31(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(30)) + ((x & _M30) << np.uint64(31))


class SpanHash:
    """Rabin-Karp hash of any span of a sequence of codes, from prefix sums modulo the prime 2^61 - 1.

    ``sum(code[i] * base^i)`` over a span, divided by ``base^start``, depends on
    the span's codes alone.  Two spans that differ are roots of a polynomial of
    their length: a base drawn at random is one of them with a probability of
    at most length / 2^61, whatever the spans look like.  Two objects with
    different seeds have independent bases.

    Prefix sums are kept as two rows (factors of 2^31 and of 1), each reduced
    only every ``STRIDE`` codes, so a code costs two products and two sums.
    """

    STRIDE = 1 << 22

    def __init__(self, seed: int) -> None:
        self.base = random.Random(seed * 7919 + 1).randrange(1 << 60, PRIME - 1)
        self._powers(1)

    def _powers(self, n: int) -> None:
        """Powers of the base and of its inverse, 16 bytes each two; the former as factors of 2^31 and of 1."""
        n = -(-n // (1 << 16)) << 16

        def powers(b: int) -> np.ndarray:
            p = np.ones(1, dtype=np.uint64)
            while len(p) < n:
                p = np.concatenate([p, reduce61(times61(p[: n - len(p)], np.uint64(pow(b, len(p), PRIME))))])
            return p

        up, self.down = powers(self.base), powers(pow(self.base, -1, PRIME))
        self.up_high, self.up_low = (up >> np.uint64(31)).astype(np.uint32), (up & _M31).astype(np.uint32)

    def _sums(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Two rows of prefix sums, for terms below 2^40."""
        out = np.zeros((2, len(high) + 1), dtype=np.uint64)
        for k, terms in enumerate((high, low)):
            for lo in range(0, len(terms), self.STRIDE):
                part = out[k, lo + 1 : lo + 1 + self.STRIDE]
                np.cumsum(terms[lo : lo + self.STRIDE], out=part)
                if lo:
                    part += reduce61(out[k, lo : lo + 1])
        return out

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums of 64-bit codes."""
        n = len(codes)
        if len(self.down) <= n:
            self._powers(n + 1)
        terms = times61(fold61(codes), (self.up_high[:n].astype(np.uint64) << np.uint64(31)) | self.up_low[:n])
        return self._sums(terms >> np.uint64(31), terms & _M31)

    def byte_prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of bytes (as codes 1 to 256, so no span equals a longer one)."""
        n = len(data)
        if len(self.down) <= n:
            self._powers(n + 1)
        codes = data.astype(np.uint64)
        codes += np.uint64(1)
        return self._sums(codes * self.up_high[:n], codes * self.up_low[:n])

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans, spread over 64 bits by a one-to-one function."""
        if prefix.shape[1] > self.STRIDE:  # sums were folded on the way: a later one may be smaller
            high, low = (reduce61(row[ends]) + _P - reduce61(row[starts]) for row in prefix)
        else:
            high, low = (row[ends] - row[starts] for row in prefix)
        return mix(reduce61(times61(fold61(_times_2_31(fold61(high)) + fold61(low)), self.down[starts])))


@cache
def span_hash(seed: int) -> SpanHash:
    """One object per worker and seed (it caches its powers)."""
    return SpanHash(seed)


def windows(bounds: np.ndarray, width: int) -> np.ndarray:
    """First word of every window of `width` words that lies in one row."""
    if width < 1:
        raise ValueError("a window holds at least one word")
    n = int(bounds[-1])
    fits = np.zeros(n + 1, dtype=np.int64)
    has = np.diff(bounds) >= width
    np.add.at(fits, bounds[:-1][has], 1)
    np.add.at(fits, bounds[1:][has] - width + 1, -1)
    return np.flatnonzero(np.cumsum(fits[:n]) > 0)


# ---------------------------------------------------------------------------
# components of a link table
# ---------------------------------------------------------------------------


MAX_ROUNDS = 200


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node that links reach, for every node with a link.

    Alternating star contraction: each node's larger neighbours move to its
    smallest neighbour, then its smaller neighbours to the smallest of them,
    until every node hangs on its component's smallest node.  The number of
    rows never grows; a hub's rows are combined before the shuffle (`min`), and
    as the minima are written out, both sides of its join are exchanges that
    Spark can split.  The number of rounds grows with the logarithm of the
    longest path (more than `MAX_ROUNDS` is an error); a round's tables are removed
    after it.  Nothing comes to the driver but a count and a sum.
    """
    # columns of the link table are renamed once; a link runs from the larger to the smaller node
    def tidy(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialise(tidy(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    seen = signature(edges)
    for _ in range(MAX_ROUNDS):
        old = [edges]
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "link-minima")
        old.append(least)
        large = tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialise(large, "large-stars")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "link-minima")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
        edges = materialise(tidy(small), "links")
        now = signature(edges)
        forget(*old, large, least)
        if now == seen:
            break
        seen = now
    else:
        raise ValueError(f"components are not settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
