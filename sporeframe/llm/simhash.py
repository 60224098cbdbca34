"""Operator 9, SimHash near-dedup by deletion-variant signatures.

Fingerprints: every 4-word shingle of a text (repeats included) is hashed with
XXH64, and a bit of the 64-bit fingerprint is set if it is set in over half of
the hashes.  Links: a fingerprint is cut into ``max_bits // 2 + 1`` segments, so
two fingerprints within `max_bits` agree in at least one segment but for one
bit at most.  Each segment is indexed once for each of its bits with that bit
deleted; equal variants are joined and the whole distance verified in the join
condition.  The condition also accepts a pair only at its first segment and
wildcard, so no pair comes out twice and no `distinct` is needed.

Equal fingerprints are one row before the join, so groups of copies cost one
row and their members never meet as pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.llm.common import LOWER, NOT_SPACE, byte_slices, components, materialise, replace_columns, text_key, word_spans

SHINGLE_WORDS, MAX_BITS, BITS, SEED = 4, 4, 64, 42
#: a byte's bits, each in a byte of its own: 255 hashes can be added without a carry
_SPREAD = np.packbits(
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None]
    * np.array([1, 0, 0, 0, 0, 0, 0, 0], dtype=np.uint8), axis=2, bitorder="little",
).reshape(256, 8).view("<u8").reshape(256)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits set in over half of the hashes of each row (rows start at ``bounds``); zero for none."""
    n = np.diff(bounds)
    out = np.zeros(len(n), dtype=np.uint64)
    rows = np.flatnonzero(n)
    if not len(rows):
        return out
    cuts = [np.arange(bounds[r], bounds[r + 1], 255) for r in rows]
    row_at = np.concatenate([[0], np.cumsum([len(c) for c in cuts])[:-1]])
    lanes = _SPREAD[np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.concatenate(cuts), axis=0).view(np.uint8).reshape(-1, BITS).astype(np.int64)
    counts = np.add.reduceat(sums, row_at, axis=0)
    bits = counts * 2 > n[rows][:, None]
    out[rows] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def slice_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprint of each row of a slice."""
    import xxhash

    # white space becomes one space after each word, so a shingle is a span of bytes
    low = LOWER[data]
    solid = NOT_SPACE[low]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    low[~solid] = 0x20
    kept = np.concatenate([[0], np.cumsum(keep)])
    low, offsets = low[keep], kept[offsets]
    starts, ends, bounds = word_spans(low, offsets, NOT_SPACE)
    words = np.diff(bounds)
    per_row = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    first = np.repeat(bounds[:-1], per_row) + np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    last = first + np.repeat(np.minimum(words, shingle), per_row) - 1
    raw, digest = low.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())), dtype=np.uint64, count=len(first)
    )
    return majority(hashes, np.concatenate([[0], np.cumsum(per_row)]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, k1, k2, fingerprint)`` of every row; the 64 bits are a signed long."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slice_fingerprints(d, o, shingle) for _, _, d, o in byte_slices(batch.column("text"))]
            if found:
                fp = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "k1", "k2")] + [fp], names=["id", "k1", "k2", "fingerprint"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("k1", "k2", "fingerprint")])
    rows = docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints that differ in at most `max_bits` bits, each once."""
    n = max_bits // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    segment_of = [next(i for i in range(n) if edges[i + 1] > j) for j in range(BITS)]
    masks = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(n)]
    if max(bin(m).count("1") for m in masks) > 56:
        raise ValueError("a segment must leave room for the wildcard's number in the key")
    fp = F.col("fingerprint")
    # key: number of the deleted bit, then the segment's other bits
    variants = [
        F.shiftrightunsigned(fp.bitwiseAND(F.lit(_signed(masks[segment_of[j]] & ~(1 << j)))), edges[segment_of[j]])
        .bitwiseOR(F.lit(_signed(j << 57)))
        for j in range(BITS)
    ]
    # Spark sizes the index as one row a fingerprint, not 64: without the hint it broadcasts either side
    index = distinct.select("fingerprint", F.explode(F.array(*variants)).alias("variant")).hint("merge")
    x, y = index.alias("x"), index.alias("y")
    diff = F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))
    bit = F.shiftrightunsigned("x.variant", 57)

    def per_segment(values: list[Column]) -> Column:
        out = values[-1]
        for i in reversed(range(n - 1)):
            out = F.when(bit < edges[i + 1], values[i]).otherwise(out)
        return out

    def accepted(i: int) -> Column:
        # equal variants differ in the deleted bit at most; equal segments count at their first wildcard
        inside = diff.bitwiseAND(F.lit(_signed(masks[i])))
        here = (inside != 0) | (bit == edges[i])
        for j in range(i):  # no earlier segment joins this pair
            here = here & (F.bit_count(diff.bitwiseAND(F.lit(_signed(masks[j])))) > 1)
        return here

    found = x.join(
        y,
        (F.col("x.variant") == F.col("y.variant")) & (F.col("x.fingerprint") < F.col("y.fingerprint"))
        & (F.bit_count(diff) <= max_bits) & per_segment([accepted(i) for i in range(n)]),
    )
    return found.select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """``(id, k1, k2, fingerprint, component_id, component)`` of every row.

    ``component_id`` is the smallest id that links reach, ``component`` the smallest fingerprint.

    Words are split at ASCII white space after lower-casing A-Z; a text of
    fewer words than a shingle is one shingle.

    Defined cases: null, empty and blank texts have fingerprint zero and link
    like any other; a null id is no smallest id unless its component has no
    other; equal rows share a component; rows of one id with different texts
    are different nodes; an empty table gives no rows; other columns of the
    input are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    groups = rows.groupBy("fingerprint").agg(F.min("id").alias("first"))
    joined = components(link_fingerprints(groups.select("fingerprint"), max_bits))
    label = F.coalesce("component", "fingerprint")
    groups = groups.join(joined, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", label.alias("label"))
    least = groups.groupBy("label").agg(F.min("first").alias("component_id"))
    named = groups.join(least, "label").select("fingerprint", "component_id", F.col("label").alias("component"))
    return rows.join(named, "fingerprint").select("id", "k1", "k2", "fingerprint", "component_id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each component of near duplicates: the smallest id's (null last; a repeated id's
    smallest text digest; one of equal rows).  Columns unchanged; see `near_duplicates`."""
    found = materialise(near_duplicates(docs, id_col, text_col, **options), "simhash-components")
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "k1", "k2")).alias("best")
    best = found.groupBy("component").agg(best).select(F.col("best.id").alias("_id"), F.col("best.k1").alias("_k1"), F.col("best.k2").alias("_k2"))
    k1, k2 = text_key(docs[text_col])
    keyed = docs.select(replace_columns(docs, {"_key1": k1, "_key2": k2}))
    on = keyed[id_col].eqNullSafe(F.col("_id")) & (F.col("_key1") == F.col("_k1")) & (F.col("_key2") == F.col("_k2"))
    kept = keyed.join(best, on, "left_semi")
    if not found.groupBy("id", "k1", "k2").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "_key1", "_key2"])
    return kept.select(*docs.columns)
