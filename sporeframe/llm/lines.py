"""Operator 8, line dedup: sharded minimal perfect hashes over the distinct line hashes.

1. Every task hashes the keys of its documents' lines (128 bits) and counts
   each once per document; Spark sums the counts and takes the largest id.
2. Keys that reach the limit are cut into shards by their hash.  Each shard
   builds a minimal perfect hash (a cascade of bit arrays: a key sits in the
   first level where it has its bit to itself, and its slot is the rank of
   that bit) and fills a fingerprint, a count and a last-id array by slot.
3. Documents probe the arrays, which take about 25 bytes a key; lines are never joined.
   An index of at most ``index_bytes`` goes out by broadcast, and texts are not
   shuffled.  A larger one stays where it is: documents are dealt into chunks, each
   sends a shard the packed hashes of its distinct lines, the shard's arrays answer
   with the hits and their last ids, and the chunk drops the lines.  Texts are
   shuffled once then, hashes (16 bytes a line) twice, whatever the index's size, and a task
   holds one shard and about ``block_bytes`` of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sporeframe.llm.common import LOWER, NOT_SPACE, byte_slices, materialise, mix, replace_columns, span_hash, text_key

MIN_CHARS, MIN_DOCS = 40, 5
KEY_BYTES = 25
SHARD_KEYS = 1 << 18


# ---------------------------------------------------------------------------
# lines of a slice of texts
# ---------------------------------------------------------------------------

def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and where each row's lines begin in them."""
    stops = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], stops + 1]), kind="stable")
    ends = np.sort(np.concatenate([stops, offsets[1:]]), kind="stable")
    return starts, ends, np.searchsorted(stops, offsets) + np.arange(len(offsets))


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lines have a key of `min_chars` code points, and the two hashes of those keys."""
    solid = np.flatnonzero(NOT_SPACE[data])
    if not len(solid):
        none = np.empty(0, dtype=np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64)
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends) - 1
    full = np.flatnonzero(last >= first)
    a, b = solid[first[full]], solid[last[full]] + 1
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    long = chars[b] - chars[a] >= min_chars
    full, a, b = full[long], a[long], b[long]
    low = LOWER[data]
    h1, h2 = span_hash(81), span_hash(82)
    return full, h1.spans(h1.byte_prefix(low), a, b), h2.spans(h2.byte_prefix(low), a, b)


def _count_lines(id_type: T.DataType, min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, found = batch.column(0), []
            for lo, _, data, offsets in byte_slices(batch.column(1)):
                starts, ends, bounds = line_spans(data, offsets)
                at, h1, h2 = line_keys(data, starts, ends, min_chars)
                found.append((h1, h2, lo + np.searchsorted(bounds, at, "right") - 1))
            h1, h2, row = (np.concatenate(x) for x in zip(*found))
            if not len(h1):
                continue
            # ids in order, null first: the largest row of a key has its largest id
            by_id = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
            rank = np.empty(len(ids), dtype=np.int64)
            rank[by_id] = np.arange(len(ids))
            rank = rank[row]
            order = np.lexsort((rank, h2, h1))
            h1, h2, rank = h1[order], h2[order], rank[order]
            new_key = np.ones(len(h1), dtype=bool)
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_key.copy()
            new_doc[1:] |= rank[1:] != rank[:-1]
            at = np.flatnonzero(new_key)
            end = np.append(at[1:], len(h1)) - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)),
                pa.array(np.add.reduceat(new_doc.astype(np.int64), at)),
                ids.take(pa.array(by_id[rank[end]])),
            ], names=["h1", "h2", "n", "last"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("h1", "h2", "n")] + [T.StructField("last", id_type)])
    return run, schema


# ---------------------------------------------------------------------------
# minimal perfect hash
# ---------------------------------------------------------------------------

class PerfectHash:
    """Slots 0..n-1 for n distinct 128-bit keys, from a cascade of bit arrays.

    Other keys get some slot or -1; the caller's fingerprint tells them apart.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits  # bits: one byte for eight positions
        ones = np.bitwise_count(bits).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(ones)])

    @staticmethod
    def _position(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h1 + h2 * np.uint64(2 * level + 1) + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, spread: float = 2.0) -> PerfectHash:
        sizes, levels = [], []
        while len(h1):
            if len(sizes) == 200:
                raise ValueError("keys are not distinct")
            size = (int(len(h1) * spread) // 8 + 1) * 8
            at = cls._position(h1, h2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(sizes, np.concatenate(levels) if levels else np.empty(0, np.uint8))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, dtype=np.int64)
        left, base = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base + self._position(h1[left], h2[left], level, size)
            byte, bit = self.bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[left[hit]] = self.ranks[at[hit] >> 3] + below[hit]
            left, base = left[~hit], base + size
        return out


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS) -> DataFrame:
    """``(h1, h2, n, last)``: keys found in `min_docs` rows or more, and their largest id."""
    run, schema = _count_lines(docs.schema[id_col].dataType, min_chars)
    counted = docs.select(id_col, text_col).mapInArrow(run, schema)
    return counted.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs)


def build_shards(keys: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: the perfect hash and the arrays that its slots index."""
    def build(group: pa.Table) -> pa.Table:
        h1, h2 = (group[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        mph = PerfectHash.build(h1, h2)
        slot = mph.slots(h1, h2)
        order = np.empty(len(slot), dtype=np.int64)
        order[slot] = np.arange(len(slot))
        last = group["last"].take(pa.array(order)).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("last", last.type)])) as w:
            w.write_batch(pa.record_batch([last], names=["last"]))
        return pa.table({
            "shard": pa.array([group["shard"][0].as_py()], pa.int64()),
            "sizes": pa.array([mph.sizes], pa.list_(pa.int64())),
            "bits": pa.array([mph.bits.tobytes()], pa.binary()),
            "fingerprints": pa.array([h2[order].tobytes()], pa.binary()),
            "counts": pa.array([group["n"].to_numpy()[order].astype(np.int64).tobytes()], pa.binary()),
            "last": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
        })

    schema = "shard long, sizes array<long>, bits binary, fingerprints binary, counts binary, last binary"
    shard = F.pmod(F.col("h1"), F.lit(n_shards)).alias("shard")
    return keys.select(shard, "h1", "h2", "n", "last").groupBy("shard").applyInArrow(build, schema)


class Shard:
    """A shard's arrays in a task."""

    def __init__(self, row) -> None:
        self.mph = PerfectHash(list(row["sizes"]), np.frombuffer(row["bits"], dtype=np.uint8))
        self.fingerprints = np.frombuffer(row["fingerprints"], dtype=np.uint64)
        self.counts = np.frombuffer(row["counts"], dtype=np.int64)
        self.last = pa.ipc.open_stream(row["last"]).read_all()["last"].combine_chunks()

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that the shard doesn't hold."""
        slot = self.mph.slots(h1, h2)
        return np.where((slot >= 0) & (self.fingerprints[slot] == h2), slot, -1)


def _rest(texts: list[bytes], data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Appends each text without its lines that are gone; returns how many those are by text."""
    raw = data.tobytes()
    n_gone = np.concatenate([[0], np.cumsum(gone)])
    n_gone = n_gone[bounds[1:]] - n_gone[bounds[:-1]]
    for i, n in enumerate(n_gone.tolist()):
        if not n:
            texts.append(raw[offsets[i] : offsets[i + 1]])
        else:
            keep = np.flatnonzero(~gone[bounds[i] : bounds[i + 1]]) + bounds[i]
            texts.append(b"\n".join([raw[a:b] for a, b in zip(starts[keep], ends[keep])]))
    return n_gone


def _drop_lines(id_col: str, text_col: str, names: list[str], shared, n_shards: int, min_chars: int, min_docs: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = {r["shard"]: Shard(r) for r in shared.value}
        for batch in batches:
            ids = batch.column(id_col)
            texts, lines, dropped = [], [], []
            for lo, hi, data, offsets in byte_slices(batch.column(text_col)):
                starts, ends, bounds = line_spans(data, offsets)
                at, h1, h2 = line_keys(data, starts, ends, min_chars)
                row = np.searchsorted(bounds, at, "right") - 1
                gone = np.zeros(len(starts), dtype=bool)
                shard = h1.view(np.int64) % n_shards
                for k in np.unique(shard):
                    if k not in shards:
                        continue
                    mine = np.flatnonzero(shard == k)
                    slot = shards[k].probe(h1[mine], h2[mine])
                    mine, slot = mine[slot >= 0], slot[slot >= 0]
                    often = shards[k].counts[slot] >= min_docs
                    mine, slot = mine[often], slot[often]
                    own, last = ids.take(pa.array(lo + row[mine])), shards[k].last.take(pa.array(slot))
                    same = pc.or_(pc.fill_null(pc.equal(own, last), False), pc.and_(pc.is_null(own), pc.is_null(last)))
                    gone[at[mine[~same.to_numpy(zero_copy_only=False)]]] = True
                n_gone = _rest(texts, data, offsets, starts, ends, bounds, gone)
                lines.append(np.diff(bounds))
                dropped.append(n_gone)
            if not texts:
                continue
            new = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(np.concatenate(lines)), "n_dropped": pa.array(np.concatenate(dropped))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return run


# ---------------------------------------------------------------------------
# an index that is too large for a broadcast
# ---------------------------------------------------------------------------

class ChunkKeys:
    """The distinct keys of a chunk's lines, in order of their hashes, and the key of every line."""

    def __init__(self, texts: pa.ChunkedArray, min_chars: int) -> None:
        self.slices, h1, h2 = [], [], []
        for lo, _, data, offsets in byte_slices(texts):
            starts, ends, bounds = line_spans(data, offsets)
            at, a, b = line_keys(data, starts, ends, min_chars)
            self.slices.append((lo, data, offsets, starts, ends, bounds, at))
            h1.append(a)
            h2.append(b)
        h1, h2 = np.concatenate(h1), np.concatenate(h2)
        order = np.lexsort((h2, h1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        self.h1, self.h2 = h1[order][new], h2[order][new]
        self.of_line = np.empty(len(order), dtype=np.int64)
        self.of_line[order] = np.cumsum(new) - 1

    def by_shard(self, n_shards: int) -> dict[int, np.ndarray]:
        shard = self.h1.view(np.int64) % n_shards
        order = np.argsort(shard, kind="stable")
        found, first = np.unique(shard[order], return_index=True)
        return dict(zip(found.tolist(), np.split(order, first[1:])))


def _probe_chunks(chunked: DataFrame, shards: DataFrame, id_col: str, text_col: str, n_shards: int, n_parts: int, min_chars: int) -> DataFrame:
    """`chunked` (columns ``_chunk``, ``n_lines``, ``n_dropped`` and the rest) without the lines of `shards`."""
    id_type = chunked.schema[id_col].dataType

    def send(docs: pa.Table) -> pa.Table:
        keys = ChunkKeys(docs[text_col], min_chars)
        mine = keys.by_shard(n_shards)
        chunk = docs["_chunk"][0].as_py()
        return pa.table({
            "shard": pa.array(list(mine), pa.int64()), "part": pa.array([chunk % n_parts] * len(mine), pa.int64()), "chunk": pa.array([chunk] * len(mine), pa.int64()),
            "keys": pa.array([np.concatenate([keys.h1[i], keys.h2[i]]).tobytes() for i in mine.values()], pa.binary()),
        })

    def answer(blocks: pa.Table, index: pa.Table) -> pa.Table:
        rows = []
        if blocks.num_rows and index.num_rows:
            shard = Shard({c: index[c][0].as_py() for c in ("sizes", "bits", "fingerprints", "counts", "last")})
            for number, chunk, packed in zip(*(blocks[c].to_pylist() for c in ("shard", "chunk", "keys"))):
                h1, h2 = np.frombuffer(packed, dtype=np.uint64).reshape(2, -1)
                slot = shard.probe(h1, h2)
                hit = np.flatnonzero(slot >= 0)
                if len(hit):
                    rows.append((chunk, number, hit.astype("<u4").tobytes(), shard.last.take(pa.array(slot[hit])).to_pylist()))
        cols = list(zip(*rows)) if rows else [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(to_arrow_type(id_type))]
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("chunk", "shard", "hits", "last"), cols, kinds)})

    def drop(docs: pa.Table, replies: pa.Table) -> pa.Table:
        keys = ChunkKeys(docs[text_col], min_chars)
        mine = keys.by_shard(n_shards)
        found = np.full(len(keys.h1), -1, dtype=np.int64)  # of each key, the place of its last id
        base = 0
        for shard, hits in zip(replies["shard"].to_pylist(), replies["hits"].to_pylist()):
            at = mine[shard][np.frombuffer(hits, dtype="<u4")]
            found[at] = base + np.arange(len(at))
            base += len(at)
        last, ids = replies["last"].combine_chunks().flatten(), docs[id_col].combine_chunks()
        texts, lines, dropped, done = [], [], [], 0
        for lo, data, offsets, starts, ends, bounds, at in keys.slices:
            key = keys.of_line[done : done + len(at)]
            done += len(at)
            often = found[key] >= 0
            row = np.searchsorted(bounds, at[often], "right") - 1
            own, kept_in = ids.take(pa.array(lo + row)), last.take(pa.array(found[key[often]]))
            same = pc.or_(pc.fill_null(pc.equal(own, kept_in), False), pc.and_(pc.is_null(own), pc.is_null(kept_in)))
            gone = np.zeros(len(starts), dtype=bool)
            gone[at[often][~same.to_numpy(zero_copy_only=False)]] = True
            dropped.append(_rest(texts, data, offsets, starts, ends, bounds, gone))
            lines.append(np.diff(bounds))
        new = {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(np.concatenate(lines)), "n_dropped": pa.array(np.concatenate(dropped))}
        return pa.table({c: new[c] if c in new else docs[c] for c in docs.column_names})

    by_chunk = chunked.groupBy("_chunk")
    sent = by_chunk.applyInArrow(send, "shard long, part long, chunk long, keys binary")
    # a shard's arrays go to each part of the chunks, so no task holds all hashes that meet a shard
    spread = shards.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))).alias("part"))
    replies = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("hits", T.BinaryType()), T.StructField("last", T.ArrayType(id_type))])
    answered = sent.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(answer, replies)

    def drop_any(docs: pa.Table, replies: pa.Table) -> pa.Table:
        return drop(docs, replies) if docs.num_rows else docs

    return by_chunk.cogroup(answered.groupBy("chunk")).applyInArrow(drop_any, chunked.schema)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    shard_keys: int = SHARD_KEYS, index_bytes: int = 64 << 20, chunk_bytes: int = 8 << 20, block_bytes: int = 64 << 20,
) -> DataFrame:
    """`docs` with frequent lines removed from the text, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased.
    Keys of at least `min_chars` code points that at least `min_docs` rows
    hold lose all their lines but those in the row of the largest id.

    Defined cases: a null text is one empty line and comes back empty; a null
    id is below every other; each row counts as a document, also equal ones,
    and all rows of the largest id keep the line; an empty table stays empty;
    input columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    spark = docs.sparkSession
    keys = materialise(line_index(docs, id_col, text_col, min_chars, min_docs), "line-keys")
    n_keys = keys.count()
    n_shards = max(1, math.ceil(n_keys / shard_keys))
    shards = materialise(build_shards(keys, n_shards), "line-shards")
    out = docs.select(replace_columns(docs, {"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}))
    if n_keys * KEY_BYTES <= index_bytes:
        rows = shards.collect()  # at most about index_bytes
        shared = spark.sparkContext.broadcast([r.asDict() for r in rows])
        return out.mapInArrow(_drop_lines(id_col, text_col, out.columns, shared, n_shards, min_chars, min_docs), out.schema)
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_chunks = max(1, math.ceil(n_bytes / chunk_bytes))
    # at most 16 bytes of hashes for each `min_chars` bytes of text, dealt over the shards
    n_parts = max(1, math.ceil(n_bytes / max(1, min_chars) * 16 / n_shards / block_bytes))
    chunk = F.pmod(F.xxhash64(F.col(id_col), *text_key(F.col(text_col))), F.lit(n_chunks))
    chunked = out.withColumn("_chunk", chunk)
    return _probe_chunks(chunked, shards, id_col, text_col, n_shards, n_parts, min_chars).select(*out.columns)
