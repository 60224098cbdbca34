"""Operator 4, substring dedup: Rabin-Karp hashes of every window, counted in Spark.

A window is 20 consecutive words of one document; it is removed if the same
words also start earlier (smaller id, or the same id and an earlier start), and
the words that removed windows cover form the maximal removal intervals.

Documents are dealt into chunks of about ``chunk_bytes``; the three steps below
read the same exchange of texts.  Windows themselves never become rows: a chunk
sends each bucket of hashes one packed block, and the bucket answers with a bitmap
in the block's order.

1. Each chunk sends the distinct 32-bit hashes of its windows by bucket (sorted,
   as differences: about two bytes a window).  The bucket answers which of them
   other chunks hold too; all other windows occur in one chunk only.
2. Each chunk sends the 128-bit hashes of the windows that may repeat, with the
   place (id, start) of the first in the chunk.  The bucket answers which blocks
   hold the first place of all.
3. Each chunk removes the covered words from its texts.

A block has a window's hash once, so the rows and bytes of a passage that every
document shares grow with the chunks, not with the documents.

A bitmap means the same windows to both its ends whatever order a shuffle brings
a chunk's rows in: every step puts them in the order of id and text first.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sporeframe.llm.common import NOT_SPACE, byte_slices, span_hash, text_key, windows, word_spans

WINDOW_WORDS, CHUNK_BYTES, BUCKET_WINDOWS = 20, 8 << 20, 1 << 20


def _pack(values: np.ndarray) -> bytes:
    """Differences of 32-bit numbers, byte plane by byte plane: small ones are runs of zeros for the shuffle's compression."""
    return np.diff(values.astype("<u4"), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint32)


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n).astype(bool)


def _id_ranks(ids: pa.Array) -> np.ndarray:
    """Dense ranks of ids, null first."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def in_order(docs: pa.Table) -> pa.Table:
    """A chunk's rows by id and text: each step reads the exchange anew, and blocks from other executors arrive in any order."""
    keyed = pa.table({"id": pa.array(_id_ranks(docs["id"].combine_chunks())), "text": docs["text"].combine_chunks()})
    return docs.take(pc.sort_indices(keyed, sort_keys=[("id", "ascending"), ("text", "ascending")]))


class Chunk(NamedTuple):
    """All windows of a chunk's documents."""

    n_words: np.ndarray   # by row
    first: np.ndarray     # of each window, its first word in the chunk
    row: np.ndarray       # of each window
    start: np.ndarray     # of each window, its first word in its document
    h1: np.ndarray
    h2: np.ndarray


def chunk_windows(texts: pa.ChunkedArray, width: int) -> Chunk:
    """Both hashes of a window cover its bytes, with one space between words."""
    h1, h2 = span_hash(41), span_hash(42)
    found, words, rows, before = [], [], 0, 0
    for _, _, data, offsets in byte_slices(texts):
        starts, ends, bounds = word_spans(data, offsets, NOT_SPACE)
        first = windows(bounds, width)
        row = np.searchsorted(bounds, first, "right") - 1
        keep = NOT_SPACE[data]
        spaced = np.where(keep, data, 32).astype(np.uint8)
        keep[ends[ends < len(data)]] = True  # one byte after each word: a space, or the next row's first
        place = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(keep, out=place[1:])
        spaced, begin, end = spaced[keep], place[starts[first]], place[ends[first + width - 1]]
        found.append((first + before, row + rows, first - bounds[row], *(h.spans(h.byte_prefix(spaced), begin, end) for h in (h1, h2))))
        words.append(np.diff(bounds))
        rows, before = rows + len(offsets) - 1, before + len(starts)
    return Chunk(np.concatenate(words), *(np.concatenate(x) for x in zip(*found)))


class Coarse(NamedTuple):
    """The windows' 32-bit hashes by bucket: distinct values in order, and each window's place among them."""

    order: np.ndarray     # windows by bucket and hash
    place: np.ndarray     # in that order, the number of the distinct value
    cuts: np.ndarray      # first distinct value of each bucket in `buckets`, and the end
    buckets: np.ndarray
    values: np.ndarray
    counts: np.ndarray


def coarse_hashes(h1: np.ndarray, n_buckets: int) -> Coarse:
    bucket, value = h1 % np.uint64(n_buckets), (h1 >> np.uint64(32))
    key = bucket << np.uint64(32) | value
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    distinct = key[at]
    buckets, cuts = np.unique(distinct >> np.uint64(32), return_index=True)
    return Coarse(order, np.cumsum(new) - 1, np.append(cuts, len(distinct)), buckets.astype(np.int64), distinct.astype(np.uint32), np.diff(np.append(at, len(key))))


def may_repeat(chunk: Chunk, answers: dict[int, bytes], n_buckets: int) -> np.ndarray:
    """Windows whose 32-bit hash occurs again in the chunk or in another one, in order."""
    c = coarse_hashes(chunk.h1, n_buckets)
    hit = c.counts > 1
    for bucket, a, b in zip(c.buckets.tolist(), c.cuts[:-1], c.cuts[1:]):
        if bucket in answers:
            hit[a:b] |= _bits(answers[bucket], b - a)
    return np.sort(c.order[hit[c.place]])


class Candidates(NamedTuple):
    """The chunk's distinct windows that may repeat."""

    windows: np.ndarray   # all that may repeat
    group: np.ndarray     # of each, its distinct window
    lead: np.ndarray      # of each distinct window, the place in `windows` of the first in the chunk
    tied: np.ndarray      # of each window, whether it is at its group's first place


def candidates(chunk: Chunk, ranks: np.ndarray, may: np.ndarray) -> Candidates:
    h1, h2, rank, start = chunk.h1[may], chunk.h2[may], ranks[chunk.row[may]], chunk.start[may]
    order = np.lexsort((start, rank, h2, h1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    lead = order[new]
    # distinct windows in the order of their first places in the chunk, which packs well
    by_place = np.argsort(lead)
    renumber = np.empty(len(lead), dtype=np.int64)
    renumber[by_place] = np.arange(len(lead))
    group, lead = renumber[group], lead[by_place]
    return Candidates(may, group, lead, (rank == rank[lead][group]) & (start == start[lead][group]))


def _answers(replies: pa.Table, step: int) -> dict[int, bytes]:
    mine = replies.filter(pc.equal(replies["step"], step))
    return dict(zip(mine["bucket"].to_pylist(), mine["bitmap"].to_pylist()))


def _send_coarse(width: int, n_buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        c = coarse_hashes(chunk_windows(docs["text"], width).h1, n_buckets)
        return pa.table({
            "bucket": pa.array(c.buckets, pa.int64()), "chunk": pa.array([docs["chunk"][0].as_py()] * len(c.buckets), pa.int64()),
            "block": pa.array([_pack(c.values[a:b]) for a, b in zip(c.cuts[:-1], c.cuts[1:])], pa.binary()),
        })

    return run, "bucket long, chunk long, block binary"


def _reply(chunks: list, bucket: int, step: int, bitmaps: list[np.ndarray]) -> pa.Table:
    """Answers with any bit set."""
    rows = [(c, np.packbits(b).tobytes()) for c, b in zip(chunks, bitmaps) if b.any()]
    return pa.table({
        "chunk": pa.array([c for c, _ in rows], pa.int64()), "step": pa.array([step] * len(rows), pa.int32()),
        "bucket": pa.array([bucket] * len(rows), pa.int64()), "bitmap": pa.array([b for _, b in rows], pa.binary()),
    })


_REPLY = "chunk long, step int, bucket long, bitmap binary"


def _answer_coarse(blocks: pa.Table) -> pa.Table:
    values = [_unpack(b) for b in blocks["block"].to_pylist()]
    _, place, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    cuts = np.cumsum([len(v) for v in values])[:-1]
    return _reply(blocks["chunk"].to_pylist(), blocks["bucket"][0].as_py(), 1, np.split(n[place] > 1, cuts))


def _send_windows(width: int, n_buckets: int, id_type: pa.DataType):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = in_order(docs)
        chunk = chunk_windows(docs["text"], width)
        ids = docs["id"].combine_chunks()
        c = candidates(chunk, _id_ranks(ids), may_repeat(chunk, _answers(replies, 1), n_buckets))
        lead = c.windows[c.lead]
        bucket = (chunk.h1[lead] % np.uint64(n_buckets)).astype(np.int64)
        rows = []
        for k in np.unique(bucket).tolist():
            mine = lead[bucket == k]
            docs_here, at = np.unique(chunk.row[mine], return_inverse=True)
            rows.append((k, chunk.h1[mine].tobytes(), chunk.h2[mine].tobytes(), ids.take(pa.array(docs_here)).to_pylist(), _pack(at), _pack(chunk.start[mine])))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(id_type), pa.binary(), pa.binary()]
        made = dict(zip(["bucket", "h1", "h2", "ids", "doc", "start"], (pa.array(v, t) for v, t in zip(cols, kinds))))
        return pa.table(made | {"chunk": pa.array([docs["chunk"][0].as_py()] * len(rows), pa.int64())})

    return run


def _answer_windows(blocks: pa.Table) -> pa.Table:
    h1, h2 = (np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in blocks[c].to_pylist()]) for c in ("h1", "h2"))
    ids = blocks["ids"].combine_chunks()
    ranks, at = _id_ranks(ids.flatten()), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])
    doc = [_unpack(b) for b in blocks["doc"].to_pylist()]
    rank = np.concatenate([ranks[a + d] for a, d in zip(at[:-1], doc)])
    start = np.concatenate([_unpack(b) for b in blocks["start"].to_pylist()])
    order = np.lexsort((start, rank, h2, h1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    lead = order[new][np.cumsum(new) - 1]  # of each entry in order, its window's first
    late = np.empty(len(order), dtype=bool)
    late[order] = (rank[order] != rank[lead]) | (start[order] != start[lead])
    return _reply(blocks["chunk"].to_pylist(), blocks["bucket"][0].as_py(), 2, np.split(late, np.cumsum([len(d) for d in doc])[:-1]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(width: int, n_buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = in_order(docs)
        chunk = chunk_windows(docs["text"], width)
        c = candidates(chunk, _id_ranks(docs["id"].combine_chunks()), may_repeat(chunk, _answers(replies, 1), n_buckets))
        late = np.zeros(len(c.lead), dtype=bool)
        answers = _answers(replies, 2)
        bucket = (chunk.h1[c.windows[c.lead]] % np.uint64(n_buckets)).astype(np.int64)
        for k, bitmap in answers.items():
            mine = np.flatnonzero(bucket == k)
            late[mine] = _bits(bitmap, len(mine))
        gone = c.windows[late[c.group] | ~c.tied]
        cover = np.zeros(int(chunk.n_words.sum()) + 1, dtype=np.int64)
        np.add.at(cover, chunk.first[gone], 1)
        np.add.at(cover, chunk.first[gone] + width, -1)
        covered = np.cumsum(cover[:-1]) > 0
        bounds = np.concatenate([[0], np.cumsum(chunk.n_words)])
        total = np.concatenate([[0], np.cumsum(covered)])
        removed = total[bounds[1:]] - total[bounds[:-1]]
        kept, spans, row = [], [], 0
        for lo, hi, data, offsets in byte_slices(docs["text"]):
            raw = data.tobytes()
            for i in range(hi - lo):
                words = raw[offsets[i] : offsets[i + 1]].split()
                mine = covered[bounds[row] : bounds[row + 1]]
                if removed[row]:
                    edge = np.flatnonzero(np.diff(mine, prepend=False, append=False)).reshape(-1, 2).tolist()
                    spans.append([{"start": a, "end": b} for a, b in edge])
                    words = [w for w, gone in zip(words, mine.tolist()) if not gone]
                else:
                    spans.append([])
                kept.append(b" ".join(words))
                row += 1
        return pa.table({
            "id": docs["id"].combine_chunks(), "n_words": pa.array(chunk.n_words), "n_removed": pa.array(removed), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "removed": pa.array(spans, _SPANS),
        })

    return run


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW_WORDS, chunk_bytes: int = CHUNK_BYTES, bucket_windows: int = BUCKET_WINDOWS
) -> DataFrame:
    """``(id, n_words, n_removed, kept, removed)`` of every row: the words left, joined by one space, and the
    maximal intervals ``[start, end)`` of removed words.

    Words are separated by ASCII white space and compared unchanged.

    Defined cases: a null, empty or blank text has no words; a null id is
    smaller than every other; rows of one id are one document (an earlier start
    in any of them counts), so exact repeats of a row get equal results and
    don't remove each other; texts shorter than a window are kept; an empty
    table gives no rows; other columns are not read.
    """
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_chunks, n_buckets = max(1, math.ceil(n_bytes / chunk_bytes)), max(1, math.ceil(n_bytes / 6 / bucket_windows))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), *text_key(F.col(text_col)))
    texts = texts.select(F.pmod(F.xxhash64("id", "k1", "k2"), F.lit(n_chunks)).alias("chunk"), "id", "text")
    by_chunk = texts.groupBy("chunk")
    id_type = docs.schema[id_col].dataType

    coarse = by_chunk.applyInArrow(*_send_coarse(width, n_buckets)).groupBy("bucket").applyInArrow(_answer_coarse, _REPLY)
    blocks = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("h1", T.BinaryType()), T.StructField("h2", T.BinaryType()),
                           T.StructField("ids", T.ArrayType(id_type)), T.StructField("doc", T.BinaryType()), T.StructField("start", T.BinaryType()), T.StructField("chunk", T.LongType())])
    sent = by_chunk.cogroup(coarse.groupBy("chunk")).applyInArrow(_send_windows(width, n_buckets, to_arrow_type(id_type)), blocks)
    first = sent.groupBy("bucket").applyInArrow(_answer_windows, _REPLY)
    out = T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
                        T.StructField("removed", T._parse_datatype_string("array<struct<start: long, end: long>>"))])
    return by_chunk.cogroup(coarse.unionAll(first).groupBy("chunk")).applyInArrow(_remove(width, n_buckets), out)
