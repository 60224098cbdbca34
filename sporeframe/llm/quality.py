"""Operator 7, quality classifier: similarity-weighted votes of labelled latent-semantic vectors.

Terms of a text are its lower-cased words and its words' shapes (runs of
capitals, small letters and digits count once, other signs stay), each hashed to
``TERMS`` columns, and one term for words that repeat the word before.  Document
frequencies are counted over all documents.  The latent space (truncated SVD of
tf-idf rows) and the voters come from at most ``max_voters`` labelled rows, half
of each label.  The voters' unit vectors are broadcast (``max_voters`` x ``rank``
floats, a fixed bound); every document meets all of them in blocked exact cosine
products, and its ``neighbours`` nearest vote with their similarity, weighted so
that each label's votes together follow the square root of its share among all
labelled rows (half-way between its share and equal labels, as rare labels would
else be outvoted).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.llm.common import LOWER, NOT_SPACE, byte_slices, replace_columns, span_hash, word_spans

TERMS = 4096  # two families of half as many columns
BLOCK_ROWS = 512
_REPEAT = TERMS - 1

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = ord("A"), ord("a"), ord("0"), ord("a")


def term_counts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(first row, counts)``: term counts of blocks of rows, one column per term."""
    starts, ends, bounds = word_spans(data, offsets, NOT_SPACE)
    h = span_hash(71)
    words = h.spans(h.byte_prefix(LOWER[data]), starts, ends)
    # shapes: drop bytes that continue a run, then hash what is left of each word
    shape = _SHAPE[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = h.spans(h.byte_prefix(shape[keep]), at[starts], at[ends])
    half = np.uint64(TERMS // 2)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = words[1:] == words[:-1]
    again[bounds[:-1][bounds[:-1] < len(words)]] = False
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    term_a, term_b = (words % half).astype(np.int64), (shapes % (half - np.uint64(1)) + half).astype(np.int64)
    for lo in range(0, len(offsets) - 1, BLOCK_ROWS):
        hi = min(lo + BLOCK_ROWS, len(offsets) - 1)
        mine = slice(bounds[lo], bounds[hi])
        base = (row[mine] - lo) * TERMS
        keys = np.concatenate([base + term_a[mine], base + term_b[mine], base[again[mine]] + _REPEAT])
        yield lo, np.bincount(keys, minlength=(hi - lo) * TERMS).reshape(hi - lo, TERMS)


class Model(NamedTuple):
    idf: np.ndarray      # TERMS
    basis: np.ndarray    # TERMS x rank
    voters: np.ndarray   # voters x rank, unit rows
    votes: np.ndarray    # weight of each voter's vote
    labels: np.ndarray   # 0 or 1
    neighbours: int
    prior: float         # share of label 1, the score of a text without words


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf rows of length one (zero rows stay zero)."""
    x = np.log1p(counts, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(model: Model, counts: np.ndarray) -> np.ndarray:
    """Score of each row of term counts."""
    out = np.full(len(counts), model.prior)
    full = counts.any(axis=1)
    if full.any():
        cosine = _unit(_weigh(counts[full], model.idf) @ model.basis) @ model.voters.T
        k = min(model.neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        similarity = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64)
        weight = similarity**16 * model.votes[near]
        out[full] = (weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many rows each term occurs, and the number of rows; TERMS numbers come to the driver."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in byte_slices(batch.column(0)):
                for _, counts in term_counts(data, offsets):
                    df += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(df, n))], names=["term", "n"])

    rows = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()
    out = np.zeros(TERMS + 1, dtype=np.int64)
    for term, n in rows:
        out[term] = n
    return out[:TERMS], int(out[TERMS])


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_voters: int = 6000, rank: int = 64, neighbours: int = 25, seed: int = 7,
) -> Model:
    """Fit on at most `max_voters` labelled ids for which `usable` (an expression over the id) holds.

    Defined cases: an id with several labels has the larger one; an id with several rows counts once, with its
    smallest text; a null text counts as empty; null ids, null and other labels, and labels without a row
    are left out; document frequencies count every row of `docs`; without any labelled row every score is 1.
    """
    df, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(usable)
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = []
    for label in (0, 1):
        chosen = known.where(F.col("label") == label).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(max_voters // 2)
        parts.append(chosen.select(F.col(id_col).alias("_id"), "label"))
    sample = docs.select(id_col, text_col).join(F.broadcast(parts[0].unionAll(parts[1])), F.col(id_col) == F.col("_id"))
    sample = sample.groupBy(F.col("_id").cast("string").alias("key"), "label").agg(F.coalesce(F.min(text_col), F.lit("")).alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(2)):
                for first, counts in term_counts(data, offsets):
                    mine = batch.slice(lo + first, len(counts))
                    packed = pa.array([_pack(c) for c in counts], pa.binary())
                    yield pa.RecordBatch.from_arrays([mine.column(0), mine.column(1), packed], names=["key", "label", "counts"])

    # a row of counts holds its non-zero terms only; the id's hash puts the rows in a repeatable order
    rows = sorted(sample.mapInArrow(count, "key string, label int, counts binary").collect())
    if not rows:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((1, 1), np.float32), np.ones(1), np.full(1, 1.0), 1, 1.0)
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    x = np.stack([_weigh(_unpack(r["counts"])[None], idf)[0] for r in rows])
    rank = min(rank, *x.shape)
    basis = np.random.default_rng(seed).standard_normal((TERMS, rank + 16)).astype(np.float32)
    for _ in range(4):  # subspace iteration towards the leading right singular vectors
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    basis = (basis @ vt.T)[:, :rank].astype(np.float32)
    here = np.array([(y == 0).sum(), (y == 1).sum()])
    # between the labels' own shares and equal ones: the geometric mean of both weights
    share = np.sqrt(np.array([sizes.get(0, 0), sizes.get(1, 0)])) / np.maximum(here, 1)
    prior = sizes.get(1, 0) / sum(sizes.values())
    return Model(idf, basis, _unit(x @ basis).astype(np.float32), share[y.astype(int)], y, neighbours, prior)


def _pack(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return np.stack([at, counts[at]]).astype(np.int32).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    at, n = np.frombuffer(packed, dtype=np.int32).reshape(2, -1)
    out = np.zeros(TERMS, dtype=np.int64)
    out[at] = n
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` plus ``score_col`` in 0..1: the higher, the likelier label 1.

    Defined cases: a null, empty or blank text has no terms and gets label 1's
    share among the labelled rows; without any labelled row every score is 1;
    equal texts get equal scores; an empty table stays empty; an input column
    of the score's name is replaced, others pass unread.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(replace_columns(docs, {score_col: F.lit(0.0)}))
    names = out.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = np.concatenate([vote(shared.value, c) for _, _, d, o in byte_slices(batch.column(text_col)) for _, c in term_counts(d, o)])
                yield pa.RecordBatch.from_arrays([pa.array(scores) if c == score_col else batch.column(c) for c in names], names=names)

    return out.mapInArrow(run, T.StructType(out.schema.fields[:-1] + [T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never train a model: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
