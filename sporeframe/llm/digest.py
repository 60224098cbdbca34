"""Operator 11, document fingerprints: quartile bucket digests.

Every three neighbouring bytes of a text are hashed into one of 256 buckets.
The digest keeps, for each bucket, the quartile of its count among all counts
(two bits), the ratios of the quartiles and the logarithm of the length; two
digests are compared by a difference score that is bounded (`MOST` and above
are alike in nothing), so the likeness lies between 0 and 1.

`digests` turns a column of texts into digests and `likeness` compares two
columns of them.  `compare_neighbours` also fingerprints each text with its end
replaced by the start of the next document: documents are range-partitioned by
id once, each sorted partition is read in a stream that holds one text back,
and only the last text of a partition meets the first of the next by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.llm.common import byte_slices, materialise

BUCKETS = 256
#: multiplier of the triplet hash (32-bit golden ratio); the upper eight bits of the product are the bucket
SPREAD = 2654435761
#: what two bucket codes 0, 1, 2 or 3 apart add to the difference
APART = np.array([0, 1, 2, 6], dtype=np.int64)
#: what one step of the length and of a quartile ratio adds, and the most that each of the three may add
STEP, HEADER_MOST = 2, 24
#: difference from which two digests are alike in nothing
MOST = 320


def length_code(n: np.ndarray) -> np.ndarray:
    """Logarithm of a length in quarter steps: 4 x the number of its highest bit + the two bits below."""
    n = n.astype(np.int64)
    top = np.zeros(len(n), dtype=np.int64)
    for shift in (32, 16, 8, 4, 2, 1):
        more = n >> (top + shift) > 0
        top += np.where(more, shift, 0)
    return np.where(n < 4, n, 4 * top + ((n >> np.maximum(top - 2, 0)) & 3))


def quartile_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By row: length code, two quartile ratios, then the code of every bucket."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * BUCKETS, dtype=np.int64)
    if len(data) > 2:
        wide = data.astype(np.uint32)
        bucket = (((wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]) * np.uint32(SPREAD)) >> np.uint32(24)
        row = np.repeat(np.arange(rows), np.diff(offsets))
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * BUCKETS + bucket[inside], minlength=rows * BUCKETS)
    counts = counts.reshape(rows, BUCKETS)
    ranked = np.sort(counts, axis=1)
    quarters = [ranked[:, k * BUCKETS // 4 - 1] for k in (1, 2, 3)]
    third = np.maximum(quarters[2], 1)
    ratios = [np.minimum(16 * q // third, 15) for q in quarters[:2]]
    codes = sum((counts > q[:, None]).astype(np.uint8) for q in quarters)
    return np.column_stack([length_code(np.diff(offsets)), *ratios, codes]).astype(np.uint8)


def text_codes(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    found = [quartile_codes(data, offsets) for _, _, data, offsets in byte_slices(texts)]
    return np.concatenate(found) if found else np.empty((0, BUCKETS + 3), dtype=np.uint8)


def to_digest(codes: np.ndarray) -> list[str]:
    """Lowercase hex: length (2 digits), ratios (2), buckets (four to a byte, the first in the upper bits)."""
    if not len(codes):
        return []
    body = codes[:, 3:].reshape(len(codes), -1, 4)
    body = (body[:, :, 0] << 6) | (body[:, :, 1] << 4) | (body[:, :, 2] << 2) | body[:, :, 3]
    packed = np.column_stack([codes[:, 0], (codes[:, 1] << 4) | codes[:, 2], body]).astype(np.uint8)
    whole = packed.tobytes().hex()
    width = 2 * packed.shape[1]
    return [whole[i : i + width] for i in range(0, len(whole), width)]


def from_digest(digests: list[str]) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex("".join(digests)), dtype=np.uint8).reshape(len(digests), -1)
    body = np.stack([packed[:, 2:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(digests), -1)
    return np.column_stack([packed[:, 0], packed[:, 1] >> 4, packed[:, 1] & 15, body])


def code_likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal codes, 0 for a difference of `MOST` or more."""
    gap = np.abs(a.astype(np.int16) - b.astype(np.int16))
    score = APART[gap[:, 3:]].sum(axis=1) + np.minimum(STEP * gap[:, :3].astype(np.int64), HEADER_MOST).sum(axis=1)
    return 1 - np.minimum(score, MOST) / MOST


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row; a null text counts as empty, a null id stays null, other columns are not read."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_digest(text_codes(batch.column(1))), pa.string())], names=["id", "fingerprint"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Likeness of two columns of digests (null if either is null)."""
    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        out = pd.Series(np.full(len(x), np.nan))
        both = (x.notna() & y.notna()).to_numpy()
        if both.any():
            out[both] = code_likeness(from_digest(x[both].tolist()), from_digest(y[both].tolist()))
        return out

    return compare(a, b)


# ---------------------------------------------------------------------------
# a document, the next one, and the text between them
# ---------------------------------------------------------------------------

def edited(text: str, following: str, share: int) -> str:
    """`text` with its last ``len / share`` code points replaced by as many first ones of `following` (or all)."""
    n = len(text) // share
    return text[: len(text) - n] + following[:n] if n else text


def _compare(ids: pa.Array, texts: list[str], codes: np.ndarray, nexts: list[str], next_codes: np.ndarray, share: int) -> list[pa.Array]:
    changed = [edited(t, n, share).encode() for t, n in zip(texts, nexts)]
    changed_codes = text_codes(pa.array(changed, pa.binary()).cast(pa.string()))
    return [
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
        pa.array(to_digest(codes), pa.string()), pa.array(to_digest(changed_codes), pa.string()),
        pa.array(code_likeness(codes, changed_codes)), pa.array(code_likeness(codes, next_codes)),
    ]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE = ["part", "first_text", "last_text"]


def _stream(names: list[str], share: int, rows: int = 1024) -> Callable:
    """Results of a sorted partition's rows but the last, and one more row with the partition's first and last text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), None, None
        for batch in (b.slice(lo, rows) for b in batches for lo in range(0, b.num_rows, rows)):
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            codes = text_codes(batch.column(1))
            if held:
                ids = pa.concat_arrays([held[0], ids])
                texts, codes = [held[1], *texts], np.concatenate([held[2], codes])
            else:
                first = texts[0]
            n = len(texts) - 1
            made = _compare(ids[:-1], texts[:-1], codes[:-1], texts[1:], codes[1:], share)
            edge = [pa.array([part] * n, pa.int32()), *[pa.nulls(n, pa.string())] * 2]
            held = ids[-1:], texts[-1], codes[-1:]
            yield pa.RecordBatch.from_arrays(made + edge, names=names)
        if held:
            none = [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.string())] * 3, *[pa.nulls(1, pa.float64())] * 2]
            yield pa.RecordBatch.from_arrays([held[0], *none, pa.array([part], pa.int32()), pa.array([first]), pa.array([held[1]])], names=names)

    return run


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row.

    The edited text is the row's text with its last ``floor(n_chars / share)``
    code points replaced by the first as many (or all) of the next row's;
    ``near_edited`` is the likeness of the row's fingerprint to the edited
    text's, ``near_next`` to the next row's.

    Defined cases: rows go by ascending id, null first, and rows of one id by
    the hash of their text; the row after the last is the first, so a single
    row is its own next; a null text counts as empty; an empty table gives no
    rows; other columns are not read.  Repeated rows follow one another.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # equal ids may be many: the hash and the row's number let a range end between them
    order = ["id", F.xxhash64("text"), F.monotonically_increasing_id()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2])
    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string(_RESULT).fields,
                         T.StructField("part", T.IntegerType()), T.StructField("first_text", T.StringType()), T.StructField("last_text", T.StringType())])
    found = materialise(ordered.mapInArrow(_stream(kind.names, share), kind), "digest-neighbours", "zstd")
    result = kind.names[: -len(_EDGE)]

    edges = found.where("last_text is not null").select("id", *_EDGE)
    parts = sorted(r[0] for r in edges.select("part").collect())  # one number per partition
    if not parts:
        return found.select(*result)
    pairs = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    last = edges.select("id", "part", "last_text").join(F.broadcast(pairs), "part")
    met = last.join(edges.select(F.col("part").alias("next"), "first_text"), "next").select("id", "last_text", "first_text")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            a, b = batch.column("last_text"), batch.column("first_text")
            yield pa.RecordBatch.from_arrays(_compare(batch.column("id"), a.to_pylist(), text_codes(a), b.to_pylist(), text_codes(b), share), names=result)

    closed = met.mapInArrow(close, T.StructType(kind.fields[: -len(_EDGE)]))
    return found.where("last_text is null").select(*result).unionAll(closed)
