"""DNA sequence functions.

Built-in expressions where Spark has them (motif counts, GC, windows,
tokens).  The dense k-mer count vector is a scalar pandas UDF: counting
into a 4^k array is one ``np.bincount`` per sequence, where a SQL
``aggregate`` would rewrite the whole 4^k array for every k-mer.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str

# Base order of the k-mer vocabulary and of one-hot / class codes.
BASES = "ACGT"
# The four motifs counted in the MPRA feature table.
MPRA_MOTIFS = ("TGTAAATA", "TGCAT", "ATATTC", "TTTTTTA")


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def motif_count(seq: ColumnOrName, motif: str) -> Column:
    """Non-overlapping occurrences of a literal motif (F13, ``str.count``)."""
    return F.regexp_count(_c(seq), F.lit(re.escape(motif)))


def gc_fraction(seq: ColumnOrName) -> Column:
    """(G + C) / length (F14); NULL for an empty sequence."""
    s = _c(seq)
    return F.try_divide(F.length(s) - F.length(F.translate(s, "GC", "")), F.length(s))


def truncate(seq: ColumnOrName, n: int) -> Column:
    """First ``n`` letters."""
    return F.substring(_c(seq), 1, n)


def chunks(seq: ColumnOrName, size: int) -> Column:
    """Consecutive pieces of ``size`` letters, the shorter tail kept."""
    s = _c(seq)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(s), F.lit(size)), lambda i: F.substring(s, i, size))
    )


def kmers(seq: ColumnOrName, k: int, overlap: bool = True) -> Column:
    """k-mers with stride 1 (F18) or stride k with the tail dropped.
    Shorter than k gives an empty array (``sequence`` would fail)."""
    s = _c(seq)
    step = 1 if overlap else k
    return F.when(F.length(s) < k, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(s) - k + 1, F.lit(step)), lambda i: F.substring(s, i, k))
    )


def kmer_index(kmer: ColumnOrName) -> Column:
    """Base-4 index of a k-mer (A0 C1 G2 T3), the position in the
    ``itertools.product('ACGT')`` order; NULL when it holds other letters."""
    km = _c(kmer)
    return F.when(km.rlike("^[ACGT]+$"), F.conv(F.translate(km, BASES, "0123"), 4, 10).cast("int"))


_LUT = np.full(256, 255, dtype=np.uint8)
for _code, _base in enumerate(BASES):
    _LUT[ord(_base)] = _code
_LUT[ord("N")] = 4


def _kmer_windows(seqs: list[str], k: int, overlap: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and base-4 index of every window without N, all sequences at once.

    The index is built letter by letter over the joined text, so memory grows
    with the letters and not with letters times k."""
    lens = np.fromiter((len(x) for x in seqs), dtype=np.int64, count=len(seqs))
    codes = _LUT[np.frombuffer("".join(seqs).encode("ascii", "replace"), dtype=np.uint8)]
    if (codes == 255).any():
        raise ValueError("k-mers: letters other than A, C, G, T, N")
    ends = np.cumsum(lens)
    n = max(0, len(codes) - k + 1)
    index, bad = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for j in range(k if n else 0):
        part = codes[j:j + n]
        index = index * 4 + (part & 3)
        bad |= part == 4
    row = np.repeat(np.arange(len(seqs)), lens)[:n]
    at = np.arange(n) - (ends - lens)[row]
    good = ~bad & (at + k <= lens[row])
    if not overlap:
        good &= at % k == 0
    return row[good], index[good]


def _spans(lengths: list[int], max_rows: int, max_letters: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Consecutive rows of bounded number and letters (a longer text is a block of its own)."""
    lo = letters = 0
    for i, n in enumerate(lengths):
        if i > lo and (i - lo >= max_rows or letters + n > max_letters):
            yield lo, i
            lo, letters = i, 0
        letters += n
    if lengths:
        yield lo, len(lengths)


def _blocks(text: list[str], max_rows: int) -> Iterator[tuple[int, int]]:
    return _spans([len(x) for x in text], max_rows)


def _kmer_matrix(text: list[str], k: int, overlap: bool, divide: bool, log: bool, drop_last: bool) -> np.ndarray:
    """Counts of all 4^k k-mers, a row for each sequence."""
    size = 4 ** k
    row, index = _kmer_windows(text, k, overlap)
    if drop_last:
        keep = index < size - 1
        row, index = row[keep], index[keep]
    counts = np.bincount(row * size + index, minlength=len(text) * size).reshape(len(text), size).astype(np.float64)
    if divide:
        lens = np.fromiter((len(x) for x in text), dtype=np.float64, count=len(text))
        counts = counts / np.where(lens > 0, lens, 1.0)[:, None]
    if log:
        counts = np.log(counts + 1)
    return counts


def _kmer_vector_np(seqs: pd.Series, k: int, overlap: bool, divide: bool, log: bool, drop_last: bool) -> pd.Series:
    valid = seqs.notna().to_numpy()
    text = seqs.where(valid, "").tolist()
    out: list = []
    for lo, hi in _blocks(text, max(1, (1 << 23) // 4 ** k)):  # a block's count matrix stays near 64 MB
        out.extend(_kmer_matrix(text[lo:hi], k, overlap, divide, log, drop_last))
    return pd.Series([v if ok else None for v, ok in zip(out, valid)], dtype=object)


def with_kmer_vectors(df: DataFrame, vectors: dict[str, tuple[str, int]], overlap: bool = True, keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all, by default) and, for each name of ``vectors``, the ``kmer_vector`` of its (column, k).

    All vectors of a row come from one pass, in blocks of about 8 MB that go back at once: a worker's memory
    depends on neither the rows of an Arrow batch nor the number of vectors.  NULL gives NULL."""
    keep = list(df.columns if keep is None else keep)
    sources = list(dict.fromkeys(c for c, _ in vectors.values()))
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(v, T.ArrayType(T.DoubleType())) for v in vectors)])
    max_rows = max(1, (1 << 20) // sum(4 ** k for _, k in vectors.values()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max_rows):
                part = batch.slice(at, max_rows)
                columns = part.columns[len(sources):]
                text = {c: part.column(i).to_pylist() for i, c in enumerate(sources)}
                lengths = [max(len(t or "") for t in row) for row in zip(*text.values())]
                for lo, hi in _spans(lengths, max_rows):
                    made = []
                    for c, k in vectors.values():
                        mine = text[c][lo:hi]
                        counts = _kmer_matrix([x or "" for x in mine], k, overlap, False, False, False)
                        null = np.array([x is None for x in mine])
                        ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * np.int32(4 ** k))
                        made.append(pa.ListArray.from_arrays(ends, pa.array(counts.ravel()), mask=pa.array(null) if null.any() else None))
                    yield pa.RecordBatch.from_arrays([*(x.slice(lo, hi - lo) for x in columns), *made], names=schema.names)

    rows = df.select(*[F.col(f"`{c}`").alias(f"_s{i}") for i, c in enumerate(sources)], *[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(run, schema)


def kmer_pairs(df: DataFrame, id_col: str, seq_col: str, k: int, overlap: bool = True) -> DataFrame:
    """``(id, kmer_index, n)`` of the k-mers present in each row (F17-F19, sparse): the same counts and the
    same rule for letters as ``kmer_vector``, for any k up to 31."""
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).fill_null("").to_pylist()
            for lo, hi in _blocks(text, len(text)):
                row, index = _kmer_windows(text[lo:hi], k, overlap)
                order = np.lexsort((index, row))
                row, index = row[order], index[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (index[1:] != index[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[at] + lo)), pa.array(index[at]), pa.array(np.diff(np.append(at, len(row))))],
                    names=[id_col, "kmer_index", "n"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("kmer_index", T.LongType()),
                           T.StructField("n", T.LongType())])
    return df.select(id_col, seq_col).mapInArrow(run, schema)


def kmer_vector(seq: ColumnOrName, k: int, overlap: bool = True, divide: bool = False, log: bool = False,
                leave_one_out: bool = False) -> Column:
    """Dense k-mer count vector of length 4^k.

    Windows holding N are skipped; ``divide`` divides by the sequence length
    (not the window count), then ``log`` applies ln(1 + x);
    ``leave_one_out`` skips the windows of the last (all-T) k-mer, whose slot
    stays 0 (the width is 4^k as without it).  Other letters raise.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _vec(s: pd.Series) -> pd.Series:
        return _kmer_vector_np(s, k, overlap, divide, log, leave_one_out)

    # non-deterministic for the optimizer, so that a filter on the vector never evaluates it a second time
    return _vec.asNondeterministic()(_c(seq))


def one_hot(seq: ColumnOrName, dim: int = 5, strict: bool = True) -> Column:
    """One-hot rows per letter (F22), A C G T in slots 0-3.  ``strict``
    raises on other letters (as the reference); else they use slot 4."""
    letters = F.split(_c(seq), "")

    def enc(b: Column) -> Column:
        pos = F.instr(F.lit(BASES), b) - 1
        if strict:
            pos = F.when(pos >= 0, pos).otherwise(F.raise_error(F.concat(F.lit("one_hot: bad letter "), b)))
        else:
            pos = F.when(pos >= 0, pos).otherwise(F.lit(4))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.when(j == pos, 1.0).otherwise(0.0))

    return F.transform(letters, enc)


def class_labels(seq: ColumnOrName) -> Column:
    """Letter to class 0-3 (F23); other letters raise."""
    def enc(b: Column) -> Column:
        pos = F.instr(F.lit(BASES), b) - 1
        return F.when(pos >= 0, pos).otherwise(F.raise_error(F.concat(F.lit("class label: bad letter "), b)))
    return F.transform(F.split(_c(seq), ""), enc)


def species_sentence(species: ColumnOrName, seq: ColumnOrName, k: int = 6) -> Column:
    """Species token then the stride-1 k-mers, space separated."""
    return F.concat_ws(" ", _c(species), F.array_join(kmers(seq, k, overlap=True), " "))


# Special tokens at the head of the k-mer vocabulary, in id order.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


def kmer_vocabulary(k: int = 6, specials: tuple[str, ...] = SPECIAL_TOKENS, extra: tuple[str, ...] = ()) -> dict[str, int]:
    """Rule-built vocabulary: specials, then every k-mer in ACGT product
    order, then ``extra`` tokens (e.g. species names).  4^k + few entries."""
    from itertools import product

    vocab = {t: i for i, t in enumerate(specials)}
    for km in ("".join(p) for p in product(BASES, repeat=k)):
        vocab[km] = len(vocab)
    for t in extra:
        vocab.setdefault(t, len(vocab))
    return vocab


def token_ids(tokens: ColumnOrName, vocab: dict[str, int] | None = None, max_len: int = 512, k: int = 6,
              cls: str = "[CLS]", sep: str = "[SEP]", pad: str = "[PAD]", unk: str = "[UNK]", lead: Column | None = None) -> Column:
    """Struct ``(input_ids, attention_mask)`` (F25): ``[CLS]`` + the first
    ``max_len - 2`` token ids + ``[SEP]``, padded with ``[PAD]`` to
    ``max_len``; unknown tokens map to ``[UNK]``.  ``lead`` is an id that goes
    before the tokens (the species token's, from a joined table) and counts
    as one of them.

    With ``vocab=None`` the vocabulary is ``kmer_vocabulary(k)`` and an id is
    computed (specials + base-4 index), O(1) per token.  A caller-supplied
    ``vocab`` ships as a map literal with the plan; Spark looks keys up by
    scanning, so keep such vocabularies small.
    """
    if vocab is None:
        rule = kmer_vocabulary(0)
        offset = len(SPECIAL_TOKENS)
        ids_of = {t: rule[t] for t in (cls, sep, pad, unk)}

        def lookup(t: Column) -> Column:
            return F.coalesce(F.when(F.length(t) == k, kmer_index(t) + offset), F.lit(ids_of[unk]))
    else:
        ids_of = vocab
        vmap = F.create_map(*[x for t, i in vocab.items() for x in (F.lit(t), F.lit(i))])

        def lookup(t: Column) -> Column:
            return F.coalesce(F.element_at(vmap, t), F.lit(vocab[unk]))

    body = F.transform(F.slice(_c(tokens), 1, max_len - 2 - (lead is not None)), lookup)
    if lead is not None:
        body = F.concat(F.array(lead.cast("int")), body)
    ids = F.concat(F.array(F.lit(ids_of[cls])), body, F.array(F.lit(ids_of[sep])))
    n_pad = F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))
    padded = F.concat(ids, F.array_repeat(F.lit(ids_of[pad]), n_pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), n_pad))
    return F.struct(padded.alias("input_ids"), mask.alias("attention_mask"))


def special_run(ids: ColumnOrName, special_ids: list[int], where: str = "left") -> Column:
    """Length of the leading (``where="left"``) or trailing run of special
    ids (F26), folded with a ``(n, going)`` state that stops at the first
    ordinary id."""
    arr = _c(ids) if where == "left" else F.reverse(_c(ids))
    specials = F.array(*[F.lit(i) for i in special_ids])
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("go"))

    def step(acc: Column, x: Column) -> Column:
        hit = acc["go"] & F.array_contains(specials, x)
        return F.struct(F.when(hit, acc["n"] + 1).otherwise(acc["n"]).alias("n"), hit.alias("go"))

    return F.aggregate(arr, start, step, lambda acc: acc["n"])
