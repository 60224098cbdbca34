"""Operator 13, periodic runs by internal pattern matching.

A run is a maximal stretch of words with smallest period q and a length of at
least 2 q.  Documents are independent; a task scans the words of a slice of documents (about
1 MB of text, or one longer document) at once:

1. Prefix doubling ranks all blocks of 2^k words within each document; the last
   ranks are the suffix array.  Only blocks that occur again in their document go on.
2. A wavelet tree over the suffix array (as a matrix of bit ranks) answers range
   successor queries: the first place after a given one where a block occurs again.
3. If a run has period q, a block of 2^k words at one of the dyadic places,
   with 2^(k+1) - 1 <= q <= 2^(k+2) - 2, lies in it and occurs again q words
   later.  The starts of a block's occurrences in a window of 2^k places are an
   arithmetic progression, so their number and the first two give all of them:
   the candidate periods.
4. A candidate is extended to both sides by comparing ranks (longest common
   extensions); stretches that are long enough are the runs.

The smallest blocks have four words, at every second place, and stand for periods
1 to 14, as runs have at least `MIN_LENGTH` words.  Everything is exact: words
are numbered by a dictionary of the slice, and no hash is compared.
Memory: about 4 bytes a word for each doubling step until no block repeats
in its document, so 4 x log2(longest repeat) bytes, besides about 100 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.llm.common import NOT_SPACE, binary_array, byte_slices, span_bytes, word_spans

MIN_LENGTH = 12
#: the smallest dyadic block: 2^BASE words, at every STRIDE-th place
BASE, STRIDE = 2, 2


# ---------------------------------------------------------------------------
# ranks of blocks
# ---------------------------------------------------------------------------

class Ranks(NamedTuple):
    """``levels[k][i]``: how many places have a smaller block of 2^k words (a document's end is below every word);
    ``again[k]``: the places, by rank, whose block occurs again in their document."""

    levels: list[np.ndarray]
    again: list[np.ndarray]


def _first_of(new: np.ndarray) -> np.ndarray:
    """For each place in order, where its group begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _changes(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return new


def _grouped(new: np.ndarray) -> np.ndarray:
    """Members of groups of two or more."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return ~alone


def block_ranks(codes: np.ndarray, end: np.ndarray) -> Ranks:
    """`codes`: a number of each word such that no two documents share one; `end`: where its document ends."""
    n = len(codes)
    order = np.argsort(codes)
    new = _changes(codes[order])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = _first_of(new)
    places, width = order[_grouped(new)], 1
    levels, again = [rank.astype(np.int32)], [places]
    while len(places):
        one, after = rank[places], places + width
        two = np.where(after < end[places], rank[np.minimum(after, n - 1)], -1)
        key = one * (n + 1) + two + 1
        order = np.argsort(key)
        places, one, new = places[order], one[order], _changes(key[order])
        rank[places] = one + _first_of(new) - _first_of(_changes(one))
        places, width = places[_grouped(new)], 2 * width
        levels.append(rank.astype(np.int32))
        again.append(places)
    return Ranks(levels, again)


def extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from `a` on equal those from `b` on (a < b)."""
    a, b, n = a.copy(), b.copy(), len(levels[0])
    found = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (b < n) & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        a, b, found = a + step, b + step, found + step
    return found


def extend_back(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words before `a` equal those before `b` (a < b)."""
    a, b = a.copy(), b.copy()
    found = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - (1 << k), b - (1 << k)
        same = (x >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])
        step = same.astype(np.int64) << k
        a, b, found = a - step, b - step, found + step
    return found


# ---------------------------------------------------------------------------
# wavelet tree
# ---------------------------------------------------------------------------

class Wavelet:
    """Order statistics of any range of a sequence of numbers: a bit vector with ranks for each binary digit,
    the numbers sorted stably by the digits above."""

    def __init__(self, values: np.ndarray) -> None:
        self.digits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        for d in range(self.digits - 1, -1, -1):
            zero = values >> d & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many numbers in places [lo, hi) are smaller than `value`."""
        out = np.where(value >> self.digits > 0, hi - lo, 0)
        inside = value >> self.digits == 0
        lo, hi = lo.copy(), hi.copy()
        for zeros, d in zip(self.zeros, range(self.digits - 1, -1, -1)):
            one, a, b = value >> d & 1 == 1, zeros[lo], zeros[hi]
            out += np.where(one & inside, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return out

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest number (from 0) in places [lo, hi)."""
        lo, hi, k, out = lo.copy(), hi.copy(), k.copy(), np.zeros(len(lo), dtype=np.int64)
        for zeros, d in zip(self.zeros, range(self.digits - 1, -1, -1)):
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            out |= one.astype(np.int64) << d
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return out


class Occurrences:
    """Where blocks that occur again are, by suffix array range and window."""

    def __init__(self, ranks: Ranks) -> None:
        self.ranks = ranks
        last, places = ranks.levels[-1], ranks.again[BASE]
        self.places = np.sort(places)  # windows are cut in these; all longer blocks that occur again begin here, too
        by_suffix = places[np.argsort(last[places])]
        self.suffix_ranks = last[by_suffix].astype(np.int64)
        self.tree = Wavelet(np.searchsorted(self.places, by_suffix))

    def ranges(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places whose block of 2^k words occurs again, and the suffix array range of each."""
        places = self.ranks.again[k]
        rank = self.ranks.levels[k][places].astype(np.int64)
        new = _changes(rank)
        size = np.diff(np.append(np.flatnonzero(new), len(rank)))
        return places, np.searchsorted(self.suffix_ranks, rank), np.searchsorted(self.suffix_ranks, rank + size[np.cumsum(new) - 1])

    def progressions(self, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the block with suffix range [lo, hi): its first occurrence in places [first, last], the distance to the second, how many there are."""
        a, b = np.searchsorted(self.places, first), np.searchsorted(self.places, last, "right")
        start, gap, count = (np.zeros(len(lo), dtype=np.int64) for _ in range(3))
        some = np.flatnonzero(a < b)
        before = self.tree.below(lo[some], hi[some], a[some])
        count[some] = self.tree.below(lo[some], hi[some], b[some]) - before
        hit = count[some] > 0
        some, before = some[hit], before[hit]
        start[some] = self.places[self.tree.smallest(lo[some], hi[some], before)]
        hit = count[some] > 1
        some, before = some[hit], before[hit]
        gap[some] = self.places[self.tree.smallest(lo[some], hi[some], before + 1)] - start[some]
        return start, gap, count


# ---------------------------------------------------------------------------
# runs
# ---------------------------------------------------------------------------

def windows_of(k: int) -> list[tuple[int, int]]:
    """Distances at which a block of 2^k words is sought, in windows of at most 2^k."""
    size = 1 << k
    first, last = (1, 4 * size - 2) if k == BASE else (2 * size - 1, 4 * size - 2)
    return [(a, min(a + size - 1, last)) for a in range(first, last + 1, size)]


def candidate_periods(ranks: Ranks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of blocks, and the distances to where they occur again in their windows."""
    found = Occurrences(ranks)
    for k in range(BASE, len(ranks.again)):
        places, lo, hi = found.ranges(k)
        dyadic = places % (STRIDE if k == BASE else 1 << k) == 0
        places, lo, hi = places[dyadic], lo[dyadic], hi[dyadic]
        if not len(places):
            continue
        for near, far in windows_of(k):
            start, gap, count = found.progressions(lo, hi, places + near, places + far)
            hit = count > 0
            p, start, gap, count = places[hit], start[hit], gap[hit], count[hit]
            # three occurrences: the block has period `gap`.  Those within the stretch of that period around it
            # can't begin a longer smallest period, as the stretch would have the shorter one.
            stretch = np.full(len(p), -1, dtype=np.int64)
            many = count > 2
            stretch[many] = p[many] + gap[many] + extend(ranks.levels, p[many], p[many] + gap[many])
            item = np.repeat(np.arange(len(p)), count)
            at = start[item] + gap[item] * (np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count))
            new = (at + (1 << k) > stretch[item]) | (at - p[item] == gap[item])
            yield p[item][new], (at - p[item])[new]


def find_runs(codes: np.ndarray, end: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs of `min_length` words or more, by start and period."""
    if min_length < MIN_LENGTH:
        raise ValueError(f"blocks of {1 << BASE} words find runs of {MIN_LENGTH} words or more")
    none = np.empty(0, dtype=np.int64)
    if len(codes) < min_length:
        return none, none, none
    ranks = block_ranks(codes, end)
    if len(ranks.again) <= BASE or not len(ranks.again[BASE]):
        return none, none, none
    kept = []
    for p, q in candidate_periods(ranks):
        start = p - extend_back(ranks.levels, p, p + q)
        stop = p + q + extend(ranks.levels, p, p + q)
        long = stop - start >= np.maximum(2 * q, min_length)
        kept.append(np.unique(np.column_stack([start, stop, q])[long], axis=0))
    start, stop, period = np.concatenate(kept).T if kept else (none, none, none)
    # multiples of a run's period give the same stretch: the smallest is first
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = _changes(start) | _changes(stop)
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


# ---------------------------------------------------------------------------
# documents
# ---------------------------------------------------------------------------

def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A number of each word's spelling and row."""
    if not len(starts):
        return np.empty(0, dtype=np.int64)
    spelled = binary_array(span_bytes(data, starts, ends - starts), ends - starts).dictionary_encode()
    return row * len(spelled.dictionary) + spelled.indices.to_numpy().astype(np.int64)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """By row, its words joined by one space."""
    last = np.ones(len(row), dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    lengths = ends - starts + ~last
    text = span_bytes(data, starts, lengths)
    stops = np.cumsum(lengths)
    text[stops[~last] - 1] = 32
    offsets = np.concatenate([[0], stops])[np.searchsorted(row, np.arange(rows + 1))]
    return binary_array(text, np.diff(offsets)).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(min_length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1)):
                starts, ends, bounds = word_spans(data, offsets, NOT_SPACE)
                n_words, rows = np.diff(bounds), hi - lo
                row = np.repeat(np.arange(rows), n_words)
                begin, stop, period = find_runs(word_codes(data, starts, ends, row), bounds[1:][row], min_length)
                # words after the first period of a run that holds them
                cover = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(cover, begin + period, 1)
                np.add.at(cover, stop, -1)
                kept = np.cumsum(cover[:-1]) == 0
                doc = row[begin]
                found = pa.StructArray.from_arrays([pa.array(begin - bounds[doc]), pa.array(stop - begin), pa.array(period)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, rows), pa.array(n_words),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(rows + 1)), pa.int32()), found),
                    joined(data, starts[kept], ends[kept], row[kept], rows),
                ], names=["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` of every row: all runs ``(start, length, period)`` by start and period, and
    the words left when each run keeps its first period only, joined by one space.

    Words are separated by ASCII white space and compared unchanged.

    Defined cases: a null, empty or blank text has no words and no runs; each row is a document of its own, also if rows
    are equal or share an id; a null id stays null; runs that overlap are all listed, and a word goes if any run
    drops it; an empty table gives no rows; other columns are not read.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T._parse_datatype_string("array<struct<start: long, length: long, period: long>>")), T.StructField("collapsed", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(_scan(min_length), schema)
