"""Operator 10, packing: minimum bin slack by bitset subset sums.

Each task tokenises its own documents and packs them, so no token is ever
shuffled.  Whole windows are cut from long documents; what remains of each
document is one length of a multiset.  A window takes the longest remaining
piece as its seed, and a subset-sum dynamic programme over a Python integer
used as a bitset finds the multiset of other lengths whose sum is closest to
the room left; the counts are read back through the recorded bitsets.  A
multiset that fills its window exactly is used as often as the counts allow.
Where no multiset fills the window, its slack is filled by a piece cut from the
longest remaining one.  Pieces left over wait for the task's next documents;
at the end of the task they are laid out as sequences whose lengths are powers
of two, which need no padding.

Memory: at most ``buffer_tokens`` plus one document are held at a time.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sporeframe.llm.common import LOWER, NOT_SPACE, binary_array, byte_slices, span_bytes, word_spans

CAPACITY = 4096
END_ID = 2
#: the longest run of letters (bytes) that `Merges` takes
LONGEST = 32
_OTHER, _LETTER, _SIGN = 0, 1, 2
#: ASCII signs without the apostrophe, which may begin a contraction
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[97:123] = _LETTER
for _lo, _hi in ((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
    _KIND[_lo : _hi + 1] = _SIGN


def _kinds(data: np.ndarray) -> np.ndarray:
    """Of each byte: part of a small Latin letter (a-z, \u00df-\u00f6, \u00f8-\u00ff), a sign, or something else."""
    kind = _KIND[data]
    pair = np.flatnonzero((data[:-1] == 0xC3) & (((data[1:] >= 0x9F) & (data[1:] <= 0xB6)) | ((data[1:] >= 0xB8) & (data[1:] <= 0xBF))))
    kind[pair] = kind[pair + 1] = _LETTER
    return kind


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """White-space separated pieces, and where each row's begin in them (rows + 1 numbers).

    Capitals become small where the tokenizer comes to the same ids: it
    looks for special tokens first, then composes (NFC), then lowers, so only
    pure ASCII without ``<|`` may be lowered before it.
    """
    starts, ends, bounds = word_spans(data, offsets, NOT_SPACE)
    lengths = ends - starts
    kept = data >= 0x80
    kept[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    before = np.concatenate([[0], np.cumsum(kept)])
    text = span_bytes(data, starts, lengths)
    small = LOWER[text]
    as_is = np.flatnonzero(before[ends] > before[starts])
    at = np.cumsum(lengths) - lengths
    spots = span_bytes(np.arange(len(text)), at[as_is], lengths[as_is])
    small[spots] = text[spots]
    return binary_array(small, lengths), bounds


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] .. starts[i] + lengths[i] - 1``, one after another."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


class Merges:
    """Byte-pair merges of many words at once.

    Words are rows of symbols.  In each step every word merges its pair of the lowest rank, the leftmost of
    equal ones, until no word has a known pair.  Pairs are looked up in an open-addressing hash table.
    """

    BITS = 19

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner, self.last = (np.array([vocab[letter[b] + end] for b in range(256)], dtype=np.int32) for end in ("", "</w>"))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.width = max(vocab.values()) + 1
        self.rank_of_none = np.int32(len(pairs))
        self.keys = np.full(1 << self.BITS, -1, dtype=np.int64)
        self.values = np.full((1 << self.BITS, 2), len(pairs), dtype=np.int32)
        if 4 * len(pairs) > len(self.keys):
            raise ValueError("too many merges for the table")
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] * self.width + vocab[b]
            slot = int(self._slots(np.array([key]))[0])
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.values[slot] = key, (rank, vocab[a + b])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged symbol of each pair; -1 stands for no symbol."""
        keys = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * self.width + right)
        slots = self._slots(keys)
        seen = self.keys[slots]
        out = self.values[slots]
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        out[seen == -1] = self.rank_of_none
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.BITS) - 1)
            seen = self.keys[slots[open_]]
            out[open_] = np.where((seen == keys[open_])[:, None], self.values[slots[open_]], self.rank_of_none)
            open_ = open_[(seen != keys[open_]) & (seen != -1)]
        return out

    def _band(self, symbols: np.ndarray) -> np.ndarray:
        """Merged rows, -1 after each word's last symbol."""
        n, width = symbols.shape
        if width < 2:
            return symbols
        found = self.look_up(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1, 2)
        # one column more on either side, so every place has neighbours
        ranks = np.full((n, width), self.rank_of_none, dtype=np.int32)
        into = np.zeros((n, width), dtype=np.int32)
        ranks[:, :-1], into[:, :-1] = found[:, :, 0], found[:, :, 1]
        out, rows, cols = symbols.copy(), np.arange(n), np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            mine = np.arange(len(rows))
            live = ranks[mine, at] < self.rank_of_none
            if not live.all():
                out[rows[~live]] = symbols[~live]
                symbols, ranks, into, rows, at = symbols[live], ranks[live], into[live], rows[live], at[live]
                mine = np.arange(len(rows))
                if not len(rows):
                    break
            merged = into[mine, at]
            # what is right of the pair moves one place to the left; the last column is empty then
            move = (cols[None, :] > at[:, None]) + np.arange(len(rows) * width).reshape(-1, width)
            move[:, -1] = move[:, -1].clip(max=len(rows) * width - 1)
            symbols, ranks, into = (x.ravel().take(move) for x in (symbols, ranks, into))
            symbols[:, -1], ranks[:, -1] = -1, self.rank_of_none
            symbols[mine, at] = merged
            right = np.where(at + 1 < width, symbols[mine, np.minimum(at + 1, width - 1)], -1)
            left = np.where(at > 0, symbols[mine, np.maximum(at - 1, 0)], -1)
            both = self.look_up(np.concatenate([left, merged]), np.concatenate([merged, right])).reshape(2, -1, 2)
            some = at > 0
            ranks[mine[some], at[some] - 1], into[mine[some], at[some] - 1] = both[0, some, 0], both[0, some, 1]
            ranks[mine, at], into[mine, at] = both[1, :, 0], both[1, :, 1]
        return out

    def apply(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[start : start + length]`` one after another, and how many each has."""
        sizes = np.zeros(len(starts), dtype=np.int64)
        parts, order = [], []
        low = 1
        for high in (4, 6, 8, 10, 12, 16, 24, LONGEST):
            mine = np.flatnonzero((lengths >= low) & (lengths <= high))
            low = high + 1
            if not len(mine):
                continue
            cols, n = np.arange(high), lengths[mine][:, None]
            raw = data[np.minimum(starts[mine][:, None] + cols, len(data) - 1)]
            symbols = np.where(cols < n - 1, self.inner[raw], np.where(cols == n - 1, self.last[raw], -1))
            merged = self._band(symbols)
            kept = merged >= 0
            sizes[mine] = kept.sum(axis=1)
            parts.append(merged[kept])
            order.append(mine)
        if not parts:
            return np.empty(0, dtype=np.int32), sizes
        out = np.empty(int(sizes.sum()), dtype=np.int32)
        by_band = np.concatenate(order)
        out[_places((np.cumsum(sizes) - sizes)[by_band], sizes[by_band])] = np.concatenate(parts)
        return out, sizes


class WordCache:
    """Token ids of white-space separated pieces.

    The vocabulary drops white space and never merges across it, so the ids
    of a text are those of its pieces in order, and each distinct piece of a slice of texts is encoded once.  A
    piece of small Latin letters is one word as it is (nothing to normalise or split), so its bytes go straight to
    the `Merges`; a run of signs after such letters is a word of its own.  Other pieces go through
    the whole tokenizer.  The worker remembers the words and the other pieces it has met; either memory
    starts anew when it holds more than `most`.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = Merges(model["vocab"], model["merges"])
        self._forget()

    def _forget(self) -> None:
        #: words met, their ids one after another, and how many each has
        self.words, self.ids, self.sizes = pa.array([], pa.large_binary()), np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int64)

    def _words(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in the memory, after learning those it lacks."""
        if len(self.words) > self.most:
            self._forget()
        found = pc.index_in(words, value_set=self.words)
        new = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        place = found.fill_null(0).to_numpy().astype(np.int64)
        if len(new):
            place[new] = len(self.words) + np.arange(len(new))
            fresh = words.take(pa.array(new))
            at = np.frombuffer(fresh.buffers()[1], dtype=np.int64)[: len(fresh) + 1]
            ids, sizes = self.merges.apply(np.frombuffer(fresh.buffers()[2], dtype=np.uint8), at[:-1], np.diff(at))
            self.words, self.ids, self.sizes = pa.concat_arrays([self.words, fresh]), np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        return place

    def _whole(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces that the whole tokenizer has to see."""
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        new = [p for p in pieces if p not in known]
        found = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
        known.update(zip(new, (np.array(e.ids, dtype=np.int64) for e in found)))
        return [known[p] for p in pieces]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after another, and how many each has."""
        n = len(pieces)
        offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[pieces.offset : pieces.offset + n + 1]
        data = np.frombuffer(pieces.buffers()[2], dtype=np.uint8)
        starts, lengths = offsets[:-1], np.diff(offsets)
        kind = _kinds(data)
        back = np.zeros(len(data), dtype=bool)  # a letter after a sign
        back[1:] = (kind[1:] == _LETTER) & (kind[:-1] == _SIGN)
        odd = np.concatenate([[0], np.cumsum((kind == _OTHER) | back)])
        letters = np.concatenate([[0], np.cumsum(kind == _LETTER)])
        stem = letters[offsets[1:]] - letters[starts]
        # the first byte's own mark is about the piece before it
        plain = (odd[offsets[1:]] - odd[np.minimum(starts + 1, offsets[1:])] == 0) & (kind[starts] == _LETTER) & (stem <= LONGEST)
        plain_at = np.flatnonzero(plain)

        stems = binary_array(span_bytes(data, starts[plain_at], stem[plain_at]), stem[plain_at]).dictionary_encode()
        which = self._words(stems.dictionary)[stems.indices.to_numpy()]
        ids, n_ids = self.ids, self.sizes
        id_at = np.cumsum(n_ids) - n_ids

        tail = (lengths - stem)[plain_at]
        signed = np.flatnonzero(tail)
        signs = binary_array(span_bytes(data, (starts + stem)[plain_at][signed], tail[signed]), tail[signed]).dictionary_encode()
        rest_at = np.flatnonzero(~plain)
        others = pieces.take(pa.array(rest_at)).to_pylist()
        found = self._whole(signs.dictionary.to_pylist() + others)
        more, n_more = (np.concatenate(found) if found else np.empty(0, np.int64)), np.array([len(f) for f in found], dtype=np.int64)
        more_at = np.cumsum(n_more) - n_more
        sign, rest = signs.indices.to_numpy(), np.arange(len(signs.dictionary), len(found))

        sizes = np.zeros(n, dtype=np.int64)
        sizes[plain_at] = n_ids[which]
        sizes[plain_at[signed]] += n_more[sign]
        sizes[rest_at] = n_more[rest]
        at = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), dtype="<u4")
        out[_places(at[plain_at], n_ids[which])] = span_bytes(ids, id_at[which], n_ids[which])
        out[_places((at[plain_at] + n_ids[which])[signed], n_more[sign])] = span_bytes(more, more_at[sign], n_more[sign])
        out[_places(at[rest_at], n_more[rest])] = span_bytes(more, more_at[rest], n_more[rest])
        return out, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text's begin in them (texts + 1 numbers)."""
        pieces, bounds = _pieces(data, offsets)
        if not len(pieces):
            return np.empty(0, dtype="<u4"), np.zeros(len(offsets), dtype=np.int64)
        coded = pieces.dictionary_encode()
        ids, sizes = self._distinct(coded.dictionary)
        piece = coded.indices.to_numpy()
        lengths = sizes[piece]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return span_bytes(ids, (np.cumsum(sizes) - sizes)[piece], lengths), ends[bounds]


_CACHES: dict[str, WordCache] = {}


def best_fill(counts: dict[int, int], room: int, lengths: list[int] | None = None) -> tuple[int, dict[int, int]]:
    """The sum closest to `room` from below that a sub-multiset of ``counts``
    (length -> how many) reaches, and the counts that reach it.

    Bit ``s`` of the bitset says that sum ``s`` is reachable.  A length with
    many copies enters as 1, 2, 4, ... copies.  Stops as soon as `room` is hit.
    ``lengths``: the keys of ``counts`` in ascending order, if they are at hand.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    lengths = sorted(counts) if lengths is None else lengths
    for length in reversed(lengths[: bisect_right(lengths, room)]):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            more = (reach | reach << (length * take)) & mask
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left, take = left - take, take * 2
        if reach >> room & 1:
            break
    best = at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return best, chosen


class Packer:
    """Packs lengths as they come; `take` and `finish` yield ``(item, start, length, sequence, offset)``."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.sequence = capacity, 0
        self.rest: dict[int, deque] = {}
        self.counts: dict[int, int] = {}  # of the same lengths
        self.lengths: list[int] = []      # in order
        self.total = 0

    def _push(self, item, start: int, length: int) -> None:
        if length not in self.rest:
            self.rest[length], self.counts[length] = deque(), 0
            insort(self.lengths, length)
        self.rest[length].append((item, start))
        self.counts[length] += 1
        self.total += length

    def _pop(self, length: int) -> tuple:
        found = self.rest[length].popleft()
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.rest[length], self.counts[length]
            del self.lengths[bisect_right(self.lengths, length) - 1]
        self.total -= length
        return found

    def add(self, item, length: int) -> Iterator[tuple]:
        whole = length // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield item, start, self.capacity, self.sequence, 0
            self.sequence += 1
        if length > whole:
            self._push(item, whole, length - whole)

    def pack(self) -> Iterator[tuple]:
        """Fills windows while the remaining pieces can fill one."""
        while self.total >= self.capacity:
            seed = self.lengths[-1]
            self.counts[seed] -= 1  # the seed itself is taken
            filled, chosen = best_fill(self.counts, self.capacity - seed, self.lengths)
            self.counts[seed] += 1
            chosen[seed] = chosen.get(seed, 0) + 1
            slack = self.capacity - seed - filled
            times = 1 if slack else min(len(self.rest[k]) // n for k, n in chosen.items())
            for _ in range(times):
                at = 0
                for length in sorted(chosen, reverse=True):
                    for _ in range(chosen[length]):
                        yield *self._pop(length), length, self.sequence, at
                        at += length
                if slack:  # every piece left is longer than the slack, or it would have been chosen
                    longest = self.lengths[-1]
                    item, start = self._pop(longest)
                    yield item, start, slack, self.sequence, at
                    self._push(item, start + slack, longest - slack)
                self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The last pieces, in sequences whose lengths are powers of two."""
        yield from self.pack()
        pieces = [(k, *x) for k in sorted(self.rest, reverse=True) for x in self.rest[k]]
        self.rest, self.counts, self.lengths, left, self.total = {}, {}, [], self.total, 0
        size = at = 0
        for length, item, start in pieces:
            while length:
                if at == size:
                    size, at = 1 << (left.bit_length() - 1), 0
                cut = min(length, size - at)
                yield item, start, cut, self.sequence, at
                at, start, length, left = at + cut, start + cut, length - cut, left - cut
                if at == size:
                    self.sequence += 1


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    buffer_tokens: int = 1 << 21,
    slice_bytes: int = 1 << 21,
) -> DataFrame:
    """One row per piece: ``id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's token ids (little-endian 32-bit, binary);
    ``sequence_id`` holds the task in its upper bits.  Every sequence has
    `capacity` tokens but a task's last ones, whose lengths are powers of two.

    Defined cases: a null or empty text has only its end token; a null id
    stays null; equal rows are packed one by one; an empty table gives no
    rows; other columns of the input are not read.  The result is a function
    of the input's partitions and their order, as a file scan fixes them.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")],
        T.StructField("ids", T.BinaryType()),
    ])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        cache = _CACHES.get(tokenizer_path) or _CACHES.setdefault(tokenizer_path, WordCache(tokenizer_path))
        packer, held, tokens = Packer(capacity), 0, {}
        id_type = None

        def emit(pieces: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [id_type, *[pa.int64()] * 5, pa.binary()])], names=schema.names
                )

            for k, start, length, sequence, offset in pieces:
                key, ids = tokens[k]
                rows.append((key, start, length, len(ids) // 4, task + sequence, offset, ids[4 * start : 4 * (start + length)]))
                size += length
                if size >= 1 << 20 or len(rows) >= 10_000:
                    yield flush()
                    rows.clear()
                    size = 0
            if rows:
                yield flush()

        n = 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            id_type = keys.type
            for lo, hi, data, offsets in byte_slices(texts, slice_bytes):
                ids, at = cache.encode(data, offsets)
                raw, at = ids.tobytes(), at.tolist()
                fresh = []
                for i, key in enumerate(keys[lo:hi].to_pylist()):
                    tokens[n] = (key, raw[4 * at[i] : 4 * at[i + 1]] + end)
                    length = at[i + 1] - at[i] + 1
                    fresh.extend(packer.add(n, length))
                    held, n = held + length, n + 1
                yield from emit(fresh)
                if held >= buffer_tokens:
                    yield from emit(packer.pack())
                    left = {k for q in packer.rest.values() for k, _ in q}
                    tokens = {k: v for k, v in tokens.items() if k in left}
                    held = packer.total
        if n:
            yield from emit(packer.finish())

    return docs.select(id_col, text_col).mapInArrow(run, schema)
