"""Operator 1, benchmark decontamination: prefix-filtered containment join on shingles.

A benchmark item gives its windows of 10 consecutive words (a shorter item is
one window); a window's tokens are its 5-word shingles.  A document holds a
window exactly only if it holds all its tokens, so for containment 1 the
necessary prefix is the one token that comes first in an order by rarity:

1. one pass counts the benchmark's tokens in all documents;
2. each window keeps its rarest token and that token's place in it;
3. a second pass finds the places of prefix tokens in documents, with the words
   around them;
4. a join on the token applies the length bound (the window is no longer than
   the document) and the positional bounds (it starts and ends inside it), and
   compares the words themselves.

What the passes broadcast are filters of fixed size (``filter_bits``); a larger
benchmark only lets more foreign tokens through to the joins, which drop them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.llm.common import ALNUM, LOWER, byte_slices, materialise, replace_columns, span_hash, text_key, windows, word_spans

WINDOW_WORDS, SHINGLE_WORDS, FILTER_BITS = 10, 5, 1 << 24


def _scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends and row bounds, and the prefix sums of the words' hashes."""
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets, ALNUM)
    h = span_hash(11)
    return low, starts, ends, bounds, span_hash(12).prefix(h.spans(h.byte_prefix(low), starts, ends))


def _shingles(prefix: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    return span_hash(12).spans(prefix, first, first + size)


def _split(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int, shingle: int) -> DataFrame:
    """``(item, words, size, tokens)``: each distinct window of each item, with its shingles' hashes by place."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(1)):
                low, starts, ends, bounds, prefix = _scan(data, offsets)
                raw, rows = low.tobytes(), []
                for i in range(hi - lo):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    size = min(width, b - a)
                    k = min(shingle, size)
                    for w in range(a, b - size + 1) if size else ():
                        tokens = _shingles(prefix, np.arange(w, w + size - k + 1), k).view(np.int64)
                        rows.append((batch.column(0)[lo + i].as_py(), _split(raw, starts[w : w + size], ends[w : w + size]), k, tokens))
                if rows:
                    item, words, size, tokens = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(size, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
                        names=["item", "words", "size", "tokens"],
                    )

    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), text_col)
    return items.mapInArrow(run, "item string, words array<string>, size int, tokens array<long>").dropDuplicates(["item", "words"])


def token_filter(tokens: DataFrame, bits: int) -> Broadcast:
    """Bitmap of ``bits`` bits with the bit of every ``token`` set; at most ``bits / 64`` rows come to the driver."""
    at = F.col("token").bitwiseAND(F.lit(bits - 1))
    rows = tokens.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(token & 63 as int))")).alias("value")
    ).collect()
    words = np.zeros(bits // 64, dtype=np.int64)
    for r in rows:
        words[r["word"]] = r["value"]
    return tokens.sparkSession.sparkContext.broadcast(words)


def _passing(words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = tokens & np.uint64(len(words) * 64 - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1


def _count(shared: Broadcast, sizes: list[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            found = []
            for _, _, data, offsets in byte_slices(batch.column(0)):
                _, _, _, bounds, prefix = _scan(data, offsets)
                for k in sizes:
                    tokens = _shingles(prefix, windows(bounds, k), k)
                    found.append(tokens[_passing(words, tokens)])
            if found:
                token, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return run


_PLACES = "places array<struct<token: long, at: long, first: long, words: array<string>>>"


def _find(shared: Broadcast, sizes: list[int], width: int):
    kind = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.string()))]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            n_words, places = [], [[] for _ in range(batch.num_rows)]
            for lo, hi, data, offsets in byte_slices(batch.column("text")):
                low, starts, ends, bounds, prefix = _scan(data, offsets)
                raw = low.tobytes()
                for k in sizes:
                    at = windows(bounds, k)
                    tokens = _shingles(prefix, at, k)
                    hit = np.flatnonzero(_passing(wanted, tokens))
                    for w, token in zip(at[hit].tolist(), tokens[hit].view(np.int64).tolist()):
                        row = int(np.searchsorted(bounds, w, "right")) - 1
                        a, b = max(int(bounds[row]), w - width + 1), min(int(bounds[row + 1]), w + width)
                        places[lo + row].append({"token": token, "at": w - int(bounds[row]), "first": a - int(bounds[row]), "words": _split(raw, starts[a:b], ends[a:b])})
                n_words.append(np.diff(bounds))
            if n_words:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in ("id", "k1", "k2")] + [pa.array(np.concatenate(n_words)), pa.array(places, kind)],
                    names=["id", "k1", "k2", "n_words", "places"],
                )

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``(id, k1, k2, n_words, n_hit, items, spans)`` of every document row.

    Words are runs of 0-9, a-z and non-ASCII characters after lower-casing
    A-Z.  ``n_hit`` counts the words inside any occurrence of a window,
    ``items`` lists the ids (as strings, sorted) of the items with an occurring
    window, ``spans`` the occurrences as word positions ``[start, end)``.

    Defined cases: a null or empty text has no words and no hits; items
    without words never occur; a null item id reads as the empty string, and
    rows of one item id are one item; equal documents get equal results, row by
    row; an empty benchmark leaves every document clean; an empty table gives
    no rows; other columns are not read.
    """
    if filter_bits < 64 or filter_bits & (filter_bits - 1):
        raise ValueError("filter_bits must be a power of two, 64 or more")
    wins = materialise(benchmark_windows(benchmark, item_col, item_text_col, width, shingle), "benchmark-windows")
    sizes = [r[0] for r in wins.select("size").distinct().collect()]  # at most `shingle` numbers
    tokens = wins.select(F.explode(F.array_distinct("tokens")).alias("token")).distinct()
    counted = docs.select(text_col).mapInArrow(_count(token_filter(tokens, filter_bits), sizes), "token long, n long")
    counted = counted.groupBy("token").agg(F.sum("n").alias("n"))
    # the window's tokens by rarity: the first is the prefix that containment needs
    placed = wins.select("item", "words", F.posexplode("tokens").alias("place", "token"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("rarest")
    prefix = placed.join(counted, "token", "left").groupBy("item", "words").agg(rarest)
    prefix = materialise(prefix.select("item", F.col("words").alias("window"), "rarest.token", "rarest.place"), "benchmark-prefix")
    rows = docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("n_words", T.LongType())])
    schema.add(T._parse_datatype_string(_PLACES).fields[0])
    found = _find(token_filter(prefix.select("token").distinct(), filter_bits), sizes, width)
    rows = materialise(rows.mapInArrow(found, schema), "benchmark-places")

    places = rows.select("id", "k1", "k2", "n_words", F.explode("places").alias("p")).select("id", "k1", "k2", "n_words", "p.*")
    start, size = F.col("at") - F.col("place"), F.size("window")
    inside = (start >= 0) & (start + size <= F.col("n_words"))
    same = F.slice("words", (start - F.col("first") + 1).cast("int"), size) == F.col("window")
    hits = places.join(prefix, "token").where(inside).where(same)
    hits = hits.select("id", "k1", "k2", "item", start.alias("start"), (start + size).alias("end"))
    per_doc = hits.groupBy("id", "k1", "k2").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], s["end"]).alias("to"),
        ),
    )["n"]
    per_doc = per_doc.select(F.col("id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "items", "spans", covered.alias("n_hit"))
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    return rows.drop("places").join(per_doc, on, "left").select(
        "id", "k1", "k2", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows that hold a benchmark window (see `contamination`); columns unchanged."""
    found = contamination(docs, benchmark, id_col, text_col, **options).where(F.col("n_hit") > 0)
    found = found.select(F.col("id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    k1, k2 = text_key(docs[text_col])
    keyed = docs.select(replace_columns(docs, {"_key1": k1, "_key2": k2}))
    on = keyed[id_col].eqNullSafe(F.col("_id")) & (F.col("_key1") == F.col("_k1")) & (F.col("_key2") == F.col("_k2"))
    return keyed.join(found, on, "left_anti").select(*docs.columns)
