"""Operator 6, toxicity: cumulative-link ordinal regression on sparse word features.

The model is ``P(grade >= k) = sigmoid(w.x - t_k)`` with one weight vector ``w``
for all thresholds and ``t_1 < t_2 < t_3``, fitted by maximum likelihood with a
ridge penalty; the result is the expected severity, the sum of the three
probabilities.

Labels say toxic or not.  Their severity grades come from the fitted rows
themselves: a word is evidence if its smoothed log-odds between toxic and clean
texts are high; toxic rows are graded 1 to 3 by the terciles of how many
evidence words they hold, and clean rows are grade 0.  Words are compared by 64-bit
hashes against a fitted vocabulary (no shared buckets, so a long clean text
cannot collect the weight of words that it doesn't hold).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.llm.common import ALNUM, LOWER, byte_slices, materialise, replace_columns, span_hash, text_key, word_spans

GRADES = 4  # 0 to 3


class Model(NamedTuple):
    vocabulary: np.ndarray  # sorted 64-bit word hashes
    weights: np.ndarray     # one for all thresholds
    thresholds: np.ndarray  # ascending, GRADES - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and where each row's begin."""
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets, ALNUM)
    h = span_hash(61)
    return h.spans(h.byte_prefix(low), starts, ends), bounds


def features(hashes: np.ndarray, bounds: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: ``(row, column, 1 + log(count))`` of the vocabulary's words."""
    if not len(vocabulary):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == hashes)
    row = np.searchsorted(bounds, hit, "right") - 1
    key, n = np.unique(row * len(vocabulary) + at[hit], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), 1 + np.log(n)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def at_least(model: Model, rows: int, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``P(grade >= k)`` for k = 1, 2, 3, of each row."""
    z = np.bincount(row, value * model.weights[column], minlength=rows) if len(row) else np.zeros(rows)
    return _sigmoid(z[:, None] - model.thresholds[None, :])


def fit_ordinal(x: np.ndarray, grade: np.ndarray, ridge: float = 0.2, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the penalised likelihood (gradient steps of adaptive size).

    Thresholds are the first one and the logarithms of the gaps, so their order holds by itself.
    """
    n, p = x.shape
    share = np.array([(grade >= k).mean() for k in range(1, GRADES)])
    start = np.log((1 - share + 1e-3) / (share + 1e-3))
    gaps = np.maximum(np.diff(start), 1e-2)
    theta = np.concatenate([np.zeros(p), start[:1], np.log(gaps)])
    m = v = np.zeros_like(theta)
    upper = np.arange(GRADES)[None, :] == grade[:, None]
    for step in range(1, steps + 1):
        w, t = theta[:p], theta[p] + np.concatenate([[0], np.cumsum(np.exp(theta[p + 1 :]))])
        q = _sigmoid((x @ w)[:, None] - t[None, :])
        edge = np.hstack([np.ones((n, 1)), q, np.zeros((n, 1))])
        prob = np.maximum((edge[:, :-1] - edge[:, 1:])[upper], 1e-12)
        slope = np.hstack([np.zeros((n, 1)), q * (1 - q), np.zeros((n, 1))])
        # d log P(grade) / d(threshold k): the grade's lower edge falls, its upper edge rises
        d_low, d_up = slope[:, :-1][upper] / prob, slope[:, 1:][upper] / prob
        d_t = np.array([d_up[grade == k - 1].sum() - d_low[grade == k].sum() for k in range(1, GRADES)])
        d_w = x.T @ (d_low - d_up) - ridge * w
        tail = np.cumsum(d_t[::-1])[::-1]
        grad = np.concatenate([d_w, tail[:1], tail[1:] * np.exp(theta[p + 1 :])]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 / np.sqrt(step / 50 + 1) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:p], theta[p] + np.concatenate([[0], np.cumsum(np.exp(theta[p + 1 :]))])


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = 8000, vocabulary: int = 1500, min_rows: int = 4,
) -> Model:
    """Fit on at most `max_rows` labelled ids (half of each label, equal texts once) for which `usable` holds.

    Defined cases: an id with several labels has the larger one; an id with several rows counts once, with its
    smallest text, so `max_rows` bounds what reaches the driver; a null text counts as empty; null ids, null and
    other labels, and labels without a row are left out; without labelled rows of both labels every
    document gets severity zero.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).where(usable)
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    parts = [
        known.where(F.col("label") == label).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(max_rows // 2)
        .select(F.col(id_col).alias("_id"), "label") for label in (0, 1)
    ]
    sample = docs.select(id_col, text_col).join(F.broadcast(parts[0].unionAll(parts[1])), F.col(id_col) == F.col("_id"))
    sample = sample.groupBy("_id", "label").agg(F.coalesce(F.min(text_col), F.lit("")).alias("_text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column(3)):
                hashes, bounds = word_hashes(data, offsets)
                pairs = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
                mine = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*mine.columns[:3], pa.array([h.view(np.int64) for h, _ in pairs], pa.list_(pa.int64())), pa.array([n for _, n in pairs], pa.list_(pa.int64()))],
                    names=["k1", "k2", "label", "words", "counts"])

    rows = sample.select(*text_key(F.col("_text")), "label", "_text").dropDuplicates(["k1", "k2", "label"])
    rows = materialise(rows.mapInArrow(count, "k1 long, k2 long, label int, words array<long>, counts array<long>"), "toxic-words")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    empty = Model(np.empty(0, np.uint64), np.empty(0), np.full(GRADES - 1, 50.0) + np.arange(GRADES - 1))
    if not n0 or not n1:
        return empty
    # words by how far their log-odds are from even, in standard errors: the vocabulary's bound is `vocabulary`
    by_word = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("all")
    ).where(F.col("all") >= min_rows)
    a, b = F.col("toxic") + 0.5, F.col("all") - F.col("toxic") + 0.5
    odds = F.log(a / (n1 - F.col("toxic") + 0.5)) - F.log(b / (n0 - F.col("all") + F.col("toxic") + 0.5))
    error = F.sqrt(1 / a + 1 / b + 1 / (n1 - F.col("toxic") + 0.5) + 1 / (n0 - F.col("all") + F.col("toxic") + 0.5))
    best = by_word.select("word", odds.alias("odds"), (odds / error).alias("z")).orderBy(F.desc(F.abs("z")), "word").limit(vocabulary).collect()
    if not best:
        return empty
    words = np.array([r["word"] for r in best], dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    words, evidence = words[order], np.array([r["odds"] > 3 and r["z"] > 3 for r in best])[order]

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for h, n in zip(batch.column("words"), batch.column("counts")):
                h = h.values.to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                hit = words[at] == h
                packed.append(np.stack([at[hit], n.values.to_numpy()[hit]]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["k1", "k2", "label", "found"])

    data = sorted(rows.mapInArrow(select, "k1 long, k2 long, label int, found binary").collect())
    x = np.zeros((len(data), len(words)))
    for i, r in enumerate(data):
        at, n = np.frombuffer(r["found"], dtype=np.int64).reshape(2, -1)
        x[i, at] = 1 + np.log(n)
    y = np.array([r["label"] for r in data])
    strength = np.where(x > 0, np.exp(x - 1), 0)[:, evidence].sum(axis=1)
    cuts = np.quantile(strength[(y == 1) & (strength > 0)], [1 / 3, 2 / 3]) if ((y == 1) & (strength > 0)).any() else [1, 2]
    grade = np.where(y == 1, 1 + (strength > cuts[0]) + (strength > cuts[1]), 0)
    weights, thresholds = fit_ordinal(x, grade)
    return Model(words, weights, thresholds)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` plus ``severity`` (expected grade, 0 to 3), ``toxicity`` (probability of grade 1 or more) and
    ``grade`` (how many thresholds are likelier passed than not).

    Defined cases: null, empty and blank texts have no words and the model's
    base severity; equal texts get equal results; an empty table stays empty;
    input columns of the three names are replaced, others pass unread.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = {"severity": F.lit(0.0), "toxicity": F.lit(0.0), "grade": F.lit(0)}
    out = docs.select(replace_columns(docs, new))
    names = out.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.concatenate([
                at_least(model, len(o) - 1, *features(*word_hashes(d, o), model.vocabulary)) for _, _, d, o in byte_slices(batch.column(text_col))
            ])
            made = {"severity": pa.array(p.sum(axis=1)), "toxicity": pa.array(p[:, 0]), "grade": pa.array((p >= 0.5).sum(axis=1).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names=names)

    fields = out.schema.fields[:-3] + [T.StructField("severity", T.DoubleType()), T.StructField("toxicity", T.DoubleType()), T.StructField("grade", T.IntegerType())]
    return out.mapInArrow(run, T.StructType(fields))
