"""Batch embedding with a caller-supplied encoder and pooling.

The language model of the reference is an external download; here any
callable ``encoder(input_ids, attention_mask) -> hidden_states`` (numpy
``[layers, batch, tokens, hidden]``) runs inside ``mapInPandas`` on batches
of ``batch_size`` rows (made once per worker, see ``Resident``), and the layer / token pooling happens in the same
task, so the per-token hidden states never become Spark rows.  A small
deterministic encoder is built in for tests and the bench.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]


def select_layers(hidden: np.ndarray, target_layer: int | Sequence[int]) -> np.ndarray:
    """an int picks one layer; ``(a,)`` averages layers a..last;
    ``(a, b)`` averages layers a..b-1.  ``hidden`` is ``[layers, B, T, H]``."""
    if isinstance(target_layer, int):
        return hidden[target_layer]
    if len(target_layer) == 1:
        return hidden[target_layer[0]:].mean(axis=0)
    return hidden[target_layer[0]:target_layer[1]].mean(axis=0)


def token_mean(layer: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """F32: mean over tokens ``[B, T, H] -> [B, H]``; padding included unless
    a mask is given (the reference averages all 512 positions)."""
    if mask is None:
        return layer.mean(axis=1)
    m = mask[..., None].astype(layer.dtype)
    return (layer * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)


def window_mean(layer: np.ndarray, pos: np.ndarray, width: int = 5) -> np.ndarray:
    """mean of tokens ``[pos - width, pos]`` clamped to the sequence, per row."""
    t = layer.shape[1]
    lo = np.clip(pos - width, 0, t - 1)
    hi = np.clip(pos, 0, t - 1)
    return np.stack([layer[b, lo[b]:hi[b] + 1].mean(axis=0) for b in range(layer.shape[0])])


class Resident:
    """An encoder that each Python worker makes once: only the maker and its arguments travel with the tasks.

    ``files`` are names of files that the application ships to every executor once (``SparkContext.addFile``, as
    ``--files`` does); their local paths are passed to the maker after the arguments.  Two encoders of equal makers,
    arguments and files share one object in a worker.
    """

    _made: dict = {}

    def __init__(self, maker: Callable[..., Encoder], *args, files: Sequence[str] = ()):
        self.maker, self.args, self.files = maker, args, tuple(files)

    def __call__(self, input_ids: np.ndarray, attention_mask: np.ndarray) -> np.ndarray:
        key = (f"{self.maker.__module__}.{self.maker.__qualname__}", repr(self.args), self.files)
        if key not in Resident._made:
            from pyspark import SparkFiles

            Resident._made[key] = self.maker(*self.args, *(SparkFiles.get(f) for f in self.files))
        return Resident._made[key](input_ids, attention_mask)


def embed(df: DataFrame, id_cols: Sequence[str], encoder: Encoder, ids_col: str = "input_ids",
          mask_col: str = "attention_mask", batch_size: int = 50, target_layer: int | Sequence[int] = (8,),
          masked: bool = False, name: str = "embedding", window: tuple[str, int] | None = None) -> DataFrame:
    """``(id..., embedding ARRAY<FLOAT>)``, one row per input row, order
    inside each task kept.

    Rows are fed to ``encoder`` ``batch_size`` at a time, rows of like length together; with ``masked`` (the mean over a row's own
    tokens) a batch is cut to its longest row.  ``window`` names a column of places and a width: the mean of
    the tokens from ``place - width`` to ``place`` (F33).  A large model goes in a `Resident`, else the encoder
    is shipped with the closure.
    """
    id_cols = list(id_cols)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)
    schema = f"{fields}, `{name}` array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            lengths = np.array([int(np.sum(m)) for m in pdf[mask_col]])
            order = np.argsort(lengths, kind="stable")
            pooled: list = [None] * len(pdf)
            for start in range(0, len(pdf), batch_size):
                mine = order[start:start + batch_size]
                part = pdf.iloc[mine]
                ids = np.stack(part[ids_col].to_numpy()).astype(np.int64)
                mask = np.stack(part[mask_col].to_numpy()).astype(np.int64)
                if masked and window is None and (mask[:, 1:] <= mask[:, :-1]).all():  # padding on the right only
                    longest = max(1, int(lengths[mine].max()))
                    ids, mask = ids[:, :longest], mask[:, :longest]
                layer = select_layers(np.asarray(encoder(ids, mask)), target_layer)
                if window is not None:
                    found = window_mean(layer, part[window[0]].to_numpy().astype(np.int64), window[1])
                else:
                    found = token_mean(layer, mask if masked else None)
                for k, v in zip(mine, found.astype(np.float32)):
                    pooled[k] = v
            out = pdf[id_cols].copy()
            out[name] = pooled
            yield out

    return df.select(*id_cols, ids_col, mask_col, *([window[0]] if window else [])).mapInPandas(run, schema)


class ProjectionEncoder:
    """Deterministic stand-in encoder: a fixed embedding table built from a
    rule (no download), then ``layers`` tanh mixing layers; returns all
    hidden states ``[layers + 1, B, T, hidden]`` like a transformer does."""

    def __init__(self, vocab_size: int, hidden: int = 16, layers: int = 4, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.standard_normal((vocab_size, hidden)).astype(np.float32) / np.sqrt(hidden)
        self.weights = [rng.standard_normal((hidden, hidden)).astype(np.float32) / np.sqrt(hidden) for _ in range(layers)]

    def __call__(self, input_ids: np.ndarray, attention_mask: np.ndarray) -> np.ndarray:
        h = self.table[np.clip(input_ids, 0, len(self.table) - 1)]
        states = [h]
        for w in self.weights:
            h = np.tanh(h @ w + h)
            states.append(h)
        return np.stack(states)


class SineEncoder:
    """Encoder given by one rule: ``hidden[l, b, t, j] = sin((id + 1) (j + 1) / 100 + l)``."""

    def __init__(self, hidden: int, layers: int):
        self.hidden, self.layers = hidden, layers

    def __call__(self, input_ids: np.ndarray, attention_mask: np.ndarray) -> np.ndarray:
        angle = (input_ids[..., None] + 1) * (np.arange(self.hidden) + 1) * 0.01
        return np.stack([np.sin(angle + layer) for layer in range(self.layers + 1)])


def token_mean_column(tokens: Column | str) -> Column:
    """F32 on an ``ARRAY<ARRAY<FLOAT>>`` column: element-wise mean of the
    token vectors, for hidden states already stored as rows."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    zero = F.transform(t[0], lambda x: F.lit(0.0))
    total = F.aggregate(t, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(t))
