"""Ridge regression for many models in one job (M1, M3-M9).

Data flow (no model's rows, and no model's whole matrix of more than one set, are ever gathered in one place):

1. ``model_statistics`` counts rows per (model key, cell) - a cell is a CV
   fold, the test set, a bootstrap replicate, or any other part of the rows that
   training sets are sums of - and gives each (key, cell) ``ceil(rows /
   rows_per_task)`` salts; rows go to a salt by the hash of their id, are
   shuffled once on (key, cell, salt) and sorted by it, so a model holding a
   third of all rows is spread over many tasks and a task holds one cell's
   matrix at a time.  Where a row's features are wide but made from little
   (`Source`), the narrow rows are shuffled, one for all its models, and the
   features are made behind the shuffle: they are never on disk.
2. ``moment_partials`` (``mapInArrow``) folds them into count, mean and scatter
   of z = [x, y], cut into blocks of at most ``BLOCK`` rows and columns (the
   lower triangle), so that no later group depends on the width as a whole.
3. Partials of a block are merged in levels of at most ``fanin``.
4. ``fit_sets`` adds and subtracts cells block by block: for every fit of a
   plan the block of its training set and of the set that scores it.  The plans
   are k folds (`cv_plan`), group folds with inner folds
   (`nested_plan`) and replicates (`replicate_plan`).
5. ``solve`` puts the blocks of one fit together (two matrices: 67 MB at 2,048
   features), solves it for each alpha and scores it by quadratic forms.
   The solves of a model spread over the cluster, one group a fit.
6. The alpha is chosen by the mean fold score; the first best one wins.

Moments are centred from the start and merged by the pairwise update, so
features far from zero lose no digits.  With the few alphas of a grid a solve for
each is cheaper than one eigendecomposition shared by them.  Keys may be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.session import reliable_checkpoint

REFERENCE_ALPHAS = (10.0, 100.0, 1000.0)
#: rows and columns of a block of a scatter matrix
BLOCK = 192
#: feature values of the rows that a worker copies at a time (8 MB)
PIECE_VALUES = 1 << 20
#: narrow rows of a task that makes their features itself
MADE_ROWS = 50_000


class Source(NamedTuple):
    """Narrow rows that several models share, and how to make features of them.

    ``make(rows, keep)`` gives ``(key columns, features, *keep)``, one row for each row and model.  It is to need no shuffle, as it
    runs once for each reading; all its models see all the rows."""

    rows: DataFrame
    make: Callable[[DataFrame, Sequence[str]], DataFrame]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "_k_") -> Column:
    """Null-safe join condition of ``left``'s keys with ``right``'s, which carry ``prefix``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys], F.lit(True))


def with_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on keys of which NULL is one."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return left.join(renamed, same_keys(left, renamed, keys), how).drop(*[f"_k_{k}" for k in keys])


# --------------------------------------------------------------------------- statistics


class Moments(NamedTuple):
    """Count, mean and scatter ``sum (z - mean)(z - mean)^T`` of a set, for the rows i and columns j of a block; ``di``
    and ``dj`` are the scatter's diagonal there."""

    n: float
    mi: np.ndarray
    mj: np.ndarray
    di: np.ndarray
    dj: np.ndarray
    q: np.ndarray

    def __add__(self, other: Moments) -> Moments:  # type: ignore[override]
        """Both sets together (pairwise update)."""
        n = self.n + other.n
        if not other.n or not self.n:
            return self if self.n else other
        i, j, share = other.mi - self.mi, other.mj - self.mj, self.n * other.n / n
        return Moments(n, self.mi + i * (other.n / n), self.mj + j * (other.n / n), self.di + other.di + i * i * share,
                       self.dj + other.dj + j * j * share, self.q + other.q + np.outer(i, j * share))

    def __sub__(self, part: Moments) -> Moments:
        """The set without one of its parts; empty if nothing is left."""
        n = self.n - part.n
        if n < 1:
            return self.none()
        if not part.n:
            return self
        mi, mj = self.mi + (self.mi - part.mi) * (part.n / n), self.mj + (self.mj - part.mj) * (part.n / n)
        i, j, share = part.mi - mi, part.mj - mj, n * part.n / self.n
        return Moments(n, mi, mj, self.di - part.di - i * i * share, self.dj - part.dj - j * j * share, self.q - part.q - np.outer(i, j * share))

    def none(self) -> Moments:
        return Moments(0.0, *(x * 0.0 for x in self[1:]))


def _total(sets: Sequence[Moments], like: Moments) -> Moments:
    return reduce(Moments.__add__, sets) if sets else like.none()


def _feature_matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offs = col.offsets.to_numpy()
    lens = np.diff(offs)
    if len(lens) == 0:
        return np.zeros((0, 0))
    p = int(lens[0])
    if not (lens == p).all():
        raise ValueError("ridge: feature vectors of different lengths in one model input")
    vals = col.values.to_numpy(zero_copy_only=False)[offs[0]:offs[-1]]
    return np.asarray(vals, dtype=np.float64).reshape(-1, p)


def _edges(width: int, block: int) -> list[tuple[int, int]]:
    return [(lo, min(lo + block, width)) for lo in range(0, width, block)]


_SET_FIELDS = ["n", "mi", "mj", "di", "dj", "q"]
_VECTOR = T.ArrayType(T.DoubleType())


def _set_schema(prefix: str = "") -> list[T.StructField]:
    return [T.StructField(prefix + c, T.DoubleType() if c == "n" else _VECTOR) for c in _SET_FIELDS]


def _as_row(m: Moments, prefix: str = "") -> dict:
    return {prefix + c: m.n if c == "n" else getattr(m, c).ravel() for c in _SET_FIELDS}


def _from_rows(pdf: pd.DataFrame, prefix: str = "") -> list[Moments]:
    out = []
    for row in pdf[[prefix + c for c in _SET_FIELDS]].itertuples(index=False):
        n, *vectors = row
        mi, mj, di, dj, q = (np.asarray(v, dtype=np.float64) for v in vectors)
        out.append(Moments(float(n), mi, mj, di, dj, q.reshape(len(mi), len(mj))))
    return out


def moment_partials(df: DataFrame, key_cols: Sequence[str], cell_col: str, features: str, y: str,
                    weights: str | None = None, block: int = BLOCK, shared: str | None = None) -> DataFrame:
    """Per stretch of rows of one (key, cell): the blocks ``(bi, bj, n, mi, mj, di, dj, q)`` of z = [features, y].

    Rows of a (key, cell) should come one after another (see `model_statistics`): a set is sent on when
    its key or cell ends, so one matrix is in memory at a time.  With ``shared``, one of the keys, the rows of one value
    of it and one cell should: the matrices of all other keys' values there are in memory then.

    With ``weights`` (``ARRAY<DOUBLE>`` of R replicate weights, NULL on test
    rows) a weighted row adds to cells 1..R with its weights instead of to
    its own cell; R matrices are in memory then.  Rows with a NULL target or
    features are skipped.
    """
    key_cols = list(key_cols)
    cols = [*key_cols, cell_col, features, y] + ([weights] if weights else [])
    d = df.select(*cols).where(F.col(y).isNotNull() & F.col(features).isNotNull() & ~F.isnan(y))
    schema = T.StructType([d.schema[k] for k in key_cols] + [
        T.StructField("cell", d.schema[cell_col].dataType), T.StructField("bi", T.IntegerType()), T.StructField("bj", T.IntegerType()), *_set_schema()])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def add(a: tuple | None, z: np.ndarray, w: np.ndarray | None = None) -> tuple:
        """Rows z added to a set; the lower triangle only, a band of blocks at a time, so that no second matrix is made."""
        n = float(len(z) if w is None else w.sum())
        mu = z.mean(axis=0) if w is None else w @ z / n
        c = z - mu
        before, mean, q = a or (0.0, mu, np.zeros((len(mu), len(mu))))
        off, share = mu - mean, before * n / (before + n)
        for lo, hi in _edges(len(mu), block):
            left = c[:, lo:hi] if w is None else c[:, lo:hi] * w[:, None]
            q[lo:hi, :hi] += left.T @ c[:, :hi]
            if share:
                q[lo:hi, :hi] += np.outer(off[lo:hi] * share, off[:hi])
        return before + n, mean + off * (n / (before + n)), q

    def blocks(key: tuple, cell, stats: tuple) -> Iterator[pa.RecordBatch]:
        n, mu, q = stats
        diagonal, edges = np.diag(q), _edges(len(mu), block)
        for bi, (i0, i1) in enumerate(edges):
            rows = [(bi, bj, n, mu[i0:i1], mu[j0:j1], diagonal[i0:i1], diagonal[j0:j1], q[i0:i1, j0:j1].ravel()) for bj, (j0, j1) in enumerate(edges[: bi + 1])]
            made = [pa.array([v] * len(rows), arrow.field(c).type) for c, v in zip([*key_cols, "cell"], [*key, cell])]
            made += [pa.array(c, arrow.field(k).type) for k, c in zip(("bi", "bj", "n"), zip(*(r[:3] for r in rows)))]
            yield pa.RecordBatch.from_arrays(made + [_list_array([r[k] for r in rows]) for k in range(3, 8)], schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, open_sets = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            for (key, cell), stats in open_sets.items():
                yield from blocks(key, cell, stats)
            open_sets.clear()

        for rb in batches:
            if rb.num_rows == 0:
                continue
            yv = rb.column(y).to_numpy(zero_copy_only=False).astype(np.float64)
            ids = list(zip(*(rb.column(c).to_pylist() for c in key_cols))) if key_cols else [()] * rb.num_rows
            cells = rb.column(cell_col).to_pylist()
            # what the rows of a stretch have in common
            common = rb.column(shared).to_pylist() if shared else ids
            marks = ids if weights else list(zip(common, cells))
            cuts = [0, *(k for k in range(1, len(marks)) if marks[k] != marks[k - 1]), len(marks)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if marks[lo] != mark:
                    yield from close()
                    mark = marks[lo]
                places: dict[tuple, list[int]] = {}
                for at in range(lo, hi):
                    places.setdefault(ids[at], []).append(at)
                for key, rows in places.items():
                    # one model's rows share a width; models in a batch may not
                    piece_rows = max(1, PIECE_VALUES // max(1, len(rb.column(features)[rows[0]])))
                    for at in range(0, len(rows), piece_rows):
                        # copies are made of a piece of the batch at a time
                        mine = rows[at : at + piece_rows]
                        column = rb.column(features)
                        column = column.take(pa.array(mine)) if shared else column.slice(mine[0], len(mine))
                        z = np.column_stack([_feature_matrix(column), yv[mine]])
                        if not weights:
                            at_key = key, cells[lo]
                            open_sets[at_key] = add(open_sets.get(at_key), z)
                            continue
                        part = rb.column(weights).slice(mine[0], len(mine))
                        drawn = ~np.asarray(part.is_null().to_numpy(zero_copy_only=False))
                        if drawn.any():
                            w = _feature_matrix(part.filter(pa.array(drawn)))
                            for r in range(w.shape[1]):
                                if w[:, r].any():
                                    open_sets[key, r + 1] = add(open_sets.get((key, r + 1)), z[drawn], w[:, r])
                        own = np.array([cells[i] for i in mine], dtype=object)[~drawn]
                        for cell in dict.fromkeys(own):
                            open_sets[key, cell] = add(open_sets.get((key, cell)), z[~drawn][own == cell])
        yield from close()

    return d.mapInArrow(fold, schema)


def _list_array(vectors: list[np.ndarray]) -> pa.Array:
    """Arrow ``list<double>`` straight from numpy vectors (no Python floats)."""
    lens = np.array([len(v) for v in vectors], dtype=np.int32)
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    flat = np.concatenate(vectors).astype(np.float64) if vectors else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def model_statistics(data: DataFrame, key_cols: Sequence[str], cell_col: str, features: str, y: str,
                     weights: str | None = None, id_col: str | None = None, rows_per_task: int = 500_000, fanin: int = 64,
                     block: int = BLOCK) -> DataFrame:
    """The blocks of every (key, cell), merged: ``(key, cell, bi, bj, n, mi, mj, di, dj, q)``, see the module notes.

    Rows go to salts by the hash of ``id_col``; without one by their content, and equal rows share a salt then.
    """
    from sporeframe.operators.joins import small_side

    key_cols = list(key_cols)
    group = key_cols if weights else [*key_cols, cell_col]
    counts = data.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    # small: a row for each model and cell; read by the max and by the join
    counts = reliable_checkpoint(counts.select(*group, F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(rows_per_task))).cast("long").alias("_salts")))
    max_salts = counts.agg(F.max("_salts")).first()[0] or 1
    salted = data
    if max_salts > 1:
        by = [F.col(id_col)] if id_col else [F.col(c) for c in [cell_col, features, y] + ([weights] if weights else [])]
        salted = with_keys(data, small_side(counts), group).withColumn("_salt", F.pmod(F.xxhash64(*by), F.col("_salts"))).drop("_salts")
    else:
        salted = data.withColumn("_salt", F.lit(0).cast("long"))
    order = [*key_cols, cell_col, "_salt"] if not weights else [*key_cols, "_salt"]
    salted = salted.select(*key_cols, cell_col, features, y, *([weights] if weights else []), "_salt")
    salted = salted.repartition(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    parts = moment_partials(salted, [*key_cols, "_salt"], cell_col, features, y, weights, block)
    return _merged(parts, key_cols, max_salts, fanin)


def _merged(parts: DataFrame, key_cols: Sequence[str], level: int, fanin: int) -> DataFrame:
    """The partials of ``level`` salts at most, added up in levels of ``fanin``."""
    merge_on = [*key_cols, "_salt", "cell", "bi", "bj"]

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {c: pdf[c].iloc[0] for c in merge_on} | _as_row(reduce(Moments.__add__, _from_rows(pdf)))
        return pd.DataFrame([row], columns=[*merge_on, *_SET_FIELDS])

    while level > 1:
        parts = parts.withColumn("_salt", F.floor(F.col("_salt") / fanin).cast("long"))
        parts = parts.groupBy(*merge_on).applyInPandas(merge, T.StructType([parts.schema[c] for c in [*merge_on, *_SET_FIELDS]]))
        level = -(-level // fanin)
    return parts.drop("_salt")


def source_statistics(source: Source, key_cols: Sequence[str], cell_col: str, features: str, y: str, id_col: str | None = None,
                      rows_per_task: int = MADE_ROWS, fanin: int = 64, block: int = BLOCK) -> DataFrame:
    """`model_statistics` of a source's models; only its narrow rows are shuffled.

    A task makes the features of one cell's rows, ``rows_per_task`` about, and adds them up at once; it holds one matrix for each model."""
    from sporeframe.operators.joins import small_side

    key_cols, rows = list(key_cols), source.rows.where(F.col(y).isNotNull() & ~F.isnan(y))
    counts = rows.groupBy(cell_col).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_task)).cast("long").alias("_salts"))
    before = Window.orderBy(cell_col).rowsBetween(Window.unboundedPreceding, -1)  # a row for each cell
    counts = reliable_checkpoint(counts.withColumn("_first", F.coalesce(F.sum("_salts").over(before), F.lit(0))))
    max_salts, n_tasks = counts.agg(F.coalesce(F.max("_salts"), F.lit(1)), F.coalesce(F.sum("_salts"), F.lit(1))).first()
    by = [id_col] if id_col else rows.columns
    placed = with_keys(rows, small_side(counts), [cell_col]).withColumn("_salt", F.pmod(F.xxhash64(*by), F.col("_salts")))
    placed = placed.repartitionById(n_tasks, (F.col("_first") + F.col("_salt")).cast("int")).drop("_salts", "_first")
    made = source.make(placed, [cell_col, y, "_salt"])
    return _merged(moment_partials(made, [*key_cols, "_salt"], cell_col, features, y, None, block, "_salt"), key_cols, max_salts, fanin)


# --------------------------------------------------------------------------- fits

class Fit(NamedTuple):
    """A training set, the set that scores it, and the set whose spread scales the features.  ``fold`` 0 is the fit on all training rows."""

    outer: int
    fold: int
    train: Moments
    score: Moments
    scale: Moments


Plan = Callable[[dict], Iterator[Fit]]


def cv_plan(n_folds: int) -> Plan:
    """Cell 0 is the test set, cells 1..n_folds the folds of the training rows."""
    def plan(cells: dict) -> Iterator[Fit]:
        folds = [f for f in range(1, n_folds + 1) if f in cells]
        if not folds:
            return
        train = _total([cells[f] for f in folds], cells[folds[0]])
        for f in folds:
            yield Fit(0, f, train - cells[f], cells[f], train)
        yield Fit(0, 0, train, cells.get(0) or train.none(), train)

    return plan


def nested_plan(outer: int, inner: int) -> Plan:
    """Cells ``"<outer fold>:<s>"``: digit f of s is the inner fold that the row's place has in outer fold f's training set
    (of ``inner`` contiguous ones).  Each outer fold is scored by the model of all other rows."""
    def plan(cells: dict) -> Iterator[Fit]:
        named = [(int(o), s, m) for o, s, m in ((*c.split(":"), m) for c, m in cells.items())]
        like = named[0][2]
        places: dict[str, Moments] = {}
        own: dict[tuple[int, int], Moments] = {}
        for o, s, m in named:
            places[s] = places[s] + m if s in places else m
            k = o, int(s[o - 1])
            own[k] = own[k] + m if k in own else m
        whole = _total(list(places.values()), like)
        for f in range(1, outer + 1):
            test = _total([m for (o, _), m in own.items() if o == f], like)
            train = whole - test
            if test.n < 1 or train.n < 1:
                continue
            for j in range(1, inner + 1):
                part = _total([m for s, m in places.items() if int(s[f - 1]) == j], like)
                part = part - own[f, j] if (f, j) in own else part
                if part.n >= 1:
                    yield Fit(f, j, train - part, part, train)
            yield Fit(f, 0, train, test, train)

    return plan


def replicate_plan(cells: dict) -> Iterator[Fit]:
    """Cells 1, 2, ... are the drawn training sets, each scaled by itself; cell 0 is the test set."""
    if 0 in cells:
        for r in sorted(c for c in cells if c > 0):
            yield Fit(r, 0, cells[r], cells[0], cells[r])


def fit_sets(stats: DataFrame, key_cols: Sequence[str], plan: Plan) -> DataFrame:
    """The blocks of every fit of the plan: a group holds one block of all cells of a model."""
    key_cols = list(key_cols)
    heads = [stats.schema[k] for k in key_cols] + [T.StructField(c, T.IntegerType()) for c in ("outer", "fold", "bi", "bj")]
    schema = T.StructType(heads + _set_schema() + _set_schema("s_") + [T.StructField("scale_i", _VECTOR)])

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        key = {k: pdf[k].iloc[0] for k in [*key_cols, "bi", "bj"]}
        cells: dict = {}
        for cell, m in zip(pdf["cell"], _from_rows(pdf)):
            cells[cell] = cells[cell] + m if cell in cells else m
        rows = []
        for fit in plan(cells):
            if fit.train.n >= 1:
                spread = np.sqrt(np.clip(fit.scale.di / fit.scale.n, 0.0, None))
                spread[spread < 10 * np.finfo(float).eps * np.maximum(1.0, np.abs(fit.scale.mi))] = 1.0
                rows.append({**key, "outer": fit.outer, "fold": fit.fold, **_as_row(fit.train), **_as_row(fit.score, "s_"), "scale_i": spread})
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return stats.groupBy(*key_cols, "bi", "bj").applyInPandas(sums, schema)


def _whole(pdf: pd.DataFrame, prefix: str = "") -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and scatter of a set from its blocks."""
    sets = _from_rows(pdf, prefix)
    at = {(i, j): m for i, j, m in zip(pdf["bi"], pdf["bj"], sets)}
    n_blocks = max(i for i, _ in at) + 1
    mean = np.concatenate([at[i, i].mi for i in range(n_blocks)])
    ends = np.cumsum([0, *(len(at[i, i].mi) for i in range(n_blocks))])
    q = np.empty((ends[-1], ends[-1]))
    for (i, j), m in at.items():
        q[ends[i] : ends[i + 1], ends[j] : ends[j + 1]] = m.q
        q[ends[j] : ends[j + 1], ends[i] : ends[i + 1]] = m.q.T
    return sets[0].n, mean, q


def _fit(stats: tuple[float, np.ndarray, np.ndarray], alpha: float, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge with intercept on features scaled by ``scale``; returns
    coefficients for the unscaled features and the intercept."""
    n, mu, C = stats
    p = len(mu) - 1
    dinv = 1.0 / scale
    A = dinv[:, None] * C[:p, :p] * dinv[None, :]
    A[np.diag_indices(p)] += alpha
    beta = dinv * np.linalg.solve(A, dinv * C[:p, p])
    return beta, float(mu[p] - mu[:p] @ beta)


def _scores(stats: tuple[float, np.ndarray, np.ndarray], beta: np.ndarray, b0: float) -> tuple[float, float]:
    """(R^2, squared Pearson r) of predictions on a set, from its moments."""
    n, mu, C = stats
    p = len(beta)
    cyy, cxy, spread = C[p, p], C[:p, p], beta @ (C[:p, :p] @ beta)
    off = mu[p] - b0 - mu[:p] @ beta
    sse = cyy - 2 * beta @ cxy + spread + n * off * off
    r2 = 1.0 - sse / cyy if cyy > 0 else float("nan")
    pr2 = (beta @ cxy) ** 2 / (cyy * spread) if cyy > 0 and spread > 0 else float("nan")
    return float(r2), float(pr2)


_FIT_FIELDS = [T.StructField("outer", T.IntegerType()), T.StructField("fold", T.IntegerType()), T.StructField("alpha_no", T.IntegerType())] + [
    T.StructField(c, T.DoubleType()) for c in ("alpha", "intercept")] + [T.StructField(c, _VECTOR) for c in ("coef", "scale")] + [
    T.StructField(c, T.DoubleType()) for c in ("n_train", "n_test", "r2", "pearson_r2")]


def solve(sets: DataFrame, key_cols: Sequence[str], alphas: Sequence[float] | str) -> DataFrame:
    """One row for each fit and alpha: ``(key, outer, fold, alpha_no, alpha, intercept, coef, scale, n_train, n_test, r2, pearson_r2)``.

    ``alphas``: a grid, or the name of a column of ``sets`` that holds the key's alpha.
    """
    key_cols = list(key_cols)
    schema = T.StructType([sets.schema[k] for k in key_cols] + _FIT_FIELDS)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        key = {k: pdf[k].iloc[0] for k in [*key_cols, "outer", "fold"]}
        train, score = _whole(pdf), _whole(pdf, "s_")
        scales = {i: v for i, j, v in zip(pdf["bi"], pdf["bj"], pdf["scale_i"]) if i == j}
        scale = np.concatenate([scales[i] for i in sorted(scales)])[:-1]
        rows = []
        for no, alpha in enumerate([float(pdf[alphas].iloc[0])] if isinstance(alphas, str) else alphas):
            beta, b0 = _fit(train, alpha, scale)
            r2, pr2 = _scores(score, beta, b0) if score[0] > (0 if key["fold"] else 1) else (float("nan"), float("nan"))
            rows.append({**key, "alpha_no": no, "alpha": alpha, "intercept": b0, "coef": beta, "scale": scale, "n_train": train[0],
                         "n_test": score[0], "r2": r2, "pearson_r2": pr2})
        return pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return sets.groupBy(*key_cols, "outer", "fold").applyInPandas(fit, schema)


# --------------------------------------------------------------------------- jobs

Scorer = Callable[[Column, Column], Column]


def best_alpha(fits: DataFrame, key_cols: Sequence[str], score: str, tables: DataFrame | None = None) -> DataFrame:
    """The fit on all training rows with the alpha of the best mean fold score (the first of equal ones, NaN below all),
    and that score as ``cv_score``; ``tables`` replaces the folds' scores."""
    keys = [*key_cols, "outer"]
    folds = tables if tables is not None else fits.where("fold > 0")
    means = folds.groupBy(*keys, "alpha_no").agg(F.avg(score).alias("cv_score"))
    rank = F.struct(F.when(F.isnan("cv_score") | F.col("cv_score").isNull(), F.lit(float("-inf"))).otherwise(F.col("cv_score")), -F.col("alpha_no"))
    best = means.groupBy(*keys).agg(F.max_by(F.struct("alpha_no", "cv_score"), rank).alias("_best"))
    out = with_keys(fits.where("fold = 0"), best, keys, "left")
    # a model without any scored fold takes the first alpha
    out = out.where(F.col("alpha_no") == F.coalesce(F.col("_best.alpha_no"), F.lit(0)))
    return out.withColumn("cv_score", F.coalesce("_best.cv_score", F.lit(float("nan")))).drop("_best", "fold", "alpha_no")


def fold_predictions(data: DataFrame, fits: DataFrame, key_cols: Sequence[str], cell_col: str, features: str, y: str) -> DataFrame:
    """``(key, outer, fold, alpha_no, y, pred)``: every row of a fold predicted by the fold's fits of all alphas.

    The coefficient vectors of a (key, fold) travel in one row; each data row meets them once."""
    from sporeframe.operators.joins import small_side

    key_cols = list(key_cols)
    lines = F.collect_list(F.struct("alpha_no", "intercept", "coef")).alias("_lines")
    vectors = fits.groupBy(*key_cols, "outer", F.col("fold").alias(cell_col)).agg(lines)
    rows = data.where(F.col(y).isNotNull() & ~F.isnan(y) & F.col(features).isNotNull()).select(*key_cols, cell_col, features, F.col(y).alias("y"))
    met = with_keys(rows, small_side(vectors), [*key_cols, cell_col])
    one = F.transform("_lines", lambda m: F.struct(m["alpha_no"].alias("alpha_no"), (m["intercept"] + dot(F.col(features), m["coef"])).alias("pred")))
    e = met.select(*key_cols, "outer", F.col(cell_col).alias("fold"), "y", F.explode(one).alias("_p"))
    return e.select(*key_cols, "outer", "fold", F.col("_p.alpha_no").alias("alpha_no"), "y", F.col("_p.pred").alias("pred"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def ridge_cv(data: DataFrame | Sequence[Source], key_cols: Sequence[str], cell_col: str, features: str, y: str,
             alphas: Sequence[float] = REFERENCE_ALPHAS, n_folds: int = 5, cv_metric: str | Scorer = "r2", id_col: str | None = None,
             rows_per_task: int = 500_000, fanin: int = 64, block: int = BLOCK) -> DataFrame:
    """M3 (+ M1, M4, M6, M7, X4): one ridge model per key.

    ``cell_col``: 0 = test rows, 1..n_folds = CV folds of the training rows.
    Alpha is chosen by the mean fold score, the model is refit on all training
    rows, and the test cell gives ``test_r2`` / ``test_pearson_r2``.

    ``data`` may be sources of different models; their rows hold ``cell_col``, ``id_col`` and ``y``.

    ``cv_metric``: "r2" (as ``RidgeCV(cv=k)``), "pearson_r2", or any scorer: a function of two columns, the
    target and the prediction, that returns an aggregate Column (larger is better).  A scorer reads the folds' rows once more,
    for all alphas and folds at once, and also scores the test rows (``test_score``).
    """
    key_cols = list(key_cols)
    if isinstance(cv_metric, str) and cv_metric not in ("r2", "pearson_r2"):
        raise ValueError(f"cv_metric must be 'r2', 'pearson_r2' or a function of two columns, not {cv_metric!r}")
    if isinstance(data, DataFrame):
        stats = model_statistics(data, key_cols, cell_col, features, y, id_col=id_col, rows_per_task=rows_per_task, fanin=fanin, block=block)
    else:
        each = min(rows_per_task, MADE_ROWS)
        stats = reduce(DataFrame.unionByName, [source_statistics(s, key_cols, cell_col, features, y, id_col, each, fanin, block) for s in data])
        data = reduce(DataFrame.unionByName, [s.make(s.rows, [cell_col, y]) for s in data])
    fits = reliable_checkpoint(solve(fit_sets(stats, key_cols, cv_plan(n_folds)), key_cols, [float(a) for a in alphas]))
    extra = []
    if isinstance(cv_metric, str):
        models = best_alpha(fits, key_cols, cv_metric)
    else:
        scored = fold_predictions(data, fits, key_cols, cell_col, features, y).groupBy(*key_cols, "outer", "fold", "alpha_no")
        scored = reliable_checkpoint(scored.agg(cv_metric(F.col("y"), F.col("pred")).cast("double").alias("score")))
        models = best_alpha(fits, key_cols, "score", scored.where("fold > 0"))
        tested = scored.where("fold = 0").select(*key_cols, F.col("alpha_no").alias("_no"), F.col("score").alias("test_score"))
        numbers = F.element_at(F.create_map(*[F.lit(v) for no, a in enumerate(alphas) for v in (float(a), no)]), F.col("alpha"))
        models = with_keys(models.withColumn("_no", numbers), tested, [*key_cols, "_no"], "left").drop("_no")
        extra = ["test_score"]
    return models.select(*key_cols, "alpha", "intercept", "coef", "scale", "cv_score", "n_train", "n_test", F.col("r2").alias("test_r2"),
                         F.col("pearson_r2").alias("test_pearson_r2"), *extra)


def nested_ridge(data: DataFrame, key_cols: Sequence[str], cell_col: str, features: str, y: str, outer: int, inner: int,
                 alphas: Sequence[float] = REFERENCE_ALPHAS, id_col: str | None = None, rows_per_task: int = 500_000, fanin: int = 64, block: int = BLOCK) -> DataFrame:
    """M8: for each key and outer fold a ridge whose alpha inner folds choose, scored on the outer fold; cells as `nested_plan` names them.

    Every row is read once and adds to one cell; all training and inner sets are sums and differences of cells."""
    key_cols = list(key_cols)
    stats = model_statistics(data, key_cols, cell_col, features, y, id_col=id_col, rows_per_task=rows_per_task, fanin=fanin, block=block)
    fits = reliable_checkpoint(solve(fit_sets(stats, key_cols, nested_plan(outer, inner)), key_cols, [float(a) for a in alphas]))
    return best_alpha(fits, key_cols, "r2")


def ridge_bootstrap(data: DataFrame, key_cols: Sequence[str], cell_col: str, features: str, y: str,
                    weights: str, alpha: str, id_col: str | None = None, rows_per_task: int = 500_000, fanin: int = 64, block: int = BLOCK) -> DataFrame:
    """M9 (+ M4): for each key and replicate, a fixed-alpha ridge fit on the
    weighted training rows, scored on the test rows (cell 0).

    ``weights`` holds the replicate weights of training rows (NULL on test
    rows); ``alpha`` is a per-key column (e.g. the alpha ``ridge_cv`` chose).
    """
    key_cols = list(key_cols)
    stats = model_statistics(data, key_cols, cell_col, features, y, weights, id_col, rows_per_task, fanin, block)
    chosen = reliable_checkpoint(data.groupBy(*key_cols).agg(F.max(alpha).alias("_alpha")))
    sets = with_keys(fit_sets(stats, key_cols, replicate_plan), chosen, key_cols).where("n >= 2")
    return solve(sets, key_cols, "_alpha").select(*key_cols, F.col("outer").alias("replicate"), "r2", "pearson_r2")


def predict(rows: DataFrame, models: DataFrame, key_cols: Sequence[str], features: str,
            name: str = "Predicted_Value") -> DataFrame:
    """M5: ``intercept + x . coef`` for each row, its model joined by key.
    The model table has one row per key (bounded by the number of models)."""
    from sporeframe.operators.joins import small_side

    m = small_side(models.select(*key_cols, "intercept", "coef"))
    j = with_keys(rows, m, list(key_cols))
    return j.withColumn(name, F.col("intercept") + dot(F.col(features), F.col("coef"))).drop("intercept", "coef")
