"""Recall of operator 5's filters on isolated pairs: no third vector helps to link them."""

import numpy as np
import pytest

from sporeframe.llm.capfilter import CODES, CODEWORDS, FILTERS, filter_lists, near_vectors


def isolated_pairs(n, size, cosine, seed):
    rng = np.random.default_rng(seed)
    x, z = rng.standard_normal((2, n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("size", [64, 128])
@pytest.mark.parametrize("cosine", [0.9301, 0.95])
def test_isolated_pairs_share_a_filter(size, cosine):
    x, y = isolated_pairs(3000, size, cosine, 5)
    a, b = (filter_lists(v, CODEWORDS, FILTERS, CODES) for v in (x, y))
    assert min(map(len, a)) >= FILTERS * CODES
    assert sum(not np.intersect1d(i, j).size for i, j in zip(a, b)) == 0


def test_isolated_pairs_are_linked(spark):
    x, y = isolated_pairs(3000, 64, 0.9301, 5)
    rows = [(2 * k + i, v[k].tolist(), k % 2) for i, v in enumerate((x, y)) for k in range(len(x))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert got == {i: (1, i // 2 * 2, i % 2 == 0) for i in range(6000)}
