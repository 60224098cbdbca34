"""Operator 13 against a brute-force search over all periods."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sporeframe.llm.queries import op13_periodic_runs
from sporeframe.llm.runs import Wavelet, block_ranks, extend, extend_back, find_runs, periodic_runs


def brute_runs(words, min_length=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, 2 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def codes(docs):
    flat = [(d, w) for d, ws in enumerate(docs) for w in ws]
    number = {x: k for k, x in enumerate(dict.fromkeys(flat))}
    ends = np.cumsum([len(ws) for ws in docs])
    return np.array([number[x] for x in flat], dtype=np.int64), np.array([ends[d] for d, _ in flat], dtype=np.int64)


def word_lists(seed=0):
    """Random words over small alphabets, powers of words, Fibonacci and Thue-Morse words, squares side by side."""
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 100, list("ab" * 40), list("abc" * 4), list("abcdef" * 2), list("x" + "abcdef" * 2 + "y")]
    a, b = "a", "ab"
    for _ in range(9):
        a, b = b, b + a
    out += [list(b), list("ab" * 15 + "a" + "a" + "ba" * 15), [str(bin(i).count("1") % 2) for i in range(300)]]
    for _ in range(150):
        letters = "abcd"[: rng.randrange(1, 5)]
        parts = []
        for _ in range(rng.randrange(1, 5)):
            u = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 13, 20]))]
            parts += (u * rng.randrange(1, 9))[: rng.randrange(1, 120)]
        out.append(parts)
    for q in range(1, 70):  # every period, at every place of the dyadic blocks
        u = [f"w{rng.randrange(50)}" for _ in range(q)]
        out.append([f"v{k}" for k in range(rng.randrange(0, 40))] + (u * 20)[: max(12, 2 * q + rng.choice([0, 0, 1, q]))] + ["end"])
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_runs_of_many_documents_at_once(seed):
    docs = word_lists(seed)
    start, stop, period = find_runs(*codes(docs))
    base = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    for k, words in enumerate(docs):
        mine = (start >= base[k]) & (start < base[k + 1])
        assert list(zip((start[mine] - base[k]).tolist(), (stop - start)[mine].tolist(), period[mine].tolist())) == brute_runs(words), words


def test_exhaustive_short_words():
    docs = [list(f"{k:014b}") for k in range(1 << 14)]
    start, stop, period = find_runs(*codes(docs))
    got = Counter((s // 14, s % 14, e - s, q) for s, e, q in zip(start.tolist(), stop.tolist(), period.tolist()))
    assert got == Counter((k, *r) for k, words in enumerate(docs) for r in brute_runs(words))


def test_wavelet_and_extensions():
    rng = np.random.default_rng(1)
    values = rng.permutation(500)
    tree = Wavelet(values)
    lo = rng.integers(0, 500, 300)
    hi = rng.integers(lo, 501)
    v = rng.integers(0, 600, 300)
    assert tree.below(lo, hi, v).tolist() == [(values[a:b] < x).sum() for a, b, x in zip(lo, hi, v)]
    full = hi > lo
    k = rng.integers(0, np.maximum(hi - lo, 1))
    assert tree.smallest(lo[full], hi[full], k[full]).tolist() == [np.sort(values[a:b])[c] for a, b, c in zip(lo[full], hi[full], k[full])]
    word = rng.integers(0, 2, 400)
    levels = block_ranks(word, np.full(400, 400)).levels
    a, b = np.sort(rng.integers(0, 400, (2, 500)), axis=0)
    a, b = a[a < b], b[a < b]
    ahead = lambda i, j: next((t for t in range(400 - j) if word[i + t] != word[j + t]), 400 - j)
    back = lambda i, j: next((t for t in range(i) if word[i - 1 - t] != word[j - 1 - t]), i)
    assert extend(levels, a, b).tolist() == [ahead(i, j) for i, j in zip(a, b)]
    assert extend_back(levels, a, b).tolist() == [back(i, j) for i, j in zip(a, b)]


def split(text):
    return [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def rows_fixture():
    rng = random.Random(8)
    words = ["é", "长", "foo", "bar", "naïve x", "a"]
    texts = [None, "", " \n\t", "one", "\x0b".join(["é 长"] * 9), " a" * 40 + "\n", "a b " * 14]
    texts += [rng.choice([" ", "\n", "\r\n "]).join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    texts += [" ".join(f"w{k % 700}" for k in range(5000)), "b " * 30_000, texts[20], texts[20]]
    rows = list(enumerate(texts, 1000))
    return rows + [(None, "c d " * 9), (1003, "same id " * 7), (1003, "same id " * 7)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, id int, runs string, start int").repartition(4)


def test_documents(spark):
    rows = rows_fixture()
    found = periodic_runs(frame(spark, rows)).collect()
    want = []
    for i, t in rows:
        words = split(t)
        runs = brute_runs(words) if len(words) < 10_000 else [(0, len(words), 1)]
        want.append((i, len(words), runs, collapse(words, runs)))
    assert Counter(repr((r["id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])) for r in found) == Counter(map(repr, want))
    assert periodic_runs(frame(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        find_runs(np.zeros(5, dtype=np.int64), np.full(5, 5), 3)


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in rows_fixture() if t is None or len(t) < 20_000]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 3
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        words, n = split(t), len(split(t))
        if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + k % p] for k in range(n - a)]
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapse(words, runs).encode()).hexdigest()))
    df = op13_periodic_runs(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in df.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert Counter(map(repr, map(tuple, df.collect()))) == Counter(map(repr, want))
