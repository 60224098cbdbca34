"""Operator 12 against a brute-force trie."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sporeframe.llm.common import PRIME, materialise, reduce61, span_hash, times61
from sporeframe.llm.queries import rebuilt_turns
from sporeframe.llm.trie import conversation_trie, ends_digest, number_turns, split_all, trie


def conversations(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for seq, mine in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        kids = [s for s in below if len(s) == len(seq) + 1]
        leaves = sum(1 for s in below if not any(len(x) == len(s) + 1 and x[: len(s)] == s for x in below))
        saved = sum((len(members[s]) - 1) * (len(s[-1][1]) if s else 0) for s in below)
        ends = ",".join(str(c) for c in sorted(c for c in mine if len(convs[c]) == len(seq)))
        out.append((min(mine), len(seq), min(members[seq[:-1]]) if seq else None, len(mine), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == cols
    return sorted((tuple(r) for r in df.collect()), key=str)


def fixture(seed=0):
    rng = random.Random(seed)
    words = ["hi", "Ü", "", None, "x y", "hello there"]
    rows = []
    for c in [0, 1, 2, 3, 5, 8, 42, 99, 100, 101, 107, 150, 199, 205, 230, 301, 1000]:
        n = rng.choice([1, 1, 2, 3, 5, 7])
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for t in range(n)]
    rows += [(7, k, "user", "hi") for k in range(40)]           # a long chain
    rows += [(c, 0, "user", "hi") for c in [*range(300, 340), *range(4001, 4012)]]     # copies; the latter have no template
    rows += [(12, None, "user", "first"), (12, 1, "b", "t"), (12, 1, "a", "u"), (12, 1, "a", "t"), (12, 1, "a", "t")]  # ties, repeats
    rows += [(None, 0, "user", "hi"), (None, None, None, None), (13, 0, None, None), (14, 0, "", "")]
    return rows


def frame(spark, rows):
    schema = "conv_id long, turn long, role string, text string, depth string, node int, i string, n int, top int, h1 string"
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3, "z") for r in rows], schema).repartition(5)


@pytest.mark.parametrize("component_rows", [1, 6, 40, 1 << 16])
def test_trie_of_every_component_size(spark, component_rows):
    rows = fixture()
    assert got(conversation_trie(frame(spark, rows), component_rows=component_rows, chunk_bytes=16)) == brute(conversations(rows))


def test_rebuilt_conversations(spark):
    rows = fixture(3)
    turns = materialise(number_turns(frame(spark, rows)), "test-turns")
    want = rebuilt(conversations(rows))
    assert any(not t for t in want.values()) and any(len(t) > 3 for t in want.values())
    assert got(trie(rebuilt_turns(turns))) == brute(want)


def test_string_ids_and_empty_table(spark):
    df = spark.createDataFrame([("b", 0, "user", "q"), ("a", 0, "user", "q"), ("a", 1, "user", "é")], "conv_id string, turn int, role string, text string")
    rows = {r["depth"]: r for r in conversation_trie(df, component_rows=1).collect()}
    assert (rows[0]["conv_id"], rows[0]["n_leaves"], rows[0]["saved_tokens"], rows[2]["parent_conv_id"]) == ("a", 1, 1, "a")
    assert rows[1]["ends_sha256"] == hashlib.sha256(b"b").hexdigest()
    assert conversation_trie(df.limit(0)).collect() == []


def test_a_conversation_over_many_partitions(spark):
    """A conversation that fills several range partitions gets the same numbers and hashes."""
    rows = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}") for t in range(2000)]
    df = trie_frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["depth"]): r for r in conversation_trie(trie_frame.repartition(8), component_rows=500).collect()}
    assert len(out) == 3001 and df.count() == 5000
    assert out[1, 2000]["n_convs"] == 2 and out[1, 2001]["n_convs"] == 1 and out[1, 0]["n_leaves"] == 1
    assert out[1, 0]["saved_tokens"] == sum(len(f"t{t}") for t in range(2000))
    assert out[1, 2000]["ends_sha256"] == hashlib.sha256(b"2").hexdigest()


def test_digest_of_a_hot_node(spark):
    ids = list(range(0, 60_000, 3))
    ends = spark.createDataFrame([(0, 1, i) for i in ids] + [(5, 1, 5), (4, 2, 4)], "node long, depth long, conv_id long").repartition(6)
    out = {(r["node"], r["depth"]): r["ends_sha256"] for r in ends_digest(ends, chunk_bytes=1000).collect()}
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert out == {(0, 1): sha(ids), (5, 1): sha([5]), (4, 2): sha([4])}


def test_split_all_on_random_trees():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 10, 400):
        for shape in ("random", "chain", "star"):
            parent = np.array([-1] + [{"random": int(rng.integers(0, i)), "chain": i - 1, "star": 0}[shape] for i in range(1, n)])
            depth = np.zeros(n, dtype=np.int64)
            for i in range(1, n):
                depth[i] = depth[parent[i]] + 1
            order = np.argsort(depth, kind="stable")
            back = np.argsort(order)
            parent = np.where(parent[order] < 0, -1, back[parent[order]])
            values, weight = rng.integers(0, 50, n), np.ones(n, dtype=np.int64)
            want = values.copy()
            for i in range(n - 1, 0, -1):
                want[parent[i]] += want[i]
                weight[parent[i]] += weight[i]
            out, = split_all(parent, weight, [values], [np.zeros(n, dtype=np.int64)])
            assert out.tolist() == want.tolist()


def test_arithmetic_of_span_hashes():
    rng = np.random.default_rng(0)
    a, b = (np.concatenate([np.array([0, 1, PRIME - 1, PRIME - 2], dtype=np.uint64), rng.integers(0, PRIME, 500, dtype=np.uint64)]) for _ in range(2))
    assert [int(x) for x in reduce61(times61(a, b))] == [int(x) * int(y) % PRIME for x, y in zip(a, b)]
    h, data = span_hash(3), rng.integers(0, 3, 400).astype(np.uint8)
    prefix = h.byte_prefix(data)
    seen = {}
    for i in range(0, 400, 7):
        for j in range(i, min(i + 30, 401)):
            code = int(h.spans(prefix, np.array([i]), np.array([j]))[0])
            assert seen.setdefault(code, bytes(data[i:j])) == bytes(data[i:j])
