"""Operators 2, 3 and 5 and the link components against brute-force versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from sporeframe.llm.capfilter import near_vectors
from sporeframe.llm.chat import escape, parse, prefix_trees, read_back, unescape
from sporeframe.llm.common import components
from sporeframe.llm.sharding import shard_documents


def roots(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(90)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(300, links)
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- embeddings ---------------------------------------------------------------------------------------

def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        base = rng.standard_normal(64)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), (base + rng.standard_normal(64) * rng.choice([0, 0.1, 0.3, 0.38, 0.5])).astype(np.float32).tolist(), int(k % 3)))
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], 2), (n + 2, rows[0][1], None), (n + 3, None, 1), (n + 4, [0.0] * 64, 1), (n + 5, [0.0] * 64, 1),
             (n + 6, [1.0] * 63 + [None], 1), (n + 7, [1.0] * 63 + [float("nan")], 1), (n + 8, [1.0] * 63 + [float("inf")], 1), (n + 9, [], 1), (n + 10, [1.0, 2.0], 1),
             (n + 11, [2.0, 4.0], 1), (n + 12, [1.0], 1), (n + 13, [3.0], 1), (n + 14, [-3.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, size int, node string").repartition(5)
    got = {r["id"]: r for r in near_vectors(df).collect()}
    good = [(i, np.array(v, dtype=np.float64), g) for i, v, g in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a[0], b[0]) for x, a in enumerate(good) for b in good[:x] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    degree, label = Counter(x for ab in links for x in ab), roots(len(rows), links)
    assert len(links) > 40
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (degree[i], label[i], label[i] == i) for i in range(len(rows))}
    assert near_vectors(df.limit(0)).collect() == []


# --- sharding -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 3, 400])
def test_sharding(spark, n):
    rng = random.Random(n)
    texts = [rng.choice([None, "", "hot", "hot", f"t{rng.randrange(60)}", f"own {i} é"]) for i in range(n)]
    rows = [(i if i % 50 else None, t, "c", 1) for i, t in enumerate(texts)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string, size int").repartition(3)).collect()
    assert Counter((r["id"], r["size"]) for r in out) == Counter((i, len((t or "").encode()) + 1) for i, t, _, _ in rows)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) <= set(range(8)) and (not n or max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(set)
    count = Counter((r["k1"], r["k2"]) for r in out)
    for r in out:
        groups[r["k1"], r["k2"]].add(r["shard"])
    if n == 400:  # a group fills as many shards as it needs and two more at most
        assert all(len(s) <= -(-count[g] // 50) + 2 for g, s in groups.items())
        assert sum(len(s) > 1 for g, s in groups.items() if count[g] < 25) <= 4
        # filling shards of 50 group by group cuts at most one group at each of the 7 borders: no more families than that
        order, at, greedy = sorted(count.values(), reverse=True), 0, 0
        for size in order:
            greedy += (at + size - 1) // 50 - at // 50 + 1
            at += size
        assert sum(map(len, groups.values())) <= greedy + 4


def test_sharding_of_a_long_text_and_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"own {i}") for i in range(900)] + [(900, "é" * 3_000_000)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sizes, hot = Counter(r["shard"] for r in out), Counter(r["shard"] for r in out if r["size"] == 4)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and max(r["size"] for r in out) == 6_000_001
    assert sum(n for _, n in hot.most_common(3)) >= 0.8 * 300  # in shards of 113


# --- chat ---------------------------------------------------------------------------------------------

def test_escapes_are_reversible():
    rng = random.Random(2)
    signs = ["\\", "#", "<", ":", " ", "\n", "/", "turn>", "### ", " </turn>\n", "a", "é", "\x00"]
    for _ in range(500):
        turns = [("".join(rng.choice(signs) for _ in range(rng.randrange(5))), "".join(rng.choice(signs) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(4))]
        text = "".join(f"### {escape(r, ':')}: {escape(t)} </turn>\n" for r, t in turns)
        assert parse(text) == turns and all(unescape(escape(t)) == t for _, t in turns)
    with pytest.raises(ValueError):
        parse("### user: a < b </turn>\n")


def test_prefix_trees(spark):
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rng = random.Random(5)
    rows = []
    for c in range(40):
        n = rng.randrange(1, 6)
        for k in range(n):
            rows.append((c, k, rng.choice(["user", "assistant", "system"]) if k > 1 else "user", rng.choice(["same words", "other <words>", "### x: ", "", "é\\n", None])))
    rows += [(100, None, "assistant", "first"), (100, 0, None, "no role"), (100, 0, None, "no role"), (None, 1, "assistant", "lost"), (101, 5, "assistant", "y " * 20_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, node int, tree string").repartition(4)
    trees = prefix_trees(df, vocabulary, pattern)
    by = defaultdict(list)
    for c, k, r, t in rows:
        by[c].append(((k is not None, k or 0), r or "", t or ""))
    want = {c: [(r, t) for _, r, t in sorted(v)] for c, v in by.items()}
    got = {r["conv_id"]: r for r in read_back(trees, vocabulary, pattern).collect()}
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == want
    assert {c: r["learned"] for c, r in got.items()} == {c: "".join(t for r, t in v if r == "assistant") for c, v in want.items()}
    nodes = trees.nodes.collect()
    prefixes = {tuple(v[: k + 1]) for v in want.values() for k in range(len(v))}
    assert len(nodes) == len(prefixes)  # each shared turn once
    whole = defaultdict(list)
    for n in nodes:
        whole[n["tree"]].append(n)
    for tree in whole.values():
        tree.sort(key=lambda n: n["start"])
        at, open_at = 0, []
        starts = {n["start"]: n for n in tree}
        for n in tree:
            assert n["start"] == at and n["length"] == len(n["ids"])
            at += n["length"]
            open_at = open_at[: n["depth"]]  # depth-first: the parent is on the open path
            assert len(open_at) == n["depth"] and (open_at[-1] if open_at else None) == n["parent_start"]
            seen = [i for a in open_at for i in range(a, a + starts[a]["length"])]
            assert [i for s in n["attends"] for i in range(s["start"], s["end"])] == seen and n["position"] == len(seen)
            open_at.append(n["start"])
    long = spark.createDataFrame([(c, k, "user", f"t{k}") for c in (1, 2) for k in range(700 + 100 * c)], "conv_id long, turn long, role string, text string")
    chain = prefix_trees(long, vocabulary, pattern)
    assert chain.nodes.count() == 900 and {r["conv_id"]: len(r["path"]) for r in chain.conversations.collect()} == {1: 800, 2: 900}
    empty = prefix_trees(df.limit(0), vocabulary, pattern)
    assert empty.nodes.collect() == [] and read_back(empty, vocabulary, pattern).collect() == []
    assert hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want[100]).encode()).hexdigest()


def test_scratch_tables_can_be_removed(spark):
    from pathlib import Path

    from sporeframe.llm.common import components, drop_scratch, materialise

    links = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    found = components(links)
    assert found.where("component <> 0").count() == 0 and found.count() == 201
    table = materialise(links, "kept")
    folder = Path(table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and drop_scratch(spark) >= 2 and not folder.exists() and drop_scratch(spark) == 0
