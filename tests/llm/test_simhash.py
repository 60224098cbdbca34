"""Operator 9 against a brute-force version, and its defined edge cases."""

import random

import numpy as np
import xxhash

from sporeframe.llm.simhash import link_fingerprints, near_duplicates


def brute_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, bits):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                label[root(i)] = root(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(len(ids))]


def test_documents_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)] + ["Été", "ÀB"]
    texts = [None, "", " \t\n", "one", "One  Two", "ONE\x0btwo three", "a b c d", "x y z. " * 400]
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(40):
        near = list(base)
        near[rng.randrange(120)] = rng.choice(words)
        texts.append(rng.choice([" ", "\n"]).join(near))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts += [" ".join(base)] * 5
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "one"), (3, "one")]
    got = near_duplicates(
        spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fingerprint int").repartition(5)
    ).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], prints, 4)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got), key=key) == sorted(
        ((i, p, c) for (i, _), p, c in zip(rows, prints, want)), key=key
    )


def test_every_link_once_for_several_distances(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    made = set(base.tolist()) | {0, -1}
    for b in base.tolist() + [0, -1]:
        for k in (1, 2, 3, 4, 5, 6, 8):
            x = b % (1 << 64)
            for j in rng.choice(64, k, replace=False):
                x ^= 1 << int(j)
            made.add(x - (1 << 64) if x >> 63 else x)
    made = sorted(made)
    df = spark.createDataFrame([(x,) for x in made], "fingerprint long")
    for bits in (2, 3, 4, 5, 7):
        got = [tuple(r) for r in link_fingerprints(df, bits).collect()]
        want = {(a, b) for a in made for b in made if a < b and ((a ^ b) % (1 << 64)).bit_count() <= bits}
        assert len(got) == len(set(got)) and set(got) == want


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_index_of_variants_is_not_broadcast(spark):
    """64 rows a fingerprint, of which Spark's sizes know nothing."""
    found = link_fingerprints(spark.range(0, 3000, 7).selectExpr("id * 1000003L AS fingerprint"))
    pairs = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    made = [i * 1_000_003 for i in range(0, 3000, 7)]
    assert {tuple(r) for r in pairs} == {(a, b) for a in made for b in made if a < b and (a ^ b).bit_count() <= 4}
