"""Operator 11 against a plain version, text by text."""

import hashlib
import random
from collections import Counter

import pytest

from sporeframe.llm.digest import MOST, compare_neighbours, digests, edited, from_digest, likeness, to_digest


def plain_digest(text):
    raw = (text or "").encode()
    counts = [0] * 256
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        counts[(((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 24] += 1
    q = [sorted(counts)[k] for k in (63, 127, 191)]
    codes = [sum(c > x for x in q) for c in counts]
    n = len(raw)
    size = n if n < 4 else 4 * (n.bit_length() - 1) + (n >> (n.bit_length() - 3)) % 4
    ratios = [min(16 * x // max(q[2], 1), 15) for x in q[:2]]
    return [size, *ratios, *codes]


def plain_hex(codes):
    body = [codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(3, 259, 4)]
    return bytes([codes[0], codes[1] << 4 | codes[2], *body]).hex()


def plain_likeness(a, b):
    gap = sum([0, 1, 2, 6][abs(x - y)] for x, y in zip(a[3:], b[3:])) + sum(min(2 * abs(x - y), 24) for x, y in zip(a[:3], b[:3]))
    return 1 - min(gap, MOST) / MOST


def texts(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Ünïcode", "長い", "x", "🙂", "gamma\n"]
    made = [None, "", "a", "ab", "abc", "abcd", "🙂🙂🙂🙂"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    return made + [" ".join(rng.choice(words) for _ in range(60_000)), made[20], made[20]]


def plain(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        changed = t[: len(t) - n] + following[:n]
        a, b, c = plain_digest(t), plain_digest(changed), plain_digest(following)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), plain_hex(a), plain_hex(b), plain_likeness(a, b), plain_likeness(a, c)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, id string")


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours(spark, parts):
    rows = [(3 * k - 20, t) for k, t in enumerate(texts())]
    found = compare_neighbours(frame(spark, random.Random(2).sample(rows, len(rows))).repartition(parts))
    assert found.columns == ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(plain(rows))


def test_repeated_and_null_ids(spark):
    rows = [(None, "first of all"), (1, "one text"), (1, "one text"), (1, "one text"), (2, None)]
    found = compare_neighbours(frame(spark, rows).repartition(3)).collect()
    assert Counter((r["id"], r["fingerprint"]) for r in found) == Counter((i, plain_hex(plain_digest(t))) for i, t in rows)
    assert sum(r["near_next"] == 1 for r in found if r["id"] == 1) >= 2


def test_one_row_and_no_row(spark):
    only, = compare_neighbours(frame(spark, [(5, "a text that is its own next")])).collect()
    assert only["near_next"] == 1 and only["edited_sha256"] == hashlib.sha256(edited("a text that is its own next", "a text that is its own next", 4).encode()).hexdigest()
    assert compare_neighbours(frame(spark, [(1, "x")]).limit(0)).collect() == []
    assert digests(frame(spark, [(1, "x")]).limit(0)).collect() == []


def test_digests_and_likeness(spark):
    made = texts(4)
    found = digests(frame(spark, list(enumerate(made)))).collect()
    assert {r["id"]: r["fingerprint"] for r in found} == {i: plain_hex(plain_digest(t)) for i, t in enumerate(made)}
    codes = from_digest([r["fingerprint"] for r in found])
    assert to_digest(codes) == [r["fingerprint"] for r in found]
    pairs = [(plain_hex(plain_digest(a)), plain_hex(plain_digest(b))) for a, b in zip(made, made[1:])] + [(None, found[0]["fingerprint"])]
    df = spark.createDataFrame(pairs, "a string, b string").select(likeness("a", "b").alias("x")).collect()
    assert [r["x"] for r in df[:-1]] == [plain_likeness(plain_digest(a), plain_digest(b)) for a, b in zip(made, made[1:])]
    assert df[-1]["x"] is None
