"""Operators 1, 4, 8 and 10 against brute-force versions on texts with every edge case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path

from sporeframe.llm.common import byte_slices, windows, word_spans, ALNUM, LOWER
from sporeframe.llm.decontaminate import contamination, drop_contaminated
from sporeframe.llm.lines import PerfectHash, dedup_lines
from sporeframe.llm.packing import Packer, best_fill, pack_documents
from sporeframe.llm import substring
from sporeframe.llm.substring import dedup_substrings

UPPER = {i: i + 32 for i in range(65, 91)}


def docs_fixture(seed=0, n=120):
    """Rows ``(doc_id, text)``: nulls, blanks, repeats, shared passages and lines, a long text, clashing ids."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "ÀB", "x.", "the", "THE", "naïve…", "a b"]
    shared = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(4)]
    lines = ["  A line that many documents share, forty chars at least ", "short line", "Éé " * 20, "x" * 39, "y" * 40]
    texts = [None, "", " \t \x0b", "\n", "\n\n", "one", "One two"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice([*shared, *lines, *lines, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))]))
        texts.append(rng.choice(["\n", " ", "\r\n"]).join(parts))
    texts.append("\n".join([" ".join(rng.choice(words) for _ in range(4000)), *lines] * 2))
    rows = list(enumerate(texts))
    rows += [rows[10], rows[10], (None, texts[20]), (12, texts[30]), (None, None)]
    return rows


def frame(spark, rows, parts=4):
    """`rows` with columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, n_lines string, n_dropped int, id string, k1 int, chunk int, words int, score int, start int"
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, 4, 5, 6) for i, t in rows], schema).repartition(parts, "doc_id")


def bag(rows):
    return Counter(map(repr, rows))


# --- line dedup ---------------------------------------------------------------------------------------

def brute_lines(rows, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).translate(UPPER)
    held, last = Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k] += 1
                last[k] = i if k not in last or last[k] is None or (i is not None and i > last[k]) else last[k]
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and held[key(x)] >= min_docs and last[key(x)] != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_keys": 2, "index_bytes": 40}, {"min_chars": 1, "min_docs": 2}, {"min_chars": 1, "min_docs": 2, "index_bytes": 0, "chunk_bytes": 2000, "block_bytes": 1000, "shard_keys": 5}])
def test_line_dedup(spark, options):
    rows = docs_fixture()
    got = dedup_lines(frame(spark, rows), **options)
    assert got.columns == ["doc_id", "id", "k1", "chunk", "words", "score", "start", "text", "n_lines", "n_dropped"] or "id" in got.columns
    want = brute_lines(rows, options.get("min_chars", 40), options.get("min_docs", 5))
    assert bag(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == bag(want)


def test_line_dedup_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 1000, 20_000):
        h1, h2 = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        mph = PerfectHash.build(h1, h2)
        assert sorted(mph.slots(h1, h2).tolist()) == list(range(n))
    same = np.zeros(2, dtype=np.uint64)
    with pytest.raises(ValueError):
        PerfectHash.build(same, same)


# --- decontamination ----------------------------------------------------------------------------------

def brute_contamination(rows, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    wins = set()
    for item, t in items:
        w = words(t)
        size = min(width, len(w))
        wins |= {(tuple(w[i : i + size]), "" if item is None else str(item)) for i in range(len(w) - size + 1) if size}
    by = defaultdict(set)
    for w, item in wins:
        by[w].add(item)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in by}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in by:
                    hit |= set(range(a, a + size))
                    found |= by[tuple(w[a : a + size])]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_decontamination(spark, bits):
    rows = docs_fixture(1)
    rng = random.Random(4)
    pool = [re.sub(r"\s+", " ", t) for _, t in rows if t and len(t.split()) > 12]
    items = [(1, None), (2, ""), (3, "!!"), (4, "w3"), (5, "w1 w2"), (6, "no such words in any text at all"), (None, "w5, w6"), (7, "The the THE")]
    for k in range(25):
        w = rng.choice(pool).split()
        a = rng.randrange(len(w) - 8)
        items.append((10 + k // 2, ", ".join(w[a : a + rng.choice([3, 5, 9, 10, 11, 25])])))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    found = contamination(frame(spark, rows), bench, filter_bits=bits)
    got = [(r["id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()]
    want = brute_contamination(rows, items)
    assert bag(got) == bag(want)
    assert any(n for _, _, n, _ in want) and any(n == 0 and w for _, w, n, _ in want)
    clean = drop_contaminated(frame(spark, rows), bench)
    texts = dict(zip(range(len(rows)), want))
    assert bag((r["doc_id"], r["text"]) for r in clean.collect()) == bag(rows[k] for k, w in texts.items() if not w[2])
    assert clean.columns == frame(spark, rows).columns


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in contamination(docs, none).collect()) == [(1, 2, 0, []), (2, 0, 0, [])]
    assert contamination(docs.limit(0), none).collect() == []


# --- substring dedup ----------------------------------------------------------------------------------

def brute_substrings(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    order = lambda i: (i is not None, i or 0)
    first = {}
    for (i, _), w in zip(rows, words):
        for a in range(len(w) - width + 1):
            k, at = tuple(w[a : a + width]), (order(i), a)
            first[k] = min(first.get(k, at), at)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < (order(i), a):
                gone |= set(range(a, a + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("width, chunk, bucket", [(20, 8 << 20, 1 << 20), (20, 3000, 200), (3, 2000, 500), (1, 5000, 100)])
def test_substring_dedup(spark, width, chunk, bucket):
    rows = docs_fixture(2, 60) + [(900 + k, "p q r s " * k) for k in range(12)]
    found = dedup_substrings(frame(spark, rows), width=width, chunk_bytes=chunk, bucket_windows=bucket).collect()
    assert bag((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in found) == bag(brute_substrings(rows, width))
    for r in found:
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_substring_dedup_rows_that_each_shuffle_brings_in_another_order():
    """Blocks from other executors arrive in any order, so the steps may read the rows of a chunk in different orders."""
    rng = random.Random(8)
    shared = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(30)) for _ in range(6)]
    rows = [(rng.randrange(40), rng.choice(shared) + f" own{k} " + rng.choice(shared)) for k in range(40)] + [(None, shared[0]), (7, None), (7, None)]
    width, n_buckets = 5, 3
    chunks = [rows[:15], rows[15:30], rows[30:]]

    def read(c):
        mixed = rng.sample(chunks[c], len(chunks[c]))
        return pa.table({"chunk": pa.array([c] * len(mixed), pa.int64()), "id": pa.array([i for i, _ in mixed], pa.int64()), "text": pa.array([t or "" for _, t in mixed])})

    def grouped(tables, by):
        t = pa.concat_tables(tables)
        return {k: t.filter(pa.array([x == k for x in t[by].to_pylist()])) for k in set(t[by].to_pylist())}

    coarse = [substring._send_coarse(width, n_buckets)[0](read(c)) for c in range(3)]
    replies = [substring._answer_coarse(t) for t in grouped(coarse, "bucket").values()]
    mine = lambda c: grouped(replies, "chunk").get(c, replies[0].slice(0, 0))
    sent = [substring._send_windows(width, n_buckets, pa.int64())(read(c), mine(c)) for c in range(3)]
    replies += [substring._answer_windows(t) for t in grouped(sent, "bucket").values()]
    found = [r for c in range(3) for r in substring._remove(width, n_buckets)(read(c), mine(c)).to_pylist()]
    assert bag((r["id"], r["n_words"], r["n_removed"], r["kept"]) for r in found) == bag(brute_substrings(rows, width))


def mirrored(n):
    """A sequence of two letters and its complement, which collide under every polynomial hash modulo a power of two."""
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t[:n]), "".join("ba"[x] for x in t[:n])


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_and_lines_that_collide_modulo_powers_of_two(spark, n):
    x, y = mirrored(n)
    plain = " ".join(f"w{k}" for k in range(19))
    df = spark.createDataFrame([(1, f"{plain} {x}"), (2, f"{plain} {y}")], "doc_id long, text string")
    assert [r["n_removed"] for r in dedup_substrings(df).collect()] == [0, 0]
    df = spark.createDataFrame([(k, x if k < 4 else y) for k in range(1, 6)], "doc_id long, text string")
    assert [r["n_dropped"] for r in dedup_lines(df).collect()] == [0] * 5


def test_substring_dedup_string_ids_and_empty_table(spark):
    rows = [("b", "x " * 25), ("a", "x " * 21), (None, "z"), ("c", "x " * 20)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["id"]: r["n_removed"] for r in dedup_substrings(df, chunk_bytes=10, bucket_windows=1).collect()}
    assert got == {"a": 21, "b": 25, None: 0, "c": 20} or got == {"a": 20, "b": 25, None: 0, "c": 20}
    assert got["a"] == 20  # the window at its start is the first of all; the next one starts later
    assert dedup_substrings(df.limit(0)).collect() == []


# --- packing ------------------------------------------------------------------------------------------

def test_best_fill_matches_all_subsets():
    rng = random.Random(3)
    for _ in range(300):
        lengths = [rng.randrange(1, 12) for _ in range(rng.randrange(0, 8))]
        room = rng.randrange(0, 40)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        best, chosen = best_fill(dict(Counter(lengths)), room)
        assert best == max(s for s in sums if s <= room) == sum(k * n for k, n in chosen.items())
        assert all(n <= Counter(lengths)[k] for k, n in chosen.items())


def check_sequences(pieces, capacity):
    """pieces: (document, start, length, sequence, offset)."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for d, start, length, s, offset in pieces:
        assert length > 0
        docs[d].append((start, length))
        sequences[s].append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    for parts in docs.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    return {d: sum(n for _, n in parts) for d, parts in docs.items()}


def test_packer_fills_every_window():
    rng = random.Random(7)
    for _ in range(100):
        lengths = [rng.choice([rng.randrange(1, 200), 7, 33]) for _ in range(rng.randrange(0, 80))]
        p, out = Packer(64), []
        for i, n in enumerate(lengths):
            out += p.add(i, n)
            if i % 17 == 0:
                out += p.pack()
        assert check_sequences([*out, *p.finish()], 64) == dict(enumerate(lengths))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = ["it's.", "don't, 'S. A's,", "<|endoftext|>. a<|startoftext|>,b.", "é. Ünter, ÅΣ, ΑΣ. x…. 12.5, ?., ...", " \x85a　b. I. İ, ﬁ. é. ÿ, ß. naïve,"]
    rows = docs_fixture(3, 60) + [(1000 + i, t) for i, t in enumerate(texts)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)] + [(None, "null id")]
    for capacity, held in ((4096, 1 << 21), (64, 500)):
        got = pack_documents(frame(spark, rows, 3), path("word_bpe_49k.json"), capacity=capacity, buffer_tokens=held).collect()
        sizes = check_sequences([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in got], capacity)
        for i, t in rows:
            want = tok.encode(t or "", add_special_tokens=False).ids + [2]
            mine = sorted((r["start"], r["ids"]) for r in got if r["doc_id"] == i)
            assert np.frombuffer(b"".join(x for _, x in mine), dtype="<u4").tolist() == want and sizes[i] == len(want)
            assert {r["doc_tokens"] for r in got if r["doc_id"] == i} == {len(want)}
    assert pack_documents(frame(spark, rows).limit(0), path("word_bpe_49k.json")).collect() == []


# --- byte scanning ------------------------------------------------------------------------------------

def test_words_never_cross_rows():
    import pyarrow as pa

    texts = ["ab", "", "cd ef", None, "gh", " i", "é1"]
    for size in (1, 4, 1 << 20):
        found = []
        for _, _, data, offsets in byte_slices(pa.array(texts), size):
            starts, ends, bounds = word_spans(LOWER[data], offsets, ALNUM)
            raw = data.tobytes()
            found += [[raw[a:b].decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(bounds[:-1], bounds[1:])]
        assert found == [["ab"], [], ["cd", "ef"], [], ["gh"], ["i"], ["é1"]]
    assert windows(np.array([0, 3, 3, 4, 8]), 3).tolist() == [0, 4, 5]


def test_registered_digests(spark):
    """The query's digest columns on a table the operators never saw."""
    assert hashlib.sha256(b"").hexdigest() == spark.sql("select sha2('', 256)").first()[0]
    assert zlib.crc32(b"abc") == spark.sql("select crc32('abc')").first()[0]
