"""Operators 6 and 7: held-out accuracy, brute-force votes, ordered thresholds, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from sporeframe.llm import quality, toxicity
from sporeframe.llm.common import table

EDGE = [(1, None), (2, ""), (3, " \n"), (4, "word"), (4, "word"), (None, "x " * 50_000)]


def auc(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF01, "documents").select("doc_id", "text").repartition(8, "doc_id"), table(spark, SF01, "labels")


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels, ~quality.held_out())
    rows = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).select("quality", "score").toPandas()
    assert auc(rows.quality.to_numpy(), rows.score.to_numpy()) > 0.97
    assert ((rows.score >= 0.5) == (rows.quality == 1))[rows.quality == 1].mean() > 0.98
    edge = quality.score(spark.createDataFrame([(i, t, "a") for i, t in EDGE], "doc_id long, text string, SCORE string"), model)
    got = edge.collect()
    assert edge.columns == ["doc_id", "text", "score"] and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 3)} == {model.prior}
    assert quality.score(tables[0].limit(0), model).collect() == []


def test_votes_match_a_loop():
    rng = np.random.default_rng(0)
    n, rank = 40, 5
    voters = rng.standard_normal((n, rank)).astype(np.float32)
    voters /= np.linalg.norm(voters, axis=1, keepdims=True)
    labels = rng.integers(0, 2, n).astype(float)
    model = quality.Model(np.ones(quality.TERMS, np.float32), rng.standard_normal((quality.TERMS, rank)).astype(np.float32), voters, 1 + labels, labels, 7, 0.5)
    counts = rng.poisson(0.01, (6, quality.TERMS))
    counts[2] = 0
    got = quality.vote(model, counts)
    for k, c in enumerate(counts):
        if not c.any():
            assert got[k] == 0.5
            continue
        z = np.log1p(c) @ model.basis
        cosine = voters @ z / np.linalg.norm(z)
        near = np.argsort(-cosine)[:7]
        w = np.maximum(cosine[near], 1e-6) ** 16 * model.votes[near]
        assert got[k] == pytest.approx((w * labels[near]).sum() / w.sum(), rel=1e-3)


def test_quality_without_labels(spark, tables):
    model = quality.fit(tables[0].limit(20), tables[1].limit(0), ~quality.held_out())
    assert {r["score"] for r in quality.score(tables[0].limit(20), model).collect()} == {1.0}


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels, ~quality.held_out())
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(quality.held_out()).toPandas()
    assert auc(rows.toxic.to_numpy(), rows.severity.to_numpy()) > 0.7
    assert (rows.toxicity[rows.toxic == 0] < 0.5).mean() > 0.98
    assert ((rows.severity >= 0) & (rows.severity <= 3)).all() and set(rows.grade) <= {0, 1, 2, 3}
    few = spark.createDataFrame([(1, "the idiot", 0), (2, "idiot scum moron loser trash stupid clown worthless " * 3, 0)], "doc_id long, text string, grade int")
    mild, strong = (r["severity"] for r in toxicity.score(few, model).orderBy("doc_id").collect())
    assert strong > mild
    got = toxicity.score(spark.createDataFrame(EDGE, "doc_id long, text string"), model).collect()
    assert len({r["severity"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_without_labels(spark, tables):
    model = toxicity.fit(tables[0], tables[1].limit(0), ~quality.held_out())
    assert all(r["severity"] < 1e-9 for r in toxicity.score(tables[0].limit(5), model).collect())


def test_ordinal_fit_recovers_shared_weights():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 3))
    z = x @ [2.0, -1.0, 0.0] + rng.logistic(size=4000)
    grade = (z > 0).astype(int) + (z > 1) + (z > 3)
    w, t = toxicity.fit_ordinal(x, grade)
    assert np.allclose(w, [2, -1, 0], atol=0.25) and np.allclose(t, [0, 1, 3], atol=0.25)


def test_repeated_ids_count_once(spark, tables):
    """An id with several texts and labels: its smallest text and larger label, whatever the order of the rows."""
    docs, labels = tables
    more = spark.createDataFrame([(0, "zzz zzz"), (0, ""), (1, "zzz"), (2, None)], "doc_id long, text string")
    twice = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (1, None, None), (None, 1, 1)], labels.select("doc_id", "quality", "toxic").schema)
    both, marks = docs.unionByName(more), labels.select("doc_id", "quality", "toxic").unionByName(twice)
    for fit, size in ((quality.fit, "max_voters"), (toxicity.fit, "max_rows")):
        a, b = (fit(d.repartition(n), marks, ~quality.held_out(), **{size: 100}) for d, n in ((both, 3), (both.orderBy("text"), 5)))
        assert all(np.array_equal(x, y) for x, y in zip(a, b))


def plain_terms(text):
    """Term counts of one text, word by word: spelling, collapsed shape, and words said twice in a row."""
    import itertools

    from sporeframe.llm.common import span_hash

    def code(raw):
        h = span_hash(71)
        return int(h.spans(h.byte_prefix(np.frombuffer(raw, dtype=np.uint8)), np.array([0]), np.array([len(raw)]))[0])

    kind = lambda b: b"A" if 65 <= b <= 90 else b"a" if 97 <= b <= 122 or b >= 128 else b"0" if 48 <= b <= 57 else bytes([b])
    out, last, half = np.zeros(quality.TERMS, dtype=int), None, quality.TERMS // 2
    for word in (text or "").encode().split():
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        out[code(low) % half] += 1
        out[half + code(b"".join(k for k, _ in itertools.groupby(map(kind, word)))) % (half - 1)] += 1
        out[quality.TERMS - 1] += low == last
        last = low
    return out


def test_quality_against_numpy_on_raw_texts(spark, tables):
    """Document frequencies, weights, the latent space and the votes, computed from the texts by plain numpy."""
    docs, labels = tables
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    short = {i: t for i, t in texts.items() if len(t or '') < 2500}
    model = quality.fit(docs.where(F.length('text') < 2500), labels, ~quality.held_out(), max_voters=400, rank=16)
    texts = short
    counts = {i: plain_terms(t) for i, t in texts.items()}
    df = sum((c > 0).astype(int) for c in counts.values())
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    assert np.allclose(model.idf, idf, rtol=1e-5)
    some = [i for i in texts if counts[i].any()][:60]
    for i in some:  # equal texts have one score; every vote against all labelled vectors
        z = np.log1p(counts[i]) * idf
        z = (z / np.linalg.norm(z)) @ model.basis
        z /= max(np.linalg.norm(z), 1e-12)
        cosine = model.voters @ z
        near = np.argsort(-cosine, kind="stable")[: model.neighbours]
        w = np.maximum(cosine[near], 1e-6) ** 16 * model.votes[near]
        assert quality.vote(model, counts[i][None])[0] == pytest.approx((w * model.labels[near]).sum() / w.sum(), abs=5e-3)


def test_severity_row_by_row(spark, tables):
    """Expected severity from the words of each text, one at a time."""
    import re
    from sporeframe.llm.toxicity import word_hashes

    docs, labels = tables
    model = toxicity.fit(docs, labels, ~quality.held_out())
    where = {int(h): k for k, h in enumerate(model.vocabulary)}
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    flagged = 0
    for r in docs.limit(300).collect():
        total = 0.0
        words = re.findall(rb"[0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (r["text"] or "").encode()))
        seen = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        for w, n in seen.items():
            h, _ = word_hashes(np.frombuffer(w, dtype=np.uint8), np.array([0, len(w)]))
            if int(h[0]) in where:
                total += (1 + np.log(n)) * model.weights[where[int(h[0])]]
        p = 1 / (1 + np.exp(model.thresholds - total))
        assert got[r["doc_id"]]["severity"] == pytest.approx(p.sum(), abs=1e-6)
        assert got[r["doc_id"]]["grade"] == (p >= 0.5).sum()
        flagged += p[0] >= 0.5
    assert flagged
