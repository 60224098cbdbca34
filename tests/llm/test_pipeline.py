"""Each stage of the corpus pipeline against a brute-force version of it, on all that the stage before kept."""

import shutil
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF001
from sporeframe.llm import quality
from sporeframe.llm.common import byte_slices
from sporeframe.llm.queries import word_tokenizer

from .test_simhash import brute_components, brute_fingerprint
from .test_text_operators import brute_contamination, brute_lines, check_sequences

EDGE = [(-1, None), (-2, ""), (-3, " \n "), (-4, "Once more. " * 3000), (-5, "twice"), (-5, "twice"), (None, "no id")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables, with null, empty, long and repeated rows and a clashing column added to documents."""
    out = tmp_path_factory.mktemp("corpus")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{SF001}/{name}.parquet", out / f"{name}.parquet")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    more = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in EDGE], docs.schema)
    from pyspark.sql import functions as F

    docs.unionByName(more).withColumn("n_lines", F.lit("x")).repartition(3).write.parquet(str(out / "documents.parquet"))
    return str(out)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        if k < 4:
            assert kept[-1].columns == columns
    before, good, lines, single, clean, packed = kept

    model = quality.fit(before, spark.read.parquet(f"{folder}/labels.parquet"), ~quality.held_out())
    want = []
    for i, t in rows_of(before):  # one document at a time
        (_, _, data, offsets), = byte_slices(__import__("pyarrow").array([t], "string"))
        (_, counts), = quality.term_counts(data, offsets)
        if quality.vote(model, counts)[0] >= 0.5:
            want.append((i, t))
    assert Counter(rows_of(good)) == Counter(want) and 0 < len(want) < before.count()

    assert Counter(rows_of(lines)) == Counter((i, t) for i, t, _, _ in brute_lines(rows_of(good)))

    rows = rows_of(lines)
    parts = {}
    prints = [brute_fingerprint(t) for _, t in rows]
    # components by place, so that rows without an id are told apart
    for place, c in enumerate(brute_components(list(range(len(rows))), prints, 4)):
        parts.setdefault(c, []).append(rows[place])
    got = rows_of(single)
    assert len(got) == len(parts)
    for members in parts.values():
        mine = [r for r in got if r in members]
        ids = [i for i, _ in members if i is not None]
        assert mine and mine[0][0] == (min(ids) if ids else None)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert Counter(rows_of(clean)) == Counter((i, t) for (i, t), w in zip(got, brute_contamination(got, items)) if not w[2])

    tok = Tokenizer.from_file(word_tokenizer())
    pieces = packed.collect()
    sizes = check_sequences([(r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in pieces], 4096)
    for i, t in rows_of(clean):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted((r["start"], r["ids"]) for r in pieces if r["doc_id"] == i)
        assert sizes[i] == len(ids) and np.frombuffer(b"".join(x for _, x in mine), dtype="<u4").tolist() == ids

    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == packed.columns
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in whole.select("doc_id", "doc_tokens").distinct().collect()) == Counter((i, sizes[i]) for i in sizes)


def test_stages_on_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.count() == 0


def test_near_copies_broadcast_no_index(spark, folder, monkeypatch):
    """The links of the near-dedup stage come from two exchanges, whatever size Spark takes the index for."""
    from sporeframe.llm import simhash

    components, links = simhash.components, []
    monkeypatch.setattr(simhash, "components", lambda found: links.append(found) or components(found))
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count() > 0
    found, = links
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
