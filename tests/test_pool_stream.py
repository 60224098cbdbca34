"""Encoder pooling (M12, F31-F33) and the streaming ETL."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sporeframe.operators import pool as pl
from sporeframe.plans.expression import etl
from sporeframe.streaming.expression_stream import read_expression_stream, start_expression_etl


def test_layer_and_token_pooling():
    rng = np.random.default_rng(1)
    h = rng.normal(size=(5, 2, 6, 3))
    assert np.allclose(pl.select_layers(h, 2), h[2])
    assert np.allclose(pl.select_layers(h, (3,)), h[3:].mean(axis=0))
    assert np.allclose(pl.select_layers(h, (1, 3)), h[1:3].mean(axis=0))
    mask = np.array([[1, 1, 1, 0, 0, 0], [1] * 6])
    assert np.allclose(pl.token_mean(h[0]), h[0].mean(axis=1))
    assert np.allclose(pl.token_mean(h[0], mask)[0], h[0, 0, :3].mean(axis=0))
    assert np.allclose(pl.window_mean(h[0], np.array([0, 4]))[1], h[0, 1, 0:5].mean(axis=0))


def test_embed_is_keyed_and_batched(spark):
    enc = pl.ProjectionEncoder(20, hidden=4, layers=2)
    rows = [(f"g{i}", [2, i % 20, 3, 0], [1, 1, 1, 0]) for i in range(120)]
    df = spark.createDataFrame(rows, "gene_id string, input_ids array<int>, attention_mask array<int>").repartition(3)
    got = {r["gene_id"]: r["embedding"] for r in pl.embed(df, ["gene_id"], enc, batch_size=50, target_layer=(1,)).collect()}
    ids = np.array([r[1] for r in rows])
    want = pl.token_mean(pl.select_layers(enc(ids, np.ones_like(ids)), (1,)))
    for i, r in enumerate(rows):
        assert np.allclose(got[r[0]], want[i], atol=1e-6)
    col = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "t array<array<double>>")
    assert col.select(pl.token_mean_column("t")).first()[0] == [2.0, 4.0]


def test_streaming_etl_equals_batch(spark, tmp_path):
    base = tmp_path / "in"
    for taxon, body in (("1", "geneId\tTPM\nG1\t1.5\nG2\tNA\n"), ("2", "geneId\tTPM\nG3\t0\nG4\t7\n")):
        os.makedirs(base / taxon)
        (base / taxon / "s.tsv").write_text(body)
    taxa = spark.createDataFrame([("1", "Candida albicans")], "Taxon_ID string, Species_name string")
    q = start_expression_etl(spark, str(base), taxa, str(tmp_path / "out"), str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(120)
    got = sorted((r["geneId"], r["TPM"], r["taxon"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("G1", 1.5, "Candida albicans"), ("G4", 7.0, "")]


def test_resident_encoder_windows_and_lengths(spark, tmp_path):
    from sporeframe.operators.pool import ProjectionEncoder, Resident, embed, select_layers, token_mean, window_mean

    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 30, 12).tolist(), [1] * n + [0] * (12 - n), int(p)) for i, (n, p) in enumerate(zip(rng.integers(1, 13, 40), rng.integers(-3, 20, 40)))]
    df = spark.createDataFrame(rows, "id int, input_ids array<int>, attention_mask array<int>, pos long").repartition(3)
    encoder = ProjectionEncoder(30, 5, 3)
    hidden = select_layers(encoder(np.array([r[1] for r in rows]), None), (1,))
    mask = np.array([r[2] for r in rows])
    resident = Resident(ProjectionEncoder, 30, 5, 3)
    for options, want in (({}, token_mean(hidden)), ({"masked": True}, token_mean(hidden, mask)),
                          ({"window": ("pos", 4)}, window_mean(hidden, np.array([r[3] for r in rows]), 4))):
        got = {r["id"]: r["embedding"] for r in embed(df, ["id"], resident, batch_size=7, target_layer=(1,), **options).collect()}
        assert np.allclose([got[i] for i in range(40)], want, atol=1e-6)
    (tmp_path / "table.txt").write_text("3")

    def scaled_encoder(factor, path):
        with open(path) as f:
            scale = factor * float(f.read())
        return lambda ids, mask: (ids * scale)[None, :, :, None]

    spark.sparkContext.addFile(str(tmp_path / "table.txt"))
    scaled = Resident(scaled_encoder, 2.0, files=["table.txt"])
    got = {r["id"]: r["embedding"] for r in embed(df, ["id"], scaled, target_layer=0).collect()}
    assert got[0] == [pytest.approx(6.0 * np.mean(rows[0][1]))]
