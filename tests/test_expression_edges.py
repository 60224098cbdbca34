"""Edge rows on the expression path: NaN / Inf / NULL values,
one-row genes, species without a passing threshold pair."""

import math

import pytest
from pyspark.sql import functions as F

from sporeframe.plans import expression as ex

SCHEMA = "species string, geneId string, sample_id long, line int, TPM double"


def test_gene_stats_clean_nan_inf_and_single_rows(spark):
    rows = [("s", "g1", 1, 1, 2.0), ("s", "g1", 2, 1, float("nan")), ("s", "g1", 3, 1, 4.0),
            ("s", "g1", 4, 1, float("inf")), ("s", "g1", 5, 1, None), ("s", "g2", 1, 1, 3.0)]
    got = {r["geneId"]: r for r in ex.gene_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["g1"]["n"] == 2 and got["g1"]["median"] == 3.0
    assert got["g1"]["rsd"] == pytest.approx(math.sqrt(2) / 3)
    assert got["g2"]["n"] == 1 and got["g2"]["std"] is None and got["g2"]["rsd"] is None
    rank = {r["geneId"]: r["median"] for r in ex.gene_stats(spark.createDataFrame(rows, SCHEMA), median_method="rank").collect()}
    assert rank == {"g1": 3.0, "g2": 3.0}


def test_species_without_a_valid_pair_is_skipped(spark):
    # 'low': every gene below both TPM thresholds; 'one': a single gene (score undefined)
    rows = []
    for g, base in enumerate([2.0, 3.0, 5.0, 8.0, 13.0]):
        for s in range(4):
            rows.append(("ok", f"g{g}", s, 1, base * (1 + 0.05 * s)))
    rows += [("low", "x1", 0, 1, 0.1), ("low", "x1", 1, 1, 0.2)]
    rows += [("one", "y1", 0, 1, 7.0), ("one", "y1", 1, 1, 7.5)]
    best = ex.threshold_search(spark.createDataFrame(rows, SCHEMA), (1, 5), (0.55, 0.65))
    got = {r["species"]: r for r in best.collect()}
    assert set(got) == {"ok"}
    scores = ex.score_combos(ex.filter_genes(ex.gene_stats(spark.createDataFrame(rows, SCHEMA)), (1, 5), (0.55, 0.65)))
    one = scores.where(F.col("species") == "one").collect()
    assert one and all(r["score"] is None for r in one)  # undefined, never chosen
