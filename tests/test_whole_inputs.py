"""Queries that once read a part of their input, over whole tables."""

import numpy as np

import __spark_entry__ as entry_mod
from conftest import SF001
from pyspark.sql import functions as F


def copy_of(spark, folder, changed):
    """A folder of the smallest tables with some of them replaced."""
    for name in ("customer", "nation", "documents", "lineitem", "part"):
        spark.read.parquet(f"{SF001}/{name}.parquet").transform(changed.get(name, lambda t: t)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_skipped_species_reads_customers_of_every_id(spark, tmp_path):
    # rich customers whose ids the filter c_custkey % 40 < 2 drops
    rich = lambda c: c.where("c_custkey % 40 >= 2").withColumn("c_acctbal", F.lit(9999.0).cast(c.schema["c_acctbal"].dataType))
    folder = copy_of(spark, tmp_path / "rich", {"customer": rich})
    have = {f"NATION_{r[0]} {r[1]}" for r in spark.read.parquet(f"{folder}/customer.parquet").select("c_nationkey", "c_mktsegment").distinct().collect()}
    got = {r["species"]: r["reason"] for r in entry_mod.queries()["skipped_species"](spark, folder).collect()}
    assert have and not have & set(got) and set(got.values()) == {"no data"}
    assert sum(s.endswith(" NONE") for s in got) == 25


def test_letter_codes_cover_whole_sequences(spark):
    from sporeframe.sources.tables import sequences

    want = {r["gene_id"]: r["seq"] for r in sequences(spark, SF001).where("length(seq) > 0").collect()}
    slots, classes = {}, {}
    for r in sorted(entry_mod.queries()["letter_codes"](spark, SF001).collect(), key=lambda r: r["piece"]):
        slots[r["gene_id"]] = slots.get(r["gene_id"], "") + r["hot_slots"]
        classes[r["gene_id"]] = classes.get(r["gene_id"], "") + r["classes"]
    assert max(map(len, want.values())) > 1000
    assert slots == {k: v.translate(str.maketrans("ACGTN", "01234")) for k, v in want.items()}
    assert classes == {k: v.translate(str.maketrans("ACGTN", "01230")) for k, v in want.items()}


def test_brand_scores_take_every_line(spark):
    from sporeframe.sources.tables import expression_samples

    want = {}
    for brand, x in expression_samples(spark, SF001).toPandas().groupby("species"):
        tpm, line = x["TPM"].astype(float), x["line"].astype(float)
        want[brand] = (np.corrcoef(tpm, line)[0, 1] ** 2, tpm.std(ddof=1) / tpm.mean())
    got = {r["species"]: (r["pearson_r2"], r["user_rsd"]) for r in entry_mod.queries()["brand_scores"](spark, SF001).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
