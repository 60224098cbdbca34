"""File sources and sinks (S1-S14) on temporary folders."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sporeframe.functions.clean import int_without_nbsp
from sporeframe.sources import files as fl
from sporeframe.sources import npy


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)


def test_taxon_folders_and_lenient_tpm(spark, tmp_path):
    base = tmp_path / "fungi"
    _write(str(base / "4932" / "s1.tsv"), "geneId\tTPM\textra\nG1\t1.5\tx\nG2\tNA\ty\n")
    _write(str(base / "4932" / "s2.tsv"), "geneId\tTPM\textra\nG1\t2.5\tz\n")
    _write(str(base / "notes" / "s3.tsv"), "geneId\tTPM\textra\nG9\t9\tq\n")
    df = fl.read_taxon_folders(spark, str(base))
    rows = sorted((r["geneId"], r["TPM"], r["taxon"]) for r in df.collect())
    assert rows == [("G1", "1.5", "4932"), ("G1", "2.5", "4932"), ("G2", "NA", "4932")]


def test_legacy_encoding_and_nbsp(spark, tmp_path):
    p = str(tmp_path / "taxonids.csv")
    _write(p, "taxon_id\n4932 \n5476\n", encoding="ISO-8859-1")
    df = fl.read_delimited(spark, p, encoding="ISO-8859-1")
    assert sorted(r[0] for r in df.select(int_without_nbsp("taxon_id")).collect()) == [4932, 5476]


def test_recursive_parquet_by_suffix(spark, tmp_path):
    for sp in ("a_b", "c_d"):
        d = tmp_path / "seq" / sp / "deep"
        d.mkdir(parents=True)
        pd.DataFrame({"geneId": ["g1"], "five_prime_seq": ["ACGT"]}).to_parquet(d / f"{sp}_five_prime.parquet")
        pd.DataFrame({"gene_id": ["g1"], "three_prime_seq": ["TTT"]}).to_parquet(d / f"{sp}_three_prime.parquet")
    df = fl.normalise_gene_key(fl.read_parquet_tree(spark, str(tmp_path / "seq"), "*five_prime.parquet"))
    assert df.count() == 2 and "gene_id" in df.columns
    assert sorted(r[0] for r in df.select("source_file").collect()) == ["a_b_five_prime.parquet", "c_d_five_prime.parquet"]


def test_gtf_files(spark, tmp_path):
    text = ("#!comment\n"
            'chr1\tStringTie\ttranscript\t10\t20\t.\t+\t.\tgene_id "G1"; ref_gene_id "gene-SPOM_x;1"; TPM "3.5";\n'
            'chr1\tStringTie\texon\t10\t15\t1000\t-\t0\tgene_id "G2"; TPM "oops";\n')
    _write(str(tmp_path / "gtf" / "SRR1.gtf"), text)
    rows = fl.read_gtf(spark, str(tmp_path / "gtf")).orderBy("gene_id").collect()
    assert [r["gene_id"] for r in rows] == ["G1", "G2"]
    assert rows[0]["ref_gene_id"] == "gene-SPOM_x;1" and rows[0]["TPM"] == 3.5 and rows[0]["score"] is None
    assert rows[1]["TPM"] is None and rows[1]["frame"] == 0 and rows[1]["run_id"] == "SRR1"


def test_npy_rows_keep_order(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "x_three_embeddings.npy", a)
    np.save(tmp_path / "y_three_embeddings.npy", a[:2] * 2)
    df = npy.read_npy(spark, str(tmp_path), "*_three_embeddings.npy")
    got = {(os.path.basename(r["source"]), r["row_idx"]): r["embedding"] for r in df.collect()}
    assert got[("x_three_embeddings.npy", 3)] == [9.0, 10.0, 11.0]
    assert len(got) == 6


@pytest.mark.parametrize("dtype", ["<f4", "<f8", ">i4", "u1"])
def test_one_matrix_is_read_by_several_tasks(spark, tmp_path, dtype):
    a = (np.arange(700).reshape(100, 7) % 200).astype(dtype)
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "rows.npy", a)
    np.save(tmp_path / "deep" / "columns.npy", np.asfortranarray(a))
    np.save(tmp_path / "cube.npy", a.reshape(50, 2, 7))
    np.save(tmp_path / "vector.npy", a[0])
    np.save(tmp_path / "none.npy", a[:0])
    df = npy.read_npy(spark, str(tmp_path), split_bytes=7 * a.dtype.itemsize * 30)
    assert df.where("source like '%rows.npy'").select(F.spark_partition_id()).distinct().count() == 4
    got = {}
    for r in df.collect():
        got.setdefault(os.path.basename(r["source"]), {})[r["row_idx"]] = r["embedding"]
    want = {"rows.npy": a, "columns.npy": a, "cube.npy": a.reshape(50, 14), "vector.npy": a[:1]}
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {k: v.astype(float).tolist() for k, v in want.items()}
    assert npy.read_npy(spark, f"file:{tmp_path}/rows.npy").count() == 100
    assert npy.read_npy(spark, str(tmp_path), "*.nothing").collect() == []


def test_a_matrix_file_for_each_species(spark, tmp_path):
    rows = [(s, i, [float(i), float(len(str(s))), -1.5]) for s, n in (("Sp a", 5000), ("b", 3), (None, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "species string, gene int, v array<double>")
    npy.write_npy(df.orderBy(F.rand(1)), str(tmp_path / "out"), "species", ["gene"], "v", "float64")
    files = {f.name: np.load(f) for f in (tmp_path / "out").iterdir()}
    assert set(files) == {"Sp_a.npy", "b.npy", "null.npy"}
    assert files["Sp_a.npy"].tolist() == [v for s, _, v in rows if s == "Sp a"] and files["null.npy"].tolist() == [v for s, _, v in rows if s is None]
    back = npy.read_npy(spark, str(tmp_path / "out"), split_bytes=24 * 1000)
    assert back.where("source like '%Sp_a.npy' and embedding[0] = row_idx").count() == 5000
    npy.write_npy(df.where("species = 'b'"), str(tmp_path / "out"), "species", ["gene"], "v")  # overwrites the folder's matrices
    assert [f.name for f in (tmp_path / "out").iterdir()] == ["b.npy"]
    with pytest.raises(Exception, match="share the file"):
        npy.write_npy(spark.createDataFrame([("x y", 1, [1.0]), ("x_y", 1, [1.0])], df.schema), str(tmp_path / "clash"), "species", ["gene"], "v")
    with pytest.raises(Exception, match="vectors of"):
        npy.write_npy(spark.createDataFrame([("x", 1, [1.0]), ("x", 2, [1.0, 2.0])], df.schema), str(tmp_path / "ragged"), "species", ["gene"], "v")
    assert not list((tmp_path / "ragged").glob("*.npy"))


def test_per_species_writes_and_skipped(spark, tmp_path):
    df = spark.createDataFrame([("sp a", "g1", 1.0), ("sp b", "g2", None)], "species string, geneId string, TPM double")
    out = str(tmp_path / "out")
    fl.write_delimited(df, out, partition_by=("species",))
    back = fl.read_delimited(spark, out, sep="\t")
    assert sorted(r["species"] for r in back.collect()) == ["sp a", "sp b"]
    wanted = spark.createDataFrame([("sp a",), ("sp b",), ("sp c",)], "species string")
    skipped = {r["species"]: r["reason"] for r in fl.skipped_report(wanted, df, "species", "TPM").collect()}
    assert skipped == {"sp b": "no TPM", "sp c": "no data"}


def test_columns_go_by_each_files_header(spark, tmp_path):
    base = tmp_path / "fungi"
    _write(str(base / "1" / "a.tsv"), "geneId\tTPM\ng1\t1.5\n")
    _write(str(base / "2" / "b b.tsv"), "TPM\tlen\tgeneId\n2.5\t9\tg2\n")
    _write(str(base / "3" / "empty.tsv"), "TPM\tgeneId\n")
    rows = sorted(tuple(r) for r in fl.read_taxon_folders(spark, str(base)).collect())
    assert rows == [("g1", "1.5", "1"), ("g2", "2.5", "2")]
    typed = fl.read_delimited(spark, f"{base}/*/*.tsv", sep="\t", schema="geneId string, TPM double, len int", source="file")
    got = sorted((r["geneId"], r["TPM"], r["len"], r["file"].rsplit("/", 1)[1]) for r in typed.collect())
    assert got == [("g1", 1.5, None, "a.tsv"), ("g2", 2.5, 9, "b%20b.tsv")]


def test_both_spellings_of_the_gene_key(spark, tmp_path):
    for name, key in (("a", "gene_id"), ("b", "geneId")):
        pd.DataFrame({key: [f"g{name}"], "five_prime_seq": ["ACGT"]}).to_parquet(tmp_path / f"{name}_five_prime.parquet")
    df = fl.normalise_gene_key(fl.read_parquet_tree(spark, str(tmp_path), "*five_prime.parquet"))
    assert sorted(r[0] for r in df.select("gene_id").collect()) == ["ga", "gb"] and "geneId" not in df.columns
