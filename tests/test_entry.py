"""Driver contract: entry(), queries(), oracle_sql(), and every oracle
query against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_mod
from conftest import SF001

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from oracle_check import compare, duck_conn  # noqa: E402


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["species", "combo", "tpm_threshold", "rsd_threshold", "n_genes", "scored_on", "skew",
                          "kurtosis", "score"]


def test_every_oracle_has_a_query():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF001)


@pytest.mark.parametrize("name", sorted(entry_mod.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF001, name, con)
    assert r["ok"], r
