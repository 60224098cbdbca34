"""Scalar functions (P4, P8, F1-F27) against small Python versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sporeframe.functions import clean as cl
from sporeframe.functions import seq as sq
from sporeframe.functions.transform import boxcox, yeojohnson


def one(spark, expr, rows, schema="x string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("o")).collect()]


def test_lenient_double_matches_pandas_rules(spark):
    rows = [("1.5",), (" 2 ",), ("1d",), ("NA",), ("",), (None,), ("inf",), ("-3e2",), (".5",), ("nan",), ("abc",)]
    assert one(spark, cl.lenient_double("x"), rows) == [1.5, 2.0, None, None, None, None, None, -300.0, 0.5, None, None]


def test_clean_numeric_drops_nan_and_inf(spark):
    rows = [(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,), (-2.0,)]
    assert one(spark, cl.clean_numeric("x"), rows, "x double") == [1.0, None, None, None, None, -2.0]


def test_species_names_from_files(spark):
    rows = [("/a/b/Candida_albicans_three_embeddings.npy",), ("x/Yarrowia_Lipolytica_mapped.csv",)]
    assert one(spark, cl.species_from_filename("x"), rows) == ["candida_albicans", "yarrowia_lipolytica"]
    assert one(spark, cl.species_from_filename("x", lower=False, check=False), rows)[1] == "Yarrowia_Lipolytica"
    with pytest.raises(Exception):
        one(spark, cl.species_from_filename("x"), [("nounderscore.csv",)])
    assert one(spark, cl.species_from_result_file("x"), [("upstream_r2_candida_albicans.csv",)]) == ["candida_albicans"]
    with pytest.raises(Exception):
        one(spark, cl.species_from_result_file("x"), [("a_b_c_d_e.csv",)])


def test_genus_and_patterns(spark):
    assert one(spark, cl.genus("x"), [("Candida albicans",)]) == ["Candida"]
    assert one(spark, cl.genus("x", "[ _]"), [("Candida_albicans",)]) == ["Candida"]
    assert one(spark, cl.strip_pattern("x", "^gene-SPOM_"), [("gene-SPOM_abc1",)]) == ["abc1"]
    assert one(spark, cl.path_safe("x"), [("Candida albicans x",)]) == ["Candida_albicans_x"]
    assert one(spark, cl.int_without_nbsp("x"), [("12 34",), ("x",)]) == [1234, None]
    assert one(spark, cl.trim_id(F.col("x")), [(" g1 ",)]) == ["g1"]


def _py_pieces(x):
    for p in cl.BLOCK_NAME_PIECES:
        x = x.replace(p, "")
    return x[1:] if x.startswith("l") else x


def test_block_names_follow_replacement_order(spark):
    descs = ["o1#lib_context_native_blockA_one_ins", "o2#context_x_one", "o3#pad_lcontext_q_wt", "o4#term_full_b_512_mut"]
    want = [_py_pieces(d.split("#")[1].split("context_")[-1]) for d in descs]
    assert one(spark, cl.block_from_description("x"), [(d,) for d in descs]) == want


def test_model_label_and_five_part_names(spark):
    rows = [("a-b-tok_species_aware_12-ds-e",), ("a-b-tok_agnostic-ds-e",), ("a-b-x_candida glabrata-ds-e",)]
    assert one(spark, cl.model_label("x"), rows) == ["Aware:species aware", "Agnostic", "Aware:candida glabrata"]
    got = one(spark, cl.five_part_name("x"), [("p-q-model-data-r",), ("p-q-r",)])
    assert got[0]["dataset"] == "data" and got[1] is None


def py_kmer_vector(seq, k, overlap=True, divide=False, log=False):
    index = {"".join(p): i for i, p in enumerate(itertools.product("ACGT", repeat=k))}
    counts = np.zeros(4 ** k)
    i, jump = 0, (1 if overlap else k)
    while i < len(seq) - k + 1:
        km = seq[i:i + k]
        if "N" not in km:
            counts[index[km]] += 1
        i += jump
    if divide:
        counts = counts / len(seq)
    if log:
        counts = np.log(counts + 1)
    return counts


SEQS = ["ACGTNACGTTGCATTGCAT", "AC", "", "NNNNN", "TGTAAATATGTAAATA", "GGGCCCAAATTT"]


@pytest.mark.parametrize("k,overlap,divide,log", [(2, True, False, False), (3, False, True, True), (4, True, True, False)])
def test_kmer_vector_matches_python(spark, k, overlap, divide, log):
    got = one(spark, sq.kmer_vector("x", k, overlap, divide, log), [(s,) for s in SEQS])
    for s, g in zip(SEQS, got):
        want = py_kmer_vector(s, k, overlap, divide, log) if s else np.zeros(4 ** k)
        assert np.allclose(g, want)


def test_windows_and_counts(spark):
    rows = [(s,) for s in SEQS]
    assert one(spark, sq.kmers("x", 3, True), rows) == [[s[i:i + 3] for i in range(len(s) - 2)] for s in SEQS]
    assert one(spark, sq.kmers("x", 3, False), rows) == [[s[i:i + 3] for i in range(0, len(s), 3) if i + 3 <= len(s)] for s in SEQS]
    assert one(spark, sq.chunks("x", 4), rows) == [[s[i:i + 4] for i in range(0, len(s), 4)] for s in SEQS]
    assert one(spark, sq.motif_count("x", "TGCAT"), rows) == [s.count("TGCAT") for s in SEQS]
    gc = one(spark, sq.gc_fraction("x"), rows)
    for s, g in zip(SEQS, gc):
        assert (g is None and not s) or g == pytest.approx((s.count("G") + s.count("C")) / len(s))
    idx = one(spark, sq.kmer_index("x"), [("AAA",), ("ACG",), ("TTT",), ("ANA",)])
    assert idx == [0, 6, 63, None]


def test_one_hot_and_labels(spark):
    oh = one(spark, sq.one_hot("x"), [("ACGT",)])[0]
    assert [list(v).index(1.0) for v in oh] == [0, 1, 2, 3] and all(len(v) == 5 for v in oh)
    assert one(spark, sq.class_labels("x"), [("TGCA",)]) == [[3, 2, 1, 0]]
    with pytest.raises(Exception):
        one(spark, sq.class_labels("x"), [("ACN",)])
    assert one(spark, sq.one_hot("x", strict=False), [("N",)])[0][0][4] == 1.0


def test_tokens_padding_and_special_runs(spark):
    vocab = sq.kmer_vocabulary(3)
    toks = F.concat(F.array(F.lit("speciesX")), sq.kmers("x", 3))
    df = spark.createDataFrame([("ACGTAN",)], "x string").select(sq.token_ids(toks, None, 12, 3).alias("t"))
    r = df.select("t.input_ids", "t.attention_mask").first()
    body = [vocab[s] for s in ["ACG", "CGT", "GTA"]]
    assert r[0] == [vocab["[CLS]"], vocab["[UNK]"], *body, vocab["[UNK]"], vocab["[SEP]"]] + [0] * 5
    assert r[1] == [1] * 7 + [0] * 5
    runs = df.select(sq.special_run("t.input_ids", list(range(5)), "left"),
                     sq.special_run("t.input_ids", list(range(5)), "right")).first()
    assert tuple(runs) == (2, 7)
    # a supplied vocabulary gives the same ids
    r2 = spark.createDataFrame([("ACGTAN",)], "x string").select(sq.token_ids(toks, vocab, 12).alias("t")).first()
    assert r2[0]["input_ids"] == r[0]


def test_transforms(spark):
    xs = [0.5, 1.0, 3.0, -2.0, 0.0]
    for lam in (0.0, 0.22, 2.0):
        bc = one(spark, boxcox("x", lam), [(x,) for x in xs], "x double")
        yj = one(spark, yeojohnson("x", lam), [(x,) for x in xs], "x double")
        for x, b, y in zip(xs, bc, yj):
            if x <= 0:
                assert b is None
            else:
                assert b == pytest.approx(math.log(x) if lam == 0 else (x ** lam - 1) / lam)
            if x >= 0:
                want = math.log1p(x) if lam == 0 else ((x + 1) ** lam - 1) / lam
            else:
                want = -math.log1p(-x) if lam == 2 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)
            assert y == pytest.approx(want)


def test_leave_one_out_vocabulary(spark):
    got = one(spark, sq.kmer_vector("x", 2, leave_one_out=True), [("AATTT",)])[0]
    assert len(got) == 16 and got[0] == 1.0 and got[3] == 1.0 and sum(got) == 2.0  # AA, AT counted; TT skipped


def test_user_aggregate_matches_builtin_rsd(spark):
    from sporeframe.functions.metrics import rsd, user_aggregate

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0), ("b", 5.0)], "g string, x double")
    py_rsd = user_aggregate(lambda s: float(s.std(ddof=1) / s.mean()))
    a = {r["g"]: r["a"] for r in df.groupBy("g").agg(rsd("x").alias("a")).collect()}
    b = {r["g"]: r["b"] for r in df.groupBy("g").agg(py_rsd("x").alias("b")).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
