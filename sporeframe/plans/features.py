"""Feature tables from sequences.

k-mer counts in long form are an explode + grouped count: the map-side
partial aggregate collapses each sequence's windows to its distinct k-mers
before the shuffle.  Dense vectors are built per row with no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeframe.functions import seq as sq
from sporeframe.functions.clean import block_from_description
from sporeframe.operators.joins import small_side
from sporeframe.operators.ranking import group_row_number
from sporeframe.operators.reshape import concat_features


def kmer_string(index: str | F.Column, k: int) -> F.Column:
    """Inverse of ``kmer_index``: base-4 digits of the index as A/C/G/T."""
    i = F.col(index) if isinstance(index, str) else index
    digits = F.lpad(F.conv(i.cast("string"), 10, 4), k, "0")
    return F.translate(digits, "0123", sq.BASES)


def kmer_counts_long(df: DataFrame, id_col: str, seq_col: str, k: int, overlap: bool = True) -> DataFrame:
    """``(id, kmer, n)`` for every k-mer present; windows holding N skipped, other letters raise.

    Sparse pairs come straight from the vectorised counting pass, for any k: no 4^k vector, no shuffle."""
    pairs = sq.kmer_pairs(df, id_col, seq_col, k, overlap)
    return pairs.select(id_col, kmer_string("kmer_index", k).alias("kmer"), "n")


def dense_to_long(df: DataFrame, id_cols: Sequence[str], vec_col: str, index: str = "kmer_index",
                  value: str = "value") -> DataFrame:
    """Non-zero entries of a dense vector as rows (for reports and checks)."""
    e = df.select(*id_cols, F.posexplode(vec_col).alias(index, value))
    return e.where(F.col(value) != 0)


def split_ends(df: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Stand-in for the two regulatory regions: first and second half."""
    half = F.floor(F.length(seq_col) / 2).cast("int")
    return df.select(
        "*",
        F.substring(F.col(seq_col), F.lit(1), half).alias("five_prime_seq"),
        F.expr(f"substring({seq_col}, floor(length({seq_col}) / 2) + 1)").alias("three_prime_seq"),
    )


def feature_registry(df: DataFrame, id_col: str = "gene_id", ks: Sequence[int] = (3, 4, 5), keep: Sequence[str] = ()) -> DataFrame:
    """``(feature_set, id, features)`` for k-mer counts of each end and
    both ends side by side (U4).  One long table instead of a dict of
    matrices, so every feature set is a key of later grouped jobs.  Each
    vector is computed once per row; the sets are exploded from them, with
    the ``keep`` columns carried along."""
    vecs = sq.with_kmer_vectors(df, {f"_{end}{k}": (f"{end}_prime_seq", k) for k in ks for end in ("five", "three")}, keep=[id_col, *keep])
    sets = []
    for k in ks:
        f, t = F.col(f"_five{k}"), F.col(f"_three{k}")
        sets += [F.struct(F.lit(f"{k}-mer-fiveprime").alias("feature_set"), f.alias("features")),
                 F.struct(F.lit(f"{k}-mer-threeprime").alias("feature_set"), t.alias("features")),
                 F.struct(F.lit(f"{k}-mer-combined").alias("feature_set"), concat_features(f, t).alias("features"))]
    e = vecs.select(id_col, *keep, F.explode(F.array(*sets)).alias("_s"))
    return e.select(F.col("_s.feature_set").alias("feature_set"), id_col, F.col("_s.features").alias("features"), *keep)


def mpra_features(df: DataFrame, seq_col: str = "Oligo Sequence", desc_col: str = "Description",
                  expr_col: str = "Expression", keep: Sequence[str] = ()) -> DataFrame:
    """Motif counts (F13), GC fraction (F14), group block from the
    description (F7 + F6) and log2 target (F27), rows with NULLs dropped (P7)."""
    d = df.dropna(how="any", subset=[seq_col, desc_col, expr_col])
    s = F.col(f"`{seq_col}`")
    return d.select(
        *keep,
        block_from_description(F.col(f"`{desc_col}`")).alias("block"),
        F.log2(F.col(f"`{expr_col}`")).alias("y"),
        *[sq.motif_count(s, m).alias(m) for m in sq.MPRA_MOTIFS],
        sq.gc_fraction(s).alias("GC_content_UTR3"),
    )


def species_vocabulary(df: DataFrame, species_col: str, k: int = 6) -> DataFrame:
    """``(species, id)``: ids after the special tokens and the 4^k k-mers, in the order of the names."""
    names = df.where(F.col(species_col).isNotNull()).select(F.col(species_col).alias("species"), F.lit(1).alias("_all")).distinct()
    first = len(sq.SPECIAL_TOKENS) + 4 ** k
    return group_row_number(names, ["_all"], ["species"], "_n").select("species", (F.lit(first - 1) + F.col("_n")).alias("id"))


def token_table(df: DataFrame, id_col: str, species_col: str, seq_col: str, k: int = 6, max_len: int = 512,
                vocab: dict[str, int] | None = None, species_ids: DataFrame | None = None) -> DataFrame:
    """Species token + stride-1 k-mers, ids padded to ``max_len``
    with the attention mask, and the special-token runs at both ends.

    ``species_ids`` (see ``species_vocabulary``) gives each species its own
    id by a join; a species it lacks, or any without it, is ``[UNK]``."""
    words = sq.kmers(seq_col, k, overlap=True)
    if vocab is None and species_ids is not None:
        ids = small_side(species_ids.select(F.col("species").alias("_species"), F.col("id").alias("_id")))
        df = df.join(ids, F.col(species_col) == F.col("_species"), "left")
        unk = sq.SPECIAL_TOKENS.index("[UNK]")
        enc = df.select(id_col, sq.token_ids(words, None, max_len, k, lead=F.coalesce("_id", F.lit(unk))).alias("t"))
    else:
        enc = df.select(id_col, sq.token_ids(F.concat(F.array(F.col(species_col)), words), vocab, max_len, k).alias("t"))
    special = list(range(len(sq.SPECIAL_TOKENS))) if vocab is None else [vocab[t] for t in sq.SPECIAL_TOKENS if t in vocab]
    return enc.select(
        id_col,
        F.col("t.input_ids").alias("input_ids"),
        F.col("t.attention_mask").alias("attention_mask"),
        sq.special_run("t.input_ids", special, "left").alias("leading_special"),
        sq.special_run("t.input_ids", special, "right").alias("trailing_special"),
    )
