"""Embedding-to-expression mapping with a match report (C6: J3, J6, J8, J9, F10, U2).

Embeddings come as row-ordered matrices per species and gene ids as
row-ordered sequence tables per species; both are numbered per species
(skew-safe) and zipped, then the species' TPM table is left-joined by gene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeframe.functions.clean import trim_id
from sporeframe.operators.joins import keep_present, matching_key_count, positional_zip


def map_embeddings(embeddings: DataFrame, gene_rows: DataFrame, tpm: DataFrame) -> DataFrame:
    """``embeddings(species, row_order, embedding)``, ``gene_rows(species,
    row_order, gene_id)``, ``tpm(species, gene_id, boxcox_tpm)`` ->
    ``(species, gene_id, embedding, boxcox_tpm)``.

    Only species present in both row tables are mapped (J6), with all their
    embedding rows; ids are trimmed
    text (F10); duplicate TPM rows multiply, as a pandas left merge does (J3).
    """
    emb = keep_present(embeddings, gene_rows.select("species").distinct(), "species")
    genes = keep_present(gene_rows, embeddings.select("species").distinct(), "species")
    # every embedding row stays; one beyond its species' gene rows has no gene id
    zipped = positional_zip(emb, genes, ["species"], ["row_order"], ["row_order"], how="left", check_counts=False)
    zipped = zipped.select("species", trim_id("gene_id").alias("gene_id"), "embedding")
    t = tpm.select("species", trim_id("gene_id").alias("gene_id"), "boxcox_tpm")
    return zipped.join(t, ["species", "gene_id"], "left")


def match_report(mapped: DataFrame, tpm: DataFrame) -> DataFrame:
    """Per species: mapped rows, TPM rows and distinct ids found in both."""
    t = tpm.select("species", trim_id("gene_id").alias("gene_id"))
    common = matching_key_count(mapped.select("species", "gene_id"), t, "gene_id", ["species"])
    sizes = mapped.groupBy("species").agg(F.count(F.lit(1)).alias("n_embeddings"))
    tsize = t.groupBy("species").agg(F.count(F.lit(1)).alias("n_tpm"))
    return (sizes.join(tsize, "species", "left").join(common, "species", "left")
            .select("species", "n_embeddings", F.coalesce("n_tpm", F.lit(0)).alias("n_tpm"),
                    F.coalesce("matching", F.lit(0)).alias("matching")))
