"""Own-pipeline TPM against published TPM per replicate.

Both sides are reduced to one row per (replicate, gene) before the join
(``dup="mean"``), so a gene repeated in a file cannot multiply into all its
pairs; the joins are then one-to-one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeframe.functions.clean import strip_pattern
from sporeframe.functions.transform import log10p1


def pipeline_tpm(gtf: DataFrame, prefix: str = "^gene-SPOM_", replicate: str = "replicate") -> DataFrame:
    """Parsed GTF to ``(replicate, geneId, Pipeline_TPM)``."""
    d = gtf.select(replicate, strip_pattern("ref_gene_id", prefix).alias("geneId"), F.col("TPM").alias("Pipeline_TPM"))
    # na.omit after the mean (which skips NULLs): same rows, and the NULL
    # test is not pushed into (and repeated inside) the parsing expressions
    agg = d.groupBy(replicate, "geneId").agg(F.avg("Pipeline_TPM").alias("Pipeline_TPM"))
    return agg.where(F.col("geneId").isNotNull() & F.col("Pipeline_TPM").isNotNull())


def published_tpm(published: DataFrame, replicate: str = "replicate") -> DataFrame:
    """Published table to ``(replicate, geneId, Published_TPM)``."""
    d = published.select(replicate, "geneId", F.col("TPM").alias("Published_TPM"))
    agg = d.groupBy(replicate, "geneId").agg(F.avg("Published_TPM").alias("Published_TPM"))
    return agg.where(F.col("geneId").isNotNull() & F.col("Published_TPM").isNotNull())


def merged_logs(pipe: DataFrame, pub: DataFrame, replicate: str = "replicate") -> DataFrame:
    """Per replicate: inner join on gene (J1), log10(x + 1) of both."""
    return pub.join(pipe, [replicate, "geneId"]).select(
        replicate, "geneId", "Pipeline_TPM", "Published_TPM",
        log10p1("Pipeline_TPM").alias("log_Pipeline_TPM"), log10p1("Published_TPM").alias("log_Published_TPM"),
    )


def per_replicate_r(merged: DataFrame, replicate: str = "replicate") -> DataFrame:
    """Pearson r of the logs per replicate (A15) and the fitted line."""
    return merged.groupBy(replicate).agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.corr("log_Pipeline_TPM", "log_Published_TPM").alias("pearson_r"),
        F.regr_slope("log_Published_TPM", "log_Pipeline_TPM").alias("slope"),
        F.regr_intercept("log_Published_TPM", "log_Pipeline_TPM").alias("intercept"),
    )


def three_way_r(merged: DataFrame, replicates: Sequence, replicate: str = "replicate") -> DataFrame:
    """Genes in all listed replicates (J2) and r of the LAST replicate (quirk
    Q6: the plain-named columns of the reference's merge, its number), next to
    the mean r over the replicates."""
    logs = ("log_Pipeline_TPM", "log_Published_TPM")
    # one row per gene with each replicate's pair: the source is read once, for any number of replicates
    pairs = [F.max(F.when(F.col(replicate) == r, F.struct(*logs))).alias(f"r{i}") for i, r in enumerate(replicates)]
    wide = merged.where(F.col(replicate).isin(list(replicates))).groupBy("geneId").agg(*pairs)
    wide = wide.dropna(how="any", subset=[f"r{i}" for i in range(len(replicates))])
    per = [F.corr(*[F.col(f"r{i}.{c}") for c in logs]) for i in range(len(replicates))]
    return wide.agg(
        F.count(F.lit(1)).alias("n_genes"), per[-1].alias("pearson_r_last"), (sum(per[1:], per[0]) / len(per)).alias("pearson_r_mean")
    )
