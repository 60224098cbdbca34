"""Report tables behind the reference's notebooks.

The reference draws these as figures; here each figure's numbers are a
DataFrame.  Group sizes are unbounded, so medians use the distributed exact
percentile and orderings the distributed row number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sporeframe.functions.clean import genus
from sporeframe.functions.transform import boxcox
from sporeframe.operators.aggregates import histogram_bins, row_mean, row_sd
from sporeframe.operators.ranking import drop_position, exact_median, group_row_number, keep_repeated
from sporeframe.operators.reshape import pivot_wider
from sporeframe.plans.expression import gene_stats

# --------------------------------------------------------------------------- C9


def species_totals(species_df: DataFrame) -> DataFrame:
    """Experiments per species with its genus."""
    return (species_df.withColumn("genus", genus("Species_name"))
            .groupBy("Species_name", "genus")
            .agg(F.sum("Experiment_number").cast("long").alias("Experiment_number")))


def genus_totals(species_df: DataFrame) -> DataFrame:
    """Experiments per genus, with the bar order: largest first, name breaks ties (A3, O2)."""
    g = (species_df.withColumn("genus", genus("Species_name")).groupBy("genus")
         .agg(F.sum("Experiment_number").cast("long").alias("Experiment_number")))
    g = g.withColumn("_all", F.lit(1))
    return group_row_number(g, ["_all"], [F.col("Experiment_number").desc(), F.col("genus")], "genus_rank").drop("_all")


def experiment_summary(species_df: DataFrame) -> DataFrame:
    """One row: mean of species totals, mean of genus totals (A8), median of
    the raw numbers (A1), missing count (A9), distinct count (A10)."""
    sp = species_totals(species_df).agg(F.avg("Experiment_number").alias("mean_species"))
    ge = genus_totals(species_df).agg(F.avg("Experiment_number").alias("mean_genus"))
    raw = species_df.agg(
        F.count_if(F.col("Experiment_number").isNull()).alias("n_missing"),
        F.count_distinct("Experiment_number").alias("n_distinct"),
    )
    med = exact_median(species_df.select("Experiment_number", F.lit(1).alias("_g")), ["_g"], "Experiment_number",
                       "median_experiments").drop("_g")
    # four one-row aggregates side by side
    return sp.select(
        "mean_species",
        ge.select("mean_genus").scalar().alias("mean_genus"),
        med.select("median_experiments").scalar().alias("median_experiments"),
        raw.select("n_missing").scalar().alias("n_missing"),
        raw.select("n_distinct").scalar().alias("n_distinct"),
    )


def experiment_histogram(species_df: DataFrame, bins: int = 50, limits: tuple[float, float] = (0, 1300),
                         max_total: float | None = None) -> DataFrame:
    """Histogram of species totals (A21); ``max_total`` is the ``<= 550`` filter (P5)."""
    t = species_totals(species_df)
    if max_total is not None:
        t = t.where(F.col("Experiment_number") <= max_total)
    return histogram_bins(t, "Experiment_number", bins, limits)


# --------------------------------------------------------------------------- C8


def species_summary(tpm_df: DataFrame, key: str = "species_name", value: str = "TPM") -> DataFrame:
    """Median and mean TPM per species (A1, A2); exact and skew-safe."""
    med = exact_median(tpm_df, [key], value, "median_tpm")
    mom = tpm_df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean_tpm"))
    return mom.join(med, key, "left")


def genus_summary(tpm_df: DataFrame, key: str = "species_name", value: str = "TPM", separators: str = " ",
                  drop_at: int | None = 73, drop_key: str | None = None) -> DataFrame:
    """Median and mean TPM per genus (F4, A1, A2), with the row at sorted
    position ``drop_at`` removed as the reference removes its outlier (P13),
    or the genus named ``drop_key`` (quirk Q11: a position moves with the data)."""
    g = tpm_df.withColumn("genus", genus(key, separators))
    out = species_summary(g, "genus", value)
    if drop_at is not None:
        out = drop_position(out, ["genus"], drop_at)
    if drop_key is not None:
        out = out.where(~F.col("genus").eqNullSafe(drop_key))
    return out


def normalised_genes(tpm_df: DataFrame, lam: float = 0.22, key: str = "species_name") -> DataFrame:
    """C8's normalised table: Box-Cox of each gene's median TPM, where it exists."""
    stats = gene_stats(tpm_df, keys=(key, "geneId"))
    out = stats.select(key, "geneId", boxcox("median", lam).alias("boxcox_tpm"))
    return out.where(F.col("boxcox_tpm").isNotNull())


# --------------------------------------------------------------------------- C10


def replicate_table(long_df: DataFrame, species_pattern: str, conditions: Sequence[str],
                    key: str = "gene_id", cond: str = "exp_cond", value: str = "TPM") -> DataFrame:
    """Rows of matching species (P9), genes seen more than once (W1),
    complete rows (P7), conditions pivoted wide (U3), mean and CV across
    conditions (A23, A5)."""
    d = long_df.where(F.col("species_name").rlike(species_pattern))
    d = keep_repeated(d, ["species_name", key])
    d = d.dropna(how="any", subset=["species_name", key, cond, value])
    wide = pivot_wider(d, ["species_name", key], cond, value, conditions, dup="mean")
    return wide.select(
        "*", row_mean(list(conditions)).alias("mean"),
        (row_sd(list(conditions)) / row_mean(list(conditions))).alias("cv"),
    )
