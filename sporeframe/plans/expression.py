"""Expression-table jobs: ETL, per-gene statistics, threshold sweep and search
(C1-C4, A4-A7, A12-A14, P15, W8).

Plan shape (C4): one shuffle on ``(species, geneId)`` for the gene
statistics, a fixed 4-way explode for the threshold grid (no join), one
shuffle on ``(species, combo)`` for the scores and a partial ``min_by`` to
pick the best combination.  Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sporeframe.functions.clean import clean_numeric, lenient_double
from sporeframe.functions.metrics import rsd
from sporeframe.functions.transform import boxcox, yeojohnson
from sporeframe.operators.joins import lookup
from sporeframe.operators.ranking import exact_percentiles, first_per_key, nested_percentiles
from sporeframe.session import reliable_checkpoint

# Threshold grids and describe() percentiles of the reference.
REFERENCE_TPM_THRESHOLDS = (1, 5)
REFERENCE_RSD_THRESHOLDS = (1, 2)
DESCRIBE_PERCENTILES = (0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 0.99)
SWEEP_MEDIANS = (0, 1, 2, 3, 4, 5)


def pct_name(p: float) -> str:
    return f"p{round(p * 100):d}"


def etl(raw: DataFrame, taxon_map: DataFrame) -> DataFrame:
    """Lenient TPM, keep TPM > 0, taxon id to species name ('' if unknown).

    ``raw`` has ``geneId, TPM (text), taxon``; ``taxon_map`` has
    ``Taxon_ID, Species_name``.
    """
    cleaned = raw.select("geneId", lenient_double("TPM").alias("TPM"), "taxon").where(F.col("TPM") > 0)
    return lookup(cleaned, taxon_map, "taxon", "Taxon_ID", "Species_name", "species", "").select(
        "geneId", "TPM", F.col("species").alias("taxon")
    )


def gene_stats(samples: DataFrame, keys: Sequence[str] = ("species", "geneId"), value: str = "TPM",
               median_method: str = "aggregate") -> DataFrame:
    """Per-gene ``n, median, std, rsd`` (A1, A4, A5).

    ``median_method="aggregate"`` uses Spark's exact ``median`` (one buffer of
    the group's values per task - fine for gene-sized groups);
    ``"rank"`` uses the distributed exact percentile for groups that can be
    huge.  Both give the same numbers.
    """
    keys = list(keys)
    v = clean_numeric(value)
    base = samples.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
    agg = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("_v").alias("std"),
        rsd("_v").alias("rsd"),
        *([F.median("_v").alias("median")] if median_method == "aggregate" else []),
    )
    if median_method == "rank":
        med = exact_percentiles(base, keys, "_v", {"median": 0.5})
        agg = agg.join(med, keys)
    return agg.select(*keys, "n", "median", "std", "rsd")


def rsd_sweep(stats: DataFrame, medians: Sequence[int] = SWEEP_MEDIANS,
              percentiles: Sequence[float] = DESCRIBE_PERCENTILES) -> DataFrame:
    """``describe()`` of gene RSD for each ``median > i`` (A6), tagged ``tmp_threshold``.

    No gene is copied and no species is gathered: a gene has the level of the largest threshold it passes,
    statistics are merged from levels, and percentiles come from ``ranking.nested_percentiles``.
    """
    steps = sorted(medians)
    level = sum((F.col("median") > i).cast("int") for i in steps) - 1
    genes = stats.select("species", level.alias("level"), "rsd").where(F.col("level") >= 0)
    parts = genes.groupBy("species", "level").agg(
        F.count(F.lit(1)).alias("rows"), F.count("rsd").alias("n"), F.avg("rsd").alias("m"), F.var_pop("rsd").alias("v"), F.min("rsd").alias("least"), F.max("rsd").alias("most"))
    # from here on a row for each species and level
    parts = reliable_checkpoint(parts).select("*", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("t"))
    parts = parts.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w := Window.partitionBy("species", "t")) / F.sum("n").over(w))
    spread = F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))))
    n = F.sum("n")
    agg = parts.groupBy("species", "t").agg(
        n.alias("count"), F.max("mean").alias("mean"), F.when(n > 1, F.sqrt(spread / F.when(n > 1, n - 1))).alias("std"), F.min("least").alias("min"), F.max("most").alias("max"))
    names = {pct_name(p): float(p) for p in percentiles}
    pct = nested_percentiles(genes, ["species"], "level", "rsd", names, len(steps)).withColumnsRenamed({"species": "_s", "level": "_t"})
    out = agg.join(pct, F.col("species").eqNullSafe(F.col("_s")) & (F.col("t") == F.col("_t")), "left")
    threshold = F.element_at(F.array(*[F.lit(i) for i in steps]), F.col("t") + 1).cast("int")
    return out.select("species", threshold.alias("tmp_threshold"), "count", "mean", "std", "min", *names, "max")


def _combos(tpm_thresholds: Sequence[float], rsd_thresholds: Sequence[float]) -> list[tuple[int, float, float]]:
    # reference loop order: TPM outer, RSD inner; the index breaks score ties
    return [(i, float(t), float(r)) for i, (t, r) in
            enumerate((t, r) for t in tpm_thresholds for r in rsd_thresholds)]


def filter_genes(stats: DataFrame, tpm_thresholds: Sequence[float] = REFERENCE_TPM_THRESHOLDS,
                 rsd_thresholds: Sequence[float] = REFERENCE_RSD_THRESHOLDS) -> DataFrame:
    """C2 for every threshold pair at once: one row per (gene, passing pair)
    with ``TPM`` = the gene's median.  Genes explode only into the pairs they
    pass, so the copy count is bounded by the (small, fixed) grid size."""
    combos = _combos(tpm_thresholds, rsd_thresholds)
    hits = F.array(*[
        F.when((F.col("median") > t) & (F.col("rsd") < r),
               F.struct(F.lit(i).alias("combo"), F.lit(t).alias("tpm_threshold"), F.lit(r).alias("rsd_threshold")))
        for i, t, r in combos
    ])
    return (
        stats.select("species", "geneId", F.col("median").alias("TPM"), F.explode(hits).alias("c"))
        .where(F.col("c").isNotNull())
        .select("species", "geneId", "TPM", "c.combo", "c.tpm_threshold", "c.rsd_threshold")
    )


def filter_gene_rows(samples: DataFrame, stats: DataFrame, tpm_threshold: float, rsd_threshold: float) -> DataFrame:
    """The original sample rows of genes passing one threshold pair."""
    keep = stats.where((F.col("median") > tpm_threshold) & (F.col("rsd") < rsd_threshold)).select("species", "geneId")
    return samples.join(keep, ["species", "geneId"], "left_semi")


def chosen_gene_rows(samples: DataFrame, stats: DataFrame, best: DataFrame) -> DataFrame:
    """C3 for every species' own best pair: the sample rows of the genes that pass it."""
    pair = best.select("species", "tpm_threshold", "rsd_threshold")
    keep = stats.join(pair, "species").where((F.col("median") > F.col("tpm_threshold")) & (F.col("rsd") < F.col("rsd_threshold")))
    return samples.join(keep.select("species", "geneId"), ["species", "geneId"], "left_semi")


def score_combos(genes: DataFrame, lam: float | None = 0.22, fitted: DataFrame | None = None) -> DataFrame:
    """Transform each (species, combo) gene set and score its normality.

    With a fixed ``lam`` the Box-Cox lambda is a constant (F28); with
    ``fitted`` (columns ``species, combo, lam_bc, lam_yj``) each group uses
    its own fitted lambdas (F29/F30).  P15: Box-Cox is scored when every
    value transformed, else Yeo-Johnson.
    """
    keys = ["species", "combo", "tpm_threshold", "rsd_threshold"]
    if fitted is not None:
        g = genes.join(fitted, ["species", "combo"])
        bc, yj = boxcox("TPM", F.col("lam_bc")), yeojohnson("TPM", F.col("lam_yj"))
    else:
        g = genes
        bc, yj = boxcox("TPM", lam), yeojohnson("TPM", lam)
    t = g.select(*keys, bc.alias("bc"), yj.alias("yj"))
    agg = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.bool_and(F.col("bc").isNotNull()).alias("all_bc"),
        F.skewness("bc").alias("skew_bc"), F.kurtosis("bc").alias("kurt_bc"),
        F.skewness("yj").alias("skew_yj"), F.kurtosis("yj").alias("kurt_yj"),
    )
    skew = F.abs(F.when(F.col("all_bc"), F.col("skew_bc")).otherwise(F.col("skew_yj")))
    kurt = F.abs(F.when(F.col("all_bc"), F.col("kurt_bc")).otherwise(F.col("kurt_yj")))
    return agg.select(
        *keys, "n_genes", F.when(F.col("all_bc"), "boxcox").otherwise("yeojohnson").alias("scored_on"),
        skew.alias("skew"), kurt.alias("kurtosis"), (skew + kurt).alias("score"),
    )


def best_thresholds(scores: DataFrame) -> DataFrame:
    """The lowest score per species, the earlier pair winning ties; NaN /
    NULL scores never win and a species with none is dropped (skipped)."""
    valid = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    # identical gene sets (e.g. every gene passing two pairs) give equal
    # scores whose last bits depend on summation order; compare at 1e-9 so
    # the earlier pair wins, as the reference's strict '<' does
    ranked = valid.withColumn("_score_key", F.round("score", 9))
    return first_per_key(ranked, ["species"], ["_score_key", "combo"]).drop("_score_key")


def threshold_search(samples: DataFrame, tpm_thresholds: Sequence[float] = REFERENCE_TPM_THRESHOLDS,
                     rsd_thresholds: Sequence[float] = REFERENCE_RSD_THRESHOLDS, lam: float = 0.22,
                     median_method: str = "aggregate") -> DataFrame:
    """C4 with a fixed Box-Cox lambda: best threshold pair per species."""
    stats = gene_stats(samples, median_method=median_method)
    genes = filter_genes(stats, tpm_thresholds, rsd_thresholds)
    return best_thresholds(score_combos(genes, lam=lam))


def threshold_search_fitted(samples: DataFrame, tpm_thresholds: Sequence[float] = REFERENCE_TPM_THRESHOLDS,
                            rsd_thresholds: Sequence[float] = REFERENCE_RSD_THRESHOLDS,
                            checkpoint: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C4 with fitted transforms (F29, F30): per (species, pair) the Box-Cox
    and Yeo-Johnson lambdas are fitted by maximum likelihood, the gene set
    is scored, and the best pair per species kept.

    Returns ``(best, genes, lambdas)``; ``genes`` (one row per gene and
    passing pair) is materialised once because four jobs read it.
    """
    from sporeframe.operators.normalise import fit_lambdas

    stats = gene_stats(samples)
    genes = filter_genes(stats, tpm_thresholds, rsd_thresholds)
    if checkpoint:
        genes = reliable_checkpoint(genes)
    keys = ["species", "combo"]
    lambdas = reliable_checkpoint(fit_lambdas(genes, keys, "TPM", {"lam_bc": "boxcox", "lam_yj": "yeojohnson"}).select(*keys, "lam_bc", "lam_yj"))
    best = best_thresholds(score_combos(genes, fitted=lambdas))
    return best, genes, lambdas


def normalised_table(best: DataFrame, genes: DataFrame, lambdas: DataFrame) -> DataFrame:
    """The chosen gene set per species with ``geneId, TPM, boxcox_tpm, yj_tpm``
    (the reference's per-species output table)."""
    keys = ["species", "combo"]
    g = genes.join(best.select(*keys), keys, "left_semi").join(lambdas, keys)
    return g.select("species", "geneId", "TPM", boxcox("TPM", F.col("lam_bc")).alias("boxcox_tpm"),
                    yeojohnson("TPM", F.col("lam_yj")).alias("yj_tpm"), "tpm_threshold", "rsd_threshold")
