"""Registered queries: a Spark callable and, where SQL can say it, the
DuckDB oracle text.  Keys are shared by ``__spark_entry__.queries()`` and
``oracle_sql()``.

Every query reads the driver tables (or data Spark derives from them) in
full.  Doubles are rounded to ``DIGITS`` places on both sides; every computed column
carries the same alias on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.functions import seq as sq
from sporeframe.functions.clean import clean_numeric
from sporeframe.functions.transform import boxcox as _boxcox
from sporeframe.functions.transform import log10p1
from sporeframe.operators import aggregates as ag
from sporeframe.operators import joins as jn
from sporeframe.operators import normalise as nm
from sporeframe.operators import pool as pl
from sporeframe.operators import ranking as rk
from sporeframe.operators import split as spl
from sporeframe.operators import tree as tr
from sporeframe.operators.ridge import Source
from sporeframe.plans import expression as ex
from sporeframe.plans import features as fe
from sporeframe.plans import mapping as mp
from sporeframe.plans import models as md
from sporeframe.plans import reports as rp
from sporeframe.plans import validate as va
from sporeframe.session import ensure_checkpoint_dir, reliable_checkpoint
from sporeframe.sources import files as fl
from sporeframe.sources import tables as tb

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Thresholds that make the search choose on the driver data (FIXTURES.md §2).
FIXTURE_TPM_THRESHOLDS = (1, 5)
FIXTURE_RSD_THRESHOLDS = (0.55, 0.65)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = nudge_rounds(sql.strip())
        return fn
    return deco


# Rounding ties: values that are exact decimals (medians and means of
# 6-decimal TPM) sit exactly on a rounding tie at some digit, and which way
# each engine rounds then depends on last-bit noise (and the two engines
# break exact ties differently).  Both sides therefore round x + 1e-9: the
# shift is 1% of the 1e-7 step, far above the noise of values below ~1e5,
# so both engines leave a tie the same way and never meet a new one.
NUDGE = 1e-9


def nudge_rounds(sql: str) -> str:
    """Rewrite every output ``round(<expr>, 7)`` of an oracle text as
    ``round((<expr>) + NUDGE, 7)`` (matching parentheses); other roundings
    (lambda grids, tie keys) are left exact."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = nudge_rounds(sql[j + len(key):comma])
        digits = sql[comma + 1:k - 1].strip()
        if digits == str(DIGITS):  # only the output rounding, not grids or tie keys
            out.append(sql[i:j] + f"round(({inner}) + CAST({NUDGE!r} AS DOUBLE),{sql[comma + 1:k]}")
        else:
            out.append(sql[i:j] + f"round({inner},{sql[comma + 1:k]}")
        i = k


# Doubles are rounded to this many places on both sides.  7, not 6: medians
# of 6-decimal values end in an exact 5 at the 7th place, and rounding such a
# tie to 6 places flips with the last-bit noise of either engine.
DIGITS = 7


def rnd(df: DataFrame) -> DataFrame:
    """Round every double column to ``DIGITS`` places (same on the oracle side)."""
    return df.select(*[
        F.round(F.col(f.name) + F.lit(NUDGE), DIGITS).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------
# expression ETL and threshold search
# ---------------------------------------------------------------------------

@register("expression_etl", _with(tb.RAW_EXPRESSION_SQL, tb.TAXON_MAP_SQL) + """
SELECT r.geneId, round(TRY_CAST(r.TPM AS DOUBLE), 7) AS TPM, coalesce(t.Species_name, '') AS taxon
FROM raw r LEFT JOIN taxmap t ON r.taxon = t.Taxon_ID
WHERE TRY_CAST(r.TPM AS DOUBLE) > 0""")
def q_expression_etl(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(ex.etl(tb.raw_expression_samples(spark, sf), tb.taxon_map(spark, sf)))


_GENE_STATS_SQL = _with(tb.EXPRESSION_SQL) + """
SELECT species, geneId, count(*) AS n, round(median(TPM), 7) AS median, round(stddev_samp(TPM), 7) AS std,
       round(stddev_samp(TPM) / avg(TPM), 7) AS rsd
FROM samples GROUP BY species, geneId"""


@register("gene_stats", _GENE_STATS_SQL)
def q_gene_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(ex.gene_stats(tb.expression_samples(spark, sf)))


@register("gene_stats_distributed_median", _GENE_STATS_SQL)
def q_gene_stats_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(ex.gene_stats(tb.expression_samples(spark, sf), median_method="rank"))


_PCTS = ", ".join(f"round(quantile_cont(rsd, {p}), 7) AS {ex.pct_name(p)}" for p in ex.DESCRIBE_PERCENTILES)


@register("rsd_sweep", _with(tb.EXPRESSION_SQL, """st AS (
  SELECT species, geneId, median(TPM) AS median, stddev_samp(TPM) / avg(TPM) AS rsd FROM samples GROUP BY species, geneId)""",
                             """p AS (
  SELECT st.species, CAST(th.i AS INTEGER) AS tmp_threshold, st.rsd
  FROM st JOIN (SELECT unnest(range(0, 6)) AS i) th ON st.median > th.i)""") + f"""
SELECT species, tmp_threshold, count(rsd) AS count, round(avg(rsd), 7) AS mean, round(stddev_samp(rsd), 7) AS std,
       round(min(rsd), 7) AS min, {_PCTS}, round(max(rsd), 7) AS max
FROM p GROUP BY species, tmp_threshold""")
def q_rsd_sweep(spark: SparkSession, sf: str) -> DataFrame:
    stats = ex.gene_stats(tb.expression_samples(spark, sf))
    return rnd(ex.rsd_sweep(stats))


def _combo_values_sql() -> str:
    rows = ", ".join(f"({i}, CAST({t} AS DOUBLE), CAST({r} AS DOUBLE))" for i, t, r in
                     ex._combos(FIXTURE_TPM_THRESHOLDS, FIXTURE_RSD_THRESHOLDS))
    return f"combos AS (SELECT * FROM (VALUES {rows}) v(combo, tpm_threshold, rsd_threshold))"


_SCORES_SQL = _with(
    tb.EXPRESSION_SQL,
    """st AS (SELECT species, geneId, median(TPM) AS med, stddev_samp(TPM) / avg(TPM) AS rsd
          FROM samples GROUP BY species, geneId)""",
    _combo_values_sql(),
    """g AS (SELECT st.species, c.combo, c.tpm_threshold, c.rsd_threshold,
                 CASE WHEN st.med > 0 THEN (power(st.med, 0.22) - 1) / 0.22 END AS bc
          FROM st JOIN combos c ON st.med > c.tpm_threshold AND st.rsd < c.rsd_threshold)""",
    """m AS (SELECT *, avg(bc) OVER (PARTITION BY species, combo) AS mu FROM g)""",
    """sc AS (SELECT species, combo, tpm_threshold, rsd_threshold, count(*) AS n_genes,
                  CASE WHEN avg(power(bc - mu, 2)) > 0
                       THEN abs(avg(power(bc - mu, 3)) / power(avg(power(bc - mu, 2)), 1.5)) END AS skew,
                  abs(kurtosis_pop(bc)) AS kurtosis
           FROM m GROUP BY species, combo, tpm_threshold, rsd_threshold)""",
)


@register("threshold_search", _SCORES_SQL + """
SELECT species, combo, tpm_threshold, rsd_threshold, n_genes, 'boxcox' AS scored_on,
       round(skew, 7) AS skew, round(kurtosis, 7) AS kurtosis, round(skew + kurtosis, 7) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY round(skew + kurtosis, 9), combo) AS rk
      FROM sc WHERE skew + kurtosis IS NOT NULL AND NOT isnan(skew + kurtosis)) WHERE rk = 1""")
def q_threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(ex.threshold_search(tb.expression_samples(spark, sf), FIXTURE_TPM_THRESHOLDS,
                                      FIXTURE_RSD_THRESHOLDS, lam=0.22))


@register("threshold_scores", _SCORES_SQL + """
SELECT species, combo, tpm_threshold, rsd_threshold, n_genes, 'boxcox' AS scored_on,
       round(skew, 7) AS skew, round(kurtosis, 7) AS kurtosis, round(skew + kurtosis, 7) AS score FROM sc""")
def q_threshold_scores(spark: SparkSession, sf: str) -> DataFrame:
    stats = ex.gene_stats(tb.expression_samples(spark, sf))
    genes = ex.filter_genes(stats, FIXTURE_TPM_THRESHOLDS, FIXTURE_RSD_THRESHOLDS)
    return rnd(ex.score_combos(genes, lam=0.22))


@register("passing_gene_rows", _with(tb.EXPRESSION_SQL, """st AS (
  SELECT species, geneId FROM samples GROUP BY species, geneId
  HAVING median(TPM) > 5 AND stddev_samp(TPM) / avg(TPM) < 0.55)""") + """
SELECT s.species, s.geneId, s.sample_id, s.line, round(s.TPM, 7) AS TPM
FROM samples s SEMI JOIN st ON s.species = st.species AND s.geneId = st.geneId""")
def q_passing_gene_rows(spark: SparkSession, sf: str) -> DataFrame:
    samples = tb.expression_samples(spark, sf)
    stats = ex.gene_stats(samples)
    return rnd(ex.filter_gene_rows(samples, stats, 5, 0.55))


_BEST_SQL = _SCORES_SQL + """, best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY round(skew + kurtosis, 9), combo) AS pos
                 FROM sc WHERE skew + kurtosis IS NOT NULL AND NOT isnan(skew + kurtosis)) WHERE pos = 1)"""


@register("chosen_gene_rows", _BEST_SQL + """
SELECT s.species, s.geneId, s.sample_id, s.line, round(s.TPM, 7) AS TPM FROM samples s JOIN st USING (species, geneId)
JOIN best ON s.species = best.species AND st.med > best.tpm_threshold AND st.rsd < best.rsd_threshold""")
def q_chosen_gene_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Each species' rows under its own best pair."""
    samples = tb.expression_samples(spark, sf)
    stats = reliable_checkpoint(ex.gene_stats(samples))  # one row per gene, read three times
    best = ex.best_thresholds(ex.score_combos(ex.filter_genes(stats, FIXTURE_TPM_THRESHOLDS, FIXTURE_RSD_THRESHOLDS), lam=0.22))
    return rnd(ex.chosen_gene_rows(samples, stats, best))


@register("skipped_models", """
SELECT lang, source, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_targets, 'no target' AS reason FROM documents
GROUP BY lang, source HAVING count(CASE WHEN n_chars > 1000 THEN 1 END) = 0
UNION ALL SELECT lang, source, count(*), count(CASE WHEN n_chars > 1000 THEN 1 END), 'too few rows' FROM documents
GROUP BY lang, source HAVING count(CASE WHEN n_chars > 1000 THEN 1 END) BETWEEN 1 AND 9""")
def q_skipped_models(spark: SparkSession, sf: str) -> DataFrame:
    """M6's skip table, for models keyed by language and source whose target long documents have."""
    docs = tb.read_table(spark, sf, "documents")
    data = docs.select("lang", "source", F.when(F.col("n_chars") > 1000, F.col("n_chars")).cast("double").alias("y"))
    return md.skipped_models(data, ("lang", "source"))


# ---------------------------------------------------------------------------
# experiment-count report (C9: A3, A8, A9, A10, A21, O2)
# ---------------------------------------------------------------------------


@register("experiment_species_totals", _with(tb.EXPERIMENT_COUNTS_SQL) + """
SELECT Species_name, split_part(Species_name, ' ', 1) AS genus,
       CAST(sum(Experiment_number) AS BIGINT) AS Experiment_number
FROM expcounts GROUP BY Species_name""")
def q_experiment_species_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rp.species_totals(tb.experiment_counts(spark, sf))


@register("experiment_genus_totals", _with(tb.EXPERIMENT_COUNTS_SQL) + """
SELECT genus, Experiment_number, row_number() OVER (ORDER BY Experiment_number DESC, genus) AS genus_rank
FROM (SELECT split_part(Species_name, ' ', 1) AS genus, CAST(sum(Experiment_number) AS BIGINT) AS Experiment_number
      FROM expcounts GROUP BY 1)""")
def q_experiment_genus_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rp.genus_totals(tb.experiment_counts(spark, sf))


@register("experiment_summary", _with(tb.EXPERIMENT_COUNTS_SQL) + """
SELECT round((SELECT avg(t) FROM (SELECT sum(Experiment_number) AS t FROM expcounts GROUP BY Species_name)), 7) AS mean_species,
       round((SELECT avg(t) FROM (SELECT sum(Experiment_number) AS t FROM expcounts
                                  GROUP BY split_part(Species_name, ' ', 1))), 7) AS mean_genus,
       round((SELECT median(Experiment_number) FROM expcounts), 7) AS median_experiments,
       (SELECT count(*) FILTER (WHERE Experiment_number IS NULL) FROM expcounts) AS n_missing,
       (SELECT count(DISTINCT Experiment_number) FROM expcounts) AS n_distinct""")
def q_experiment_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(rp.experiment_summary(tb.experiment_counts(spark, sf)))


@register("experiment_histogram", _with(tb.EXPERIMENT_COUNTS_SQL, """t AS (
  SELECT sum(Experiment_number) AS x FROM expcounts GROUP BY Species_name)""",
                                         """d AS (SELECT CAST(x AS DOUBLE) AS x FROM t WHERE x >= 0 AND x <= 1300)""",
                                         """w AS (SELECT (1300.0::DOUBLE - 0.0::DOUBLE) / 49.0::DOUBLE AS w)""",
                                         """c AS (SELECT CAST(greatest(ceil((x - 0.0::DOUBLE) / w) - 1, 0) AS BIGINT) AS bin,
                count(*) AS cnt FROM d, w GROUP BY 1)""",
                                         """b AS (SELECT range AS bin FROM range(0, 51), w WHERE range < ceil((1300.0::DOUBLE - 0.0::DOUBLE) / w))""") + """
SELECT b.bin, round(0.0::DOUBLE + b.bin * w, 7) AS bin_lo, round(0.0::DOUBLE + (b.bin + 1) * w, 7) AS bin_hi,
       coalesce(c.cnt, 0) AS count
FROM b CROSS JOIN w LEFT JOIN c ON b.bin = c.bin""")
def q_experiment_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(rp.experiment_histogram(tb.experiment_counts(spark, sf), bins=50, limits=(0, 1300)))


# ---------------------------------------------------------------------------
# distribution report (C8: A1, A2, F4, P13, A20)
# ---------------------------------------------------------------------------

@register("species_tpm_summary", _with(tb.DISTRIBUTION_SQL) + """
SELECT species_name, count(TPM) AS n, round(avg(TPM), 7) AS mean_tpm, round(median(TPM), 7) AS median_tpm
FROM dist GROUP BY species_name""")
def q_species_tpm_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(rp.species_summary(tb.distribution_samples(spark, sf)))


@register("genus_tpm_summary", _with(tb.DISTRIBUTION_SQL) + """
SELECT genus, n, mean_tpm, median_tpm FROM (
  SELECT genus, n, mean_tpm, median_tpm, row_number() OVER (ORDER BY genus) AS pos FROM (
    SELECT split_part(species_name, ' ', 1) AS genus, count(TPM) AS n, round(avg(TPM), 7) AS mean_tpm,
           round(median(TPM), 7) AS median_tpm
    FROM dist GROUP BY 1)) WHERE pos <> 73""")
def q_genus_tpm_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(rp.genus_summary(tb.distribution_samples(spark, sf), drop_at=73))


# Bin width for species medians: the reference's 20 TPM spans every species
# median of the scaled driver TPM (2-9), so the driver query uses 0.25.
MEDIAN_BIN_WIDTH = 0.25


@register("species_median_histogram", _with(tb.DISTRIBUTION_SQL) + f"""
SELECT bin, round(0.0::DOUBLE + bin * {MEDIAN_BIN_WIDTH}::DOUBLE, 7) AS bin_lo,
       round(0.0::DOUBLE + (bin + 1) * {MEDIAN_BIN_WIDTH}::DOUBLE, 7) AS bin_hi,
       count(*) AS count
FROM (SELECT CAST(greatest(ceil(m / {MEDIAN_BIN_WIDTH}) - 1, floor(min(m) OVER () / {MEDIAN_BIN_WIDTH})) AS BIGINT) AS bin
      FROM (SELECT median(TPM) AS m FROM dist GROUP BY species_name))
GROUP BY bin""")
def q_species_median_histogram(spark: SparkSession, sf: str) -> DataFrame:
    from sporeframe.operators.aggregates import histogram_width
    med = rp.species_summary(tb.distribution_samples(spark, sf))
    return rnd(histogram_width(med, "median_tpm", MEDIAN_BIN_WIDTH, 0.0))


_NORMALISED_GENES_SQL = _with(tb.DISTRIBUTION_SQL, """ng AS (
  SELECT species_name, split_part(species_name, ' ', 1) AS genus, (power(m, 0.22) - 1) / 0.22 AS v
  FROM (SELECT species_name, geneId, median(TPM) AS m FROM dist GROUP BY species_name, geneId) WHERE m > 0)""")


@register("normalised_species_summary", _NORMALISED_GENES_SQL + """
SELECT species_name, count(v) AS n, round(avg(v), 7) AS mean_tpm, round(median(v), 7) AS median_tpm FROM ng GROUP BY species_name""")
def q_normalised_species_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(rp.species_summary(rp.normalised_genes(tb.distribution_samples(spark, sf)), value="boxcox_tpm"))


@register("normalised_genus_summary", _NORMALISED_GENES_SQL + """
SELECT genus, count(v) AS n, round(avg(v), 7) AS mean_tpm, round(median(v), 7) AS median_tpm FROM ng WHERE genus <> 'NATION_3' GROUP BY genus""")
def q_normalised_genus_summary(spark: SparkSession, sf: str) -> DataFrame:
    """C8 on the normalised table, the outlier removed by its name."""
    return rnd(rp.genus_summary(rp.normalised_genes(tb.distribution_samples(spark, sf)), value="boxcox_tpm", drop_at=None, drop_key="NATION_3"))


@register("normalised_mean_histogram", _NORMALISED_GENES_SQL + """,
m AS (SELECT avg(v) AS v FROM ng GROUP BY species_name),
r AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 49.0 AS w FROM m),
e AS (SELECT lo, hi, w, floor(lo / w) * w AS f FROM r),
b AS (SELECT CAST(greatest(ceil((v - f) / w) - 1, 0) AS BIGINT) AS bin, count(*) AS n FROM m, e GROUP BY 1)
SELECT CAST(k AS BIGINT) AS bin, round(f + k * w, 7) AS bin_lo, round(f + (k + 1) * w, 7) AS bin_hi, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM e, range(0, 51) t(k) LEFT JOIN b ON b.bin = k WHERE k < ceil((hi - f) / w)""")
def q_normalised_mean_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """50 bins over the species' mean Box-Cox values."""
    means = rp.normalised_genes(tb.distribution_samples(spark, sf)).groupBy("species_name").agg(F.avg("boxcox_tpm").alias("mean_tpm"))
    return rnd(ag.histogram_bins(reliable_checkpoint(means), "mean_tpm", 50))


# ---------------------------------------------------------------------------
# replicate table (C10: P9, W1, P7, U3, A23, A5)
# ---------------------------------------------------------------------------

REPLICATE_CONDITIONS = tuple(f"cond{i}" for i in range(1, 8))
_COND_COLS = ", ".join(f"round(max(v) FILTER (WHERE exp_cond = '{c}'), 7) AS {c}" for c in REPLICATE_CONDITIONS)


@register("replicate_table", _with(tb.EXPRESSION_SQL, """l AS (
  SELECT species AS species_name, geneId AS gene_id, 'cond' || line AS exp_cond, TPM FROM samples
  WHERE regexp_matches(species, '^Brand#1'))""", """k AS (
  SELECT l.* FROM l SEMI JOIN (SELECT species_name, gene_id FROM l GROUP BY ALL HAVING count(*) > 1) r
  ON l.species_name = r.species_name AND l.gene_id = r.gene_id)""", """c AS (
  SELECT species_name, gene_id, exp_cond, avg(TPM) AS v FROM k GROUP BY ALL)""") + f"""
SELECT species_name, gene_id, {_COND_COLS}, round(avg(v), 7) AS mean, round(stddev_samp(v) / avg(v), 7) AS cv
FROM c GROUP BY species_name, gene_id""")
def q_replicate_table(spark: SparkSession, sf: str) -> DataFrame:
    s = tb.expression_samples(spark, sf)
    long_df = s.select(F.col("species").alias("species_name"), F.col("geneId").alias("gene_id"),
                       F.concat(F.lit("cond"), F.col("line")).alias("exp_cond"), "TPM")
    return rnd(rp.replicate_table(long_df, "^Brand#1", REPLICATE_CONDITIONS))


# ---------------------------------------------------------------------------
# GTF and validation (S6, C5: F5, P2, P7, J1, J2, F27, A15, A19)
# ---------------------------------------------------------------------------

@register("gtf_parse", """
SELECT l_linenumber AS replicate, 'chr' || l_suppkey AS seqname, 'pipeline' AS source, 'transcript' AS feature,
       l_orderkey AS start, l_orderkey + l_linenumber AS "end", NULL::DOUBLE AS score,
       CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand, NULL::INTEGER AS frame,
       'G' || l_partkey AS gene_id, 'gene-SPOM_' || l_partkey AS ref_gene_id, round(l_quantity, 7) AS TPM
FROM lineitem""")
def q_gtf_parse(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(fl.parse_gtf(tb.gtf_lines(spark, sf), keep=("replicate",)))


_VALIDATION_CTES = _with(tb.EXPRESSION_SQL, """pipe AS (
  SELECT l_linenumber AS replicate, CAST(l_partkey AS VARCHAR) AS geneId, avg(l_quantity) AS p
  FROM lineitem GROUP BY ALL)""", """pub AS (SELECT line AS replicate, geneId, avg(TPM) AS f FROM samples GROUP BY ALL)""",
                         """m AS (SELECT pub.replicate, pub.geneId, log10(p + 1) AS lp, log10(f + 1) AS lf
          FROM pub JOIN pipe ON pub.replicate = pipe.replicate AND pub.geneId = pipe.geneId)""")


def _merged_logs(spark: SparkSession, sf: str) -> DataFrame:
    gtf = fl.parse_gtf(tb.gtf_lines(spark, sf), keep=("replicate",))
    pub = tb.expression_samples(spark, sf).select(F.col("line").alias("replicate"), "geneId", "TPM")
    return va.merged_logs(va.pipeline_tpm(gtf), va.published_tpm(pub))


@register("validation_per_replicate", _VALIDATION_CTES + """
SELECT replicate, count(*) AS n_genes, round(corr(lp, lf), 7) AS pearson_r, round(regr_slope(lf, lp), 7) AS slope,
       round(regr_intercept(lf, lp), 7) AS intercept
FROM m GROUP BY replicate""")
def q_validation_per_replicate(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(va.per_replicate_r(_merged_logs(spark, sf)))


@register("validation_three_way", _VALIDATION_CTES + """
SELECT count(*) AS n_genes, round(corr(c.lp, c.lf), 7) AS pearson_r_last,
       round((corr(a.lp, a.lf) + corr(b.lp, b.lf) + corr(c.lp, c.lf)) / 3, 7) AS pearson_r_mean
FROM (SELECT * FROM m WHERE replicate = 1) a
JOIN (SELECT * FROM m WHERE replicate = 2) b ON a.geneId = b.geneId
JOIN (SELECT * FROM m WHERE replicate = 3) c ON a.geneId = c.geneId""")
def q_validation_three_way(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(va.three_way_r(_merged_logs(spark, sf), [1, 2, 3]))


# ---------------------------------------------------------------------------
# sequences and features
# ---------------------------------------------------------------------------


def _kmer_index_sql(col: str, k: int) -> str:
    return " + ".join(f"(instr('ACGT', substr({col}, {j + 1}, 1)) - 1) * {4 ** (k - 1 - j)}" for j in range(k))


@register("kmer_counts_long", _with(tb.sequences_sql(), """w AS (
  SELECT gene_id, unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 3))) AS kmer
  FROM seqs WHERE length(seq) >= 3)""") + """
SELECT gene_id, kmer, count(*) AS n FROM w WHERE NOT contains(kmer, 'N') GROUP BY gene_id, kmer""")
def q_kmer_counts_long(spark: SparkSession, sf: str) -> DataFrame:
    return fe.kmer_counts_long(tb.sequences(spark, sf), "gene_id", "seq", 3, overlap=True)


@register("kmer_vector_codon", _with(tb.sequences_sql(), """w AS (
  SELECT gene_id, length(seq) AS L,
         unnest(list_transform(range(0, length(seq) // 3), lambda j: substr(seq, j * 3 + 1, 3))) AS kmer
  FROM seqs WHERE length(seq) >= 3)""") + f"""
SELECT gene_id, CAST({_kmer_index_sql('kmer', 3)} AS INTEGER) AS kmer_index, round(ln(count(*) / L + 1), 7) AS value
FROM w WHERE NOT contains(kmer, 'N') GROUP BY gene_id, kmer, L""")
def q_kmer_vector_codon(spark: SparkSession, sf: str) -> DataFrame:
    s = tb.sequences(spark, sf)
    v = s.select("gene_id", sq.kmer_vector("seq", 3, overlap=False, divide=True, log=True).alias("v"))
    return rnd(fe.dense_to_long(v, ["gene_id"], "v"))


_MOTIF_SQL = ", ".join(f"CAST(len(regexp_extract_all(seq, '{m}')) AS INTEGER) AS {m}" for m in sq.MPRA_MOTIFS)


@register("mpra_features", _with(tb.sequences_sql()) + f"""
SELECT s.gene_id, s.source AS block, round(log2(d.n_chars), 7) AS y, {_MOTIF_SQL},
       round(CASE WHEN length(seq) > 0
                  THEN (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) END, 7)
         AS GC_content_UTR3
FROM seqs s JOIN documents d ON s.gene_id = CAST(d.doc_id AS VARCHAR)""")
def q_mpra_features(spark: SparkSession, sf: str) -> DataFrame:
    docs = tb.read_table(spark, sf, "documents").select("doc_id", "source", "text", "n_chars")
    oligo = docs.select(
        F.col("doc_id").cast("string").alias("gene_id"),
        tb.dna_from_text("text").alias("Oligo Sequence"),
        # description in the reference's '<name>#<...>context_<block><suffix>' shape
        F.concat(F.lit("oligo"), F.col("doc_id"), F.lit("#lib_context_native_"), F.col("source"), F.lit("_one_ins"))
        .alias("Description"),
        F.col("n_chars").cast("double").alias("Expression"),
    )
    return rnd(fe.mpra_features(oligo, keep=("gene_id",)))


def _ends_sql() -> str:
    return """ends AS (
  SELECT gene_id, substr(seq, 1, length(seq) // 2) AS five, substr(seq, length(seq) // 2 + 1) AS three FROM seqs)"""


def _windows_sql(col: str, k: int) -> str:
    return (f"(SELECT count(*) FROM (SELECT unnest(list_transform(range(1, length({col}) - {k - 2}), "
            f"lambda i: substr({col}, i, {k}))) AS km) WHERE NOT contains(km, 'N'))")


_REGISTRY_ROWS = " UNION ALL ".join(
    f"SELECT '{k}-mer-{end}' AS feature_set, gene_id, {w} AS width, {tot} AS total FROM ends"
    for k in (3, 4, 5)
    for end, w, tot in (
        ("fiveprime", 4 ** k, f"CASE WHEN length(five) >= {k} THEN {_windows_sql('five', k)} ELSE 0 END"),
        ("threeprime", 4 ** k, f"CASE WHEN length(three) >= {k} THEN {_windows_sql('three', k)} ELSE 0 END"),
        ("combined", 2 * 4 ** k, f"CASE WHEN length(five) >= {k} THEN {_windows_sql('five', k)} ELSE 0 END"
                                 f" + CASE WHEN length(three) >= {k} THEN {_windows_sql('three', k)} ELSE 0 END"),
    )
)


@register("feature_registry_summary", _with(tb.sequences_sql(), _ends_sql(), f"r AS ({_REGISTRY_ROWS})") + """
SELECT feature_set, count(*) AS n_genes, CAST(max(width) AS INTEGER) AS width, round(sum(total), 7) AS total
FROM r GROUP BY feature_set""")
def q_feature_registry_summary(spark: SparkSession, sf: str) -> DataFrame:
    ends = fe.split_ends(tb.sequences(spark, sf))
    reg = fe.feature_registry(ends)
    return rnd(reg.groupBy("feature_set").agg(
        F.count(F.lit(1)).alias("n_genes"),
        F.max(F.size("features")).alias("width"),
        F.sum(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total"),
    ))


@register("sequence_sentences", _with(tb.sequences_sql(), """t AS (SELECT gene_id, source, substr(seq, 1, 300) AS s FROM seqs)""") + """
SELECT gene_id, source || ' ' || array_to_string(list_transform(range(1, length(s) - 4), lambda i: substr(s, i, 6)), ' ')
       AS sentence
FROM t WHERE length(s) = 300""")
def q_sequence_sentences(spark: SparkSession, sf: str) -> DataFrame:
    t = tb.sequences(spark, sf).select("gene_id", "source", sq.truncate("seq", 300).alias("s"))
    return t.where(F.length("s") == 300).select("gene_id", sq.species_sentence("source", "s", 6).alias("sentence"))


_TOKEN_SQL = _with(tb.sequences_sql(), """t AS (SELECT gene_id, substr(seq, 1, 300) AS s,
         CAST(5 + 4096 - 1 + dense_rank() OVER (ORDER BY source) AS INTEGER) AS lead FROM seqs)""", f"""ids AS (
  SELECT gene_id, [2, lead] || list_transform(
           CASE WHEN length(s) >= 6 THEN list_transform(range(1, length(s) - 4), lambda i: substr(s, i, 6)) ELSE [] END,
           lambda km: CASE WHEN regexp_full_match(km, '[ACGT]+') THEN 5 + {_kmer_index_sql('km', 6)} ELSE 1 END)[1:509]
         || [3] AS body
  FROM t)""")


@register("token_runs", _TOKEN_SQL + """
SELECT gene_id, CAST(len(body) AS INTEGER) AS n_attended,
       CAST(coalesce(list_position(list_transform(body, lambda x: x >= 5), true) - 1, 512) AS INTEGER) AS leading_special,
       CAST(coalesce(list_position(list_transform(list_reverse(body), lambda x: x >= 5), true) - 1 + 512 - len(body), 512)
            AS INTEGER) AS trailing_special,
       CAST(list_sum(body) AS BIGINT) AS id_sum
FROM ids""")
def q_token_runs(spark: SparkSession, sf: str) -> DataFrame:
    t = tb.sequences(spark, sf).select("gene_id", "source", sq.truncate("seq", 300).alias("s"))
    tt = fe.token_table(t, "gene_id", "source", "s", k=6, max_len=512, species_ids=fe.species_vocabulary(t, "source"))
    return tt.select(
        "gene_id",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_attended"),
        "leading_special", "trailing_special",
        F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
    )


# ---------------------------------------------------------------------------
# splits, folds, positional zip, cross-species gene table
# ---------------------------------------------------------------------------


_RIDGE_INPUT_SQL = """ri AS (
  SELECT e.*, 'sp' || CAST(label AS VARCHAR) AS species, CAST(vec_id AS VARCHAR) AS gene_id FROM embeddings e)"""


@register("holdout_split", _with(_RIDGE_INPUT_SQL, """r AS (
  SELECT species, gene_id,
         row_number() OVER (PARTITION BY species ORDER BY md5(concat('42:', gene_id)), gene_id) AS rn,
         count(*) OVER (PARTITION BY species) AS n FROM ri)""", """t AS (
  SELECT species, gene_id, rn <= ceil(0.1::DOUBLE * n) AS is_test, rn - CAST(ceil(0.1::DOUBLE * n) AS BIGINT) AS trn,
         n - CAST(ceil(0.1::DOUBLE * n) AS BIGINT) AS tn FROM r)""") + """
SELECT species, gene_id, is_test,
       CAST(CASE WHEN is_test THEN 0 ELSE ntile(5) OVER (PARTITION BY species, is_test ORDER BY trn) END AS INTEGER) AS fold
FROM t""")
def q_holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    d = tb.ridge_input(spark, sf).where(F.col("end") == "upstream").select("species", "gene_id")
    return spl.holdout_split(d, ["species"], "gene_id", 0.1, 42, n_folds=5)


# greedy rule: the largest block goes to the fold with the fewest rows so far
_W7_SQL = ("""RECURSIVE b AS (
  SELECT source, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, source) AS p FROM documents GROUP BY source)""",
           """dealt AS (
  SELECT CAST(0 AS BIGINT) AS p, CAST(NULL AS VARCHAR) AS source, CAST(0 AS BIGINT) AS fold,
         CAST([0, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS loads
  UNION ALL
  SELECT b.p, b.source, CAST(list_position(loads, list_min(loads)) AS BIGINT),
         list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + b.size ELSE x END)
  FROM dealt JOIN b ON b.p = dealt.p + 1)""", """f AS (SELECT source, CAST(fold AS INTEGER) AS fold FROM dealt WHERE p > 0)""", tb.sequences_sql())


@register("group_kfold_assignment", _with(*_W7_SQL) + """
SELECT s.gene_id, s.source, f.fold FROM seqs s JOIN f ON s.source = f.source""")
def q_group_kfold_assignment(spark: SparkSession, sf: str) -> DataFrame:
    s = tb.sequences(spark, sf).select("gene_id", "source", F.lit("all").alias("_g"))
    return spl.group_kfold(s, ["_g"], "source", 10).select("gene_id", "source", "fold")


@register("positional_zip_embeddings", """
SELECT d.gene_id, d.row_idx, e.vec_id, e.label FROM
  (SELECT CAST(doc_id AS VARCHAR) AS gene_id, row_number() OVER (ORDER BY doc_id) AS row_idx FROM documents) d
LEFT JOIN (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row_idx FROM embeddings) e ON d.row_idx = e.row_idx""")
def q_positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    docs = tb.read_table(spark, sf, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("gene_id"),
                                                        F.lit(1).alias("_g"))
    emb = tb.read_table(spark, sf, "embeddings").select("vec_id", "label", F.lit(1).alias("_g"))
    z = jn.positional_zip(docs, emb, ["_g"], ["doc_id"], ["vec_id"], how="left", check_counts=False)
    return z.select("gene_id", "row_idx", "vec_id", "label")


# Lower bound on per-sample Box-Cox TPM: the reference keeps >= 5 on its TPM
# scale; the driver TPM is divided by 10^4, so the stand-in keeps >= 0 (TPM >= 1).
MIN_BOXCOX = 0.0


def gene_table(spark: SparkSession, sf: str) -> DataFrame:
    """Per gene median Box-Cox(0.22) and TPM of the kept samples (P5, F28,
    A1), log10 TPM (F27), test flag from ``labels`` (J7), joined to both
    sequence ends (W2 first per gene, J2)."""
    s = tb.expression_samples(spark, sf).select("geneId", "TPM", _boxcox("TPM", 0.22).alias("boxcox_tpm"))
    s = s.where(F.col("boxcox_tpm") >= MIN_BOXCOX)
    expr = s.groupBy("geneId").agg(F.median("boxcox_tpm").alias("boxcox_tpm"), F.median("TPM").alias("TPM"))
    expr = expr.withColumn("log_TPM", log10p1("TPM"))
    labels = tb.read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("names_test"))
    expr = jn.membership_flag(expr, labels, "geneId", "names_test", "is_test")
    ends = fe.split_ends(tb.sequences(spark, sf))
    # both ends come from one row, so one de-duplication serves both: the first row by the document's key
    first = rk.first_per_key(ends.select(F.col("gene_id").alias("geneId"), F.col("gene_id").cast("long").alias("_row"),
                                         "five_prime_seq", "three_prime_seq"), ["geneId"], ["_row", "five_prime_seq"])
    return jn.inner_join_all([expr, first.drop("_row")], "geneId")


@register("cross_species_genes", _with(tb.EXPRESSION_SQL, tb.sequences_sql(), f"""e AS (
  SELECT geneId, median(bc) AS boxcox_tpm, median(TPM) AS TPM FROM (
    SELECT geneId, TPM, CASE WHEN TPM > 0 THEN (power(TPM, 0.22) - 1) / 0.22 END AS bc FROM samples) WHERE bc >= {MIN_BOXCOX}
  GROUP BY geneId)""") + """
SELECT e.geneId, round(e.boxcox_tpm, 7) AS boxcox_tpm, round(e.TPM, 7) AS TPM, round(log10(e.TPM + 1), 7) AS log_TPM,
       e.geneId IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AS is_test,
       CAST(length(seq) // 2 AS INTEGER) AS five_len, CAST(length(seq) - length(seq) // 2 AS INTEGER) AS three_len
FROM e JOIN seqs s ON e.geneId = s.gene_id""")
def q_cross_species_genes(spark: SparkSession, sf: str) -> DataFrame:
    g = gene_table(spark, sf)
    return rnd(g.select("geneId", "boxcox_tpm", "TPM", "log_TPM", "is_test",
                        F.length("five_prime_seq").alias("five_len"), F.length("three_prime_seq").alias("three_len")))


# ---------------------------------------------------------------------------
# ridge jobs (M1, M3-M9, M13): no SQL form; checked against numpy in tests
# ---------------------------------------------------------------------------

def _ridge2_sql(keys: str, n_folds: int, pick: str, alphas: Sequence[float] = (10.0, 100.0, 1000.0)) -> list[str]:
    """CTEs of a two-feature ridge in closed form over ``cells(keys, cell, x1, x2, y)`` (cell 0: test rows): the
    same choice of alpha, scaling and refit as the wide jobs.  Ends in ``model(keys, alpha, b0, b1, b2, cv_score,
    n_train, n_test, r2, pr2)``."""
    sums = ("count(*)", "sum(x1)", "sum(x2)", "sum(y)", "sum(x1*x1)", "sum(x1*x2)", "sum(x2*x2)", "sum(x1*y)", "sum(x2*y)", "sum(y*y)")
    names = ("n", "x1", "x2", "y", "x11", "x12", "x22", "x1y", "x2y", "yy")
    cols = ", ".join(f"CAST({s} AS DOUBLE) AS {c}" for s, c in zip(sums, names))
    less = ", ".join(f"t.{c} - CASE WHEN e.cell > 0 THEN e.{c} ELSE 0 END AS f{c}, e.{c} AS e{c}" for c in names)

    def cov(p: str, a: str, b: str, ab: str) -> str:
        return f"({p}{ab} - {p}{a} * {p}{b} / {p}n)"

    return [
        f"stat AS (SELECT {keys}, cell, {cols} FROM cells GROUP BY {keys}, cell)",
        f"tot AS (SELECT {keys}, {', '.join(f'sum({c}) AS {c}' for c in names)} FROM stat WHERE cell > 0 GROUP BY {keys})",
        f"scale AS (SELECT {keys}, sqrt({cov('', 'x1', 'x1', 'x11')} / n) AS s1, sqrt({cov('', 'x2', 'x2', 'x22')} / n) AS s2 FROM tot)",
        f"fit AS (SELECT e.cell, t.n AS n_train, {less}, {keys} FROM stat e JOIN tot t USING ({keys}))",
        f"""solved AS (SELECT *, (a22 * g1 - a12 * g2) / (a11 * a22 - a12 * a12) / s1 AS b1, (a11 * g2 - a12 * g1) / (a11 * a22 - a12 * a12) / s2 AS b2
          FROM (SELECT *, {cov('f', 'x1', 'x1', 'x11')} / (s1 * s1) + alpha AS a11, {cov('f', 'x1', 'x2', 'x12')} / (s1 * s2) AS a12,
                       {cov('f', 'x2', 'x2', 'x22')} / (s2 * s2) + alpha AS a22, {cov('f', 'x1', 'y', 'x1y')} / s1 AS g1,
                       {cov('f', 'x2', 'y', 'x2y')} / s2 AS g2
                FROM fit JOIN scale USING ({keys}), (SELECT unnest([{', '.join(str(a) for a in alphas)}]::DOUBLE[]) AS alpha)))""",
        f"""lines AS (SELECT *, fy / fn - b1 * fx1 / fn - b2 * fx2 / fn AS b0,
                 b1 * b1 * {cov('e', 'x1', 'x1', 'x11')} + 2 * b1 * b2 * {cov('e', 'x1', 'x2', 'x12')} + b2 * b2 * {cov('e', 'x2', 'x2', 'x22')} AS vp,
                 b1 * {cov('e', 'x1', 'y', 'x1y')} + b2 * {cov('e', 'x2', 'y', 'x2y')} AS cp, {cov('e', 'y', 'y', 'yy')} AS vy FROM solved)""",
        f"""scored AS (SELECT *, 1 - (vy - 2 * cp + vp + en * power(ey / en - b0 - b1 * ex1 / en - b2 * ex2 / en, 2)) / vy AS r2,
                 cp * cp / (vy * vp) AS pr2 FROM lines)""",
        f"cv AS (SELECT {keys}, alpha, avg({pick}) AS cv_score FROM scored WHERE cell BETWEEN 1 AND {n_folds} GROUP BY {keys}, alpha)",
        f"best AS (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY cv_score DESC, alpha) = 1)",
        f"""model AS (SELECT {keys}, alpha, b0, b1, b2, cv_score, n_train, en AS n_test, r2, pr2
          FROM scored JOIN best USING ({keys}, alpha) WHERE cell = 0)""",
    ]


def two_features(df: DataFrame) -> DataFrame:
    """The first two features of each row: models whose algebra SQL can repeat."""
    return df.withColumn("features", F.slice("features", 1, 2))


_SPECIES2_SQL = ("""ri AS (
  SELECT 'upstream' AS "end", 'sp' || CAST(label AS VARCHAR) AS species, CAST(vec_id AS VARCHAR) AS gene_id, CAST(embedding[1] AS DOUBLE) AS x1,
         CAST(embedding[2] AS DOUBLE) AS x2, label + 20.0 * CAST(embedding[1] AS DOUBLE) AS y FROM embeddings
  UNION ALL SELECT 'downstream', 'sp' || CAST(label AS VARCHAR), CAST(vec_id AS VARCHAR), CAST(embedding[len(embedding) // 2 + 1] AS DOUBLE),
         CAST(embedding[len(embedding) // 2 + 2] AS DOUBLE), label + 20.0 * CAST(embedding[1] AS DOUBLE) FROM embeddings)""", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "end", species ORDER BY md5(concat('42:', gene_id)), gene_id)
              <= ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY "end", species)) AS is_test,
         row_number() OVER (PARTITION BY "end", species ORDER BY md5(concat('42:', gene_id)), gene_id) AS rn FROM ri)""", """cells AS (
  SELECT *, CASE WHEN is_test THEN 0 ELSE ntile(5) OVER (PARTITION BY "end", species, is_test ORDER BY rn) END AS cell FROM ranked)""",
                 *_ridge2_sql('"end", species', 5, "r2"))


@register("species_ridge_two_features", _with(*_SPECIES2_SQL) + """
SELECT "end", species, alpha, round(cv_score, 7) AS cv_score, n_train, n_test, round(r2, 7) AS "R2" FROM model""")
def q_species_ridge_two(spark: SparkSession, sf: str) -> DataFrame:
    models, _ = md.species_ridge(two_features(tb.ridge_input(spark, sf)))
    return rnd(models.select("end", "species", "alpha", "cv_score", "n_train", "n_test", F.col("test_r2").alias("R2")))


@register("species_predictions_two_features", _with(*_SPECIES2_SQL) + """
SELECT "end", species, gene_id, round(y, 7) AS "True_Value", round(b0 + b1 * x1 + b2 * x2, 7) AS "Predicted_Value"
FROM cells JOIN model USING ("end", species) WHERE cell = 0""")
def q_species_predictions_two(spark: SparkSession, sf: str) -> DataFrame:
    _, preds = md.species_ridge(two_features(tb.ridge_input(spark, sf)))
    return rnd(preds)


@register("prediction_r2_two_features", _with(*_SPECIES2_SQL) + """
SELECT "end", species, round(1 - sum(power(y - b0 - b1 * x1 - b2 * x2, 2)) / (count(*) * var_pop(y)), 7) AS "R2"
FROM cells JOIN model USING ("end", species) WHERE cell = 0 GROUP BY "end", species""")
def q_prediction_r2_two(spark: SparkSession, sf: str) -> DataFrame:
    """A18 from the predictions table (M5)."""
    _, preds = md.species_ridge(two_features(tb.ridge_input(spark, sf)))
    return rnd(md.r2_from_predictions(preds, ["end", "species"]))


@register("r2_trend_two_features", _with(*_SPECIES2_SQL) + """
SELECT "end", round(regr_slope(r2, x), 7) AS slope, round(regr_intercept(r2, x), 7) AS intercept
FROM (SELECT "end", r2, row_number() OVER (PARTITION BY "end" ORDER BY species) - 1 AS x FROM model) GROUP BY "end" """)
def q_r2_trend_two(spark: SparkSession, sf: str) -> DataFrame:
    """M13 for both ends."""
    models, _ = md.species_ridge(two_features(tb.ridge_input(spark, sf)))
    return rnd(md.r2_trend(models.select("end", "species", F.col("test_r2").alias("R2")), group_cols=("end",)).select("end", "slope", "intercept"))


@register("species_ridge_r2")
def q_species_ridge_r2(spark: SparkSession, sf: str) -> DataFrame:
    models, _ = md.species_ridge(tb.ridge_input(spark, sf))
    return rnd(models.select("end", "species", "alpha", "cv_score", "n_train", "n_test",
                             F.col("test_r2").alias("R2")))


@register("species_ridge_predictions")
def q_species_ridge_predictions(spark: SparkSession, sf: str) -> DataFrame:
    _, preds = md.species_ridge(tb.ridge_input(spark, sf))
    return rnd(preds)


@register("r2_trend")
def q_r2_trend(spark: SparkSession, sf: str) -> DataFrame:
    models, _ = md.species_ridge(tb.ridge_input(spark, sf))
    return rnd(md.r2_trend(models.select("end", "species", F.col("test_r2").alias("R2")), group_cols=("end",)))


def feature_set_sources(spark: SparkSession, sf: str, kmer_sets: bool = True) -> list[Source]:
    """M7 input: the C7 gene table's k-mer feature sets (M10) and the embedding set attached by
    position (J8), target = median Box-Cox TPM, as narrow rows and the functions that make features of them.
    ``kmer_sets=False`` leaves the k-mer sets out."""
    genes = gene_table(spark, sf).select(F.col("geneId").alias("gene_id"), "five_prime_seq", "three_prime_seq",
                                         F.col("boxcox_tpm").alias("y"), "is_test", F.col("geneId").cast("long").alias("row_order"))
    if kmer_sets:
        genes = reliable_checkpoint(genes)  # read by both sources, for folds and for statistics
    docs = tb.read_table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("gene_id"),
                                                        F.lit(1).alias("_g"))
    emb = tb.read_table(spark, sf, "embeddings").select("vec_id", "embedding", F.lit(1).alias("_g"))
    z = jn.positional_zip(docs, emb, ["_g"], ["doc_id"], ["vec_id"], how="left", check_counts=False)
    z = z.where(F.col("embedding").isNotNull())  # a gene beyond the embedding rows has no embedding set

    def embedding_sets(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        vec, half = F.transform("embedding", lambda v: v.cast("double")), F.floor(F.size("embedding") / 2).cast("int")
        # the set of both ends names its downstream part first, so a filter on that name takes it, too
        ends = [("Upstream", F.slice(vec, F.lit(1), half)), ("Downstream", F.slice(vec, half + 1, F.size("embedding") - half)),
                ("Combined: Downstream: embedding ! Upstream", vec)]
        sets = F.array(*[F.struct(F.lit(f"{end}: embedding").alias("feature_set"), v.alias("features")) for end, v in ends])
        return rows.select("gene_id", *keep, F.explode(sets).alias("s")).select("s.feature_set", "gene_id", "s.features", *keep)

    z = z.select("gene_id", "embedding").join(genes.select("gene_id", "y", "is_test", "row_order"), "gene_id")
    kmers = [Source(genes, lambda rows, keep: fe.feature_registry(rows, keep=keep))] if kmer_sets else []
    return [*kmers, Source(z, embedding_sets)]


def feature_set_input(spark: SparkSession, sf: str, name_filter=None, kmer_sets: bool = True) -> DataFrame:
    """The rows of all sets of `feature_set_sources`.  ``kmer_sets=False`` skips computing the k-mer vectors when the
    caller's filter keeps none of them (a filter after the explode would not)."""
    made = [s.make(s.rows, ["y", "is_test", "row_order"]) for s in feature_set_sources(spark, sf, kmer_sets)]
    out = reduce(DataFrame.unionByName, made)
    if name_filter is not None:
        out = out.where(name_filter)
    # features feed CV, refit, bootstrap and predictions: compute them once
    return reliable_checkpoint(out)


def two_feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    """M7 input with two features a set: sequence shape (length in thousands, GC), and the first two embedding values."""
    genes = gene_table(spark, sf).select(F.col("geneId").alias("gene_id"), F.col("geneId").cast("long").alias("row_order"), F.col("boxcox_tpm").alias("y"),
                                         "is_test", F.concat("five_prime_seq", "three_prime_seq").alias("seq"))
    shape = genes.where(F.length("seq") > 0).select(F.lit("shape").alias("feature_set"), "gene_id", "row_order", "y", "is_test",
                                                    F.array(F.length("seq") / 1000.0, sq.gc_fraction("seq")).alias("features"))
    docs = tb.read_table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("gene_id"), F.lit(1).alias("_g"))
    emb = tb.read_table(spark, sf, "embeddings").select("vec_id", "embedding", F.lit(1).alias("_g"))
    z = jn.positional_zip(docs, emb, ["_g"], ["doc_id"], ["vec_id"], how="left", check_counts=False).where(F.col("embedding").isNotNull())
    vec = z.select("gene_id", F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("features"))
    near = genes.join(vec, "gene_id").select(F.lit("embedding").alias("feature_set"), "gene_id", "row_order", "y", "is_test", "features")
    return reliable_checkpoint(shape.unionByName(near))


_SETS2_SQL = (tb.EXPRESSION_SQL, tb.sequences_sql(), f"""e AS (
  SELECT geneId, median(bc) AS y FROM (
    SELECT geneId, CASE WHEN TPM > 0 THEN (power(TPM, 0.22) - 1) / 0.22 END AS bc FROM samples) WHERE bc >= {MIN_BOXCOX} GROUP BY geneId)""",
              """g AS (SELECT s.gene_id, CAST(s.gene_id AS BIGINT) AS row_order, e.y, s.seq,
         s.gene_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AS is_test FROM e JOIN seqs s ON e.geneId = s.gene_id)""",
              """zip AS (SELECT CAST(d.doc_id AS VARCHAR) AS gene_id, v.embedding FROM
    (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents) d
    JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings) v ON d.k = v.k)""",
              """sets AS (
  SELECT 'shape' AS feature_set, gene_id, row_order, y, is_test, length(seq) / 1000.0::DOUBLE AS x1,
         (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) AS x2 FROM g WHERE length(seq) > 0
  UNION ALL SELECT 'embedding', g.gene_id, row_order, y, is_test, CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)
  FROM g JOIN zip ON g.gene_id = zip.gene_id)""",
              """cells AS (SELECT *, CASE WHEN is_test THEN 0 ELSE ntile(5) OVER (PARTITION BY feature_set, is_test ORDER BY row_order, gene_id) END AS cell
         FROM sets)""", *_ridge2_sql("feature_set", 5, "r2"))


@register("feature_set_ridge_two_features", _with(*_SETS2_SQL) + """
SELECT feature_set AS model, round(pr2, 7) AS r2, alpha FROM model""")
def q_feature_set_ridge_two(spark: SparkSession, sf: str) -> DataFrame:
    metrics, _ = md.feature_set_ridge(two_feature_sets(spark, sf))
    return rnd(metrics)


@register("feature_set_predictions_two_features", _with(*_SETS2_SQL) + """
SELECT feature_set AS model, gene_id, round(b0 + b1 * x1 + b2 * x2, 7) AS y_pred, round(y, 7) AS y_true
FROM cells JOIN model USING (feature_set) WHERE cell = 0""")
def q_feature_set_predictions_two(spark: SparkSession, sf: str) -> DataFrame:
    """M7's predictions table."""
    data = two_feature_sets(spark, sf)
    _, models = md.feature_set_ridge(data)
    return rnd(md.feature_set_predictions(data, models))


@register("feature_set_ridge_metrics")
def q_feature_set_ridge(spark: SparkSession, sf: str) -> DataFrame:
    kmers, vectors = feature_set_sources(spark, sf)
    # folds and statistics read the rows again; the vectors made of them are never written
    metrics, _ = md.feature_set_ridge([kmers, vectors._replace(rows=reliable_checkpoint(vectors.rows))])
    return rnd(metrics)


@register("bootstrap_spread")
def q_bootstrap_spread(spark: SparkSession, sf: str) -> DataFrame:
    sel = F.col("feature_set").contains("Downstream") & ~F.col("feature_set").contains("6-mer")
    # only the bootstrapped sets need their M7 alpha (P14 before fitting)
    # the k-mer sets are named '<k>-mer-...': none is a Downstream set
    data = feature_set_input(spark, sf, name_filter=sel, kmer_sets=False)
    _, models = md.feature_set_ridge(data)
    boot = md.bootstrap_ridge(data, models, replicates=100)
    return rnd(md.bootstrap_spread(boot))


@register("bootstrap_draws", _with(*_SETS2_SQL[:6]) + """
SELECT feature_set, CAST(count(*) AS BIGINT) AS n_train, 100 AS replicates, CAST(count(*) AS DOUBLE) AS least, CAST(count(*) AS DOUBLE) AS most
FROM sets WHERE NOT is_test GROUP BY feature_set""")
def q_bootstrap_draws(spark: SparkSession, sf: str) -> DataFrame:
    """M9's draws: every replicate draws exactly as many rows as the training set has."""
    data = two_feature_sets(spark, sf).where(~F.col("is_test"))
    drawn = spl.bootstrap_weights(data, ["feature_set"], ["row_order", "gene_id"], 100)
    each = drawn.select("feature_set", "gene_id", F.posexplode("weights").alias("replicate", "w"))
    each = each.groupBy("feature_set", "replicate").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows"))
    return each.groupBy("feature_set").agg(F.max("rows").alias("n_train"), F.count(F.lit(1)).cast("int").alias("replicates"), F.min("n").alias("least"), F.max("n").alias("most"))


def mpra_input(spark: SparkSession, sf: str, ks: Sequence[int] = (2, 3, 4, 5)) -> DataFrame:
    docs = tb.read_table(spark, sf, "documents").select("doc_id", "source", "text", "n_chars")
    oligo = docs.select(
        F.col("doc_id").cast("string").alias("gene_id"), F.col("doc_id").alias("row_order"),
        tb.dna_from_text("text").alias("Oligo Sequence"),
        F.concat(F.lit("oligo"), F.col("doc_id"), F.lit("#lib_context_native_"), F.col("source"), F.lit("_one_ins"))
        .alias("Description"),
        F.col("n_chars").cast("double").alias("Expression"),
    )
    feats = fe.mpra_features(oligo, keep=("gene_id", "row_order", "Oligo Sequence"))
    # every k in one pass over the sequences
    vecs = sq.with_kmer_vectors(feats, {f"_k{k}": ("Oligo Sequence", k) for k in ks}, keep=["gene_id", "row_order", "block", "y"])
    sets = F.array(*[F.struct(F.lit(f"{k}-mer counts").alias("feature_set"), F.col(f"_k{k}").alias("features")) for k in ks])
    e = vecs.select("gene_id", "row_order", "block", "y", F.explode(sets).alias("_s"))
    return reliable_checkpoint(e.select("_s.feature_set", "gene_id", "row_order", "block", "y", "_s.features"))


@register("mpra_group_kfold")
def q_mpra_group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(md.group_kfold_ridge(mpra_input(spark, sf))[0])


@register("mpra_group_kfold_predictions")
def q_mpra_group_kfold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """M8's predictions table: every row of every feature set, predicted by the folds that don't hold it."""
    return rnd(md.group_kfold_ridge(mpra_input(spark, sf))[1])


def mpra_two_features(spark: SparkSession, sf: str) -> DataFrame:
    """M8 input with two features: length in thousands and GC fraction."""
    docs = tb.read_table(spark, sf, "documents").select(F.col("doc_id").alias("row_order"), F.log2("n_chars").alias("y"))
    s = tb.sequences(spark, sf).withColumn("row_order", F.col("gene_id").cast("long"))
    d = s.join(docs, "row_order").where(F.length("seq") > 0)
    return reliable_checkpoint(d.select(F.lit("shape").alias("feature_set"), "gene_id", "row_order", F.col("source").alias("block"), "y",
                                        F.array(F.length("seq") / 1000.0, sq.gc_fraction("seq")).alias("features")))


_MPRA2_SQL = (*_W7_SQL, """g AS (
  SELECT s.gene_id, CAST(s.gene_id AS BIGINT) AS row_order, log2(d.n_chars) AS y, f.fold AS own, length(seq) / 1000.0::DOUBLE AS x1,
         (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) AS x2
  FROM seqs s JOIN documents d ON s.gene_id = CAST(d.doc_id AS VARCHAR) JOIN f ON s.source = f.source WHERE length(seq) > 0)""", """cells AS (
  SELECT *, CASE WHEN own = outer_fold THEN 0 ELSE ntile(3) OVER (PARTITION BY outer_fold, own = outer_fold ORDER BY row_order) END AS cell
  FROM (SELECT *, unnest(range(1, 11)) AS outer_fold FROM g))""", *_ridge2_sql("outer_fold", 3, "r2"))


@register("mpra_group_kfold_two_features", _with(*_MPRA2_SQL) + """
SELECT 'shape' AS model, CAST(outer_fold AS INTEGER) AS fold, round(pr2, 7) AS r2, alpha FROM model""")
def q_mpra_group_kfold_two(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(md.group_kfold_ridge(mpra_two_features(spark, sf))[0])


@register("mpra_predictions_two_features", _with(*_MPRA2_SQL) + """
SELECT 'shape' AS model, CAST(outer_fold AS INTEGER) AS fold, gene_id, round(b0 + b1 * x1 + b2 * x2, 7) AS pred, round(y, 7) AS "true"
FROM cells JOIN model USING (outer_fold) WHERE cell = 0""")
def q_mpra_predictions_two(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(md.group_kfold_ridge(mpra_two_features(spark, sf))[1])


@register("fixed_alpha_ridge_two_features", _with(*_SPECIES2_SQL[:-len(_ridge2_sql("x", 5, "r2"))], *_ridge2_sql('"end", species', 5, "r2", (100.0,))) + """
SELECT "end", species, alpha, round(b0, 7) AS intercept, round(b1, 7) AS b1, round(b2, 7) AS b2, round(r2, 7) AS "R2" FROM model""")
def q_fixed_alpha_ridge_two(spark: SparkSession, sf: str) -> DataFrame:
    """M4: one given alpha for every species and end."""
    models, _ = md.species_ridge(two_features(tb.ridge_input(spark, sf)), alphas=(100.0,))
    return rnd(models.select("end", "species", "alpha", "intercept", F.col("coef")[0].alias("b1"), F.col("coef")[1].alias("b2"), F.col("test_r2").alias("R2")))


def minus_absolute_error(y: F.Column, pred: F.Column) -> F.Column:
    return -F.avg(F.abs(y - pred))


@register("feature_set_absolute_error_two_features", _with(*_SETS2_SQL[:-3], """errors AS (
  SELECT feature_set, cell, alpha, avg(abs(c.y - b0 - b1 * c.x1 - b2 * c.x2)) AS mae
  FROM cells c JOIN lines USING (feature_set, cell) GROUP BY feature_set, cell, alpha)""", """cv AS (
  SELECT feature_set, alpha, avg(mae) AS cv_mae FROM errors WHERE cell > 0 GROUP BY feature_set, alpha
  QUALIFY row_number() OVER (PARTITION BY feature_set ORDER BY cv_mae, alpha) = 1)""") + """
SELECT feature_set, cv.alpha, round(cv.cv_mae, 7) AS cv_error, round(e.mae, 7) AS test_error FROM cv JOIN errors e USING (feature_set, alpha) WHERE e.cell = 0""")
def q_feature_set_absolute_error(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer of the user's own (mean absolute error) chooses the alpha and scores the test genes."""
    _, models = md.feature_set_ridge(two_feature_sets(spark, sf), cv_metric=minus_absolute_error)
    return rnd(models.select("feature_set", "alpha", (-F.col("cv_score")).alias("cv_error"), (-F.col("test_score")).alias("test_error")))



# ---------------------------------------------------------------------------
# fitted transforms, QQ, Spearman, KDE
# ---------------------------------------------------------------------------


def _yj_sql(x: str, lam: str) -> str:
    pos = f"CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (power(1 + {x}, {lam}) - 1) / {lam} END"
    neg = (f"CASE WHEN abs(2 - {lam}) < 1e-12 THEN -ln(1 - {x}) "
           f"ELSE -(power(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END")
    return f"CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


def _bc_sql(x: str, lam: str) -> str:
    return f"CASE WHEN abs({lam}) < 1e-12 THEN ln({x}) ELSE (power({x}, {lam}) - 1) / {lam} END"


def _lambda_stage_ctes(method: str) -> tuple[list[str], str]:
    """CTEs of the staged maximum-likelihood lambda search (F29 / F30) over
    the gene sets ``g``; returns them and the name of the final best table."""
    tf = _bc_sql if method == "boxcox" else _yj_sql
    p = "bc" if method == "boxcox" else "yj"
    jac = "ln(x)" if method == "boxcox" else "sign(x) * ln(1 + abs(x))"
    having = "HAVING count(*) >= 2 AND min(x) > 0" if method == "boxcox" else "HAVING count(*) >= 2"
    ctes = [f"""{p}gs AS (SELECT species, combo, count(*) AS n, sum({jac}) AS j FROM g GROUP BY species, combo {having})"""]
    prev = None
    for k, (lo, hi, step) in enumerate(nm.STAGES, start=1):
        n = int(round((hi - lo) / step))
        off = f"round(CAST({lo!r} AS DOUBLE) + CAST({step!r} AS DOUBLE) * i, 10)"
        base = "0.0" if prev is None else f"{prev}.lam"
        src = f"{p}gs" if prev is None else f"{p}gs JOIN {prev} USING (species, combo)"
        ctes.append(f"""{p}c{k} AS (SELECT {p}gs.species, {p}gs.combo, {p}gs.n, {p}gs.j, round({base} + {off}, 10) AS lam
          FROM {src}, range(0, {n + 1}) t(i))""")
        ctes.append(f"""{p}l{k} AS (SELECT c.species, c.combo, c.lam,
                 (c.lam - 1) * c.j - c.n / 2.0 * ln(var_pop({tf('g.x', 'c.lam')})) AS llf
          FROM {p}c{k} c JOIN g ON c.species = g.species AND c.combo = g.combo
          GROUP BY c.species, c.combo, c.lam, c.j, c.n)""")
        ctes.append(f"""{p}b{k} AS (SELECT species, combo, lam FROM (
            SELECT *, row_number() OVER (PARTITION BY species, combo
                                         ORDER BY round(coalesce(llf, '-inf'::DOUBLE), 9) DESC, abs(lam)) AS rk
            FROM {p}l{k})
          WHERE rk = 1)""")
        prev = f"{p}b{k}"
    return ctes, prev


def _fitted_ctes() -> list[str]:
    """Gene sets per (species, pair), both fitted lambdas, Box-Cox scores and
    the chosen pair per species (``best``)."""
    bc_ctes, bc_best = _lambda_stage_ctes("boxcox")
    yj_ctes, yj_best = _lambda_stage_ctes("yeojohnson")
    return [
        tb.EXPRESSION_SQL,
        """st AS (SELECT species, geneId, median(TPM) AS med, stddev_samp(TPM) / avg(TPM) AS rsd
          FROM samples GROUP BY species, geneId)""",
        _combo_values_sql(),
        """g AS (SELECT st.species, st.geneId, c.combo, c.tpm_threshold, c.rsd_threshold, st.med AS x
         FROM st JOIN combos c ON st.med > c.tpm_threshold AND st.rsd < c.rsd_threshold)""",
        *bc_ctes, *yj_ctes,
        f"""lams AS (SELECT coalesce(b.species, y.species) AS species, coalesce(b.combo, y.combo) AS combo,
                     b.lam AS lam_bc, y.lam AS lam_yj
          FROM {bc_best} b FULL JOIN {yj_best} y ON b.species = y.species AND b.combo = y.combo)""",
        f"""t AS (SELECT g.*, lams.lam_bc, lams.lam_yj,
                 CASE WHEN g.x <= 0 THEN NULL WHEN lams.lam_bc = 0 THEN ln(g.x)
                      ELSE (power(g.x, lams.lam_bc) - 1) / lams.lam_bc END AS bc
          FROM g JOIN lams ON g.species = lams.species AND g.combo = lams.combo)""",
        """m AS (SELECT *, avg(bc) OVER (PARTITION BY species, combo) AS mu FROM t)""",
        """sc AS (SELECT species, combo, tpm_threshold, rsd_threshold, count(*) AS n_genes,
                  CASE WHEN avg(power(bc - mu, 2)) > 0
                       THEN abs(avg(power(bc - mu, 3)) / power(avg(power(bc - mu, 2)), 1.5)) END AS skew,
                  abs(kurtosis_pop(bc)) AS kurtosis
           FROM m GROUP BY species, combo, tpm_threshold, rsd_threshold)""",
        """best AS (SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY species ORDER BY round(skew + kurtosis, 9), combo) AS rk
            FROM sc WHERE skew + kurtosis IS NOT NULL AND NOT isnan(skew + kurtosis)) WHERE rk = 1)""",
    ]


def _fitted_search_sql() -> str:
    """DuckDB twin of C4 with fitted lambdas (F29): the chosen pair per species."""
    return _with(*_fitted_ctes()) + """
SELECT species, combo, tpm_threshold, rsd_threshold, n_genes, 'boxcox' AS scored_on,
       round(skew, 7) AS skew, round(kurtosis, 7) AS kurtosis, round(skew + kurtosis, 7) AS score FROM best"""


def _normalised_sql() -> str:
    """DuckDB twin of the per-species normalised table."""
    return _with(*_fitted_ctes()) + f"""
SELECT t.species, t.geneId, round(t.x, 7) AS TPM,
       round(CASE WHEN t.x <= 0 THEN NULL WHEN t.lam_bc = 0 THEN ln(t.x)
                  ELSE (power(t.x, t.lam_bc) - 1) / t.lam_bc END, 7) AS boxcox_tpm,
       round({_yj_sql('t.x', 't.lam_yj')}, 7) AS yj_tpm, t.tpm_threshold, t.rsd_threshold
FROM t SEMI JOIN best ON t.species = best.species AND t.combo = best.combo"""


@register("threshold_search_fitted", _fitted_search_sql())
def q_threshold_search_fitted(spark: SparkSession, sf: str) -> DataFrame:
    best, _, _ = ex.threshold_search_fitted(tb.expression_samples(spark, sf), FIXTURE_TPM_THRESHOLDS,
                                            FIXTURE_RSD_THRESHOLDS)
    return rnd(best)


@register("normalised_expression", _normalised_sql())
def q_normalised_expression(spark: SparkSession, sf: str) -> DataFrame:
    best, genes, lambdas = ex.threshold_search_fitted(tb.expression_samples(spark, sf), FIXTURE_TPM_THRESHOLDS,
                                                      FIXTURE_RSD_THRESHOLDS)
    return rnd(ex.normalised_table(best, genes, lambdas))


def _acklam_sql(p: str) -> str:
    def horner(coefs, x):
        out = repr(coefs[0])
        for c in coefs[1:]:
            out = f"({out}) * {x} + {c!r}"
        return out
    q_lo, q_hi, r = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"(({p}) - 0.5) * (({p}) - 0.5)"
    low = f"({horner(nm._C, q_lo)}) / (({horner(nm._D, q_lo)}) * {q_lo} + 1)"
    high = f"-({horner(nm._C, q_hi)}) / (({horner(nm._D, q_hi)}) * {q_hi} + 1)"
    mid = f"({horner(nm._A, r)}) * (({p}) - 0.5) / (({horner(nm._B, r)}) * {r} + 1)"
    return f"CASE WHEN {p} < {nm._P_LOW!r} THEN {low} WHEN {p} > 1 - {nm._P_LOW!r} THEN {high} ELSE {mid} END"


@register("chosen_qq_fit", _BEST_SQL + f""", o AS (
  SELECT g.species, bc AS v, row_number() OVER (PARTITION BY g.species ORDER BY bc, st.geneId) AS i, count(*) OVER (PARTITION BY g.species) AS n
  FROM best g JOIN st ON st.species = g.species AND st.med > g.tpm_threshold AND st.rsd < g.rsd_threshold,
       LATERAL (SELECT (power(st.med, 0.22) - 1) / 0.22 AS bc) b),
m2 AS (SELECT species, v, CASE WHEN i = n THEN power(0.5, 1.0 / n) WHEN i = 1 THEN 1 - power(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END AS u FROM o),
q AS (SELECT species, v, {_acklam_sql('u')} AS osm FROM m2)
SELECT species, round(regr_slope(v, osm), 7) AS slope, round(regr_intercept(v, osm), 7) AS intercept, round(corr(v, osm), 7) AS r FROM q GROUP BY species""")
def q_chosen_qq_fit(spark: SparkSession, sf: str) -> DataFrame:
    """W5 on the Box-Cox values of each species' chosen gene set."""
    stats = reliable_checkpoint(ex.gene_stats(tb.expression_samples(spark, sf)))
    genes = ex.filter_genes(stats, FIXTURE_TPM_THRESHOLDS, FIXTURE_RSD_THRESHOLDS)
    best = ex.best_thresholds(ex.score_combos(genes, lam=0.22)).select("species", "combo")
    chosen = genes.join(best, ["species", "combo"], "left_semi").select("species", "geneId", _boxcox("TPM", 0.22).alias("boxcox_tpm"))
    return rnd(nm.qq_fit(chosen, ["species"], "boxcox_tpm", tiebreak=["geneId"]))


@register("species_qq_fit", _with(tb.EXPRESSION_SQL, """o AS (
  SELECT species, TPM, row_number() OVER (PARTITION BY species ORDER BY TPM, sample_id, line) AS i,
         count(*) OVER (PARTITION BY species) AS n FROM samples)""", """m AS (
  SELECT species, TPM, CASE WHEN i = n THEN power(0.5, 1.0 / n) WHEN i = 1 THEN 1 - power(0.5, 1.0 / n)
                            ELSE (i - 0.3175) / (n + 0.365) END AS u FROM o)""",
                                     f"""q AS (SELECT species, TPM, {_acklam_sql('u')} AS osm FROM m)""") + """
SELECT species, round(regr_slope(TPM, osm), 7) AS slope, round(regr_intercept(TPM, osm), 7) AS intercept,
       round(corr(TPM, osm), 7) AS r
FROM q GROUP BY species""")
def q_species_qq_fit(spark: SparkSession, sf: str) -> DataFrame:
    s = tb.expression_samples(spark, sf)
    return rnd(nm.qq_fit(s, ["species"], "TPM", tiebreak=["sample_id", "line"]))


@register("replicate_spearman", _with(tb.EXPRESSION_SQL, """g AS (
  SELECT species, geneId, avg(TPM) FILTER (WHERE line = 1) AS a, avg(TPM) FILTER (WHERE line = 2) AS b
  FROM samples GROUP BY species, geneId)""", """h AS (SELECT * FROM g WHERE a IS NOT NULL AND b IS NOT NULL)""",
                                        """r AS (SELECT species, geneId, rank() OVER (PARTITION BY species ORDER BY a)
          + (count(*) OVER (PARTITION BY species, a) - 1) / 2.0 AS ra,
          rank() OVER (PARTITION BY species ORDER BY b) + (count(*) OVER (PARTITION BY species, b) - 1) / 2.0 AS rb FROM h)""") + """
SELECT species, round(corr(ra, rb), 7) AS spearman FROM r GROUP BY species""")
def q_replicate_spearman(spark: SparkSession, sf: str) -> DataFrame:
    s = tb.expression_samples(spark, sf)
    g = s.groupBy("species", "geneId").agg(F.avg(F.when(F.col("line") == 1, F.col("TPM"))).alias("a"),
                                           F.avg(F.when(F.col("line") == 2, F.col("TPM"))).alias("b"))
    g = g.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return rnd(ag.spearman(g, ["species"], "a", "b", "geneId"))


@register("experiment_density", _with(tb.EXPERIMENT_COUNTS_SQL, """d AS (
  SELECT CAST(Experiment_number AS DOUBLE) AS v FROM expcounts WHERE Experiment_number IS NOT NULL)""", """st AS (
  SELECT min(v) AS lo, max(v) AS hi, count(*) AS n, stddev_samp(v) AS sd,
         (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34 AS iqr FROM d)""", """k AS (
  SELECT lo, hi, CAST(n AS DOUBLE) AS n,
         0.9 * (CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) ELSE sd END) * power(CAST(n AS DOUBLE), -0.2) AS bw,
         (hi - lo) / 1023.0 AS step, (hi - lo) / 511.0 AS ostep FROM st)""", """p AS (
  SELECT CASE WHEN step > 0 THEN (v - lo) / step ELSE 0.0 END AS pos FROM d, k)""", """l AS (
  SELECT CAST(least(floor(pos), 1022) AS INTEGER) AS lft, pos FROM p)""", """w AS (
  SELECT b, sum(w) AS w FROM (SELECT lft AS b, 1.0 - (pos - lft) AS w FROM l
                              UNION ALL SELECT lft + 1 AS b, pos - lft AS w FROM l) GROUP BY b)""") + """
SELECT CAST(j AS INTEGER) AS point, round(lo + j * ostep, 7) AS x,
       round(sum(w.w * exp(-power(((lo + j * ostep) - (lo + b * step)) / bw, 2) / 2))
             * ((1.0 / sqrt(2 * pi())) / (n * bw)), 7) AS density
FROM w, k, range(0, 512) t(j) GROUP BY j, lo, ostep, bw, n""")
def q_experiment_density(spark: SparkSession, sf: str) -> DataFrame:
    return rnd(ag.kde(tb.experiment_counts(spark, sf), "Experiment_number"))


# ---------------------------------------------------------------------------
# taxonomy tree (T1-T3, J5, F12, S13) over region -> nation -> customer
# ---------------------------------------------------------------------------


def taxonomy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Edges ``(child, parent)`` and names ``(node, name)`` of the
    region -> nation -> customer hierarchy; node ids are 'r..', 'n..', 'c..'."""
    region = tb.read_table(spark, sf, "region")
    nation = tb.read_table(spark, sf, "nation")
    cust = tb.read_table(spark, sf, "customer")
    edges = nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"),
                          F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent")).unionByName(
        cust.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("child"),
                    F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent")))
    names = (region.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.col("r_name").alias("name"))
             .unionByName(nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.col("n_name").alias("name")))
             .unionByName(cust.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.col("c_name").alias("name"))))
    return edges, names


def chosen_taxa(spark: SparkSession, sf: str) -> DataFrame:
    """The taxon list: customers of the 'BUILDING' segment with a balance above 9000."""
    c = tb.read_table(spark, sf, "customer")
    return c.where((F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000)).select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))


_TREE_SQL = _with("""edges AS (
  SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)""", """names AS (
  SELECT 'r' || r_regionkey AS node, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name FROM customer)""", """chosen AS (
  SELECT 'c' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)""",
                  """members AS (SELECT node FROM chosen UNION SELECT parent FROM edges WHERE child IN (SELECT node FROM chosen)
  UNION SELECT e2.parent FROM edges e1 JOIN edges e2 ON e1.parent = e2.child WHERE e1.child IN (SELECT node FROM chosen))""",
                  """fan AS (SELECT e.parent AS node, count(DISTINCT e.child) AS kids FROM edges e
  WHERE e.child IN (SELECT node FROM members) GROUP BY e.parent)""", """kept AS (
  SELECT m.node FROM members m LEFT JOIN fan f ON m.node = f.node
  WHERE m.node IN (SELECT node FROM chosen) OR coalesce(f.kids, 0) >= 2)""", """anc AS (
  SELECT e.child AS node, e.parent AS a1, e2.parent AS a2 FROM edges e LEFT JOIN edges e2 ON e.parent = e2.child)""")


@register("taxonomy_subtree", _TREE_SQL + """
SELECT k.node AS child,
       CASE WHEN anc.a1 IN (SELECT node FROM kept) THEN anc.a1 WHEN anc.a2 IN (SELECT node FROM kept) THEN anc.a2 END AS parent,
       names.name
FROM kept k LEFT JOIN anc ON k.node = anc.node LEFT JOIN names ON k.node = names.node""")
def q_taxonomy_subtree(spark: SparkSession, sf: str) -> DataFrame:
    edges, names = taxonomy(spark, sf)
    return tr.name_nodes(tr.induced_subtree(edges, chosen_taxa(spark, sf)), names)


# The stand-in taxonomy is at most three levels deep (region, nation,
# customer), so the oracle places the Newick text level by level.
_NEWICK_SQL = _TREE_SQL[:-1] + """,
tt AS (SELECT k.node AS child,
              CASE WHEN anc.a1 IN (SELECT node FROM kept) THEN anc.a1 WHEN anc.a2 IN (SELECT node FROM kept) THEN anc.a2 END
                AS parent,
              regexp_replace(coalesce(names.name, k.node), '[(),:;]', '_', 'g') AS label
       FROM kept k LEFT JOIN anc ON k.node = anc.node LEFT JOIN names ON k.node = names.node),
d AS (SELECT t.*, CASE WHEN t.parent IS NULL THEN 0 WHEN p.parent IS NULL THEN 1 ELSE 2 END AS depth
      FROM tt t LEFT JOIN tt p ON t.parent = p.child),
z2 AS (SELECT child, parent, label, 1 AS ev FROM d WHERE depth = 2),
z1 AS (SELECT d.child, d.parent, d.label, CASE WHEN count(z2.child) = 0 THEN 1 ELSE 2 + sum(z2.ev) END AS ev
       FROM d LEFT JOIN z2 ON z2.parent = d.child WHERE d.depth = 1 GROUP BY d.child, d.parent, d.label),
z0 AS (SELECT d.child, d.label, CASE WHEN count(z1.child) = 0 THEN 1 ELSE 2 + sum(z1.ev) END AS ev
       FROM d LEFT JOIN z1 ON z1.parent = d.child WHERE d.depth = 0 GROUP BY d.child, d.label),
p0 AS (SELECT child, label, ev, sum(ev) OVER (ORDER BY label, child) - ev AS place, '' AS comma, ';' AS tail FROM z0),
p1 AS (SELECT z.child, z.label, z.ev, p.place + 1 + sum(z.ev) OVER w - z.ev AS place,
              CASE WHEN row_number() OVER w > 1 THEN ',' ELSE '' END AS comma, ':1' AS tail
       FROM z1 z JOIN p0 p ON z.parent = p.child WINDOW w AS (PARTITION BY z.parent ORDER BY z.label, z.child)),
p2 AS (SELECT z.child, z.label, z.ev, p.place + 1 + sum(z.ev) OVER w - z.ev AS place,
              CASE WHEN row_number() OVER w > 1 THEN ',' ELSE '' END AS comma, ':1' AS tail
       FROM z2 z JOIN p1 p ON z.parent = p.child WINDOW w AS (PARTITION BY z.parent ORDER BY z.label, z.child)),
p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)
SELECT CAST(place AS BIGINT) AS place, comma || CASE WHEN ev = 1 THEN label || tail ELSE '(' END AS text FROM p
UNION ALL SELECT CAST(place + ev - 1 AS BIGINT), ')' || label || tail FROM p WHERE ev > 1
"""


@register("taxonomy_newick", _NEWICK_SQL)
def q_taxonomy_newick(spark: SparkSession, sf: str) -> DataFrame:
    """T3 as ordered rows: their texts by place are the Newick text."""
    edges, names = taxonomy(spark, sf)
    return tr.newick_rows(tr.name_nodes(tr.induced_subtree(edges, chosen_taxa(spark, sf)), names))


# ---------------------------------------------------------------------------
# batch embedding and pooling
# ---------------------------------------------------------------------------


@register("rule_embeddings", _TOKEN_SQL.replace("AS lead FROM seqs)", "AS lead FROM seqs QUALIFY length(seq) >= 300)", 1) + """,
padded AS (SELECT gene_id, body || list_transform(range(0, 512 - len(body)), lambda i: 0) AS ids FROM ids),
dims AS (SELECT unnest(range(0, 8)) AS dim)
SELECT gene_id, CAST(dim AS INTEGER) AS dim,
       round((list_sum(list_transform(ids, lambda t: sin((t + 1) * (dim + 1) * 0.01 + 2))) / 512
            + list_sum(list_transform(ids, lambda t: sin((t + 1) * (dim + 1) * 0.01 + 3))) / 512) / 2, 4) AS value
FROM padded, dims""")
def q_rule_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """M12, F31, F32 with an encoder that SQL can repeat: the whole pooled vector, one row per value."""
    t = tb.sequences(spark, sf).select("gene_id", "source", sq.truncate("seq", 300).alias("s")).where(F.length("s") == 300)
    ids = fe.species_vocabulary(tb.sequences(spark, sf), "source")
    emb = pl.embed(fe.token_table(t, "gene_id", "source", "s", k=6, max_len=512, species_ids=ids), ["gene_id"], pl.SineEncoder(8, 3), target_layer=(2,))
    return emb.select("gene_id", F.posexplode("embedding").alias("dim", "value")).select("gene_id", "dim", F.round(F.col("value").cast("double"), 4).alias("value"))


@register("window_embeddings", _TOKEN_SQL.replace("AS lead FROM seqs)", "AS lead FROM seqs QUALIFY length(seq) >= 300)", 1) + """,
padded AS (SELECT gene_id, CAST(gene_id AS BIGINT) % 600 AS p, body || list_transform(range(0, 512 - len(body)), lambda i: 0) AS ids FROM ids),
windows AS (SELECT gene_id, ids[least(511, greatest(0, p - 5)) + 1 : least(511, p) + 1] AS ids FROM padded),
dims AS (SELECT unnest(range(0, 4)) AS dim)
SELECT gene_id, CAST(dim AS INTEGER) AS dim, round(list_avg(list_transform(ids, lambda t: sin((t + 1) * (dim + 1) * 0.01 + 1))), 4) AS value
FROM windows, dims""")
def q_window_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """F33 and M12 with an encoder that each worker makes once: the mean of the six tokens up to a place, clamped to the sequence."""
    t = tb.sequences(spark, sf).select("gene_id", "source", sq.truncate("seq", 300).alias("s")).where(F.length("s") == 300)
    ids = fe.species_vocabulary(tb.sequences(spark, sf), "source")
    toks = fe.token_table(t, "gene_id", "source", "s", k=6, max_len=512, species_ids=ids).withColumn("pos", F.col("gene_id").cast("long") % 600)
    emb = pl.embed(toks, ["gene_id"], pl.Resident(pl.SineEncoder, 4, 2), target_layer=1, window=("pos", 5))
    return emb.select("gene_id", F.posexplode("embedding").alias("dim", "value")).select("gene_id", "dim", F.round(F.col("value").cast("double"), 4).alias("value"))


@register("finite_ratios", """
SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (isfinite(v)) AS n_finite, round(avg(v) FILTER (isfinite(v)), 7) AS mean
FROM (SELECT l_returnflag, CASE WHEN l_discount > 0 THEN CAST(l_tax AS DOUBLE) / CAST(l_discount AS DOUBLE) WHEN l_tax > 0.04 THEN 'inf'::DOUBLE
             WHEN l_tax > 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS v FROM lineitem) GROUP BY l_returnflag""")
def q_finite_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Infinite and NaN ratios become NULL before the aggregates."""
    x, y = F.col("l_tax").cast("double"), F.col("l_discount").cast("double")
    odd = F.when(F.col("l_tax") > 0.04, F.lit(float("inf"))).when(F.col("l_tax") > 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    v = F.when(F.col("l_discount") > 0, F.try_divide(x, y)).otherwise(odd)
    d = tb.read_table(spark, sf, "lineitem").select("l_returnflag", clean_numeric(v).alias("v"))
    return rnd(d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_finite"), F.avg("v").alias("mean")))


@register("downstream_sets", _with(*_SETS2_SQL[:5]) + """
SELECT name AS feature_set, count(*) AS n_genes, count(*) FILTER (is_test) AS n_test
FROM g JOIN zip ON g.gene_id = zip.gene_id, (SELECT unnest(['Downstream: embedding', 'Combined: Downstream: embedding ! Upstream: embedding']) AS name) GROUP BY name""")
def q_downstream_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Feature sets picked by their names, the sets of both ends included."""
    data = feature_set_input(spark, sf, name_filter=F.col("feature_set").contains("Downstream") & ~F.col("feature_set").contains("6-mer"), kmer_sets=False)
    return data.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n_genes"), F.count_if("is_test").alias("n_test"))


@register("fold_spread_two_features", _with(*_MPRA2_SQL) + """
SELECT 'shape' AS model, round(2 * stddev_samp(pr2), 7) AS r2 FROM model""")
def q_fold_spread_two(spark: SparkSession, sf: str) -> DataFrame:
    """A24 over the outer folds' scores."""
    folds, _ = md.group_kfold_ridge(mpra_two_features(spark, sf))
    return rnd(md.bootstrap_spread(folds.select(F.col("model").alias("feature_set"), F.col("r2").alias("pearson_r2"))))


@register("sequence_embeddings")
def q_sequence_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    t = tb.sequences(spark, sf).select("gene_id", "source", sq.truncate("seq", 300).alias("s"))
    t = t.where(F.length("s") == 300)
    toks = fe.token_table(t, "gene_id", "source", "s", k=6, max_len=512)
    enc = pl.ProjectionEncoder(vocab_size=len(sq.kmer_vocabulary(6)), hidden=16, layers=4)
    emb = pl.embed(toks, ["gene_id"], enc, batch_size=50, target_layer=(2,))
    return rnd(emb.select("gene_id", F.size("embedding").alias("dim"),
                          F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")))


# ---------------------------------------------------------------------------
# embedding mapping and match report (C6: J3, J6, J8, J9, F10, U2); A11 + F8
# ---------------------------------------------------------------------------


def _mapping_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Embeddings keyed 'src<label>' in vec_id order, document ids keyed by
    source in doc_id order, and a per-gene Box-Cox TPM table keyed by the
    document's source."""
    emb = tb.read_table(spark, sf, "embeddings").select(
        F.concat(F.lit("src"), F.col("label").cast("string")).alias("species"), F.col("vec_id").alias("row_order"),
        "embedding")
    docs = tb.read_table(spark, sf, "documents").select(
        F.col("source").alias("species"), F.col("doc_id").alias("row_order"),
        F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("gene_id"))
    samples = tb.expression_samples(spark, sf).select("geneId", _boxcox("TPM", 0.22).alias("bc"))
    per_gene = samples.groupBy("geneId").agg(F.median("bc").alias("boxcox_tpm"))
    tpm = (tb.read_table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("geneId"))
           .join(per_gene, "geneId").select(F.col("source").alias("species"), F.col("geneId").alias("gene_id"),
                                            "boxcox_tpm"))
    return emb, docs, tpm


_MAPPING_SQL = _with("""e AS (SELECT 'src' || CAST(label AS VARCHAR) AS species, vec_id,
                 row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)""",
                     """d AS (SELECT source AS species, CAST(doc_id AS VARCHAR) AS gene_id,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)""",
                     tb.EXPRESSION_SQL, """pg AS (SELECT geneId, median(CASE WHEN TPM > 0 THEN (power(TPM, 0.22) - 1) / 0.22 END) AS bc
           FROM samples GROUP BY geneId)""", """t AS (SELECT doc.source AS species, pg.geneId AS gene_id, pg.bc AS boxcox_tpm
          FROM documents doc JOIN pg ON CAST(doc.doc_id AS VARCHAR) = pg.geneId)""",
                     """m AS (SELECT e.species, d.gene_id, e.vec_id, t.boxcox_tpm FROM e LEFT JOIN d ON d.species = e.species AND d.rn = e.rn
          LEFT JOIN t ON d.species = t.species AND d.gene_id = t.gene_id WHERE e.species IN (SELECT species FROM d))""")


@register("embedding_tpm_mapping", _MAPPING_SQL + """
SELECT species, gene_id, CAST(vec_id AS BIGINT) AS vec_id, round(boxcox_tpm, 7) AS boxcox_tpm FROM m""")
def q_embedding_tpm_mapping(spark: SparkSession, sf: str) -> DataFrame:
    emb, docs, tpm = _mapping_inputs(spark, sf)
    emb = emb.withColumn("embedding", F.struct(F.col("row_order").alias("vec_id"), "embedding"))
    mapped = mp.map_embeddings(emb, docs, tpm)
    return rnd(mapped.select("species", "gene_id", F.col("embedding.vec_id").alias("vec_id"), "boxcox_tpm"))


@register("embedding_match_report", _MAPPING_SQL + """
SELECT m.species, count(*) AS n_embeddings, coalesce(max(tt.n), 0) AS n_tpm,
       coalesce(max(cm.c), 0) AS matching
FROM m
LEFT JOIN (SELECT species, count(*) AS n FROM t GROUP BY species) tt ON m.species = tt.species
LEFT JOIN (SELECT species, count(*) AS c FROM (SELECT species, gene_id FROM m INTERSECT SELECT species, gene_id FROM t)
           GROUP BY species) cm ON m.species = cm.species
GROUP BY m.species""")
def q_embedding_match_report(spark: SparkSession, sf: str) -> DataFrame:
    emb, docs, tpm = _mapping_inputs(spark, sf)
    return mp.match_report(mp.map_embeddings(emb, docs, tpm), tpm)


# ---------------------------------------------------------------------------
# names, letters, columns, user aggregate, skip report
# ---------------------------------------------------------------------------


@register("name_functions", """
SELECT c_custkey, 'genus' || c_nationkey || '_sp' || c_custkey AS species, 'Genus' || c_nationkey || '_Sp' || c_custkey AS loose,
       'genus' || c_nationkey || '_sp' || c_custkey AS result_species,
       CASE WHEN c_nationkey % 2 = 0 THEN 'Agnostic' ELSE 'Aware:' || lower(c_mktsegment) || ' ' || c_nationkey END AS label,
       replace(c_name || ' x', ' ', '_') AS safe, CAST(CASE WHEN c_nationkey % 5 > 0 THEN c_custkey END AS INTEGER) AS number
FROM customer""")
def q_name_functions(spark: SparkSession, sf: str) -> DataFrame:
    from sporeframe.functions import clean as cl
    c = tb.read_table(spark, sf, "customer")
    stem = F.concat(F.lit("Genus"), "c_nationkey", F.lit("_Sp"), "c_custkey")
    model = F.when(F.col("c_nationkey") % 2 == 0, F.lit("tok_agnostic x")).otherwise(F.concat(F.lit("tok_"), F.lower("c_mktsegment"), F.lit("_"), "c_nationkey", F.lit("_more")))
    digits = F.concat(F.when(F.col("c_nationkey") % 5 > 0, F.lit("")).otherwise(F.lit("x")), F.lit("\u00a0"), F.col("c_custkey").cast("string"))
    return c.select(
        "c_custkey", cl.species_from_filename(F.concat(F.lit("a/b/"), stem, F.lit("_five_prime.tsv"))).alias("species"),
        cl.species_from_filename(F.concat(stem, F.lit("_x")), lower=False, check=False).alias("loose"),
        cl.species_from_result_file(F.concat(F.lit("r/upstream_r2_"), stem, F.lit(".csv"))).alias("result_species"),
        cl.model_label(F.concat(F.lit("out-lm-"), model, F.lit("-set-v1"))).alias("label"), cl.path_safe(F.concat("c_name", F.lit(" x"))).alias("safe"),
        cl.int_without_nbsp(digits).alias("number"))


@register("sequence_pieces", _with(tb.sequences_sql()) + """
SELECT gene_id, CAST(ceil(length(seq) / 100.0) AS INTEGER) AS n_chunks,
       md5(array_to_string(list_transform(range(0, CAST(ceil(length(seq) / 100.0) AS BIGINT)), lambda j: substr(seq, j * 100 + 1, 100)), '|')) AS chunks,
       md5(array_to_string(list_transform(range(0, length(seq) // 7), lambda j: substr(seq, j * 7 + 1, 7)), '|')) AS kmers
FROM seqs""")
def q_sequence_pieces(spark: SparkSession, sf: str) -> DataFrame:
    s = tb.sequences(spark, sf)
    return s.select("gene_id", F.size(sq.chunks("seq", 100)).alias("n_chunks"), F.md5(F.array_join(sq.chunks("seq", 100), "|")).alias("chunks"),
                    F.md5(F.array_join(sq.kmers("seq", 7, overlap=False), "|")).alias("kmers"))


@register("letter_codes", _with(tb.sequences_sql(), """p AS (SELECT gene_id, seq, unnest(range(0, (length(seq) + 999) // 1000)) AS piece FROM seqs)""",
                                      """c AS (SELECT gene_id, CAST(piece AS INTEGER) AS piece, substr(seq, piece * 1000 + 1, 1000) AS s FROM p)""") + """
SELECT gene_id, piece, array_to_string(list_transform(string_split(s, ''), lambda b: CASE b WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END), '')
         AS hot_slots,
       array_to_string(list_transform(string_split(replace(s, 'N', 'A'), ''), lambda b: instr('ACGT', b) - 1), '') AS classes
FROM c""")
def q_letter_codes(spark: SparkSession, sf: str) -> DataFrame:
    """F22 and F23 over the whole sequence, in pieces of 1,000 letters: the slot that is 1 in each letter's row, and the class of each letter (N read as A)."""
    p = tb.sequences(spark, sf).select("gene_id", F.posexplode(sq.chunks("seq", 1000)).alias("piece", "s"))
    slots = F.transform(sq.one_hot("s", 5, strict=False), lambda row: (F.array_position(row, F.lit(1.0)) - 1).cast("string"))
    classes = F.transform(sq.class_labels(F.translate("s", "N", "A")), lambda x: x.cast("string"))
    return p.select("gene_id", "piece", F.array_join(slots, "").alias("hot_slots"), F.array_join(classes, "").alias("classes"))


@register("matrix_round_trip", """
SELECT 'sp' || label AS species, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_idx, len(embedding) AS width,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total
FROM embeddings""")
def q_matrix_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """One matrix file for each species, written in the shared checkpoint folder, and read back by row ranges."""
    from sporeframe.sources import npy
    folder = f"{ensure_checkpoint_dir(spark)}/matrices-{uuid.uuid4().hex}"
    e = tb.read_table(spark, sf, "embeddings").select(F.concat(F.lit("sp"), "label").alias("species"), "vec_id", "embedding")
    npy.write_npy(e, folder, "species", ["vec_id"], "embedding")
    back = npy.read_npy(spark, folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select(F.regexp_extract("source", "([^/]+)[.]npy$", 1).alias("species"), "row_idx", F.size("embedding").cast("long").alias("width"), F.round(total, 4).alias("total"))


@register("embedding_columns", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 7) AS embed_0, round(CAST(embedding[2] AS DOUBLE), 7) AS embed_1, round(CAST(embedding[3] AS DOUBLE), 7) AS embed_2,
       round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[3] AS DOUBLE), 7) AS back FROM embeddings""")
def q_embedding_columns(spark: SparkSession, sf: str) -> DataFrame:
    """U5 both ways, P3: an array to named columns, some of them, and back to an array."""
    from sporeframe.operators.reshape import array_to_columns, columns_to_array
    e = tb.read_table(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")).alias("v"))
    wide = array_to_columns(e, "v", 3)
    back = columns_to_array(wide.select("vec_id", "embed_0", "embed_2"), name="a").select("vec_id", (F.col("a")[0] + F.col("a")[1]).alias("back"))
    return rnd(wide.join(back, "vec_id").select("vec_id", "embed_0", "embed_1", "embed_2", "back"))


@register("brand_scores", _with(tb.EXPRESSION_SQL) + """
SELECT species, round(power(corr(TPM, line), 2), 7) AS pearson_r2, round(stddev_samp(TPM) / avg(TPM), 7) AS user_rsd
FROM samples GROUP BY species""")
def q_brand_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A16 as a metric expression over all samples, X1 as Python reducers over
    a brand's samples of 4,096 order keys (bounded by an order's seven lines),
    whose counts, means and squared deviations are merged per brand."""
    from sporeframe.functions.metrics import pearson_r2, user_aggregate
    s = tb.expression_samples(spark, sf).withColumn("line", F.col("line").cast("double"))
    count, mean = user_aggregate(lambda x: float(len(x))), user_aggregate(lambda x: float(x.mean()))
    spread = user_aggregate(lambda x: float(((x - x.mean()) ** 2).sum()))
    parts = s.groupBy("species", F.floor(F.col("sample_id") / 4096).alias("part")).agg(count("TPM").alias("n"), mean("TPM").alias("m"), spread("TPM").alias("d"))
    # squared deviations from the brand's mean: those inside the parts and those of the parts' means
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("m"))
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - total * total / n
    merged = parts.groupBy("species").agg((F.sqrt(F.try_divide(F.sum("d") + between, n - 1)) / (total / n)).alias("user_rsd"))
    stats = s.groupBy("species").agg(pearson_r2("TPM", "line").alias("pearson_r2"))
    return rnd(stats.join(merged, "species"))


#: the customer segments that a user asks for; the last has no customer
WANTED_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE")


@register("skipped_species", f"""
SELECT 'NATION_' || n_nationkey || ' ' || segment AS species, CASE WHEN max(c_custkey) IS NULL THEN 'no data' ELSE 'no c_acctbal' END AS reason
FROM (SELECT n_nationkey, unnest({list(WANTED_SEGMENTS)}) AS segment FROM nation)
LEFT JOIN customer ON n_nationkey = c_nationkey AND segment = c_mktsegment
GROUP BY n_nationkey, segment HAVING count(CASE WHEN c_acctbal > 9900 THEN 1 END) = 0""")
def q_skipped_species(spark: SparkSession, sf: str) -> DataFrame:
    """S10 over all customers: wanted pairs of nation and segment without customers, or without one whose balance counts."""
    c = tb.read_table(spark, sf, "customer")
    segment = F.explode(F.array(*map(F.lit, WANTED_SEGMENTS))).alias("segment")
    wanted = tb.read_table(spark, sf, "nation").select("n_nationkey", segment).select(F.concat(F.lit("NATION_"), "n_nationkey", F.lit(" "), "segment").alias("species"))
    data = c.select(F.concat(F.lit("NATION_"), "c_nationkey", F.lit(" "), "c_mktsegment").alias("species"), F.when(F.col("c_acctbal") > 9900, F.col("c_acctbal")).alias("c_acctbal"))
    return fl.skipped_report(wanted, data, "species", "c_acctbal")


@register("model_dataset_map", """
SELECT dataset, array_to_string(list_sort(list(DISTINCT folder)), ',') AS folders, count(DISTINCT folder) AS n_models
FROM (SELECT 'out-lm-tok_' || lang || '-' || source || '-v1' AS folder, source AS dataset FROM documents)
GROUP BY dataset""")
def q_model_dataset_map(spark: SparkSession, sf: str) -> DataFrame:
    """F8 + A11: output folders named ``a-b-<model>-<dataset>-e`` grouped into
    a sorted folder list per dataset (a dataset has few models)."""
    from sporeframe.functions.clean import five_part_name
    docs = tb.read_table(spark, sf, "documents")
    folders = docs.select(F.concat(F.lit("out-lm-tok_"), "lang", F.lit("-"), "source", F.lit("-v1")).alias("folder"))
    parsed = folders.distinct().select("folder", five_part_name("folder").alias("p")).where(F.col("p").isNotNull())
    lists = ag.group_to_list(parsed.select(F.col("p.dataset").alias("dataset"), "folder"), "dataset", "folder", "folders")
    return lists.select("dataset", F.array_join("folders", ",").alias("folders"), F.size("folders").cast("long").alias("n_models"))
