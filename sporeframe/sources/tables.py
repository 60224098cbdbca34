"""Driver tables and the stand-ins built from them (see FIXTURES.md §2).

Every stand-in is a lazy DataFrame derived from the given parquet tables, so
its size grows with the scale factor.  Each has a twin SQL text (``*_SQL``)
that DuckDB runs for the oracle; the two must stay in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


# Key of each large table, used to spread an under-split scan (see read_table).
SPREAD_KEYS = {"lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",), "documents": ("doc_id",),
               "pages": ("page_id",), "events": ("event_id",), "conversations": ("conv_id", "turn")}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the parquet scan.

    A file smaller than one split (here: one Parquet row group per table)
    scans in ONE task, so everything up to the first shuffle would run on
    one core.  When a large table's scan has fewer partitions than the
    session's parallelism, it is spread by a hash of its key (deterministic,
    so retries see the same rows).  On a cluster reading many files the scan
    already has enough splits and nothing is added.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    keys = SPREAD_KEYS.get(name)
    if keys:
        want = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < want:
            df = df.repartition(want, *[F.col(k) for k in keys])
    return df


# ---------------------------------------------------------------------------
# expression samples: lineitem x part
# ---------------------------------------------------------------------------

def expression_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long expression table ``(species, geneId, sample_id, line, TPM)``.

    species = part brand, gene = part key, one sample per order line,
    TPM = extended price / 10000.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("species"),
        F.col("l_partkey").cast("string").alias("geneId"),
        F.col("l_orderkey").alias("sample_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_extendedprice") / F.lit(10000.0)).alias("TPM"),
    )


EXPRESSION_SQL = """samples AS (
  SELECT p.p_brand AS species, CAST(l.l_partkey AS VARCHAR) AS geneId, l.l_orderkey AS sample_id,
         l.l_linenumber AS line, l.l_extendedprice / 10000.0 AS TPM
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""


def distribution_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(species_name, geneId, TPM)`` with species = '<supplier nation> <brand>'
    so that the first word (genus) groups many species."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(sup, li.l_suppkey == sup.s_suppkey)
        .join(nation, sup.s_nationkey == nation.n_nationkey)
        .select(
            F.concat_ws(" ", "n_name", "p_brand").alias("species_name"),
            F.col("l_partkey").cast("string").alias("geneId"),
            (F.col("l_extendedprice") / F.lit(10000.0)).alias("TPM"),
        )
    )


DISTRIBUTION_SQL = """dist AS (
  SELECT concat_ws(' ', n.n_name, p.p_brand) AS species_name, CAST(l.l_partkey AS VARCHAR) AS geneId,
         l.l_extendedprice / 10000.0 AS TPM
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)"""


def raw_expression_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression rows as read from text: TPM is a STRING that may be junk.

    ``taxon`` is the supplier's nation key as text (a folder name in the
    reference), so the lookup to a species name goes through ``nation``.
    Line 7 carries 'NA' and line 6 an empty string, as untidy files do.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"
    )
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    raw_tpm = (
        F.when(F.col("l_linenumber") == 7, F.lit("NA"))
        .when(F.col("l_linenumber") == 6, F.lit(""))
        .otherwise(F.col("l_extendedprice").cast("string"))
    )
    return li.join(sup, li.l_suppkey == sup.s_suppkey).select(
        F.col("l_partkey").cast("string").alias("geneId"),
        raw_tpm.alias("TPM"),
        F.col("s_nationkey").cast("string").alias("taxon"),
    )


RAW_EXPRESSION_SQL = """raw AS (
  SELECT CAST(l.l_partkey AS VARCHAR) AS geneId,
         CASE WHEN l.l_linenumber = 7 THEN 'NA' WHEN l.l_linenumber = 6 THEN ''
              ELSE CAST(l.l_extendedprice AS VARCHAR) END AS TPM,
         CAST(s.s_nationkey AS VARCHAR) AS taxon
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""


def taxon_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(Taxon_ID, Species_name)`` lookup from ``nation``."""
    return read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("Taxon_ID"), F.col("n_name").alias("Species_name")
    )


TAXON_MAP_SQL = """taxmap AS (SELECT CAST(n_nationkey AS VARCHAR) AS Taxon_ID, n_name AS Species_name FROM nation)"""


def experiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(Species_name, Experiment_number)``: one row per order, species = customer name
    with the nation as genus word ('NATION_3 Customer#...'), experiments = order line count."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("nlines"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(li, orders.o_orderkey == li.l_orderkey)
        .join(cust, orders.o_custkey == cust.c_custkey)
        .join(nation, cust.c_nationkey == nation.n_nationkey)
        .select(
            F.concat_ws(" ", "n_name", "c_name").alias("Species_name"),
            F.col("nlines").cast("int").alias("Experiment_number"),
        )
    )


EXPERIMENT_COUNTS_SQL = """expcounts AS (
  SELECT concat_ws(' ', n.n_name, c.c_name) AS Species_name, CAST(li.nlines AS INTEGER) AS Experiment_number
  FROM orders o
  JOIN (SELECT l_orderkey, count(*) AS nlines FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey)"""


# ---------------------------------------------------------------------------
# DNA sequences from documents
# ---------------------------------------------------------------------------

def dna_from_text(text: Column | str) -> Column:
    """Letters of the whole text, lower case, mapped onto ACGT (z gives N)."""
    letters = F.lower(F.regexp_replace(F.col(text) if isinstance(text, str) else text, "[^A-Za-z]", ""))
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAN")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(gene_id, source, seq)`` over A,C,G,T,N from ``documents``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select(
        F.col("doc_id").cast("string").alias("gene_id"),
        F.col("source"),
        dna_from_text("text").alias("seq"),
    )


def sequences_sql() -> str:
    return """seqs AS (
  SELECT CAST(doc_id AS VARCHAR) AS gene_id, source,
         translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')),
                   'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAN') AS seq
  FROM documents)"""


# ---------------------------------------------------------------------------
# embeddings as ridge input
# ---------------------------------------------------------------------------

def ridge_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(end, species, gene_id, features ARRAY<DOUBLE>, y)`` for per-species ridge.

    species = label, target = label + 20 * embedding[0]; the 'upstream' end
    sees the first half of the vector (which holds the signal), 'downstream'
    the second half.
    """
    emb = read_table(spark, sf_dir, "embeddings")
    vec = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    half = F.size("embedding") / 2
    base = emb.select(
        F.concat(F.lit("sp"), F.col("label").cast("string")).alias("species"),
        F.col("vec_id").cast("string").alias("gene_id"),
        vec.alias("vec"),
        half.cast("int").alias("half"),
        (F.col("label") + F.lit(20.0) * F.col("embedding")[0].cast("double")).alias("y"),
    )
    up = base.select(F.lit("upstream").alias("end"), "species", "gene_id",
                     F.slice("vec", F.lit(1), F.col("half")).alias("features"), "y")
    down = base.select(F.lit("downstream").alias("end"), "species", "gene_id",
                       F.slice("vec", F.col("half") + 1, F.col("half")).alias("features"), "y")
    return up.unionByName(down)


# ---------------------------------------------------------------------------
# GTF text built from lineitem
# ---------------------------------------------------------------------------

def gtf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GTF text line per order line (9 tab-separated fields, quoted attributes)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )
    attrs = F.concat(
        F.lit('gene_id "G'), F.col("l_partkey").cast("string"),
        F.lit('"; ref_gene_id "gene-SPOM_'), F.col("l_partkey").cast("string"),
        F.lit('"; TPM "'), F.col("l_quantity").cast("string"), F.lit('";'),
    )
    line = F.concat_ws(
        "\t",
        F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")),
        F.lit("pipeline"),
        F.lit("transcript"),
        F.col("l_orderkey").cast("string"),
        (F.col("l_orderkey") + F.col("l_linenumber")).cast("string"),
        F.lit("."),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("+")).otherwise(F.lit("-")),
        F.lit("."),
        attrs,
    )
    return li.select(F.col("l_linenumber").alias("replicate"), line.alias("value"))
