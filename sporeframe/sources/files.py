"""File sources and sinks (S1-S14) as single distributed reads / writes.

One ``spark.read`` over a glob replaces the reference's per-file loops; the
file a row came from is ``_metadata.file_path`` / ``_metadata.file_name``.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sporeframe.functions.clean import lenient_double

# ---------------------------------------------------------------------------
# delimited text
# ---------------------------------------------------------------------------


def read_delimited(spark: SparkSession, path: str | Sequence[str], sep: str = ",", schema: str | T.StructType | None = None,
                   encoding: str = "UTF-8", glob_filter: str | None = None, recursive: bool = False,
                   source: str | None = None) -> DataFrame:
    """Header CSV / TSV, all columns STRING unless a schema is given.

    Columns go by each file's own header line, whatever their order: files are
    grouped by header, each layout is read with its own schema, and the
    layouts are united by name (a column that a file lacks is NULL there).
    With a schema its columns are returned, cast leniently.
    ``encoding="ISO-8859-1"`` reads legacy files (S4); ``glob_filter``
    picks files by name (S8, e.g. ``"upstream*"``); ``source`` names a column
    for each row's file path (S9).
    """
    def reader():
        r = spark.read.option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE")
        if isinstance(path, str) and not recursive and not re.search(r"[*?\[{]", path) and not path.endswith((".csv", ".tsv", ".txt")):
            r = r.option("basePath", path)  # a folder's partition columns stay
        if glob_filter:
            r = r.option("pathGlobFilter", glob_filter)
        return r.option("recursiveFileLookup", True) if recursive else r

    # the first line of every file, read as one column; only (header, file names) reach the driver
    lines = reader().option("sep", "\u0001").option("quote", "").schema("line string").csv(path)
    lines = lines.select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").withColumn("id", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("line", "id").alias("line"))
    layouts = first.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("line").collect()
    parts = []
    for layout in layouts:
        names = next(csv.reader([layout["line"] or ""], delimiter=sep))
        kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = reader().option("header", True).schema(kind).csv([unquote(f) for f in layout["files"]])
        parts.append(part.withColumn(source, F.col("_metadata.file_path")) if source else part)
    if not parts:
        empty = schema if schema is not None else T.StructType()
        return spark.createDataFrame([], empty)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        have = set(out.columns)
        cols = [F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in wanted.fields]
        out = out.select(*[c.alias(f.name) for c, f in zip(cols, wanted.fields)], *([source] if source else []))
    return out


def with_source(df: DataFrame, name: str = "source_file", full_path: bool = False) -> DataFrame:
    """Tag rows of a plain file read with the file they came from (S9, S14 ``assign(name, df)``); a
    ``read_delimited`` over several layouts takes ``source=`` instead."""
    field = "_metadata.file_path" if full_path else "_metadata.file_name"
    return df.withColumn(name, F.col(field))


def file_stem(col: Column | str, suffix_pattern: str = r"\.[^.]*$") -> Column:
    """File name without its extension (``file_path_sans_ext``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), suffix_pattern, "")


def read_taxon_folders(spark: SparkSession, base: str, columns: Sequence[str] = ("geneId", "TPM")) -> DataFrame:
    """Every ``<base>/<taxon>/*.tsv`` with an all-digit folder name, all
    strings, the wanted columns plus ``taxon`` from the folder name."""
    df = read_delimited(spark, f"{base.rstrip('/')}/*/*.tsv", sep="\t", source="_file")
    taxon = F.regexp_extract(F.col("_file"), r"/([^/]+)/[^/]+$", 1)
    return df.select(*columns, taxon.alias("taxon")).where(F.col("taxon").rlike("^[0-9]+$"))


def read_parquet_tree(spark: SparkSession, base: str, name_glob: str) -> DataFrame:
    """Parquet files anywhere below ``base`` whose name matches
    ``name_glob`` (e.g. ``"*five_prime.parquet"``).  Partition discovery is
    off with recursive lookup, so species comes from the file name."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).option("mergeSchema", True).parquet(base)
        .withColumn("source_file", F.col("_metadata.file_name"))
    )


def normalise_gene_key(df: DataFrame) -> DataFrame:
    """Quirk Q4: some sequence files call the key ``geneId``; use ``gene_id``
    (row by row where the files of one read differ)."""
    if "geneId" not in df.columns:
        return df
    if "gene_id" not in df.columns:
        return df.withColumnRenamed("geneId", "gene_id")
    return df.withColumn("gene_id", F.coalesce("gene_id", "geneId")).drop("geneId")


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite",
                    partition_by: Sequence[str] = ()) -> None:
    """Header text output; ``partition_by=("species",)`` writes
    one folder per species, and a species with no rows writes nothing."""
    w = df.write.mode(mode).option("header", True).option("sep", sep)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_text(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """One string column as plain text lines (e.g. a Newick tree)."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def skipped_report(wanted: DataFrame, data: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have no file or no non-null ``value``, with the reason."""
    have = data.groupBy(key).agg(F.count(value).alias("_n"), F.lit(True).alias("_seen"))
    j = wanted.select(key).distinct().join(have, key, "left")
    reason = (F.when(F.col("_seen").isNull(), F.lit("no data"))
              .when(F.col("_n") == 0, F.lit(f"no {value}")))
    return j.select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


# ---------------------------------------------------------------------------
# GTF
# ---------------------------------------------------------------------------

GTF_FIELDS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")


def gtf_attribute(attrs: Column | str, key: str) -> Column:
    """Value of one ``key "value";`` attribute; NULL when absent.  Quoted
    values may hold ``;`` (which ``str_to_map`` would split on)."""
    a = F.col(attrs) if isinstance(attrs, str) else attrs
    # \b: 'gene_id' must not match inside 'ref_gene_id' ('_' is a word character)
    return F.nullif(F.regexp_extract(a, rf'\b{key} "([^"]*)"', 1), F.lit(""))


def parse_gtf(lines: DataFrame, column: str = "value", attributes: Sequence[str] = ("gene_id", "ref_gene_id", "TPM"),
              keep: Sequence[str] = ()) -> DataFrame:
    """GTF text lines to the 8 fixed columns plus the named attributes.

    Comment lines (``#``) are dropped; '.' in score / frame is NULL; the
    ``TPM`` attribute is parsed leniently to DOUBLE.
    """
    # split once into its own projection; Catalyst will not copy a non-cheap
    # expression into each of the nine field references
    split = lines.where(~F.col(column).startswith("#")).select(*keep, F.split(F.col(column), "\t").alias("_f"))
    body = split.where(F.size("_f") >= 9).select(
        *keep, *[F.col("_f").getItem(i).alias(n) for i, n in enumerate(GTF_FIELDS)]
    )
    dot_null = lambda c: F.when(F.col(c) != ".", F.col(c))
    out = body.select(
        *keep, "seqname", "source", "feature",
        F.col("start").try_cast("bigint").alias("start"), F.col("end").try_cast("bigint").alias("end"),
        lenient_double(dot_null("score")).alias("score"), dot_null("strand").alias("strand"),
        dot_null("frame").try_cast("int").alias("frame"),
        *[(lenient_double(gtf_attribute("attributes", a)) if a == "TPM" else gtf_attribute("attributes", a)).alias(a)
          for a in attributes],
    )
    return out


def read_gtf(spark: SparkSession, path: str | Sequence[str], attributes: Sequence[str] = ("gene_id", "ref_gene_id", "TPM"),
             run_id: bool = True) -> DataFrame:
    """S6 + S14: GTF files, one ``run_id`` (file stem) per file."""
    lines = spark.read.text(path)
    if run_id:
        lines = lines.withColumn("run_id", file_stem(F.col("_metadata.file_name")))
    return parse_gtf(lines, attributes=attributes, keep=("run_id",) if run_id else ())
