"""Incremental expression ETL on a file stream.

The reference has no streaming operator (all inputs are finite files read
whole).  Its cleaning steps are stateless column expressions, so the same
plan runs unchanged on ``readStream``: new TSV files dropped into the
taxon folders are cleaned (P4, P5), mapped to species names through a
stream-static join (J4) and appended to one Parquet table - the combined
table of the reference (unmapped rows keep taxon '', which a partition
folder could not hold); per-species files are the batch writer's job
(S12).  Progress lives in a checkpoint folder, so a restarted query
resumes without reprocessing or losing files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sporeframe.plans.expression import etl

RAW_SCHEMA = "geneId string, TPM string"


def read_expression_stream(spark: SparkSession, base: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """``<base>/<taxon>/*.tsv`` as a stream of ``(geneId, TPM text, taxon)``.

    A stream has one fixed layout: a file whose header line differs from
    ``geneId, TPM`` fails the query instead of being read by position."""
    df = (spark.readStream.schema(RAW_SCHEMA).option("header", True).option("sep", "\t").option("enforceSchema", False)
          .option("maxFilesPerTrigger", max_files_per_trigger).csv(f"{base.rstrip('/')}/*/"))
    taxon = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    return df.select("geneId", "TPM", taxon.alias("taxon")).where(F.col("taxon").rlike("^[0-9]+$"))


def start_expression_etl(spark: SparkSession, base: str, taxon_map: DataFrame, out: str, checkpoint: str,
                         trigger_seconds: int | None = None, available_now: bool = False) -> StreamingQuery:
    """Start the stream: cleaned rows appended to the Parquet table ``out``.

    ``checkpoint`` must be a reliable shared folder (one per query).
    """
    cleaned = etl(read_expression_stream(spark, base), taxon_map)
    w = (cleaned.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
