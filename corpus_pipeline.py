"""From raw documents to packed training sequences, in five stages over the llm operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.

Defined cases of all stages: a null text counts as empty; null ids and repeated rows are
rows like any other; an empty table stays empty; other columns pass as they are, also if
their names are an operator's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sporeframe.llm import quality
from sporeframe.llm.common import materialise, table
from sporeframe.llm.decontaminate import drop_contaminated
from sporeframe.llm.lines import dedup_lines
from sporeframe.llm.packing import pack_documents
from sporeframe.llm.queries import word_tokenizer
from sporeframe.llm.simhash import keep_one
from sporeframe.session import ensure_checkpoint_dir, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _on_cluster(stage: Stage) -> Stage:
    """Workers can import the package, and the checkpoint folder is set, before the stage starts."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fitted without held-out labels) gives 0.5 or more.

    A text without words gets label 1's share among the labelled rows, so it stays if that is at least a half; equal
    texts share their fate; an id with several labels has the larger one; without any label all documents stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.score(docs, model, score_col="_quality").where(F.col("_quality") >= 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in one document only; ``n_chars`` (if there) follows the text.

    No document goes: one that loses all its lines has an empty text.  Lines stay in all rows of the largest id that
    holds them (null is the smallest); a null text becomes empty.
    """
    kept = dedup_lines(docs.select("*"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id, null being the largest; of equal rows one.

    Texts without words have fingerprint zero and are near copies of each other.
    """
    return keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Texts without words, and all texts if the benchmark has no words, stay; each row is judged by itself.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null or empty text is its end token alone; equal rows are packed one by one.
    """
    pieces = pack_documents(docs, word_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    (name, _on_cluster(stage))
    for name, stage in (
        ("quality", keep_quality),
        ("line_dedup", drop_lines),
        ("near_dedup", drop_near_copies),
        ("decontamination", drop_benchmark),
        ("packing", pack),
    )
]

#: Models and tokenizers have no SQL form; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
