"""Spark session and checkpoint-folder helpers.

The library never builds its own cluster settings: on a cluster the caller's
session is used as-is.  `local_session` exists for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "sporeframe") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPOREFRAME_DRIVER_MEMORY", "16g"))
        # remove checkpoint files once their DataFrames are garbage-collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sporeframe`` importable in the Python workers of this
    application, as ``--py-files`` would: a zip of the package is added once
    with ``addPyFile`` (Spark distributes the driver's copy to every
    executor), so UDF and ``mapInPandas`` code is pickled by reference.
    Skipped when the package is already importable from an installed copy
    that the caller manages (set ``SPOREFRAME_SHIP=0``)."""
    if os.environ.get("SPOREFRAME_SHIP", "1") == "0":
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="sporeframe-pyfiles-")
    archive = shutil.make_archive(os.path.join(out_dir, "sporeframe"), "zip", os.path.dirname(pkg_dir), "sporeframe")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only in local mode.

    On a cluster the folder must be the shared one named by
    ``spark.checkpoint.dir``; a machine-local temporary folder would not
    survive the loss of an executor, so we refuse to invent one there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/...) before running "
            "operators that cut lineage"
        )
    local_dir = tempfile.mkdtemp(prefix="sporeframe-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise `df` to the shared checkpoint folder and cut its lineage.

    Used where a later step must see exactly the same rows twice (ids that
    depend on physical order).  Never `localCheckpoint`: executor-local
    blocks are lost with the executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
