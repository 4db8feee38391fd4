"""Session helper and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on. None of them fixes a degree of parallelism:
#: that belongs to the cluster, and AQE sizes the shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot keys also where an aggregate above would have liked the join's partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # batches for Python workers are bounded by bytes too: texts may be long
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20),
    # model responses may repeat a key; the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(name: str = "caseloom", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session carrying :data:`SETTINGS` plus ``extra``."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor sees, as named by ``spark.checkpoint.dir``.

    Only where the session names none, and the master is this very machine, is
    a temporary folder set up instead; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR"))
    spark.conf.set("spark.checkpoint.dir", folder)
    context.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame, label: str) -> DataFrame:
    """The same rows, computed once and read back from the shared folder.

    For small results of expensive plans that several joins use: the plan runs once,
    and a lost executor costs a read, not the plan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
