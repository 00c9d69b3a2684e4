"""Session settings and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A cached plan keeps its partitioning, so readers by the same key need no shuffle.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false",
    # Plans here are made of many small Column calls; recording a call site for each is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Raw HTML rows are large, so Arrow batches are bounded by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def build_session(app_name: str, master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; ``extra`` entries use ``_`` for ``.``-free keys."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: what ``spark.checkpoint.dir`` names.

    Only a session that runs on one machine may leave it unset; it then gets a fresh
    temporary folder. On a cluster each executor would write to a disk of its own, so an
    unset folder is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="beaconry-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def persist_clustered(df: DataFrame) -> DataFrame:
    """Cache ``df``. Sessions of :func:`build_session` keep its hash clustering, so later
    steps by that key need no shuffle; the caller unpersists it."""
    return df.persist()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
