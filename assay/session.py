"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Call sites of expressions cost a round trip to the JVM each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Batches with payloads are cut by size, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def build_session(master: str | None = None, app: str = "assay", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only on a local master.

    Executors of a cluster can not see a folder of the driver's machine, so outside
    local mode the folder has to come from ``spark.checkpoint.dir``.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="assay-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one, for tables one run writes and reads back."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
