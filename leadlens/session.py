"""Session helper: the few settings the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
_OWN: dict[str, str] = {}  # temporary folders of local applications


def build_session(app: str = "leadlens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time, AQE and Arrow.  ``master`` is only set for local runs; on a cluster it comes
    from spark-submit, like memory and partition sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``.  Where it is unset a local master may use
    a temporary folder; a cluster must name one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = tempfile.mkdtemp(prefix="leadlens-")
    return _OWN[application]


def checkpointed(df, spark: SparkSession | None = None):
    """Cut lineage through the shared folder (reliable checkpoint; survives lost executors).  Spark removes the files when
    the frame is garbage."""
    spark = spark or df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(shared_dir(spark), "checkpoints"))
    return df.checkpoint(eager=True)
