"""SparkSession helpers.

The library never hard-codes cluster sizing: ``get_session`` only fills in
settings that the caller (spark-submit, a notebook, a cluster policy) left
unset, so the same code runs on ``local[8]`` in tests and on a large cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults applied only when the key is not already configured.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "revlens") -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_defaults(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if master and master.startswith("local["):
        # one JVM is driver and executors at once, and its default heap is 1 GB
        builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> None:
    """Pin the session time zone (timestamps must agree with the oracle) and
    make sure a checkpoint directory exists for lineage cuts."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared directory named by ``spark.checkpoint.dir``.

    On a cluster this must be a shared file system (HDFS, object store) and is
    provided by the deployment: off a local master an unset folder is an error.
    Only a local master (unit tests, a laptop) gets a scratch folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    jsc_dir = spark.sparkContext.getCheckpointDir()
    if jsc_dir:
        return jsc_dir
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="revlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured
