"""Session helper and run-time settings.

The settings here are the ones every job of this package relies on: UTC
session time, adaptive query execution (runtime join selection, partition
coalescing and skew-join splitting) and a checkpoint directory that lives on
shared storage.  On a cluster ``spark.checkpoint.dir`` is set by the
deployment; only when it is unset (local tests) a scratch folder is made.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings shared by every session made here.  AQE replans joins from the
# measured size of each shuffle stage, so a dictionary-like side is broadcast
# only when its real size is below the threshold; skewJoin splits a hot key
# (one community may own a third of all posts) over several tasks.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "communitylens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a scratch one only when
    the cluster did not name one (local runs and tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    try:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # not readable through the runtime conf on this session
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        # local runs and tests only: a cluster names a folder that all its machines share
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="communitylens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # a core conf may be read-only at run time
            pass
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
