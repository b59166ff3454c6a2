"""Session construction and the shared checkpoint folder.

On a cluster the session comes from the platform and already names a shared
``spark.checkpoint.dir``; we only read it. Tests and the local bench build their
own session and get a fresh scratch folder when the setting is absent.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every podium job relies on. AQE re-plans joins from measured shuffle
# sizes (broadcast only what is measured small, split skewed partitions).
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "podium") -> SparkSession:
    """Local session for tests and the bench (``local[N]``)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="podium-warehouse-"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    )
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when unset.

    The cluster setting wins; a machine-local folder is only used when the
    session has none and the master is local (tests): on a cluster each machine has its own
    disk, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        current = tempfile.mkdtemp(prefix="podium-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current
