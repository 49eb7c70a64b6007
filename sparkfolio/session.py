"""Session factory used by the tests, the bench and stand-alone scripts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "sparkfolio", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session.  On a cluster pass no master: spark-submit supplies it.

    Only settings that the operators rely on are named here; sizes stay with AQE,
    which coalesces small shuffle partitions and splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call-site capture costs about a millisecond per column expression on the driver.
        "spark.sql.dataFrameQueryContext.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str | None:
    """Shared folder the cluster names for cutting lineage; None when it names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


def work_dir(spark: SparkSession) -> str:
    """A new folder for written tables: under the cluster's shared folder, or, with a
    local master and no shared folder, a temporary folder of this machine."""
    shared = checkpoint_dir(spark)
    if shared is not None:
        return f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="sparkfolio-")
