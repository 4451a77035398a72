"""Session defaults and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = 8, name: str = "wardlight", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark.

    On a cluster the session comes from spark-submit; nothing in the library
    depends on this function.
    """
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.log.level": "ERROR",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder path for files a job hands to a later job.

    The root is ``spark.checkpoint.dir``, which a cluster points at shared
    storage that outlives any executor; where it is unset, the warehouse,
    which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
