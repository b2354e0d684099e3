"""Session settings for local runs; on a cluster the submitted session is used as it is."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "alphaloom", cpus: int | None = None) -> SparkSession:
    """Session for tests and the bench: one JVM, AQE on, UTC, no UI port."""
    cores = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("ALPHALOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``, or a folder beside the warehouse's tables where that is unset.

    On several machines that folder has to be in a store they share: a warehouse on a local disk is refused there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
        if not spark.sparkContext.master.startswith("local") and re.match(r"file:|(?!\w+:)", folder):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share; {folder} is local to each")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
