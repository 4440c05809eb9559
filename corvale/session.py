"""Spark sessions with the settings that the operators expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(name: str = "corvale", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and map keys that overwrite; ``conf`` takes precedence (``__`` for dots)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. In local mode a temporary one does where the session names none."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corvale-shared-")
        context.setCheckpointDir(named)
    return named.rstrip("/")
