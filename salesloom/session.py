"""Spark session defaults for the engine."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app_name: str = "salesloom", master: str | None = None,
                  **conf: str) -> SparkSession:
    """Session with adaptive execution and a fixed (UTC) session time zone.

    ``conf`` entries use ``__`` for dots: ``spark__sql__shuffle__partitions="8"``.
    Without ``master`` the value given to ``spark-submit`` applies.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # A report is many small generated classes; keep them for the next one.
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        # Call-site capture costs several driver round trips per Column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; unset, only a session in one process gets one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if shared is None and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or tempfile.mkdtemp(prefix="salesloom-checkpoint-")
