"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; where it is unset, only a session in one process gets a folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)


def cut(frame: DataFrame) -> DataFrame:
    """``frame``, computed once and kept in the checkpoint folder."""
    prepare(frame.sparkSession)
    return frame.checkpoint()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame``, computed once and kept as Parquet in the checkpoint folder."""
    spark = frame.sparkSession
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def removed(frame: DataFrame) -> None:
    """Removes the files of a ``stored`` frame that nothing reads any more."""
    spark = frame.sparkSession
    name = frame.inputFiles()
    if name:
        path = spark._jvm.org.apache.hadoop.fs.Path(name[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
