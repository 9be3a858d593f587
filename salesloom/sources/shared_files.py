"""Small files and folders on the storage that Spark reads, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system = _system(spark, folder)
    if not system.exists(_path(spark, folder)):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(_path(spark, folder)))


def read_text(spark: SparkSession, path: str) -> str:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str, draft: str) -> bool:
    """Write ``path`` as a whole, by way of the file ``draft``; false if it is there already."""
    jvm = spark.sparkContext._jvm
    stream = _system(spark, draft).create(_path(spark, draft), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _path(spark, path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(
        getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    if files.util().exists(_path(spark, path)):
        remove(spark, draft)
        return False
    try:
        files.rename(_path(spark, draft), _path(spark, path), no_options)
    except Exception:
        remove(spark, draft)
        if files.util().exists(_path(spark, path)):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file, or a folder with all that is in it."""
    _system(spark, path).delete(_path(spark, path), True)
