"""Index tables on shared storage, addressed by (path, collection).

Rows are kept in hash buckets of their id, each a folder of Parquet files that never changes. A
version is a list of one folder per bucket, with rows and last position of each:

    <path>/<collection>/data/<write>/bucket=<n>/part-*.parquet
    <path>/<collection>/versions/v000001.json

A write reads and rewrites the buckets of its ids only; all others are carried over by name. Its
version is published by a rename that fails if another writer was first, in which case the merge
is done again on top of that one. Readers take the newest version. A running reader is not
disturbed while its version is among the ``keep`` newest, a failed write leaves no version, and a
rebuild never leaves rows of an earlier build behind.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.index import upsert
from . import shared_files

BUCKETS, KEEP, ATTEMPTS = 64, 3, 5


@dataclass(frozen=True)
class Version:
    """What a version lists. ``folders`` are bucket -> (folder below the root, rows, last position)."""

    number: int
    buckets: int
    schema: T.StructType
    folders: dict[int, tuple[str, int, int]]

    @property
    def end(self) -> int:
        """The last position of the whole index, -1 if it is empty."""
        return max((last for _, _, last in self.folders.values()), default=-1)

    @property
    def rows(self) -> int:
        return sum(rows for _, rows, _ in self.folders.values())

    def text(self) -> str:
        return json.dumps({"buckets": self.buckets, "schema": self.schema.jsonValue(),
                           "folders": {str(b): list(f) for b, f in sorted(self.folders.items())}})


def _root(path: str, collection: str) -> str:
    return f"{path.rstrip('/')}/{collection}"


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Published versions in ascending order."""
    found = (re.fullmatch(r"v(\d+)\.json", n) for n in shared_files.names(spark, f"{root}/versions"))
    return sorted(int(m[1]) for m in found if m)


def _load(spark: SparkSession, root: str, number: int) -> Version:
    listed = json.loads(shared_files.read_text(spark, f"{root}/versions/v{number:06d}.json"))
    return Version(number, listed["buckets"], T.StructType.fromJson(listed["schema"]),
                   {int(b): tuple(f) for b, f in listed["folders"].items()})


def newest_version(spark: SparkSession, path: str, collection: str) -> Version | None:
    root = _root(path, collection)
    numbers = _numbers(spark, root)
    return _load(spark, root, numbers[-1]) if numbers else None


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, version: Version, only: set[int] | None = None) -> DataFrame:
    folders = [f"{root}/{folder}" for bucket, (folder, _, _) in sorted(version.folders.items())
               if only is None or bucket in only]
    if not folders:
        return spark.createDataFrame([], version.schema)
    return spark.read.schema(version.schema).parquet(*folders)


def read_index(spark: SparkSession, path: str, collection: str) -> DataFrame | None:
    """The newest index, or ``None`` when there is none yet."""
    version = newest_version(spark, path, collection)
    return _read(spark, _root(path, collection), version) if version else None


def read_ids(spark: SparkSession, path: str, collection: str, ids: list[str]) -> DataFrame | None:
    """Rows of a few ids; only their buckets are read."""
    version = newest_version(spark, path, collection)
    if version is None:
        return None
    asked = spark.createDataFrame([(i,) for i in ids], "id string")
    wanted = {r[0] for r in asked.select(bucket_of(F.col("id"), version.buckets)).distinct().collect()}
    return _read(spark, _root(path, collection), version, wanted).where(F.col("id").isin(ids))


def write_index(rows: DataFrame, path: str, collection: str, rebuild: bool = False,
                buckets: int = BUCKETS, keep: int = KEEP) -> Version:
    """Merge ``rows`` into the index, or replace it with them.

    Known ids keep their place, new ones come behind everything there is. ``buckets`` holds for
    a new or rebuilt index; a bucket should be some hundred megabytes. ``rows`` are persisted
    meanwhile, so that embeddings are computed once. Versions older than the ``keep`` newest are
    removed, with the folders that only they list.
    """
    spark, root = rows.sparkSession, _root(path, collection)
    if buckets < 1 or keep < 1:
        raise ValueError("buckets and keep must be at least 1.")
    rows = rows.persist()
    try:
        for _ in range(ATTEMPTS):
            version = _written(spark, root, rows, newest_version(spark, path, collection), rebuild, buckets)
            if version is not None:
                break
        else:
            raise RuntimeError(f"Other writers were first {ATTEMPTS} times: {root}")
    finally:
        rows.unpersist()
    _forget(spark, root, keep)
    return version


def _written(spark: SparkSession, root: str, rows: DataFrame, current: Version | None, rebuild: bool,
             buckets: int) -> Version | None:
    """The next version, or ``None`` if another writer has published it meanwhile."""
    fresh = current is None or rebuild
    n = buckets if fresh else current.buckets
    carried = {} if fresh else dict(current.folders)
    place = bucket_of(F.col("id"), n)
    merged = rows
    if not fresh:
        touched = {r[0] for r in rows.select(place).distinct().collect()}
        merged = upsert(_read(spark, root, current, touched), rows, end=current.end)
    write = f"data/{uuid.uuid4().hex}"
    by_bucket = merged.withColumn("bucket", place).hint("rebalance", F.col("bucket"))
    by_bucket.write.partitionBy("bucket").parquet(f"{root}/{write}")
    sizes = (spark.read.schema("pos long, bucket int").parquet(f"{root}/{write}").groupBy("bucket")
             .agg(F.count(F.lit(1)), F.coalesce(F.max("pos"), F.lit(-1))).collect())
    folders = {**carried, **{b: (f"{write}/bucket={b}", n_rows, last) for b, n_rows, last in sizes}}
    version = Version((current.number if current else 0) + 1, n, merged.schema, folders)
    if shared_files.publish(spark, f"{root}/versions/v{version.number:06d}.json", version.text(),
                            f"{root}/versions/{write.rsplit('/', 1)[1]}.draft"):
        return version
    shared_files.remove(spark, f"{root}/{write}")
    return None


def _forget(spark: SparkSession, root: str, keep: int) -> None:
    """Remove versions beyond the ``keep`` newest, and the folders no version lists any more."""
    numbers = _numbers(spark, root)
    old = [_load(spark, root, n) for n in numbers[:-keep]]
    listed = {folder for n in numbers[-keep:] for folder, _, _ in _load(spark, root, n).folders.values()}
    for version in old:
        for folder in {f for f, _, _ in version.folders.values()} - listed:
            shared_files.remove(spark, f"{root}/{folder}")
        shared_files.remove(spark, f"{root}/versions/v{version.number:06d}.json")


def cache_index(rows: DataFrame, view: str) -> DataFrame:
    """Keep an index in executor memory for this session, as a temporary view."""
    cached = rows.cache()
    cached.createOrReplaceTempView(view)
    return cached
