"""The similarity index as a table: merge new documents by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX_COLUMNS = ("id", "pos", "text", "metadata", "embedding", "norm")


def latest_per_id(rows: DataFrame) -> DataFrame:
    """One row per id: the content of the last one, at the place of the first one.

    Rows of an id that share a position are told apart by their content, so the result
    does not depend on the order in which tasks finish.
    """
    content = [c for c in rows.columns if c not in ("id", "pos")]
    merged = rows.groupBy("id").agg(F.min("pos").alias("first"),
                                    F.max(F.struct("pos", *content)).alias("last"))
    return merged.select("id", F.col("first").alias("pos"),
                         *[F.col("last")[c].alias(c) for c in content]).select(*rows.columns)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` is proven to have no more than ``rows`` rows. The job stops early and
    fetches no data."""
    return len(df.select(F.lit(1)).limit(rows + 1).collect()) <= rows


def upsert(current: DataFrame, new: DataFrame, broadcast_rows: int = 200_000,
           end: int | None = None) -> DataFrame:
    """``current`` with ``new`` merged in: last write wins, known ids keep their place.

    New ids are placed behind everything there is. The large current table is only
    filtered and passed on: a batch of at most ``broadcast_rows`` ids is broadcast to it,
    so that it is not shuffled; a larger one is joined by sorting both sides. ``new`` is read
    several times: persist it if its embeddings come from a provider. ``end`` is the last
    position of the index, if ``current`` is the part of it that can hold the new ids.
    """
    new = latest_per_id(new.select(*current.columns))
    new_ids = new.select("id")
    if at_most(new_ids, broadcast_rows):
        new_ids = F.broadcast(new_ids)
    kept = current.join(new_ids, "id", "left_anti")
    places = (current.select("id", "pos").join(new_ids, "id", "left_semi")
              .withColumnRenamed("pos", "known_pos"))
    last = (current.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("end")).scalar()
            if end is None else F.lit(end).cast("bigint"))
    start = new.agg(F.min("pos").alias("start")).scalar()
    placed = new.join(places, "id", "left").withColumn(
        "pos", F.coalesce("known_pos", last + 1 + F.col("pos") - start))
    return kept.select(*current.columns).unionByName(placed.select(*current.columns))
