"""Keeping an index table up to date from a stream of raw transactions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import DEFAULT_COLUMNS, DEFAULT_DATE_FORMAT, clean_transactions
from ..operators.documents import EmbedBatch, index_rows
from ..sources.index_table import write_index


def upsert_stream(raw: DataFrame, id_col: str, path: str, collection: str, checkpoint: str,
                  columns: Mapping[str, str | None] = DEFAULT_COLUMNS,
                  date_format: str | None = DEFAULT_DATE_FORMAT,
                  provider: EmbedBatch | None = None, once: bool = False,
                  pos_col: str | None = None) -> StreamingQuery:
    """Clean, describe and embed streamed transactions; merge each micro-batch by id.

    ``pos_col`` orders the states of a transaction within a batch; the last one stays.

    Merging by id is idempotent, so a micro-batch that is replayed after a failure changes
    nothing. ``once`` processes what is there and stops.
    """
    rows = index_rows(clean_transactions(raw, columns, date_format), id_col, provider, pos_col)

    def merge(batch: DataFrame, _: int) -> None:
        batch.persist()  # embedded once, however often the merge reads it
        try:
            if not batch.isEmpty():
                write_index(batch, path, collection)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
