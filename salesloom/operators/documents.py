"""Transactions as text documents with metadata and a local embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import characters, vectors
from ..functions.formatting import float_text, iso_timestamp

METADATA = ("transaction_id", "date", "amount", "category", "product", "customer_id",
            "channel", "row_index")


def _optional(tx: DataFrame, name: str) -> Column:
    return (F.col(name) if name in tx.columns else F.lit(None)).cast("string")


def _key(tx: DataFrame, id_col: str | None) -> tuple[Column, Column]:
    """(key as text, its place as a whole number) of a transaction.

    A whole number, or a text of one, is its own place. Another key is placed by its hash, and
    where there is no key, the hash of the whole row is both. Hashes give places of 44 bits, so
    that an index has room behind its last place for hundreds of thousands of batches.
    """
    if id_col is None:
        key = F.xxhash64(*[F.col(f"`{c}`") for c in tx.columns])
        return F.shiftrightunsigned(key, 1).cast("string"), F.shiftrightunsigned(key, 20)
    key = F.col(id_col)
    if not isinstance(tx.schema[id_col].dataType, T.StringType):
        whole = key.cast("bigint")
        return whole.cast("string"), whole
    whole = key.try_cast("bigint")
    return (F.coalesce(whole.cast("string"), key),
            F.coalesce(whole, F.shiftrightunsigned(F.xxhash64(key), 20)))


def documents(tx: DataFrame, id_col: str | None = None, pos_col: str | None = None) -> DataFrame:
    """One document per transaction: ``id, pos, text, metadata``.

    ``id_col`` is a key of the transactions; it names the document and orders equal search
    scores, so both survive reruns. Without a key a row is named by its hash, and rows equal in
    all columns are one document in an index. ``pos_col`` gives another order, needed where one
    batch holds several states of a transaction (the last one wins in an index). Missing and
    empty fields are left out of the text.
    """
    name, key = _key(tx, id_col)
    txn_id = F.concat(F.lit("txn-"), name)
    amount = F.col("amount").cast("double")
    date = iso_timestamp(F.col("date"))
    named = {c: _optional(tx, c) for c in ("category", "product", "customer_id", "channel")}

    filled = [F.nullif(v, F.lit("")) for v in named.values()]
    prefixes = ("in category ", "for product ", "for customer ", "via channel ")
    category, product, customer, channel = (
        F.concat(F.lit(prefix), v) for prefix, v in zip(prefixes, filled))
    # concat is NULL for a missing value, and concat_ws leaves NULL parts out.
    parts = F.concat_ws(", ", F.concat(F.lit("on "), date), category, product,
                        F.concat(F.lit("with amount "), float_text(amount)), customer, channel)
    head = F.concat(F.lit("Transaction "), txn_id)
    described = F.col("date").isNotNull() | amount.isNotNull()
    for value in filled:
        described = described | value.isNotNull()
    text = F.when(described, F.concat(head, F.lit(" "), parts, F.lit("."))).otherwise(
        F.concat(head, F.lit(".")))
    metadata = F.struct(
        txn_id.alias("transaction_id"), F.coalesce(date, F.lit("")).alias("date"),
        amount.alias("amount"), *[v.alias(k) for k, v in named.items()],
        key.alias("row_index"))
    pos = F.col(pos_col).cast("bigint") if pos_col else key
    return tx.select(txn_id.alias("id"), pos.alias("pos"), text.alias("text"),
                     metadata.alias("metadata"))


def local_embedding(text: Column) -> Column:
    """``[characters, letters, digits, white space]`` of a text; no model, no UDF."""
    text = F.coalesce(text, F.lit(""))
    counts = characters.letter_digit_space_counts(text)
    return F.array(*[c.cast("double") for c in (F.length(text), *counts)])


EmbedBatch = Callable[[pd.Series], list[list[float]]]


def embed(df: DataFrame, text_col: str = "text", provider: EmbedBatch | None = None
          ) -> DataFrame:
    """Add ``embedding array<double>`` for ``text_col``.

    Without ``provider`` the local embedding is used. A provider gets batches of texts on
    the executors and must return one vector per text.
    """
    if provider is None:
        return df.withColumn("embedding", local_embedding(F.col(text_col)))
    schema = T.StructType([*df.schema.fields,
                           T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(provider(batch[text_col]))
            if len(found) != len(batch):
                raise ValueError("The embedding provider returned "
                                 f"{len(found)} vectors for {len(batch)} texts.")
            yield batch.assign(embedding=found)

    return df.mapInPandas(run, schema)


def index_rows(tx: DataFrame, id_col: str | None = None, provider: EmbedBatch | None = None,
               pos_col: str | None = None) -> DataFrame:
    """Documents ready for an index: ``id, pos, text, metadata, embedding, norm``."""
    embedded = embed(documents(tx, id_col, pos_col), "text", provider)
    return embedded.withColumn("norm", vectors.norm(F.col("embedding")))
