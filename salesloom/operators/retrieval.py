"""Questions answered by similar transactions: search, typed rows, JSON, documents, text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import cut, fixed, float_text, grouped_number, language_code
from .documents import EmbedBatch, embed
from .kpi import null_safe_join
from .similarity import top_k

DEFAULT_TOP_K = 5
BLOCK_ITEMS = 5
BLOCK_CHARS = 1_200
BLOCK_MARKER = "\n[Context truncated for length]"

# Headers and field names of a context block.
BLOCK_HEADERS = {
    ("report", "en"): "[RAG context: sample transactions]",
    ("report", "id"): "[Konteks RAG: contoh transaksi]",
    ("chat", "en"): "[RAG context: relevant transactions]",
    ("chat", "id"): "[Konteks RAG: transaksi relevan]",
}
BLOCK_FIELDS = {
    "en": ("category", "product", "amount", "similarity"),
    "id": ("kategori", "produk", "jumlah", "skor_kemiripan"),
}


def search(questions: DataFrame, index: DataFrame, query_col: str = "query",
           keys: Sequence[str] = (), top_k_rows: int | None = DEFAULT_TOP_K,
           provider: EmbedBatch | None = None, metric: str = "cosine",
           where: Column | None = None, **limits: int) -> DataFrame:
    """Matches per question: ``keys, rank, id, pos, score, text, metadata``.

    Each ``query_col`` text is embedded like the documents. ``where`` restricts the index
    before the search (it is pushed to the index scan). A per-question limit is a filter
    on ``rank`` afterwards. With a ``provider`` the embedded questions are persisted; ``index``
    should then be a stored table (``read_index``), since it is read several times.
    """
    embedded = embed(questions.select(*keys, query_col), query_col, provider)
    if provider is not None:
        embedded.persist()
    rows = index if where is None else index.where(where)
    return top_k(rows, embedded.drop(query_col), top_k_rows, metric,
                 carry=("text", "metadata"), many_equal=provider is None, **limits)


def retrieved_rows(matches: DataFrame) -> DataFrame:
    """Matches with the metadata promoted to typed columns (the id stands in for a missing
    transaction id; a value of the wrong type is NULL)."""
    meta = F.col("metadata")
    promoted = [F.coalesce(meta.transaction_id, F.col("id")).alias("transaction_id")]
    promoted += [meta[c].cast("string").alias(c) if c != "amount"
                 else meta[c].cast("double").alias(c)
                 for c in ("date", "amount", "category", "product", "customer_id", "channel")]
    others = [c for c in matches.columns if c not in ("metadata", "pos")]
    return matches.select(*others, *promoted, meta.row_index.alias("row_index"), "metadata")


def merged_filters(base: Mapping[str, str] | None, override: Mapping[str, str] | None
                   ) -> dict[str, str]:
    """Filters of a search with per-call entries on top. They describe, never restrict."""
    return {**(base or {}), **(override or {})}


def filters_column(filters: Mapping[str, str] | None) -> Column:
    pairs = [F.lit(x) for entry in sorted((filters or {}).items()) for x in entry]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.create_map(*pairs) if pairs else empty


_MATCH_JSON = ("id", "score", "transaction_id", "date", "amount", "category", "product",
               "customer_id", "channel", "row_index")


def contexts(questions: DataFrame, rows: DataFrame, keys: Sequence[str],
             query_col: str = "query", top_k_rows: int | None = DEFAULT_TOP_K,
             language: str = "en", filters: Column | None = None) -> DataFrame:
    """One row per question: ``keys, query, top_k, language, filters, matches``.

    ``matches`` has at most k entries in rank order; a question without a match keeps an
    empty list. Without a requested k the number of matches stands for it.
    """
    item = F.struct("rank", *_MATCH_JSON)
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("found"))
    joined = null_safe_join(questions, grouped, keys)
    matches = F.transform(
        F.coalesce("found", F.array().cast(dict(grouped.dtypes)["found"])),
        lambda m: F.struct(*[m[c].alias(c) for c in _MATCH_JSON]))
    size = F.size("matches") if top_k_rows is None else F.lit(top_k_rows)
    return joined.select(
        *keys, F.col(query_col).alias("query"), F.lit(language).alias("language"),
        (filters_column({}) if filters is None else filters).alias("filters"),
        matches.alias("matches"),
    ).select(*keys, "query", size.alias("top_k"), "language", "filters", "matches")


def context_json(context: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The context of a question as one JSON text."""
    body = F.struct("query", "top_k", "language", "filters", "matches")
    return context.select(*keys, F.to_json(body, {"ignoreNullFields": "false"})
                          .alias("context_json"))


def fallback_text() -> Column:
    """Short description of a retrieved row that has no text of its own."""
    def part(name: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(f"{name}="), value))

    parts = F.concat_ws(
        ", ", F.concat(F.lit("date="), F.col("date")),
        F.concat(F.lit("amount="), float_text(F.col("amount"))),
        *[part(c, F.col(c)) for c in ("category", "product", "customer_id", "channel")])
    head = F.concat(F.lit("Retrieved transaction "), F.col("transaction_id"))
    return F.when(F.length(parts) > 0, F.concat(head, F.lit(": "), parts)).otherwise(head)


def retrieved_documents(rows: DataFrame, questions: DataFrame, keys: Sequence[str],
                        query_col: str = "query", top_k_rows: int | None = DEFAULT_TOP_K,
                        language: str = "en", filters: Column | None = None) -> DataFrame:
    """Retrieved rows as documents: ``keys, rank, page_content, metadata``."""
    asked = questions.select(*keys, F.col(query_col).alias("query"))
    if top_k_rows is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("top_k"))
        asked = null_safe_join(asked, counts, keys)
    else:
        asked = asked.withColumn("top_k", F.lit(top_k_rows))
    joined = null_safe_join(rows, asked, keys, "inner")
    text = F.when(F.length("text") > 0, F.col("text")).otherwise(fallback_text())
    metadata = F.struct(
        "id", "transaction_id", "score", "date", "amount", "category", "product",
        "customer_id", "channel", "row_index", "query", F.lit(language).alias("language"),
        "top_k", (filters_column({}) if filters is None else filters).alias("filters"))
    return joined.select(*keys, "rank", text.alias("page_content"), metadata.alias("metadata"))


def result_lines(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One printable line per match; ``?`` for what is missing."""
    def shown(value: Column) -> Column:
        return F.when(F.length(value) > 0, value).otherwise(F.lit("?"))

    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), shown(F.col("date")),
        F.lit(" | id="), F.col("transaction_id"),
        F.lit(" | category="), shown(F.col("category")),
        F.lit(" | product="), shown(F.col("product")),
        F.lit(" | amount="), F.coalesce(float_text(F.col("amount")), F.lit("?")),
        F.lit(" | similarity="), fixed(F.col("score"), 3))
    return rows.select(*keys, "rank", line.alias("line"))


def context_block(rows: DataFrame, keys: Sequence[str], language: str = "en",
                  audience: str = "chat", max_items: int = BLOCK_ITEMS,
                  max_chars: int = BLOCK_CHARS, marker: bool = False) -> DataFrame:
    """A few numbered match lines per question under a header: ``keys, block``.

    Questions without a match have no block. ``marker`` notes a cut at ``max_chars``.
    """
    lang = language_code(language)
    category, product, amount, similarity = BLOCK_FIELDS[lang]

    def shown(value: Column, missing: str) -> Column:
        return F.when(F.length(value) > 0, value).otherwise(F.lit(missing))

    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), shown(F.col("date"), "?"),
        F.lit(f" | {category}="), shown(F.col("category"), "-"),
        F.lit(f" | {product}="), shown(F.col("product"), "-"),
        F.lit(f" | {amount}="), F.coalesce(grouped_number(F.col("amount"), 2), F.lit("n/a")),
        F.lit(f" | {similarity}="), F.coalesce(fixed(F.col("score"), 3), F.lit("n/a")))
    first = rows.where(F.col("rank") <= max_items)
    grouped = first.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    block = F.concat(F.lit(BLOCK_HEADERS[audience, lang] + "\n"),
                     F.array_join(F.transform("lines", lambda x: x.line), "\n"))
    return grouped.select(
        *keys, cut(block, max_chars, BLOCK_MARKER if marker else "").alias("block"))
