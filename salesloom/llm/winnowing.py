"""Benchmark decontamination by winnowing, in columns and DataFrame functions only.

Of every window of 13 words, the word 5-gram with the least hash is a fingerprint. Texts that share
13 words share the fingerprint of those words, so the fingerprints of documents and benchmark items
are joined on equality and every hit is extended: along its diagonal (place in the document less
place in the item) the words are compared, and runs of 13 equal words or more are hits. An item of
fewer words is one window of its own length; documents are then fingerprinted for that length too.

The item side of the join is broadcast if a count shows at most ``BROADCAST_ROWS`` rows of a few
numbers, else both sides are shuffled. Texts of documents travel only for the extension.
Fingerprints are hashed from words in full lower case, which equal more often than words whose A-Z
are lower-cased; the extension compares the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.text import LOWER, UPPER, let

WINDOW, GRAM = 13, 5
BROADCAST_ROWS = 1_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def _gram_hashes(word_list: Column, size: int) -> Column:
    """Hash of every run of ``size`` words; empty if there are fewer."""
    def runs(one: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(one) - size),
                           lambda i: F.xxhash64(*[F.get(one, i + k) for k in range(size)]))

    hashed = F.transform(word_list, lambda x: F.xxhash64(F.lower(x)))
    return F.when(F.size(word_list) >= size, let(hashed, runs)).otherwise(F.array().cast("array<bigint>"))


def fingerprints(word_list: Column, window: int) -> Column:
    """Distinct least gram hashes of all windows of ``window`` words."""
    gram = min(GRAM, window)
    span = window - gram + 1

    def least(hashes: Column) -> Column:
        if span == 1:
            return F.array_distinct(hashes)
        return F.when(F.size(hashes) >= span, F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size(hashes) - span + 1), lambda j: F.array_min(F.slice(hashes, j, F.lit(span))))))

    return let(_gram_hashes(word_list, gram), least)


def _item_fingerprints(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(window, h, item, at): places of an item's fingerprints."""
    parts = []
    for length in lengths:
        own = items.filter(F.least(F.size("words"), F.lit(WINDOW)) == length)
        hashes = own.select("item", fingerprints(F.col("words"), length).alias("prints"),
                            _gram_hashes(F.col("words"), min(GRAM, length)).alias("grams"))
        parts.append(hashes.select("item", "prints", F.posexplode("grams").alias("at", "h"))
                     .filter(F.array_contains("prints", F.col("h")))
                     .select(F.lit(length).alias("window"), "h", "item", "at"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _extend(doc: Column, item: Column, diagonal: Column) -> Column:
    """Runs [start, end) of equal words on a diagonal, as long as the item's window at least."""
    start, end = F.greatest(F.lit(0), diagonal), F.least(F.size(doc), F.size(item) + diagonal)
    flags = F.concat_ws("", F.transform(F.sequence(start, end - 1), lambda i: F.when(
        F.get(doc, i) == F.get(item, i - diagonal), F.lit("1")).otherwise(F.lit("0"))))
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(state: Column, run: Column) -> Column:
        stop = state["at"] + F.length(run)
        long_enough = F.length(run) >= F.least(F.size(item), F.lit(WINDOW))
        return F.struct((stop + 1).alias("at"), F.when(long_enough, F.concat(
            state["runs"], F.array(F.struct(state["at"].alias("s"), stop.alias("e"))))).otherwise(
            state["runs"]).alias("runs"))

    runs = F.aggregate(F.split(flags, "0"), F.struct(start.alias("at"), empty.alias("runs")), step,
                       lambda state: state["runs"])
    return F.when(start < end, runs).otherwise(empty)


def hit_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(row, item_id, s, e): words [s, e) of a document row that stand in an item; may overlap.

    ``row`` is ``row_key`` of the document.
    """
    rows = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    bench = items.select(F.col(item_col).cast("string").alias("item_id"),
                         _words(F.col(item_text_col).cast("string")).alias("words"))
    bench = bench.withColumn("item", F.xxhash64("item_id", "words")).filter(F.size("words") > 0)
    lengths = sorted(r[0] for r in bench.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())
    places = _item_fingerprints(bench, lengths or [WINDOW])
    if places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    kinds = F.array(*[F.struct(F.lit(n).alias("window"), fingerprints(F.col("w"), n).alias("prints"))
                      for n in (lengths or [WINDOW])])
    prints = rows.select("row", _words(F.col("text")).alias("w")).select("row", F.inline(kinds)).select(
        "row", "window", F.explode("prints").alias("h"))
    hits = prints.join(places, ["window", "h"]).groupBy("row", "item").agg(
        F.collect_set(F.struct("window", "h", "at")).alias("hits"))
    exact = bench.select("item", "item_id", F.transform("words", lambda x: F.translate(x, UPPER, LOWER)).alias("b"))
    pairs = hits.join(exact.dropDuplicates(["item", "item_id"]), "item").join(rows, "row")
    pairs = pairs.select("row", "item_id", "hits", "b", _words(F.col("text")).alias("w"))
    pairs = pairs.select("row", "item_id", "hits", "b", F.transform("w", lambda x: F.translate(x, UPPER, LOWER)).alias("d"),
                         F.array(*[_gram_hashes(F.col("w"), k) for k in range(1, GRAM + 1)]).alias("grams"))

    def diagonals(hit: Column) -> Column:
        own = F.get("grams", F.least(hit["window"], F.lit(GRAM)) - 1)
        return let(own, lambda g: F.transform(F.filter(
            F.transform(g, lambda h, i: F.when(h == hit["h"], i)), lambda i: i.isNotNull()), lambda i: i - hit["at"]))

    ways = pairs.select("row", "item_id", "b", "d",
                        F.explode(F.array_distinct(F.flatten(F.transform("hits", diagonals)))).alias("diagonal"))
    return ways.select("row", "item_id", F.inline(_extend(F.col("d"), F.col("b"), F.col("diagonal"))))


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that share an id but not the text."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) of every row; ``items`` are sorted ids as strings.

    Contaminated: a hit, and hits cover a twentieth of the words at least. A null text has no
    words; a benchmark row without words hits nothing, one without an id is not listed. Repeated
    rows and ids are judged each for itself.
    """
    spans = hit_spans(docs, items, id_col, text_col, item_col, item_text_col)
    spans = spans.distinct()
    covered = spans.select("row", F.explode(F.sequence("s", F.col("e") - 1)).alias("at")).distinct()
    found = covered.groupBy("row").agg(F.count("*").alias("n_hit")).join(
        spans.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "row")
    base = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"),
                       F.size(_words(F.col(text_col).cast("string"))).cast("long").alias("n_words"))
    rows = base.join(found, "row", "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return rows.select("id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                       F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"))
