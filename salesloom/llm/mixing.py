"""Mixing sources to target weights by a low-discrepancy schedule.

Weights become targets in words by filling up: sources share the words of all by weight, a source
stops at ``MAX_EPOCHS`` times its own words, and what it leaves is shared again. The schedule has
``SLOTS`` slots of equal tokens. Slot i's part of the unit interval begins at the van der Corput number of i
(its bits reversed); the sources that own it by the cumulative targets share the slot, most slots have
one. A source's pieces, in the order of slots, are dealt the blocks of its documents' stream, which are
shuffled by a hash and repeated end on end: so any stretch of the schedule has the sources in close to
their target shares, and a source has its target to the word, whatever the size of a slot.

All numbers of a source come from one row per source. Places of documents in their source's stream
are running sums in two levels, over hash buckets and inside them: a source of any size is dealt
to ``BUCKETS`` tasks. Parts are joined to sources by cells of the unit interval, and pieces to documents by
blocks of the stream, on equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesloom.llm.storage import cut
from salesloom.llm.text import words

SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
CELLS = 1024
BUCKETS = 1024
MAX_EPOCHS = 3


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source") -> DataFrame:
    """(id, source, size, key, row): words of each row, a hash that shuffles rows, and a number of the row."""
    text = F.col(text_col).cast("string")
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("mix")))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       F.size(words(text)).cast("long").alias("size"), key.alias("key"),
                       F.monotonically_increasing_id().alias("row"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, total, weight, target, low, high) per source: targets in words, and the part of [0, 1) it owns.

    Weights are 1, 2, 3, repeating, in the order of code points, null last. A source without words
    has target 0. A share of the rest is the same for all sources that are not full, so sources
    fill in the order of total over weight, and the full ones are the first in it. The level after
    the last full one is the share; behind it, levels fall.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("total"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = totals.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    everything = Window.partitionBy()
    filling = Window.orderBy((MAX_EPOCHS * F.col("total") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    rows = totals.withColumn("all", F.sum("total").over(everything)).withColumn(
        "level", (F.col("all") - MAX_EPOCHS * F.coalesce(F.sum("total").over(before), F.lit(0)))
        / F.sum("weight").over(onward))
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= MAX_EPOCHS * F.col("total"))
    rows = rows.withColumn("share", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    rows = rows.withColumn("target", F.when(F.col("full"), (MAX_EPOCHS * F.col("total")).cast("double"))
                           .otherwise(F.col("share") * F.col("weight")).cast("double"))
    sums = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    scale = F.when(F.col("all") > 0, F.sum("target").over(sums) / F.sum("target").over(everything)).otherwise(0.0)
    rows = rows.withColumn("high", scale).withColumn(
        "low", F.coalesce(F.lag("high").over(by_name), F.lit(0.0)))
    return rows.select("source", "total", "weight", "target", "low", "high", "all")


def schedule(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """(slot, source, rank, start, stop, block): the pieces of every slot, each with its rank among its source's, the
    words of the source's stream it takes, and the words of a whole slot.

    What lies above the last source by rounding goes to the last source. Pieces of a source end where its
    parts so far have their share of its target, rounded to words; so the last one ends at the target.
    """
    reversed_bits = F.lit(0).cast("long")
    for bit in range(SLOT_BITS):
        reversed_bits = reversed_bits + F.shiftleft(F.shiftright(F.col("id"), bit).bitwiseAND(1), SLOT_BITS - 1 - bit)
    parts = spark.range(SLOTS).select(F.col("id").alias("slot"), (reversed_bits / SLOTS).alias("point"))
    parts = parts.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    last = F.col("high") >= F.max("high").over(Window.partitionBy())
    owners = targets.filter("high > low").withColumn("end", F.when(last, F.lit(1.0)).otherwise(F.col("high")))
    owners = owners.withColumn("cell", F.explode(F.sequence(*[
        F.least(F.lit(CELLS - 1), F.floor(F.col(x) * CELLS)).cast("int") for x in ("low", "end")])))
    owners = owners.select("source", "low", "end", "cell", F.floor(F.col("target") + 0.5).alias("words"),
                           F.ceil(F.col("all") / SLOTS).alias("block"))
    share = F.least("end", F.col("point") + 1 / SLOTS) - F.greatest("low", "point")
    pieces = parts.join(owners, "cell").withColumn("share", share).filter("share > 0")
    order = Window.partitionBy("source").orderBy("slot")
    so_far = F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.row_number().over(order) - 1
    whole = F.count("*").over(Window.partitionBy("source"))
    pieces = pieces.withColumn("rank", rank.cast("long")).withColumn("stop", F.when(
        F.col("rank") == whole - 1, F.col("words")).otherwise(F.least("words", F.floor(
            so_far / (F.col("end") - F.col("low")) * F.col("words") + 0.5))).cast("long"))
    return pieces.select("slot", "source", "rank", F.coalesce(F.lag("stop").over(order), F.lit(0)).alias("start"),
                         "stop", F.col("block").cast("long").alias("block"))


def stream_places(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``begin``, the words before a row in its source's shuffled stream."""
    rows = sizes.withColumn("bucket", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % BUCKETS)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                       F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.select("id", "source", "size", "row", (F.col("offset") + F.col("inside")).alias("begin"))


def blocks_of(start: Column, stop: Column, block: Column) -> Column:
    """The blocks of a stream that [start, stop) touches."""
    return F.explode(F.sequence(F.floor(start / block), F.floor((stop - 1) / block)))


def taken(places: DataFrame, pieces: DataFrame) -> DataFrame:
    """(row, taken) of the rows that pieces take; ``places`` have their source's total, target and block."""
    epochs = F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1)))
    shown = places.filter("size > 0 and block > 0").select("row", "source", "size", "begin", "total", "target", "block",
                                                           epochs.alias("epoch"))
    shown = shown.withColumn("from", F.col("begin") + F.col("epoch") * F.col("total")).filter("from < target + 1")
    shown = shown.withColumn("to", F.col("from") + F.col("size"))
    shown = shown.select("row", "source", "from", "to", blocks_of(F.col("from"), F.col("to"), F.col("block")).alias("at"),
                         "block")
    dealt = pieces.filter("stop > start").select(
        F.col("source").alias("s"), "start", "stop", blocks_of(F.col("start"), F.col("stop"), F.col("block")).alias("b"))
    hit = shown.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("b")))
    low = F.greatest("from", "start", F.col("at") * F.col("block"))
    high = F.least("to", "stop", (F.col("at") + 1) * F.col("block"))
    return hit.withColumn("words", high - low).filter("words > 0").groupBy("row").agg(F.sum("words").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, begin, taken) per row.

    ``taken``: words of the row that the schedule's slots take, repeats counted; a row is taken at
    most ``MAX_EPOCHS`` times. Null texts have no words and are never taken; null sources are one
    source. Rows that repeat an id are rows of their own. No rows give no rows.
    """
    sizes = cut(document_sizes(docs, id_col, text_col, source_col))
    targets = cut(source_targets(sizes))
    plan = targets.select(F.col("source").alias("s"), "total", "target",
                          F.ceil(F.col("all") / SLOTS).cast("long").alias("block"))
    rows = stream_places(sizes).join(F.broadcast(plan) if plan.limit(10_001).count() <= 10_000 else plan,
                                     F.col("source").eqNullSafe(F.col("s")))
    rows = cut(rows.drop("s"))
    rows = rows.join(taken(rows, schedule(docs.sparkSession, targets)), "row", "left")
    return rows.select("id", "source", "size", F.col("total").alias("source_size"), "target", "begin",
                       F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
