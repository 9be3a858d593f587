"""Removal of repeated word passages by level-wise doubling.

Windows of ``window`` words are looked for through shorter runs: of every window, one run of 10
words stands for it (that of least hash, so equal windows choose equal runs). Runs that repeat
anywhere are extended to 20 words inside their windows, those that repeat again to 40, and so on up
to the window itself; a window whose run stands alone at some length drops out. At the last length,
the least (id, start) of equal windows stays, all others are repeats, and the words they cover go.

Documents of equal words are settled before: all but the least id are repeats from end to end.
Texts travel compressed, and only those with candidates go on. Shorter runs are counted by 64-bit
hashes, where a collision only adds candidates; windows are told apart by 96 bits. Of equal windows
in a batch, all but the first are known as repeats at once, so a passage that very many documents
share meets in one place only once a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.storage import cut
from salesloom.llm.text import grams, hashed_words

START = 10
FILTER_BITS = 1 << 24
_CODEC = pa.Codec("zstd", compression_level=1)
_SECOND_BASE = 0x9FB21C651E98DF25
_LAST = (1 << 63) - 1


def _levels(window: int) -> list[int]:
    """10, 20, 40, ... below the window, then the window."""
    out = [min(START, window)]
    while out[-1] * 2 < window:
        out.append(out[-1] * 2)
    return [*out, window] if out[-1] < window else out


def _choices(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window's start, where its run of least hash starts."""
    first = grams(hashes, min(START, window))
    span = window - min(START, window) + 1
    if len(first) < span:
        return np.empty(0, dtype=np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(first, span)
    return rows.argmin(axis=1) + np.arange(len(rows))


def _extended(choice: np.ndarray, window: int, size: int) -> np.ndarray:
    """Where a run of ``size`` words around the choice starts, inside the window of each start.

    It starts at the choice, or as many steps of ``START`` words before as it takes to end inside the
    window; where that is before the window, at the window's start. Only the choice's place in the
    window counts, so equal windows have equal runs.
    """
    if size == window:
        return np.arange(len(choice))
    first = np.arange(len(choice))
    over = choice - first + size - window
    return np.maximum(first, choice - np.maximum(0, -(-over // START)) * START)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.array(value.as_py() or [], dtype=np.int64)


def _base():
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("words_sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks = [], []
            for value in batch.column(2):
                parts = (value.as_py() or "").encode().split()
                sizes.append(len(parts))
                marks.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(marks)], schema=schema)

    return run


def _first_level(window: int):
    schema = pa.schema([("h", pa.int64()), ("row", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            hs, rows, ats = [], [], []
            for key, hashes in zip(keys, hashed_words(batch.column(1))):
                choice = np.unique(_choices(hashes, window))
                if len(choice):
                    hs.append(grams(hashes, min(START, window))[choice])
                    rows.append(np.full(len(choice), key, dtype=np.int64))
                    ats.append(choice.astype(np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(rows)),
                     pa.array(np.concatenate(ats))], schema=schema)

    return run


def _alive(choice: np.ndarray, window: int, size: int, repeated: np.ndarray) -> np.ndarray:
    """Starts of windows whose run of ``size`` words starts at one of ``repeated``."""
    starts = _extended(choice, window, size)
    known = np.zeros(len(choice) + window, dtype=bool)
    known[repeated] = True
    return np.flatnonzero(known[starts])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as (size, compressed bytes)."""
    for batch in batches:
        raw = [(value.as_py() or "").encode() for value in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(x) for x in raw], pa.int64()),
             pa.array([_CODEC.compress(x, asbytes=True) for x in raw], pa.binary())],
            names=["row", "id", "size", "packed"])


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    sizes, packed = batch.column("size").to_pylist(), batch.column("packed").to_pylist()
    return [_CODEC.decompress(x, decompressed_size=n, asbytes=True) if n else b"" for x, n in zip(packed, sizes)]


def _hashed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return hashed_words(pa.array(_unpacked(batch), pa.large_binary()).cast(pa.large_string()))


def _next_level(window: int, before: int, size: int):
    """Rows of the runs of ``size`` words that contain repeated runs of ``before`` words."""
    schema = pa.schema([("h", pa.int64()), ("row", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, repeated, hashes in zip(batch.column("row").to_pylist(), _lists(batch.column("places")), _hashed(batch)):
                choice = _choices(hashes, window)
                at = np.unique(_extended(choice, window, size)[_alive(choice, window, before, repeated)])
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams(hashes, size)[at].view(np.int64)),
                         pa.array(np.full(len(at), key, dtype=np.int64)), pa.array(at.astype(np.int32))], schema=schema)

    return run


def _windows(window: int, before: int):
    """Windows that contain repeated runs; ``known``: an equal one stands before it in the batch.

    ``spot``: the lower half of the row key, then the start.
    """
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("id", pa.int64()), ("spot", pa.int64()),
                        ("known", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, gs, keys, ids, ats = [], [], [], [], []
            known = zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), _lists(batch.column("places")))
            for (key, own, repeated), hashes in zip(known, _hashed(batch)):
                at = _alive(_choices(hashes, window), window, before, repeated)
                if len(at):
                    hs.append(grams(hashes, window)[at])
                    gs.append((grams(hashes, window, _SECOND_BASE)[at] >> np.uint64(32)).astype(np.uint32))
                    keys.append(np.full(len(at), key, dtype=np.int64))
                    ids.append(np.full(len(at), own, dtype=np.int64))
                    ats.append(at)
            if not hs:
                continue
            h, g, key, own, at = (np.concatenate(x) for x in (hs, gs, keys, ids, ats))
            order = np.lexsort((at, own, g, h))
            h, g, key, own, at = h[order], g[order], key[order], own[order], at[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            later = (own != own[first]) | (at != at[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(g.view(np.int32)), pa.array(own),
                 pa.array(key << np.int64(32) | at), pa.array(later)], schema=schema)

    return run


def _kept(window: int):
    schema = pa.schema([("row", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, texts = [], []
            for raw, starts in zip(_unpacked(batch), _lists(batch.column("starts"))):
                parts = raw.split()
                edges = np.zeros(len(parts) + 1, dtype=np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + window, -1)
                gone = np.cumsum(edges[:-1]) > 0
                removed.append(int(gone.sum()))
                texts.append(b" ".join(p for p, g in zip(parts, gone) if not g).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], schema=schema)

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """(row, places, least): where runs start whose hash stands twice or more, and the least such hash."""
    often = rows.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    return rows.join(often, "h", "left_semi").groupBy("row").agg(
        F.collect_set("at").alias("places"), F.min("h").alias("least"))


def _perhaps_in(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose row key is not in ``wanted``; never without one that is.

    A bitmap of ``FILTER_BITS`` bits, 2 MB at any size of input, goes to all tasks. Where it is
    full it lets all rows pass, which the join that follows sorts out.
    """
    bit = F.pmod("row", F.lit(FILTER_BITS)) + 1
    bits = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position(bit).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = rows.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "bucket")
    return kept.filter(
        F.get(F.array(*[F.lit(1 << k) for k in range(8)]), place % 8).bitwiseAND(byte) > 0).drop("bucket", "bits")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(id, row, n, n_removed, kept) of every row; ``kept`` is null where the whole text stays.

    ``kept``: the words that stay, joined by one space. A null text has no words. Null ids come
    after all others. Rows of the same id are one document: of windows in them, the earlier start
    stays, and repeated rows lose nothing to each other.
    """
    levels = _levels(window)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"),
                       F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("row"),
                       F.col(text_col).cast("string").alias("text"))
    base = cut(rows.mapInArrow(_base(), "id long, row long, n long, words_sha string"))
    classes = base.filter(F.col("n") >= window).groupBy("words_sha").agg(F.min("id").alias("first"))
    base = base.join(classes, "words_sha", "left").withColumn(
        "copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("first")
    originals = base.filter(~F.col("copy") & (F.col("n") >= window)).select("row").distinct()
    found = _repeated(rows.select("row", "text").mapInArrow(_first_level(window), "h long, row long, at int"))
    columns = ["row", "id", "size", "packed", "places", "least"]
    found = cut(found.join(originals, "row"))
    packed = _perhaps_in(rows, found).select("row", "id", "text").mapInArrow(
        _packed, "row long, id long, size long, packed binary")
    texts = cut(found.join(packed, "row").dropDuplicates(["row"]).select(*columns))
    for before, size in zip(levels, levels[1:-1]):
        found = _repeated(texts.mapInArrow(_next_level(window, before, size), "h long, row long, at int"))
        texts = cut(texts.drop("places", "least").join(found, "row").select(*columns))
    # Near copies lie side by side, so that most of their windows are known in their batch.
    near = texts.repartitionByRange("least", "row")
    last = near.mapInArrow(_windows(window, levels[-2] if len(levels) > 1 else window),
                           "h long, g int, id long, spot long, known boolean")
    place = F.struct("id", F.col("spot").bitwiseAND(0xFFFFFFFF).alias("at"))
    first = F.min(place).over(Window.partitionBy("h", "g"))
    open_ = last.filter(~F.col("known")).withColumn("first", first).filter(place > F.col("first"))
    repeats = open_.select("id", "spot").unionByName(last.filter("known").select("id", "spot"))
    part = F.shiftright("spot", 32).cast("int")
    repeats = repeats.groupBy("id", part.alias("part")).agg(
        F.collect_set(F.col("spot").bitwiseAND(0xFFFFFFFF).cast("int")).alias("starts"))
    results = texts.withColumn("part", F.shiftright(F.shiftleft("row", 32), 32).cast("int"))
    results = results.join(repeats, ["id", "part"]).select("row", "size", "packed", "starts").mapInArrow(
        _kept(window), "row long, n_removed long, kept string")
    out = base.join(results, "row", "left")
    return out.select(
        F.when(F.col("id") != _LAST, F.col("id")).alias("id"), "row", "n", "words_sha",
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"))
