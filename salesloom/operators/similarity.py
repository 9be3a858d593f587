"""Exact top-k similarity search for a table of query vectors.

No plan here pairs rows in a join. Vectors are scored block against block inside tasks (a
matrix product), and a task only hands on the best ``k`` per query:

* few distinct index vectors: they are broadcast and the queries stream past, so every
  query is finished in one task without any shuffle;
* few queries: they are broadcast and the index streams past; the best ``k`` per task are
  merged afterwards;
* many of both: both sides are cut into hash blocks and every pair of blocks is one task.

The first two need a proven bound (``broadcast_rows``, ``broadcast_bytes``); a job that
stops early at the bound proves it. All three give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .index import at_most

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20
BLOCK_CELLS = 4_000_000  # scores held at once by a task

_MATCH_FIELDS = [
    T.StructField("rank", T.IntegerType()), T.StructField("id", T.StringType()),
    T.StructField("pos", T.LongType()), T.StructField("score", T.DoubleType()),
]


# ---------------------------------------------------------------------------
# Scoring inside a task
# ---------------------------------------------------------------------------


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors padded with zeros to one length, true lengths)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    lengths = np.diff(offsets)
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return flat.reshape(len(lengths), width), lengths
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def _scores(q: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray],
            metric: str) -> np.ndarray:
    """Scores of every query against every vector; 0.0 where the lengths differ."""
    (qm, ql), (xm, xl) = q, x
    width = min(qm.shape[1], xm.shape[1])
    product = qm[:, :width] @ xm[:, :width].T
    q2, x2 = (qm * qm).sum(axis=1), (xm * xm).sum(axis=1)
    if metric == "cosine":
        size = np.sqrt(q2)[:, None] * np.sqrt(x2)[None, :]
        scores = np.divide(product, size, out=np.zeros_like(product), where=size > 0)
    else:
        # Differences first: |q|^2 + |x|^2 - 2qx loses near neighbours far from the origin.
        distance = np.zeros_like(product)
        for at in range(width):
            gap = qm[:, at, None] - xm[None, :, at]
            distance += gap * gap
        scores = 1.0 / (1.0 + distance)
    same = ql[:, None] == xl[None, :]
    return scores if same.all() else np.where(same, scores, 0.0)


def _sort_key(scores: np.ndarray) -> np.ndarray:
    # Twelve decimals: noise in the last bits must not reorder equal scores.
    return np.floor(scores * 1e12 + 0.5)


class _Best:
    """Best ``k`` candidates per query over any number of index blocks."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.found = [(np.empty(0), np.empty(0, np.int64), np.empty(0, object))
                      for _ in range(n_queries)]

    def offer(self, first: int, scores: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> None:
        """Scores of queries ``first, first+1, …`` against one block."""
        keys = _sort_key(scores)
        n, k = scores.shape[1], self.k
        for row in range(len(scores)):
            key = keys[row]
            near = np.arange(n)
            if n > k:  # everything that ties with the k-th best stays in
                near = np.flatnonzero(key >= np.partition(key, n - k)[n - k])
            near = near[np.lexsort((pos[near], -key[near]))[:k]]
            old_score, old_pos, old_ids = self.found[first + row]
            score = np.concatenate([old_score, scores[row, near]])
            place = np.concatenate([old_pos, pos[near]])
            names = np.concatenate([old_ids, ids[near]])
            best = np.lexsort((place, -_sort_key(score)))[:k]
            self.found[first + row] = (score[best], place[best], names[best])

    def table(self, keys: pa.Table) -> pa.Table:
        """``keys, rank, id, pos, score``: one row per query and kept candidate."""
        sizes = [len(score) for score, _, _ in self.found]
        taken = keys.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))

        def joined(i: int) -> np.ndarray:
            return np.concatenate([f[i] for f in self.found]) if sizes else np.empty(0)

        ranks = np.concatenate([np.arange(1, s + 1) for s in sizes]) if sizes else np.empty(0)
        for name, values, kind in (("rank", ranks, pa.int32()), ("id", joined(2), pa.string()),
                                   ("pos", joined(1), pa.int64()),
                                   ("score", joined(0), pa.float64())):
            taken = taken.append_column(name, pa.array(values, kind))
        return taken


def _score_blocks(best: _Best, queries: tuple[np.ndarray, np.ndarray],
                  index: pa.Table, metric: str) -> None:
    """Score all queries against an index block, a bounded number of cells at a time."""
    if not index.num_rows or not len(queries[0]):
        return
    vectors, lengths = _matrix(index.column("embedding"))
    pos = index.column("pos").to_numpy()
    ids = index.column("id").to_numpy()
    step = max(1, BLOCK_CELLS // len(pos))
    for at in range(0, len(queries[0]), step):
        part = (queries[0][at:at + step], queries[1][at:at + step])
        best.offer(at, _scores(part, (vectors, lengths), metric), pos, ids)


# ---------------------------------------------------------------------------
# Plans
# ---------------------------------------------------------------------------


def _row_bound(sample: DataFrame, max_rows: int, max_bytes: int) -> int:
    """Rows whose vectors fit into ``max_bytes``, judged by the longest one."""
    width = max(1, sample.agg(F.max(F.size("embedding"))).first()[0] or 1)
    return max(1, min(max_rows, max_bytes // (8 * width + 64)))


def _bounded(df: DataFrame, bound: int) -> pa.Table | None:
    """All rows of ``df`` if there are no more than ``bound``, else ``None``."""
    return df.toArrow().combine_chunks() if at_most(df, bound) else None


def _output(keys: DataFrame) -> T.StructType:
    return T.StructType([*keys.schema.fields, *_MATCH_FIELDS])


def _queries_past_index(queries: DataFrame, keys: Sequence[str], index: pa.Table, k: int,
                        metric: str) -> DataFrame:
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Equal vectors within a batch are scored once.
            vectors, lengths = _matrix(batch.column("embedding"))
            both = np.column_stack([vectors, lengths]) + 0.0
            distinct, which = np.unique(both, axis=0, return_inverse=True)
            best = _Best(len(distinct), k)
            _score_blocks(best, (distinct[:, :-1], distinct[:, -1].astype(lengths.dtype)),
                          shared.value, metric)
            best.found = [best.found[i] for i in which.ravel()]
            table = best.table(pa.Table.from_batches([batch]).select(list(keys)))
            yield from table.to_batches()

    return queries.mapInArrow(run, _output(queries.select(*keys)))


def _merge(partial: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Best ``k`` per query out of the best ``k`` per task."""
    order = Window.partitionBy(*keys).orderBy(
        F.desc(F.floor(F.col("score") * 1e12 + 0.5)), F.asc("pos"))
    return (partial.withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k))


def _index_past_queries(queries: pa.Table, query_keys: DataFrame, keys: Sequence[str],
                        index: DataFrame, k: int, metric: str) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        vectors = _matrix(asked.column("embedding"))
        best = _Best(asked.num_rows, k)
        for batch in batches:
            _score_blocks(best, vectors, pa.Table.from_batches([batch]), metric)
        yield from best.table(asked.select(list(keys))).to_batches()

    return _merge(index.mapInArrow(run, _output(query_keys)), keys, k)


def _block_against_block(queries: DataFrame, keys: Sequence[str], index: DataFrame, k: int,
                         metric: str, block_rows: int) -> DataFrame:
    index_blocks = index.count() // block_rows + 1
    # Every query block is one more copy of the index, so query blocks are larger.
    query_blocks = queries.count() // (4 * block_rows) + 1

    def numbered(n: int) -> Column:
        first, last = (F.lit(i).cast("bigint") for i in (0, n - 1))
        return F.explode(F.sequence(first, last))

    # Blocks come from a hash of the row key, so they are even however skewed the data is.
    pair = ["_index_block", "_query_block"]
    left = index.select(
        "*", F.pmod(F.xxhash64("pos", "id"), F.lit(index_blocks)).alias(pair[0]),
        numbered(query_blocks).alias(pair[1]))
    right = queries.select(
        "*", F.pmod(F.xxhash64(*keys), F.lit(query_blocks)).alias(pair[1]),
        numbered(index_blocks).alias(pair[0]))

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        best = _Best(asked.num_rows, k)
        if asked.num_rows:
            _score_blocks(best, _matrix(asked.column("embedding")), block, metric)
        return best.table(asked.select(list(keys)))

    partial = (left.groupBy(*pair).cogroup(right.groupBy(*pair))
               .applyInArrow(run, _output(queries.select(*keys))))
    return _merge(partial, keys, k)


def first_of_equal(index: DataFrame, k: int) -> DataFrame:
    """The ``k`` first rows of every distinct vector: no later row can be a match.

    The limit applies before the shuffle as well, so a vector shared by a third of all
    rows sends no more than ``k`` rows per task.
    """
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("pos"))
    return index.withColumn("place", place).where(F.col("place") <= k).drop("place")


def top_k(index: DataFrame, queries: DataFrame, k: int | None = 5, metric: str = "cosine",
          carry: Sequence[str] = (), many_equal: bool = False,
          broadcast_rows: int = BROADCAST_ROWS, broadcast_bytes: int = BROADCAST_BYTES,
          block_rows: int = 50_000) -> DataFrame:
    """Best ``k`` index rows per query: ``<query columns>, rank, id, pos, score[, carry]``.

    ``index`` has ``id, pos, embedding``; ``queries`` has ``embedding`` and key columns
    that identify a query. Scores are cosine, or ``1 / (1 + squared distance)`` for
    ``metric="l2"``. Equal scores rank by ``pos``. ``k=None`` means 5; ``k <= 0`` gives no
    rows. ``many_equal`` tells that index vectors repeat a lot (the local embedding), so
    only the first rows of each distinct vector need scoring. ``carry`` names further
    index columns to return.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"Unsupported metric '{metric}'; use cosine or l2.")
    k = 5 if k is None else int(k)
    keys = [c for c in queries.columns if c != "embedding"]
    vectors = index.select("id", "pos", "embedding")
    if k <= 0:
        return _with_carried(queries.sparkSession.createDataFrame(
            [], _output(queries.select(*keys))), index, carry)
    candidates = first_of_equal(vectors, k) if many_equal else vectors
    bound = _row_bound(vectors, broadcast_rows, broadcast_bytes)
    if many_equal:
        candidates.persist()  # counted, then fetched
    small_index = _bounded(candidates, bound)
    if many_equal:
        candidates.unpersist()
    if small_index is not None:
        matches = _queries_past_index(queries, keys, small_index, k, metric)
        return _with_carried(matches, index, carry, small_index.select(["id"]))
    small_queries = _bounded(queries, bound)
    if small_queries is not None:
        matches = _index_past_queries(small_queries, queries.select(*keys), keys, candidates,
                                      k, metric)
        return _with_carried(matches, index, carry)
    matches = _block_against_block(queries, keys, candidates, k, metric, block_rows)
    return _with_carried(matches, index, carry)


def _with_carried(matches: DataFrame, index: DataFrame, carry: Sequence[str],
                  possible_ids: pa.Table | None = None) -> DataFrame:
    """Add index columns to matches. When the possible ids are known and few, only their
    rows are fetched; how those meet the matches is left to their size."""
    if not carry:
        return matches
    payload = index.select("id", *carry)
    if possible_ids is not None:
        ids = index.sparkSession.createDataFrame(possible_ids)
        payload = payload.join(F.broadcast(ids), "id", "left_semi")
    names = [*matches.columns, *carry]
    return matches.join(payload, "id").select(*names)
