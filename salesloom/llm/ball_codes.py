"""Codes of vectors by product quantisation, codebooks trained by ball k-means.

Vectors are cut into parts, and each part position has a codebook. Everything is in whole numbers, so that sums
do not depend on the order of rows, and ties are real ties: they go to the lower index.

* The parts that have an entry form its ball. With the new entries, a part's own distance is computed first; the
  ball's radius is the largest of them. Entries nearer to the ball's entry than twice the radius, and only they,
  are its neighbours.
* A part nearer to its entry than half of the way to the nearest neighbour is in the stable core: nothing else is
  computed for it. Around the core lie rings; in the k-th ring only the k nearest neighbours can be nearer.
  Half ways count as ties, so rings close at the exact half.
* A ball is looked at as far as its parts are in one batch; its radius there is at most that of the whole ball,
  and what it rules out is ruled out exactly.
* A round is one pass that stores vectors with their codes, and a sum per entry. Only codebooks travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.storage import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of vectors, floored; beyond it squared distances could leave 64 bits.
LARGEST = 1 << 26
#: Labels whose sums are broadcast at most.
LABELS = 100_000
_SCHEMA = "id long, label string, v binary, code binary, error long, sums binary"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, v) of rows whose vector has finite components only: floors of ``scale`` times each component."""
    number = F.col(vector_col).cast("array<double>")
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                      number.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return out.filter(F.col("v").isNotNull() & finite).withColumn(
        "v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))


def _dimension(vectors: DataFrame, parts: int) -> int:
    """The length of most vectors, the largest at a tie; 0 without vectors."""
    found = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = found.n if found else 0
    if n % parts:
        raise ValueError(f"vectors of {n} components cannot be cut into {parts} equal parts")
    return n


def nearest(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For parts [n, width], the index of the nearest of the entries [k, width]; all are compared."""
    best = np.zeros(len(parts), dtype=np.int64)
    least = np.full(len(parts), np.iinfo(np.int64).max)
    for k, entry in enumerate(book):
        far = ((parts - entry) ** 2).sum(axis=1)
        nearer = far < least
        best[nearer], least[nearer] = k, far[nearer]
    return best


class Balls:
    """One codebook, with every entry's other entries by distance."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        between = ((book[:, None] - book[None]) ** 2).sum(axis=2)
        np.fill_diagonal(between, -1)
        self.order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.way = np.take_along_axis(between, self.order, axis=1)

    def moved(self, parts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest entries of parts that had the entries ``own``, and how many distances it took."""
        far = ((parts - self.book[own]) ** 2).sum(axis=1)
        rings = np.zeros(len(parts), dtype=np.int64)
        by_entry = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[by_entry], np.arange(len(self.book) + 1))
        for entry in np.flatnonzero(bounds[1:] > bounds[:-1]):
            ball = by_entry[bounds[entry]:bounds[entry + 1]]
            neighbours = int(np.searchsorted(self.way[entry], 4 * far[ball].max(), side="right"))
            if neighbours:
                rings[ball] = np.searchsorted(self.way[entry, :neighbours], 4 * far[ball], side="right")
        best, least, looked = own.copy(), far.copy(), len(parts)
        outside = np.flatnonzero(rings)
        ring = 0
        while len(outside):
            looked += len(outside)
            other = self.order[own[outside], ring]
            there = ((parts[outside] - self.book[other]) ** 2).sum(axis=1)
            nearer = (there < least[outside]) | ((there == least[outside]) & (other < best[outside]))
            at = outside[nearer]
            best[at], least[at] = other[nearer], there[nearer]
            ring += 1
            outside = outside[rings[outside] > ring]
        return best, looked


def _assign(shared, parts: int):
    """Rows with their codes and errors, and per task a row with the sums and counts of all entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        balls = [Balls(book) for book in books]
        sums = np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
        schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("v", pa.binary()), ("code", pa.binary()),
                            ("error", pa.int64()), ("sums", pa.binary())])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.int32).astype(np.int64)
            vectors = vectors.reshape(n, parts, -1)
            had = batch.column(3)
            codes = np.empty((n, parts), dtype=np.uint8)
            error = np.zeros(n, dtype=np.int64)
            old = None if had.null_count else np.frombuffer(
                b"".join(had.to_pylist()), dtype=np.uint8).reshape(n, parts).astype(np.int64)
            for p in range(parts):
                own = np.ascontiguousarray(vectors[:, p])
                best = nearest(own, books[p]) if old is None else balls[p].moved(own, old[:, p])[0]
                codes[:, p] = best
                error += ((own - books[p][best]) ** 2).sum(axis=1)
                np.add.at(sums[p], best, np.concatenate((own, np.ones((n, 1), dtype=np.int64)), axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(error), pa.nulls(n, pa.binary())], schema=schema)
        yield pa.RecordBatch.from_pylist([{"sums": sums.tobytes()}], schema=schema)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
        if max(rows.max(), -(rows.min() + 1)) >= LARGEST:
            raise ValueError(f"components of {LARGEST} and more in size after scaling: exact distances need more than 64 bits")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in rows.astype(np.int32)], pa.binary())],
            names=["id", "label", "v"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of sums as rows (cell, n)."""
    total = None
    for batch in batches:
        for value in batch.column(0).to_pylist():
            found = np.frombuffer(value, dtype=np.int64)
            total = found.copy() if total is None else total + found
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])


def _next_books(books: np.ndarray, rows: DataFrame) -> np.ndarray:
    """Every used entry as the floor of the mean of its parts; ``parts x entries x (width + 1)`` numbers reach the driver."""
    cells = rows.filter("sums IS NOT NULL").select("sums").mapInArrow(_cells, "cell long, n long")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
    sums.reshape(-1)[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def part_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
               parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row with a vector of finite components.

    Codebooks start as the parts of the ``entries`` (256 at most) rows of least id (nulls last, equal ids by their
    vectors), of fewer if there are fewer; each row counts, repeated ones too. Left out are rows whose vector is null,
    holds a null or a number that is not finite, or has another length than most vectors (an empty vector, say).
    ``label_error`` adds up over equal labels, null ones together. An empty table gives no rows. Lengths that
    ``parts`` does not divide, and components from ``LARGEST`` on after scaling, raise an error. Columns besides the
    three named are not read, so their names do not matter.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, label_col, scale)
    size = _dimension(vectors, parts)
    vectors = vectors.filter(F.size("v") == size)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect() if size else []
    books = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2) \
        if first else np.zeros((parts, 0, 1), dtype=np.int64)
    if not first:
        return vectors.limit(0).select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                       F.lit(0).cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
    now = vectors.mapInArrow(_packed, "id long, label string, v binary").withColumn("code", F.lit(None).cast("binary"))
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(books))
        out = stored(now.mapInArrow(_assign(shared, parts), _SCHEMA), "codes")
        shared.destroy()
        if turn < rounds:
            books = _next_books(books, out)
        now = out.filter("sums IS NULL").select("id", "label", "v", "code")
    coded = out.filter("sums IS NULL").select("id", "label", F.lower(F.hex("code")).alias("code"), "error")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if by_label.count() <= LABELS:
        by_label = F.broadcast(by_label)
    by_label = by_label.withColumnRenamed("label", "its_label")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("its_label")))
    return joined.select("id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
