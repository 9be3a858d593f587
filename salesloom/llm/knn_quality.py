"""Quality by the votes of nearest labelled neighbours in a latent space.

A text's terms are pairs of character classes that follow each other, and a few counts of its words
and lines (words equal to the one before, words and lines that stand once); no term depends on the
language. Term shares, square-rooted and centred, are projected on the leading singular vectors of
the labelled sample. Labelled vectors are broadcast: at most ``SAMPLE`` rows of ``DIMENSIONS``
numbers. Documents go past them in blocks, the cosines with all labelled vectors are one matrix
product, and the ``NEIGHBOURS`` highest vote with a weight that grows with the cosine.

The sample is the ``SAMPLE`` labelled training rows of least hash; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.text import text_blocks, word_bounds

SAMPLE, DIMENSIONS, NEIGHBOURS, SHARPNESS = 4096, 24, 25, 20.0
BLOCK_ROWS = 256

_MARKS = b".,!?|#*$%&<>\"':;-_/@()[]{}=+~^`\\"
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 5
for _i, _c in enumerate(_MARKS):
    _CLASS[_c] = 6 + _i
_KINDS = 6 + len(_MARKS)
_WORD_TERMS = 4
TERMS = _KINDS * _KINDS + _WORD_TERMS


def term_shares(texts: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows: square roots of term shares; zeros for a text of fewer than two characters."""
    for _, data, offsets in text_blocks(texts):
        kinds = _CLASS[data]
        starts, ends, first = word_bounds(data, offsets)
        raw = data.tobytes()
        out = np.zeros((len(offsets) - 1, TERMS), dtype=np.float32)
        for i in range(len(offsets) - 1):
            own = kinds[offsets[i]:offsets[i + 1]]
            if len(own) < 2:
                continue
            pairs = np.bincount(own[:-1] * _KINDS + own[1:], minlength=_KINDS * _KINDS)
            words = [raw[s:e] for s, e in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])]
            lines = raw[offsets[i]:offsets[i + 1]].split(b"\n")
            n = max(1, len(words))
            again = sum(a == b for a, b in zip(words, words[1:]))
            out[i, :-_WORD_TERMS] = pairs / len(own)
            out[i, -_WORD_TERMS:] = (again / n, len(set(words)) / n, len(set(lines)) / len(lines), min(1.0, n / 1000))
        yield np.sqrt(out)


def _share_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        for block in term_shares(batch.column(1)):
            labels = batch.column(0).slice(done, len(block))
            done += len(block)
            yield pa.RecordBatch.from_arrays([labels, pa.array(list(block), pa.list_(pa.float32()))], names=["y", "shares"])


class NeighbourVotes:
    """Labelled vectors in the latent space."""

    def __init__(self, shares: np.ndarray, labels: np.ndarray) -> None:
        self.labels = labels.astype(np.float64)
        self.prior = float(self.labels.mean()) if len(labels) else 0.5
        self.centre = shares.mean(axis=0) if len(labels) else np.zeros(TERMS, dtype=np.float32)
        centred = shares - self.centre
        if len(labels):
            _, vectors = np.linalg.eigh((centred.T @ centred).astype(np.float64))
            self.axes = vectors[:, ::-1][:, :DIMENSIONS].astype(np.float32)
        else:
            self.axes = np.zeros((TERMS, DIMENSIONS), dtype=np.float32)
        self.points = self._place(shares)

    def _place(self, shares: np.ndarray) -> np.ndarray:
        points = (shares - self.centre) @ self.axes
        points[~shares.any(axis=1)] = 0
        norms = np.linalg.norm(points, axis=1, keepdims=True)
        return points / np.where(norms > 0, norms, 1)

    def scores(self, shares: np.ndarray) -> np.ndarray:
        """Share of the neighbours' weight that is labelled 1; of a text without terms, the sample's share."""
        out = np.full(len(shares), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(shares), BLOCK_ROWS):
            points = self._place(shares[at:at + BLOCK_ROWS])
            cosines = points @ self.points.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.exp(SHARPNESS * (np.take_along_axis(cosines, near, axis=1).astype(np.float64) - 1))
            votes = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
            filled = points.any(axis=1)
            out[at:at + BLOCK_ROWS][filled] = votes[filled]
        return np.clip(out, 0.0, 1.0)


def train(texts: DataFrame, text_col: str, label_col: str) -> NeighbourVotes:
    """From labelled texts, ``SAMPLE`` rows at most."""
    rows = texts.select(F.col(label_col).cast("double").alias("y"), F.col(text_col).cast("string")).mapInArrow(
        _share_rows, "y double, shares array<float>").toArrow()
    if not rows.num_rows:
        return NeighbourVotes(np.zeros((0, TERMS), dtype=np.float32), np.zeros(0))
    shares = np.stack([np.asarray(x, dtype=np.float32) for x in rows.column("shares").to_numpy()])
    # Rows come in no set order; sorting makes sums, and so the axes, the same each time.
    order = np.lexsort(shares.T[::-1])
    return NeighbourVotes(shares[order], rows.column("y").to_numpy()[order])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", folds: int = 3, held_fold: int = 1) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Held out: crc32(id as text) mod ``folds`` is ``held_fold``, a null id counts as the empty text;
    such labels are never read. Labels other than 0 and 1 count for nothing; of several labels of
    an id, the least holds. A null or blank text gets the share of 1 among the sample. Without
    labels, all scores are 0.5.
    """
    def held(name: str):
        return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % folds == held_fold

    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__y"))
    known = known.orderBy(F.xxhash64(F.col("__id").cast("string"), F.lit("sample")), "__id").limit(SAMPLE)
    sample = docs.join(F.broadcast(known), F.col(id_col) == F.col("__id")).select(text_col, "__y", "__id")
    sample = sample.dropDuplicates(["__id"])
    model = docs.sparkSession.sparkContext.broadcast(train(sample, text_col, "__y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = model.value
        for batch in batches:
            scores = [votes.scores(block) for block in term_shares(batch.column(2))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array((scores >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held(id_col).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int")
