"""Words of texts: as SQL expressions, and as 64-bit hashes of Arrow batches.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``. The hashes are computed for
a block of texts at once, from prefix sums of a polynomial modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_PATTERN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE, _GRAM_BASE, _LENGTH = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0x2545F4914F6CDD1D
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once per row however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), "")


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    if kind not in _POWERS or len(_POWERS[kind]) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[kind] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[kind]


def text_blocks(texts: pa.Array, block_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, row offsets in them) of consecutive rows; a long text is alone."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each row's first word (one more at the end)."""
    letter = ~_IS_SPACE[data]
    begins, stops = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    stops[:-1] &= ~letter[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = letter[cuts]
    stops[cuts - 1] = letter[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def folded_words(texts: pa.Array, block_bytes: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(first row, index of each row's first word and one more at the end, words) of consecutive rows; A-Z lower-cased."""
    for row, data, offsets in text_blocks(texts, block_bytes):
        starts, ends, first = word_bounds(data, offsets)
        letters = data.tobytes().translate(_FOLD.tobytes(), b"\t\n\v\f\r ")
        places = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        yield row, first, pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)])


def hashed_words(texts: pa.Array, fold: bool = False) -> Iterator[np.ndarray]:
    """For every text in order, the hashes of its words; ``fold`` lower-cases A-Z first."""
    for _, data, offsets in text_blocks(texts):
        if not len(data):
            yield from (np.empty(0, dtype=np.uint64) for _ in offsets[1:])
            continue
        starts, ends, first = word_bounds(data, offsets)
        letters = (_FOLD[data] if fold else data).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(letters * _powers("up", _BASE, len(data))[:len(data)], out=sums[1:])
        down = _powers("down", pow(_BASE, -1, 1 << 64), len(data))
        hashes = mix((sums[ends] - sums[starts]) * down[starts]
                     + (ends - starts).astype(np.uint64) * np.uint64(_LENGTH))
        for i in range(len(offsets) - 1):
            yield hashes[first[i]:first[i + 1]]


def grams(hashes: np.ndarray, size: int, base: int = _GRAM_BASE) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words; none if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0 or size <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= np.uint64(base)
        out += hashes[j:j + n]
    return mix(out + np.uint64(size * _LENGTH % (1 << 64)))
