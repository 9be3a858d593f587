"""Brown class-based bigram model: words fall into classes by exchange, and a text's probability is
that of its classes in order times that of its words in their classes.

Tokens are the words, A-Z lower-cased, and one end per text. Counts and classes cover all training texts
and all their words.

* The most frequent words are the head: at most ``HEAD`` of them with at most ``HEAD_BYTES`` bytes each on
  average, as many whole bands of counts (``BANDS`` to a doubling) as fit. A table of proven size, which is
  broadcast with its counts and classes. Head and tail differ in how they travel, not in what they get.
* Texts are encoded once: ranks of head words, and ids of the others (63 bits: a hash, and the class the word
  starts in). Words are dealt to blocks: head words by rank, tail words by hash, as many blocks as keep about
  ``BLOCK_USES`` uses in each. A row of the table is a block: words, classes and neighbours packed as numbers,
  so a round handles arrays and no row per word. A word's uses lie in its block, however many they are.
* Texts are read once for the rounds: pairs of head words are counted, and each pair is an entry of the block of
  either word, whatever its uses. Blocks of frequent words are cut into parts of about ``PART_USES`` uses, by neighbour.
* A round counts the classes before and after each word: pairs of head words from these entries, all
  others from the tail's blocks, where a tail word tells its tail neighbours its class by a message. Head
  counts go out as sums per part, or per task and block. Each word then takes the class that explains its neighbours best,
  given all others; of the rest only the matrix of classes and the classes of the head are sent (half of the
  words a round, so that pairs don't change places for ever). Rounds end when both halves together move less
  than ``SETTLED`` of the tokens, or after ``ROUNDS``. The table of a round replaces that of the round before.
* The end is a class of its own. Class transitions are smoothed toward class shares. An unknown word is in the
  class with most words seen once, whose words are smoothed by one: it has what a word never seen has.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from salesloom.llm.storage import cut, prepare, removed, stored
from salesloom.llm.text import folded_words

HEAD, HEAD_BYTES, BANDS = 262_144, 64, 8
CLASSES, ROUNDS, SETTLED = 32, 12, 0.02
SMOOTHING = 10.0
END = ""
_END_CLASS, _WIDTH = 0, CLASSES + 1
#: Cells of a word: a class on the left, or a class on the right.
_LEFT, _RIGHT, _CELLS = 0, _WIDTH, 2 * _WIDTH
#: Words of a head block, whose cells have numbers of 16 bits, and uses of a tail block.
_HEAD_BLOCK, BLOCK_USES = 512, 65_536
#: Uses of a part of a head block. An entry in it is word, side and neighbour in 32 bits, the last in ``_NEAR`` of them,
#: which hold the rank of the end too.
PART_USES, _NEAR = 4_000_000, np.uint32(19)
_NEAR_MASK = np.uint32((1 << 19) - 1)
_FLUSH, _PAIRS = 400_000, 4_000_000
_ROWS, _TASKS, _TEXT_BYTES = 1_000, 128, 8 << 20
#: Head and tail blocks of a partition of a round.
_HEADS_EACH, _TAILS_EACH = 64, 16


def word_id(word: bytes) -> int:
    """Below zero; the last bits are the class to start with, less one."""
    mixed = xxh3_64_intdigest(word) >> 1
    return (mixed - mixed % CLASSES + zlib.crc32(word[-3:]) % CLASSES) - (1 << 63)


def _start(ids: np.ndarray) -> np.ndarray:
    return ids % CLASSES + 1


def _turn(ids: np.ndarray) -> np.ndarray:
    return ids // CLASSES % 2


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> Iterator[pa.RecordBatch]:
        counts = pa.table({"word": pa.chunked_array(words, pa.binary()), "n": pa.chunked_array(numbers, pa.int64())})
        counts = counts.group_by("word", use_threads=False).aggregate([("n", "sum")])
        yield from pa.table({"word": counts["word"].cast(pa.string()), "n": counts["n_sum"]}).to_batches()

    words, numbers, size = [], [], 0
    for batch in batches:
        words.append(pa.array([END.encode()], pa.binary()))
        numbers.append(pa.array([batch.num_rows], pa.int64()))
        for _, _, found in folded_words(batch.column(0), _TEXT_BYTES):
            found, n = found.value_counts().flatten()
            words.append(found)
            numbers.append(n)
            size += len(n)
            if size > 4 * _FLUSH:
                yield from out()
                words, numbers, size = [], [], 0
    if words:
        yield from out()


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts; the end of a text is the empty word."""
    rows = texts.select(F.col(text_col).cast("string")).mapInArrow(_word_counts, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _listed(words: pa.Array) -> list[bytes]:
    """Words without space as Python's bytes, quicker than one by one."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, b" ")[0].as_py().split()


def _packed(numbers: np.ndarray, first: np.ndarray) -> pa.Array:
    """The numbers of each row as bytes; ``first`` are the places of its first ones, and one more at the end."""
    places = (first * numbers.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(places), pa.py_buffer(numbers)])


def _encoded(shared):
    """(.., ranks, tails): 32-bit ranks of a text's tokens, -1 outside the head; 64-bit ids of those outside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = pa.array(shared.value.split("\n") if shared.value else [], pa.string()).cast(pa.binary())
        for batch in batches:
            for row, first, words in folded_words(batch.column(2), _TEXT_BYTES):
                words = words.dictionary_encode()
                own, names = words.indices.to_numpy(), words.dictionary
                known = pc.index_in(names, value_set=head).fill_null(-1).to_numpy()
                outside = np.flatnonzero(known < 0)
                ids = np.zeros(len(names), dtype=np.int64)
                ids[outside] = list(map(word_id, _listed(names.take(pa.array(outside)))))
                ranks = known[own]
                at = np.flatnonzero(ranks < 0)
                rows = len(first) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, rows), batch.column(1).slice(row, rows),
                     _packed(ranks, first), _packed(ids[own[at]], np.searchsorted(at, first))],
                    names=["id", "held_out", "ranks", "tails"])

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            yield batch.slice(k, _ROWS)


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _sequence(ranks: pa.Array, tails: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, ids (below zero) and ends of texts one after the other, and the place behind each text's end."""
    out = _numbers(ranks, np.int32).astype(np.int64)
    out[out < 0] = _numbers(tails, np.int64)
    stops = np.cumsum(pc.binary_length(ranks).to_numpy(zero_copy_only=False) // 4)
    return np.insert(out, stops, end), stops + np.arange(1, len(stops) + 1)


#: A block of the head (below zero) has ``cells`` and ``counts``, or in a part ``pairs`` and ``counts``; one of the tail
#: its ``words`` in order with their ``classes``, ``uses`` and neighbours ``near`` (ranks; -1 for the next id in ``far``),
#: and messages: the cell ``told`` for the word with the number ``to``. On the way a message names its word in ``words``.
#: ``moved`` counts uses whose word changed its class.
_BLOCK = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("moved", pa.int64()), *[(name, pa.binary()) for name in (
    "words", "classes", "uses", "near", "far", "to", "told", "pairs", "cells", "counts", "matrix")]])
_BLOCK_SQL = "block long, part long, moved long, " + ", ".join(f"{name} binary" for name in _BLOCK.names[3:])


def _block_rows(rows: list[dict]) -> pa.RecordBatch:
    packed = [{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in row.items()} for row in rows]
    return pa.RecordBatch.from_pylist(packed, schema=_BLOCK)


def _numbered(row: dict, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[name] or b"", dtype=kind)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The distinct numbers of a sorted array with their places."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)]):
        yield int(keys[a]), slice(a, b)


def _dealt(words: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks of tail words; the low bits of an id hold its class and turn."""
    return (words >> 8) % blocks


def _by_size(numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and counts, of one byte where that will do."""
    for here, kind in ((numbers < 256, np.uint8), (numbers >= 256, np.int64)):
        yield np.flatnonzero(here), numbers[here].astype(kind)


def _sized(row: dict, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a row and their counts, in the size they have."""
    numbers = _numbered(row, name, kind)
    return numbers, _numbered(row, "counts", np.uint8 if len(row["counts"]) == len(numbers) else np.int64)


def _head_rows(at: np.ndarray, found: np.ndarray) -> Iterator[dict]:
    """Counts of the sorted cells ``at`` of the head, by block."""
    for here, n in _by_size(found):
        cells = at[here]
        block = cells // (_HEAD_BLOCK * _CELLS)
        cells = (cells % (_HEAD_BLOCK * _CELLS)).astype(np.uint16)
        yield from ({"block": -1 - b, "cells": cells[k], "counts": n[k]} for b, k in _runs(block))


def _batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 64)):
        yield _block_rows(some)


def _head_contexts(shared):
    """Cells of head words (and the end, the rank behind them) next to head words, from the parts of their pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value.astype(np.uint32)

        def cells() -> Iterator[dict]:
            parts = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
            for block, rows in groupby(parts, itemgetter("block")):
                counts = np.zeros(_HEAD_BLOCK * _CELLS)
                for pairs, n in (_sized(row, "pairs", np.uint32) for row in rows):
                    at = (pairs >> _NEAR) * np.uint32(_WIDTH) + classes[pairs & _NEAR_MASK]
                    counts += np.bincount(at, n, minlength=len(counts))
                at = np.flatnonzero(counts)
                yield from _head_rows((-1 - block) * len(counts) + at, counts[at].astype(np.int64))

        yield from _batched(cells())

    return run


def _uses(end: int, blocks: int, parts: np.ndarray):
    """Pairs of head words as counted entries of the blocks of both, and tail words with the ranks or ids on their left
    and right, one entry per use."""
    def tail(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, near = (np.concatenate(x) for x in zip(*found))
        block = _dealt(words, blocks)
        order = np.argsort(block, kind="stable")
        words, near = words[order], near[order]
        return _block_rows([{"block": b, "part": 0, "words": words[k], "near": near[k]} for b, k in _runs(block[order])])

    def head(found: list[np.ndarray]) -> Iterator[dict]:
        pairs, n = np.unique(np.concatenate(found), return_counts=True)
        block = pairs // (2 * _HEAD_BLOCK << int(_NEAR))
        pairs = (pairs % (2 * _HEAD_BLOCK << int(_NEAR))).astype(np.uint32)
        for b, k in _runs(block):
            part = (pairs[k] & _NEAR_MASK) % parts[b]
            order = np.argsort(part, kind="stable")
            own, numbers = pairs[k][order], n[k][order]
            for p, j in _runs(part[order]):
                yield from _pair_rows(-1 - b, p, own[j], numbers[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size, pairs, n_pairs = [], 0, [], 0
        for batch in _slices(batches):
            right, _ = _sequence(batch.column(0), batch.column(1), end)
            left = np.concatenate(([end], right[:-1]))
            at = np.flatnonzero(right < 0)
            found.append((right[at], np.stack((left[at], right[at + 1]), axis=1)))
            size += len(at)
            both = (left >= 0) & (right >= 0)
            left, right = left[both], right[both]
            pairs += [2 * right << int(_NEAR) | left, 2 * left + 1 << int(_NEAR) | right]
            n_pairs += 2 * len(left)
            if size > _FLUSH:
                yield tail(found)
                found, size = [], 0
            if n_pairs > _PAIRS:
                yield from _batched(head(pairs))
                pairs, n_pairs = [], 0
        if size:
            yield tail(found)
        if n_pairs:
            yield from _batched(head(pairs))

    return run


def _pair_rows(block: int, part: int, pairs: np.ndarray, counts: np.ndarray) -> list[dict]:
    return [{"block": block, "part": part, "pairs": pairs[at], "counts": n} for at, n in _by_size(counts) if len(at)]


def _merged(block: int, part: int, rows: list[dict]) -> list[dict]:
    """The entries of a part of a head block, each once: sorted with their counts in the lower bits."""
    both = np.sort(np.concatenate([pairs.astype(np.int64) << 34 | n for pairs, n in (
        _sized(row, "pairs", np.uint32) for row in rows)]))
    pairs = both >> 34
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    return _pair_rows(block, part, pairs[first].astype(np.uint32), np.add.reduceat(both & (1 << 34) - 1, first))


def _started(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A tail block from all its uses, with the classes to start with; a part of a head block from all its pairs."""
    block, part = (x.as_py() for x in key)
    if block < 0:
        return pa.Table.from_batches([_block_rows(_merged(block, part, table.select(["pairs", "counts"]).to_pylist()))])
    words = _numbers(table.column("words"), np.int64)
    near = _numbers(table.column("near"), np.int64).reshape(-1, 2)
    near = near[np.argsort(words, kind="stable")]
    names, uses = np.unique(words, return_counts=True)
    return pa.Table.from_batches([_block_rows([{
        "block": block, "moved": 0, "words": names, "classes": _start(names).astype(np.uint8),
        "uses": uses.astype(np.int32), "near": np.maximum(near, -1).astype(np.int32), "far": near[near < 0]}])])


def _tail_cells(row: dict, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the word, and cell, of all that is next to the words of a tail block."""
    uses = _numbered(row, "uses", np.int32)
    near = _numbered(row, "near", np.int32).reshape(-1, 2)
    word = np.repeat(np.arange(len(uses)), uses)
    words, cells = [_numbered(row, "to", np.int32)], [_numbered(row, "told", np.uint8)]
    for side, first in ((near[:, 0], _LEFT), (near[:, 1], _RIGHT)):
        known = side >= 0
        words.append(word[known])
        cells.append(first + head[side[known]])
    return np.concatenate(words), np.concatenate(cells)


def _counted(words: np.ndarray, cells: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(words.astype(np.int64) * _CELLS + cells, minlength=size * _CELLS).reshape(size, _CELLS)


def _tail_sent(shared):
    """Tail blocks after their choice, what they count for the head, and their messages to other tail words.

    A pair of tail words is a use of both; each tells the other its class. The choice goes by the classes
    the contexts were counted with (``old``), and is left out before the first round (``gain`` is None).
    """
    def messages(found: list[tuple[np.ndarray, np.ndarray]], blocks: int) -> pa.RecordBatch:
        words, cells = (np.concatenate(x) for x in zip(*found))
        block = _dealt(words, blocks)
        order = np.argsort(block, kind="stable")
        words, cells = words[order], cells[order].astype(np.uint8)
        return _block_rows([{"block": b, "words": words[k], "told": cells[k]} for b, k in _runs(block[order])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old, gain, turn, blocks = shared.value
        found, size, counts, n_counts = [], 0, [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                words, own = _numbered(row, "words", np.int64), _numbered(row, "classes", np.uint8).astype(np.int64)
                uses, moved = _numbered(row, "uses", np.int32), 0
                if gain is not None:
                    best = (_counted(*_tail_cells(row, old), len(words)) @ gain).argmax(axis=1) + 1
                    new = np.where(_turn(words) == turn % 2, best, own)
                    moved, own = int(uses[new != own].sum()), new
                yield _block_rows([{"block": row["block"], "moved": moved, "words": words, "uses": uses,
                                    "classes": own.astype(np.uint8), "near": row["near"], "far": row["far"]}])
                near = _numbered(row, "near", np.int32)
                theirs = (np.repeat(own, uses)[:, None] + (_RIGHT, _LEFT)).ravel()
                known = near >= 0
                counts.append(near[known].astype(np.int64) * _CELLS + theirs[known])
                n_counts += len(counts[-1])
                found.append((_numbered(row, "far", np.int64), theirs[~known]))
                size += len(found[-1][0])
                if size > _FLUSH:
                    yield messages(found, blocks)
                    found, size = [], 0
                if n_counts > _PAIRS:
                    yield from _batched(_head_rows(*np.unique(np.concatenate(counts), return_counts=True)))
                    counts, n_counts = [], 0
        if size:
            yield messages(found, blocks)
        if n_counts:
            yield from _batched(_head_rows(*np.unique(np.concatenate(counts), return_counts=True)))

    return run


def _head_block(table: pa.Table) -> np.ndarray:
    """[word, cell] counts of a head block."""
    counts = np.zeros(_HEAD_BLOCK * _CELLS, dtype=np.int64)
    for row in table.select(["cells", "counts"]).to_pylist():
        at, n = _sized(row, "cells", np.uint16)
        counts[at] += n
    return counts.reshape(_HEAD_BLOCK, _CELLS)


def _head_summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The sum of a part of the rows of a head block; rows of the tail as they are."""
    if key[0].as_py() >= 0:
        return table.select(_BLOCK.names)
    counts = _head_block(table).ravel()
    at = np.flatnonzero(counts)
    rows = [{**row, "block": key[0].as_py()} for row in _head_rows(at, counts[at])]
    return pa.Table.from_batches([_block_rows(rows)])


def _gathered(shared):
    """A block with all that came for it, and its share of the matrix of classes: [left class, class]."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        classes, block = shared.value, key[0].as_py()
        matrix = np.zeros((_WIDTH, _WIDTH), dtype=np.int64)
        if block < 0:
            counts = _head_block(table)
            own = np.zeros(_HEAD_BLOCK, dtype=np.int64)
            here = classes[(-1 - block) * _HEAD_BLOCK:][:_HEAD_BLOCK]
            own[:len(here)] = here
            np.add.at(matrix.T, own, counts[:, _LEFT:_LEFT + _WIDTH])
            at = np.flatnonzero(counts)
            row = {"cells": at.astype(np.uint16), "counts": counts.ravel()[at]}
        else:
            rows = table.to_pylist()
            row = next(r for r in rows if r["uses"] is not None)
            sent = [r for r in rows if r["uses"] is None]
            words = np.frombuffer(b"".join(r["words"] for r in sent), dtype=np.int64)
            row["to"] = np.searchsorted(_numbered(row, "words", np.int64), words).astype(np.int32)
            row["told"] = np.frombuffer(b"".join(r["told"] for r in sent), dtype=np.uint8)
            at, cells = _tail_cells({k: v.tobytes() if k in ("to", "told") else v for k, v in row.items()}, classes)
            left = cells < _WIDTH
            pairs = cells[left].astype(np.int64) * _WIDTH + _numbered(row, "classes", np.uint8)[at[left]]
            matrix = np.bincount(pairs, minlength=_WIDTH * _WIDTH)
        return pa.Table.from_batches([_block_rows([{**row, "block": block, "matrix": matrix}])])

    return run


def _matrix_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the matrix, and of the uses that moved in the cell behind it."""
    total = np.zeros(_WIDTH * _WIDTH + 1, dtype=np.int64)
    for batch in batches:
        for value in batch.column(0):
            total[:-1] += np.frombuffer(value.as_py(), dtype=np.int64)
        total[-1] += pc.sum(batch.column(1)).as_py() or 0
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])


def _head_chosen(shared):
    """(block, classes) of head blocks: the class that explains the neighbours of each word best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                counts = _head_block(pa.Table.from_batches([batch.slice(k, 1)]))
                best = (counts @ gain).argmax(axis=1) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([best.astype(np.uint8).tobytes()], pa.binary())],
                    names=["block", "classes"])

    return run


def _tail_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, uses, classes in zip(*(column.to_pylist() for column in batch.columns)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(words, dtype=np.int64)),
                 pa.array(np.frombuffer(uses, dtype=np.int32).astype(np.int64)),
                 pa.array(np.frombuffer(classes, dtype=np.uint8).astype(np.int64))], names=["word", "n", "class"])


def gains(matrix: np.ndarray) -> np.ndarray:
    """[cell, class]: what a neighbour adds to the likelihood of a word in a class (1 to ``CLASSES``)."""
    counts = matrix + 0.1
    after, own = np.log(counts / counts.sum(axis=1, keepdims=True)), np.log(counts.sum(axis=0))
    return np.concatenate((after - own, after.T))[:, 1:]


class BrownModel:
    """A trained model. ``head`` are words with ``counts`` and ``classes`` (the end is behind them), ``tail`` a table
    (word, n, class) of all others. ``encoded`` are the rows (id, held_out, ranks, tails), held out ones as well."""

    def __init__(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        prepare(spark)
        vocabulary = stored(word_counts(rows.filter("not held_out"), "text"), "vocabulary")
        self.head, self.counts = self._head(vocabulary)
        removed(vocabulary)
        self.ids = np.array([word_id(w.encode()) for w in self.head] + [0], dtype=np.int64)
        self.classes = np.append(_start(self.ids[:-1]), _END_CLASS)
        self.encoded = self._encode(rows)
        self._train(self.encoded.filter("not held_out").select("ranks", "tails"))

    def _train(self, train: DataFrame) -> None:
        self.blocks = 1 + (self.tokens - self.texts - int(self.counts.sum())) // BLOCK_USES
        uses = np.append(self.counts, self.texts)
        self.parts = 1 + 2 * np.add.reduceat(uses, np.arange(0, len(uses), _HEAD_BLOCK)) // PART_USES
        found = train.mapInArrow(_uses(len(self.head), self.blocks, self.parts), _BLOCK_SQL)
        found = found.repartition(1 + self.tokens // (PART_USES // 2), "block", "part")
        self.started = stored(found.groupBy("block", "part").applyInArrow(_started, _BLOCK_SQL), "started")
        table = self._round(self.started, self.classes, None, 0)
        matrix, _ = self._matrix(table)
        self.moves: list[float] = []
        for turn in range(ROUNDS):
            gain, old = gains(matrix), self.classes
            moved = self._choose_head(table, gain, turn)
            last, table = table, self._round(table, old, gain, turn)
            removed(last)
            matrix, tail = self._matrix(table)
            self.moves.append((moved + tail) / max(1, self.tokens))
            if turn and sum(self.moves[-2:]) < SETTLED:
                break
        removed(self.started)
        self.table = table
        self.tail = table.filter("block >= 0").select("words", "uses", "classes").mapInArrow(
            _tail_words, "word long, n long, class long")
        self._estimate(matrix)

    def _head(self, vocabulary: DataFrame) -> tuple[list[str], np.ndarray]:
        """Words with counts, the most frequent first: as many bands of counts as fit."""
        word, band = F.col("word"), F.floor(F.log2("n") * BANDS)
        found = vocabulary.groupBy((word == END).alias("end"), band.alias("band")).agg(
            F.count("*"), F.sum(F.octet_length("word")), F.sum("n")).collect()
        #: All tokens, distinct ones and training texts.
        self.tokens, self.distinct = sum(row[4] for row in found), sum(row[2] for row in found)
        self.texts = sum(row[4] for row in found if row[0])
        bands = [tuple(row)[1:4] for row in found if not row[0]]
        least, held, size = None, 0, 0
        for value, number, octets in sorted(bands, reverse=True):
            held, size = held + number, size + octets
            if held > HEAD or size > HEAD * HEAD_BYTES:
                break
            least = value
        if least is None:
            return [], np.empty(0, dtype=np.int64)
        table = vocabulary.filter((word != END) & (band >= least)).toArrow()
        names, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
        order = sorted(range(len(names)), key=lambda i: (-counts[i], names[i]))
        return [names[i] for i in order], counts[order]

    def _encode(self, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast("\n".join(self.head))
        encoded = rows.mapInArrow(_encoded(shared), "id long, held_out boolean, ranks binary, tails binary")
        out = stored(encoded, "encoded")
        shared.destroy()
        return out

    def _round(self, table: DataFrame, old: np.ndarray, gain: np.ndarray | None, turn: int) -> DataFrame:
        """The blocks after the tail's choice, with contexts for the classes as they are now."""
        context = table.sparkSession.sparkContext
        shared = context.broadcast(self.classes)
        sent = context.broadcast((old, gain, turn, self.blocks))
        tail = table.filter("block >= 0").select(
            "block", "words", "classes", "uses", "near", "far", "to", "told").mapInArrow(_tail_sent(sent), _BLOCK_SQL)
        pairs = self.started.filter("block < 0").select("block", "pairs", "counts")
        found = pairs.mapInArrow(_head_contexts(shared), _BLOCK_SQL).union(tail)
        tasks = int(self.parts.max()) + tail.rdd.getNumPartitions()
        if tasks > _TASKS:  # where very many have rows of a head block, they are summed in parts first
            part = F.when(F.col("block") < 0, F.spark_partition_id() % math.isqrt(tasks)).otherwise(F.lit(0)).cast("long")
            found = found.withColumn("part", part).groupBy("block", "part").applyInArrow(_head_summed, _BLOCK_SQL)
        # A round writes so little that a file for each task and partition would be most of its work: as many as blocks need.
        found = found.repartition(1 + len(self.parts) // _HEADS_EACH + self.blocks // _TAILS_EACH, "block")
        out = stored(found.groupBy("block").applyInArrow(_gathered(shared), _BLOCK_SQL), "classes")
        shared.destroy()
        sent.destroy()
        context._jvm.System.gc()  # Spark removes shuffle files of past rounds when memory is collected
        return out

    def _matrix(self, table: DataFrame) -> tuple[np.ndarray, int]:
        """[left class, class] counts, and the uses of tail words that moved."""
        cells = table.select("matrix", "moved").mapInArrow(_matrix_cells, "cell long, n long")
        out = np.zeros(_WIDTH * _WIDTH + 1)
        for cell, n in cells.groupBy("cell").agg(F.sum("n")).collect():
            out[cell] = n
        return out[:-1].reshape(_WIDTH, _WIDTH), int(out[-1])

    def _choose_head(self, table: DataFrame, gain: np.ndarray, turn: int) -> int:
        """Classes of the head's words of the turn; returns the uses that moved."""
        shared = table.sparkSession.sparkContext.broadcast(gain)
        best = table.filter("block < 0").select("block", "cells", "counts").mapInArrow(
            _head_chosen(shared), "block long, classes binary").toArrow()
        shared.destroy()
        new = self.classes.copy()
        for block, classes in zip(best.column("block").to_pylist(), best.column("classes").to_pylist()):
            here = slice((-1 - block) * _HEAD_BLOCK, (-block) * _HEAD_BLOCK)
            new[here] = np.frombuffer(classes, dtype=np.uint8)[:len(new[here])]
        new = np.where((_turn(self.ids) == turn % 2) & (np.arange(len(new)) < len(self.head)), new, self.classes)
        changed, self.classes = new != self.classes, new
        return int(self.counts[changed[:-1]].sum())

    def _estimate(self, counts: np.ndarray) -> None:
        size = counts.sum(axis=0)
        share = (size + 1) / (size.sum() + len(size))
        self.transition = np.log10((counts + SMOOTHING * share) / (counts.sum(axis=1, keepdims=True) + SMOOTHING))
        words, once = np.zeros(_WIDTH), np.zeros(_WIDTH)
        np.add.at(words, self.classes[:-1], 1)
        np.add.at(once, self.classes[:-1], self.counts == 1)
        for name, n, few in self.tail.groupBy("class").agg(F.count("*"), F.count(F.when(F.col("n") == 1, 1))).collect():
            words[name] += n
            once[name] += few
        #: The class of unknown words, and the totals words are divided by in their classes.
        self.open = int(once[1:].argmax()) + 1
        self.added = np.zeros(_WIDTH)
        self.added[self.open] = 1
        self.totals = np.maximum(1, size + self.added * (words + 1))
        own = self.classes[:-1]
        self.emission = np.log10((self.counts + self.added[own]) / self.totals[own])
        self.base_total = self.tokens + self.distinct + 1
        self.base = np.log10((self.counts + 1) / self.base_total)
        self.base_end = math.log10((int(size[_END_CLASS]) + 1) / self.base_total)


def _head_scores(shared):
    """Scores of what the head covers, and the tail words, in order: (place, word, class on the left and right).

    A neighbour in the tail has the class -1; the left one of two counts the step between them.
    """
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
                        ("tail", pa.list_(pa.struct([("place", pa.int64()), ("word", pa.int64()),
                                                     ("left", pa.int64()), ("right", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, transition, emission, base, base_end, end_known = shared.value
        emission, base = np.append(emission, 0.0), np.append(base, base_end)
        for batch in _slices(batches):
            words, stops = _sequence(batch.column(2), batch.column(3), len(classes) - 1)
            starts = np.concatenate(([0], stops[:-1]))
            known = words >= 0
            path = np.where(known, classes[np.maximum(words, 0)], -1)
            left = np.concatenate(([_END_CLASS], path[:-1]))
            ranks = np.maximum(words, 0)
            own = np.where(known, emission[ranks], 0.0)
            step = np.where((path >= 0) & (left >= 0), transition[left, path], 0.0)
            n_known = np.add.reduceat(known.astype(np.int64), starts) - 1 + end_known
            at = np.flatnonzero(~known)
            tail = pa.StructArray.from_arrays(
                [pa.array(at), pa.array(words[at]), pa.array(left[at]), pa.array(path[at + 1])],
                fields=list(schema.field("tail").type.value_type))
            offsets = np.concatenate(([0], np.searchsorted(at, stops))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(stops - starts), pa.array(n_known),
                 pa.array(np.add.reduceat(np.where(known, base[ranks], 0.0), starts)),
                 pa.array(np.add.reduceat(own + step, starts)),
                 pa.ListArray.from_arrays(pa.array(offsets), tail, type=schema.field("tail").type)], schema=schema)

    return run


def _tail_steps(shared):
    """(row, steps): the transitions into and out of a row's tail words; ``uses`` are (place, class, left, right)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition = shared.value
        for batch in batches:
            row = pc.list_parent_indices(batch.column(1)).to_numpy()
            place, own, left, right = (x.to_numpy(zero_copy_only=False) for x in batch.column(1).flatten().flatten())
            follows = np.concatenate((own[1:], [0]))
            steps = np.where(left >= 0, transition[left, own], 0.0) + transition[own, np.where(right >= 0, right, follows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.bincount(row, steps, batch.num_rows))], names=["row", "steps"])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7,
                held_fold: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(id as text) mod ``folds`` is ``held_fold`` are held out, all others train the
    model; a null id counts as the empty text. A null text is the end alone. Without training rows
    nothing is known. Rows that repeat an id are scored each for itself.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == held_fold
    model = BrownModel(docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"),
                                   F.col(text_col).cast("string").alias("text")))
    shared = spark.sparkContext.broadcast((model.classes, model.transition, model.emission, model.base,
                                           model.base_end, int(model.tokens > 0)))
    scored = cut(model.encoded.mapInArrow(_head_scores(shared), (
        "id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
        "tail array<struct<place:long,word:long,left:long,right:long>>"))
        .withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    added, totals = (F.array(*[F.lit(float(x)) for x in values]) for values in (model.added, model.totals))
    tail = scored.select("row", F.inline("tail")).join(model.tail, "word", "left")
    tail = tail.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("class", F.coalesce("class", F.lit(model.open)))
    own = F.log10((F.col("n") + F.get(added, F.col("class").cast("int"))) / F.get(totals, F.col("class").cast("int")))
    sums = cut(tail.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("place", "class", "left", "right"))).alias("uses"),
        F.sum((F.col("n") > 0).cast("long")).alias("known"),
        F.sum(F.log10((F.col("n") + 1) / F.lit(float(model.base_total)))).alias("base_tail"),
        F.sum(own).alias("own_tail")))
    shared = spark.sparkContext.broadcast(model.transition)
    removed(model.encoded)
    removed(model.table)
    steps = sums.select("row", "uses").mapInArrow(_tail_steps(shared), "row long, steps double")
    out = scored.drop("tail").join(sums.drop("uses"), "row", "left").join(steps, "row", "left")
    return out.select("id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                      F.lit(model.tokens).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("base_tail", F.lit(0.0))).alias("base_score"),
                      (F.col("score") + F.coalesce("own_tail", F.lit(0.0)) + F.coalesce("steps", F.lit(0.0))).alias("score"))
