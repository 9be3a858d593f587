"""Exact duplicates by radix tries over whole texts.

* Reading: texts that repeat within a task travel once. Every row is noted with the number of its text, every
  text with its bytes, the row that stays so far, and how many rows it stands for. Both are one stored table.
* Owners: texts are dealt by their length and content hash, so equal texts meet. An owner puts the full bytes
  into a compressed radix trie; the node at which a text ends holds the row that stays and the count. Equality
  is decided by the bytes on the path, never by a hash.
* Spill: a trie above its budget gives up its largest subtrees. Their texts, and all that come later below
  the same prefixes, are rows of the next pass, which deals them anew, until none are left.
* Every number of a text gets its group's row and size. A group of any size sends one text per task and
  ``READ_BYTES``; its members meet again by the numbers, which a hot group has many of.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.storage import stored

#: Bytes of distinct texts that a reading task remembers, bytes of one trie, and what a node counts besides its label.
READ_BYTES, TRIE_BYTES, NODE_BYTES = 32 << 20, 64 << 20, 300
#: Texts of one owner.
OWNED = 20_000
_BATCH = 4 << 20

_READ = "doc long, row long, no long, held int, size long, text binary, sha string"
_OWNED = "no long, keep long, keep_row long, size long, text binary, members array<long>"


class Node:
    """``label`` are the bytes that lead here; ``end`` is [id, row, rows, numbers] of the text that ends here."""

    __slots__ = ("label", "children", "end", "given_up")

    def __init__(self, label: bytes) -> None:
        self.label, self.children, self.end, self.given_up = label, {}, None, False


def _shared(label: bytes, text: bytes, at: int) -> int:
    """Leading bytes that ``label`` and ``text`` from ``at`` on have in common, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def better(one: tuple, other: tuple, largest: bool) -> bool:
    """Whether the row ``one`` stays rather than ``other``; both are (id, row). A null id stays last, of equal ids
    the first row stays."""
    (a, i), (b, j) = one, other
    if a is None or b is None or a == b:
        return a is not None if (a is None) != (b is None) else i < j
    return (a > b) == largest


class RadixTrie:
    """Texts with the row that stays of each; ``insert`` is false for a text below a subtree that was given up."""

    def __init__(self, largest: bool, budget: int = TRIE_BYTES) -> None:
        self.largest, self.budget, self.root, self.size = largest, budget, Node(b""), NODE_BYTES

    def insert(self, text: bytes, name: int | None, row: int, rows: int, numbers: list[int]) -> bool:
        node, at = self.root, 0
        while at < len(text) and not node.given_up:
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += len(text) - at + NODE_BYTES
            elif not text.startswith(child.label, at):
                n = _shared(child.label, text, at)
                middle = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                node.children[text[at]] = child = middle
                self.size += NODE_BYTES
            node = child
            at += len(child.label)
        if node.given_up:
            return False
        if node.end is None:
            node.end = [name, row, rows, numbers]
        else:
            if better((name, row), (node.end[0], node.end[1]), self.largest):
                node.end[0], node.end[1] = name, row
            node.end[2] += rows
            node.end[3] += numbers
        self.size += 8 * len(numbers)
        return True

    def texts(self, node: Node, path: bytes) -> Iterator[tuple[bytes, list]]:
        """All texts at and below ``node``, whose path is ``path``."""
        stack = [(node, path)]
        while stack:
            node, path = stack.pop()
            if node.end is not None:
                yield path, node.end
            stack.extend((child, path + child.label) for child in node.children.values())

    def _weights(self) -> dict[int, int]:
        """Bytes at and below every node, by its identity."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children.values())
        weights: dict[int, int] = {}
        for node in reversed(order):
            own = len(node.label) + NODE_BYTES + (8 * len(node.end[3]) if node.end else 0)
            weights[id(node)] = own + sum(weights[id(child)] for child in node.children.values())
        return weights

    def give_up(self) -> Iterator[tuple[bytes, list]]:
        """(text, end) of the largest subtrees, until half of the budget is left.

        Below the root; where one subtree is nearly all, its parts. A text that ends inside the path stays.
        """
        weights = self._weights()
        open_nodes = [(child, child.label) for child in self.root.children.values()]
        while self.size > self.budget // 2 and open_nodes:
            open_nodes.sort(key=lambda x: weights[id(x[0])])
            node, path = open_nodes.pop()
            if weights[id(node)] > self.budget // 4 and len(node.children) > 1:
                open_nodes.extend((child, path + child.label) for child in node.children.values())
                continue
            if node.given_up:
                continue
            yield from self.texts(node, path)
            self.size -= weights[id(node)] - NODE_BYTES - len(node.label)
            node.children, node.end, node.given_up = {}, None, True


def _read(largest: bool):
    """A row per document, and a row with the bytes for each text of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("no", pa.int64()), ("held", pa.int32()),
                            ("size", pa.int64()), ("text", pa.binary()), ("sha", pa.string())])
        row = number = TaskContext.get().partitionId() << 33
        known: dict[bytes, list] = {}
        held = 0

        def texts() -> Iterator[pa.RecordBatch]:
            rows = [(name, at, no, 1, n, text, None) for text, (name, at, no, n, _) in known.items()]
            yield from packed(rows, schema)

        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = known.get(text)
                if found is None:
                    sha = hashlib.sha256(text).hexdigest()
                    known[text] = found = [name, row, number, 0, sha]
                    held += len(text)
                    number += 1
                elif better((name, row), (found[0], found[1]), largest):
                    found[0], found[1] = name, row
                found[3] += 1
                rows.append((name, row, found[2], 0, None, None, found[4]))
                row += 1
                if held > READ_BYTES:
                    yield from texts()
                    known, held = {}, 0
            yield from packed(rows, schema)
        yield from texts()

    return run


def packed(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows``, each of a few MB of text unless a text is longer; the text is the column ``text``."""
    at, first, size = schema.get_field_index("text"), 0, 0
    for k, row in enumerate(rows):
        size += len(row[at] or b"") + 64
        if size > _BATCH or k == len(rows) - 1:
            columns = zip(*rows[first:k + 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            first, size = k + 1, 0


def _owned(largest: bool, budget: int):
    """Numbers with their group's row and size; and texts given up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("no", pa.int64()), ("keep", pa.int64()), ("keep_row", pa.int64()), ("size", pa.int64()),
                            ("text", pa.binary()), ("members", pa.list_(pa.int64()))])
        trie = RadixTrie(largest, budget)
        for batch in batches:
            rows = []
            for text, name, row, size, members in zip(*(c.to_pylist() for c in batch.columns)):
                if not trie.insert(text, name, row, size, members):
                    rows.append((None, name, row, size, text, members))
                elif trie.size > budget:
                    for spilled, (*end, numbers) in trie.give_up():
                        rows.append((None, *end, spilled, numbers))
                if len(rows) > 1000:
                    yield from packed(rows, schema)
                    rows = []
            yield from packed(rows, schema)
        rows = []
        for _, (name, row, size, members) in trie.texts(trie.root, b""):
            rows.extend((no, name, row, size, None, None) for no in members)
            if len(rows) > 10_000:
                yield from packed(rows, schema)
                rows = []
        yield from packed(rows, schema)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(id, keep_id, size, kept, sha) of every row: of the rows with the same text, the one that stays, and their number.

    ``keep`` is "min" or "max": the row with the least or largest id stays; rows without an id only if none has one,
    and of rows that repeat an id the first. A null text counts as empty; nothing else is changed. ``sha`` is the
    lowercase SHA-256 of the text in UTF-8. Other columns of ``docs`` are not read. An empty table gives no rows.
    A text of any length that Spark can hold is compared whole; a budget that no text fits is doubled.
    """
    largest = {"min": False, "max": True}[keep]
    rows = docs.select(F.col(id_col).cast("long").alias("doc"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    read = stored(rows.mapInArrow(_read(largest), _READ), "texts")
    texts = read.filter("held = 1").select("text", F.col("doc").alias("keep"), F.col("row").alias("keep_row"), "size",
                                           F.array("no").alias("members"))
    left, found = texts.count(), []
    dealt = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while left:
        owners = max(dealt, -(-left // OWNED))
        dealt_by = F.octet_length("text"), F.xxhash64(F.lit(len(found)), "text")
        spread = texts.repartition(owners, *dealt_by)
        done = stored(spread.mapInArrow(_owned(largest, trie_bytes), _OWNED), "owned")
        found.append(done.filter("no IS NOT NULL").select("no", "keep", "keep_row", "size"))
        again = done.filter("no IS NULL")
        texts = again.select("text", "keep", "keep_row", "size", "members")
        before, left = left, again.count()
        if left >= before:
            trie_bytes *= 2
    members = read.filter("held = 0").select("doc", "row", "no", "sha")
    if not found:
        return members.select(F.col("doc").alias("id"), F.col("doc").alias("keep_id"), F.col("row").alias("size"),
                              F.lit(True).alias("kept"), "sha")
    groups = found[0]
    for more in found[1:]:
        groups = groups.unionByName(more)
    return members.join(groups, "no").select(
        F.col("doc").alias("id"), F.col("keep").alias("keep_id"), "size",
        (F.col("row") == F.col("keep_row")).alias("kept"), "sha")
