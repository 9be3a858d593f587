"""The trie of conversation prefixes, with aggregates per node, by a splitter skeleton.

* A turn is a digest of its role and text (16 bytes of SHA-256) and a number of words; texts stay where they are
  read. A conversation is its path: the digests of its turns in order, so that paths sort as the trie does.
* Some paths of a sample, at even distances, are splitters: they cut the sorted conversations into shards of much
  the same size. A node whose conversations lie in two shards is a prefix of the splitter between them. So the trie
  of the splitter paths, the skeleton, is all that shards share; it is broadcast.
* A shard is sorted by path and conversation, which splits equal paths as well, and finishes all its nodes that
  are not in the skeleton in one walk. Of skeleton nodes it gives partial aggregates: members, children and leaves
  of its own, tokens saved below, and the members that end there, in pieces of text.
* Partial aggregates of the skeleton are added up; a bottom-up walk over it on the driver settles its leaves,
  children and tokens. Ends of a skeleton node are digested piece by piece in order, in one stream per node.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.storage import stored
from salesloom.llm.text import words

#: Bytes of a turn's digest. Turns of a shard, sampled paths per shard, and bytes of the skeleton's paths at most.
TURN, SHARD_TURNS, SAMPLED, SKELETON_BYTES = 16, 200_000, 20, 32 << 20
#: Longer paths are no splitters.
LONGEST_SPLITTER = 4096 * TURN
#: Numbers in a piece of a skeleton node's ends.
PIECE = 5_000
NOTHING = hashlib.sha256(b"").hexdigest()

_PATH = "struct<turn:binary,words:int>"
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, skeleton long, parent_skeleton long, words long, seq long, piece string")
_NAMES = [part.split()[0] for part in _NODE.split(", ")]
_NODE_SCHEMA = pa.schema([(part.split()[0], pa.string() if part.endswith("string") else pa.int64())
                          for part in _NODE.split(", ")])


def paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(conv_id, turns) per conversation; ``turns`` are digests with numbers of words, by turn, null first.

    A null role or text becomes empty. Equal turn numbers are in the order of the digests. Rows without a conv_id
    belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("at"),
        F.unhex(F.substring(F.sha2(named, 256), 1, 2 * TURN)).alias("turn"),
        F.size(words(text)).alias("words"))
    sorted_turns = F.array_sort(F.collect_list(F.struct(
        F.col("at").isNotNull().alias("known"), "at", "turn", "words")))
    rows = rows.groupBy("conv_id").agg(sorted_turns.alias("turns"))
    return rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t.turn.alias("turn"), t.words.alias("words"))))


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4, **columns: str) -> DataFrame:
    """(conv_id, turns) of every conversation c, rebuilt: the first h original turns of conversation c - c % ``block``
    (all if it has fewer, none if there is none), then c's own turns after its first h; h = crc32(c as text) % ``heads``.
    """
    own = paths(turns, **columns)
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    first = own.filter(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("donor"), F.slice("turns", 1, heads - 1).alias("head"))
    rows = own.withColumn("donor", F.col("conv_id") - F.col("conv_id") % block).join(first, "donor", "left")
    none = F.array().cast(f"array<{_PATH}>")
    head = F.slice(F.coalesce("head", none), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return rows.select("conv_id", F.concat(head, rest).alias("turns"))


class Skeleton:
    """The trie of splitter paths. Nodes are numbered; 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]) -> None:
        self.splitters = splitters
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth = [-1], [0]
        self.own = [self._add(path) for path, _ in splitters]

    def _add(self, path: bytes) -> list[int]:
        """The nodes on ``path``, from the root."""
        nodes = [0]
        for at in range(0, len(path), TURN):
            turn, here = path[at:at + TURN], nodes[-1]
            if turn not in self.children[here]:
                self.children[here][turn] = len(self.parent)
                self.children.append({})
                self.parent.append(here)
                self.depth.append(self.depth[here] + 1)
            nodes.append(self.children[here][turn])
        return nodes


def splitters(conversations: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Keys (path, conv_id) that cut the sorted conversations into ``shards`` parts of much the same size, from the
    ``SAMPLED`` conversations per shard of least hash; fewer where their paths are more than ``SKELETON_BYTES``."""
    if shards < 2:
        return []
    rows = conversations.filter(F.octet_length("path") <= LONGEST_SPLITTER).orderBy(
        F.xxhash64("conv_id"), "conv_id").select("path", "conv_id").limit(SAMPLED * shards).collect()
    keys = sorted((bytes(r.path), r.conv_id) for r in rows)
    step = max(1, len(keys) // shards)
    chosen = keys[step::step][:shards - 1]
    while sum(len(path) for path, _ in chosen) > SKELETON_BYTES:
        chosen = chosen[1::2]
    return chosen


def _shards(shared):
    """Rows with the number of their shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value.splitters
        for batch in batches:
            keys = zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([bisect_right(cuts, key) for key in keys], pa.int32())],
                names=["conv_id", "path", "words", "shard"])

    return run


class _Open:
    """A node on the path of the walk, or a skeleton node."""

    __slots__ = ("least", "depth", "convs", "children", "leaves", "saved", "words", "digest", "ends", "skeleton", "waiting")

    def __init__(self, depth: int, words: int, skeleton: int | None) -> None:
        self.least, self.depth, self.words, self.skeleton = None, depth, words, skeleton
        self.convs = self.children = self.leaves = self.saved = 0
        self.digest, self.ends, self.waiting = None, [], []


class _Walk:
    """Nodes of one shard, whose conversations come sorted by path and conv_id."""

    def __init__(self, skeleton: Skeleton, shard: int) -> None:
        self.skeleton, self.shard, self.out = skeleton, shard, []
        self.pieces = 0
        self.before, self.open = b"", [_Open(0, 0, 0)]

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        shared, most = 0, min(len(path), len(self.before))
        while shared < most and path[shared:shared + TURN] == self.before[shared:shared + TURN]:
            shared += TURN
        while len(self.open) - 1 > shared // TURN:
            self.close()
        for depth in range(len(self.open), len(path) // TURN + 1):
            above, own = self.open[-1].skeleton, None
            if above is not None:
                own = self.skeleton.children[above].get(path[(depth - 1) * TURN:depth * TURN])
            self.open.append(_Open(depth, words[depth - 1], own))
        self.before = path
        last = self.open[-1]
        for node in self.open:
            node.convs += 1
            if node.least is None or conv < node.least:
                node.least = conv
        if last.skeleton is not None:
            last.ends.append(conv)
            if len(last.ends) >= PIECE:
                self._piece(last)
        elif last.digest is None:
            last.digest = hashlib.sha256(str(conv).encode())
        else:
            last.digest.update(f",{conv}".encode())

    def _row(self, **values) -> dict:
        self.out.append(values)
        return values

    def _piece(self, node: _Open) -> None:
        if node.ends:
            self._row(skeleton=node.skeleton, seq=(self.shard << 32) + self.pieces, piece=",".join(map(str, node.ends)))
            self.pieces += 1
            node.ends = []

    def close(self) -> None:
        """The last open node is done; its row waits in the parent, whose least member is not known yet."""
        node = self.open.pop()
        above = self.open[-1] if self.open else None
        if node.skeleton is not None:
            self._piece(node)
            self._row(skeleton=node.skeleton, conv_id=node.least, depth=node.depth, n_convs=node.convs,
                      n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, words=node.words)
        else:
            node.saved += (node.convs - 1) * node.words
            node.leaves = node.leaves or 1
            row = self._row(conv_id=node.least, depth=node.depth, n_convs=node.convs, n_children=node.children,
                            n_leaves=node.leaves, saved_tokens=node.saved,
                            ends_sha256=node.digest.hexdigest() if node.digest else NOTHING,
                            parent_skeleton=above.skeleton)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            if above.skeleton is None:
                above.waiting.append(row)
        for row in node.waiting:
            row["parent_conv_id"] = node.least

    def finish(self) -> list[dict]:
        while self.open:
            self.close()
        return self.out


def _walked(shared):
    """Finished nodes, partial aggregates of skeleton nodes, and pieces of their ends."""
    def rows(walk: _Walk) -> Iterator[pa.RecordBatch]:
        found = walk.finish()
        for k in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_pylist(found[k:k + 10_000], schema=_NODE_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            for conv, path, counts, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if walk is None or walk.shard != shard:
                    if walk is not None:
                        yield from rows(walk)
                    walk = _Walk(shared.value, shard)
                walk.add(conv, path, counts)
        if walk is not None:
            yield from rows(walk)

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(skeleton, ends_sha256) of pieces that come in order."""
    now, digest = None, None
    out = []
    for batch in batches:
        for node, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
    if digest is not None:
        out.append((now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())],
        names=["skeleton", "ends_sha256"])


def _settled(skeleton: Skeleton, partial: list) -> list[tuple]:
    """Whole rows of the skeleton nodes from their added-up parts, deepest first."""
    node = {r.skeleton: r.asDict() for r in partial}
    for number in sorted(node, key=lambda k: -skeleton.depth[k]):
        own, above = node[number], node.get(skeleton.parent[number])
        own["n_leaves"] = own["n_leaves"] or 1
        own["saved_tokens"] += (own["n_convs"] - 1) * own["words"]
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += own["n_leaves"]
            above["saved_tokens"] += own["saved_tokens"]
    return [(k, r["conv_id"], skeleton.depth[k], node[skeleton.parent[k]]["conv_id"] if k else None, r["n_convs"],
             r["n_children"], r["n_leaves"], r["saved_tokens"]) for k, r in node.items()]


def trie_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``conversations`` are rows (conv_id, turns) as :func:`paths` gives them, each conv_id once. A node is a distinct
    sequence of first turns; the root has none, and is the only node if all conversations are turnless. ``conv_id``
    is the smallest member; ``saved_tokens`` adds up (members - 1) x words of the last turn over the subtree;
    ``ends_sha256`` is the digest of the decimal conv_ids that end at the node, ascending, joined by commas. No
    conversations give no nodes. A conversation is one row of about 20 bytes per turn, whatever its texts' lengths;
    a row can hold 2 GB. Columns besides the named ones are not read, so their names do not matter.
    """
    spark = conversations.sparkSession
    kept = stored(conversations.select(
        "conv_id", F.concat(F.lit(b""), F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t.turn)), ""))).alias("path"),
        F.transform("turns", lambda t: t.words).alias("words")), "paths")
    total = kept.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_turns)) if total else 1
    skeleton = Skeleton(splitters(kept, shards))
    shared = spark.sparkContext.broadcast(skeleton)
    dealt = kept.mapInArrow(_shards(shared), "conv_id long, path binary, words array<int>, shard int")
    dealt = dealt.repartitionByRange(len(skeleton.splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    rows = stored(dealt.mapInArrow(_walked(shared), _NODE), "nodes")
    pieces = rows.filter("piece IS NOT NULL").select("skeleton", "seq", "piece")
    ends = pieces.repartition("skeleton").sortWithinPartitions("skeleton", "seq").select(
        "skeleton", "piece").mapInArrow(_digests, "skeleton long, ends_sha256 string")
    partial = rows.filter("skeleton IS NOT NULL AND piece IS NULL").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))).collect()
    whole = spark.createDataFrame(_settled(skeleton, partial), (
        "skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long"))
    own = whole.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    columns = _NAMES[:8]
    above = F.broadcast(whole.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("above")))
    local = rows.filter("skeleton IS NULL").join(above, "parent_skeleton", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return local.select(*columns).unionByName(own.select(*columns))
