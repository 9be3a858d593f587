"""Similarity join of texts on their word n-grams by signature trees.

Two texts link when the Jaccard similarity of their sets of n-grams reaches ``threshold``.

1. One pass over the texts makes, per row, the size of its set, a 128-bit digest of the set and a
   sketch: the ``SKETCH`` n-grams with the least hashes. Rows of equal digest are one class.
2. The top of the tree: a node for every n-gram that stands in the sketches of several classes.
   Of a class's sketch, its rarest n-grams are enough (prefix filter): classes that can link
   share one of those, so a pair of nodes without a common class need not be looked at.
   Pairs of a node whose sketches have too little in common for a link are left out, else texts
   that share an n-gram by chance would tie ever more of a growing corpus together. Classes
   joined by the pairs that remain, directly or by others, make a bucket. Of a node of more
   than ``PAIRED`` classes, the pairs with one of them come first, then those of different
   buckets, by blocks of ``NODE_CLASSES``.
3. In a bucket, a tree of signatures: a leaf is the bitmap and size of one class, an inner node
   holds the OR of the bitmaps below it and their range of sizes. A dual traversal starts with the
   pair (root, root) and drops a pair of nodes if the largest possible overlap is under what the
   threshold asks, or if all below them is already connected. Pairs of leaves that remain are
   compared by their whole sets.
4. A bucket with more n-grams than ``BLOCK_GRAMS`` is dealt to blocks of about that size, each
   with the same few pivots of the bucket. Then the blocks are compared pairwise, without pairs
   that are connected by now: of the largest component only against the rest of the bucket.

The prefix filter and the comparison of sketches need a lower bound for the n-grams that linked classes share in their sketches.
For sets of at most ``threshold * SKETCH`` it is the exact one. For larger sets it is ``SHARED``:
the sketch of the union has ``SKETCH`` n-grams, each common with probability of the similarity at
least; fewer than 20 of 64 are common at 0.75 with a probability of 3e-13.
Links of equal sets are exact but for collisions of 128-bit digests, n-grams are 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.graph import components
from salesloom.llm.storage import cut
from salesloom.llm.text import grams, hashed_words, mix

SKETCH, SHARED = 64, 20
PAIRED, NODE_CLASSES = 32, 512
BLOCK_GRAMS = 1_000_000
PIVOTS = 16
SIGNATURE_BITS = 4096
FANOUT = 8


def gram_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct n-grams; of fewer words, the whole sequence; of no words, none."""
    return np.unique(grams(hashes, min(size, len(hashes))))


def digest(grams_: np.ndarray) -> tuple[int, int]:
    one = mix(grams_ ^ np.uint64(0xA0761D6478BD642F))
    two = mix(grams_ + np.uint64(0xE7037ED1A0B428DB))
    return (int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64)))


def _signatures(size: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("own", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows, ones, twos, sketches = [], [], [], []
            for hashes in hashed_words(batch.column(1), fold=True):
                grams_ = gram_set(hashes, size)
                mark = digest(grams_)
                rows.append(len(grams_))
                ones.append(mark[0])
                twos.append(mark[1])
                # One sketch for the copies in a task saves shuffling; which rows it is left out
                # for makes no difference, since sketches belong to digests.
                fresh = len(grams_) and mark not in seen
                if fresh:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(mark)
                sketches.append(grams_[:SKETCH].view(np.int64) if fresh else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(rows, pa.int64()), pa.array(ones, pa.int64()),
                 pa.array(twos, pa.int64()), batch.column(2), pa.array(sketches, pa.list_(pa.int64()))], schema=schema)

    return run


class SignatureTree:
    """Levels of nodes over classes; level 0 has one node per class."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        # Near copies have the same least n-gram most of the time, and so meet in a node.
        self.order = np.lexsort((sizes, np.array([x[0] for x in sets])))
        bits = np.zeros((len(sets), SIGNATURE_BITS // 64), dtype=np.uint64)
        for row, k in enumerate(self.order):
            at = sets[k] % np.uint64(SIGNATURE_BITS)
            np.bitwise_or.at(bits[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        sizes = sizes[self.order]
        hidden = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, hidden)]
        while len(self.levels[-1][0]) > 1:
            bits, least, most, hidden = self.levels[-1]
            cuts = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, cuts, axis=0), np.minimum.reduceat(least, cuts),
                                np.maximum.reduceat(most, cuts), np.maximum.reduceat(hidden, cuts)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs of nodes may hold a link: by their sizes, and by the bits that both have.

        A common n-gram sets a bit in both bitmaps; the n-grams of a set beyond its bits number
        ``hidden``.
        """
        bits, least, most, hidden = self.levels[level]
        keep = np.minimum(most[a], most[b]) >= threshold * np.maximum(least[a], least[b]) - 1e-9
        a, b = a[keep], b[keep]
        common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[a], hidden[b])
        overlap = np.minimum(common, np.minimum(most[a], most[b]))
        keep[keep] = overlap >= threshold / (1 + threshold) * (least[a] + least[b]) - 1e-9
        return keep


def tree_links(sets: list[np.ndarray], threshold: float, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between the sets (by index) that connect all that links connect.

    ``group``: sets of equal value are connected already. A link within what is connected is not
    looked for.
    """
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if group is not None:
        first: dict[int, int] = {}
        for k, g in enumerate(group):
            parent[k] = first.setdefault(int(g), k)
    if len(sets) < 2:
        return []
    tree, links = SignatureTree(sets), []
    hundredths = round(threshold * 100)

    def compare(i: int, j: int) -> None:
        a, b = int(tree.order[i]), int(tree.order[j])
        ra, rb = find(a), find(b)
        if ra == rb:
            return
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * common >= hundredths * (len(sets[a]) + len(sets[b]) - common):
            parent[ra] = rb
            links.append((a, b))

    # Depth first in portions, so that near neighbours connect before far pairs are looked at.
    stack = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > 512:
            half = len(a) // 2
            stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
            continue
        roots = np.array([find(int(k)) for k in tree.order]) if level and level <= 2 else None
        keep = np.ones(len(a), dtype=bool)
        if roots is not None:
            cuts = np.arange(0, len(roots), FANOUT ** level)
            low, high = np.minimum.reduceat(roots, cuts), np.maximum.reduceat(roots, cuts)
            keep = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[keep], b[keep]
        keep = tree.possible(level, a, b, threshold)
        a, b = a[keep], b[keep]
        if level == 0:
            for i, j in zip(a.tolist(), b.tolist()):
                compare(i, j)
            continue
        n = len(tree.levels[level - 1][0])
        step = np.arange(FANOUT)
        left = np.repeat(a[:, None] * FANOUT + step, FANOUT, axis=1).ravel()
        right = np.tile(b[:, None] * FANOUT + step, (1, FANOUT)).ravel()
        keep = (left < n) & (right < n) & ((left < right) if level == 1 else (left <= right))
        left, right = left[keep], right[keep]
        if len(left):
            nearest = np.argsort(right - left, kind="stable")
            stack.append((level - 1, left[nearest], right[nearest]))
    return links


_LINKS = "a1 long, a2 long, b1 long, b2 long"


def _block_links(size: int, threshold: float):
    """Links between the classes of a block; a class is known by its digest."""
    def run(table: pa.Table) -> pa.Table:
        sets, classes, groups = [], [], []
        texts = table.column("text").combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        known = zip(*(table.column(name).to_pylist() for name in ("d1", "d2", "g1", "g2")))
        taken, numbers = set(), {}
        for hashes, (d1, d2, g1, g2) in zip(hashed_words(texts, fold=True), known):
            # A pivot may meet itself.
            if (d1, d2) in taken:
                continue
            taken.add((d1, d2))
            sets.append(gram_set(hashes, size))
            classes.append((d1, d2))
            groups.append(numbers.setdefault((g1, g2), len(numbers)))
        found = tree_links(sets, threshold, np.array(groups, dtype=np.int64))
        ends = [(*classes[i], *classes[j]) for i, j in found]
        return pa.table({name: pa.array([x[k] for x in ends], pa.int64())
                         for k, name in enumerate(("a1", "a2", "b1", "b2"))})

    return run


def _class(first: str, second: str) -> Column:
    return F.struct(F.col(first).alias("d1"), F.col(second).alias("d2"))


def _linked(links: DataFrame) -> DataFrame:
    """(d1, d2, component) of the classes that have links."""
    found = components(links.select(_class("a1", "a2").alias("a"), _class("b1", "b2").alias("b")))
    return found.select("node.d1", "node.d2", "component")


def _sketch_links(threshold: float):
    """Pairs of classes of a block that may link by their sketches; enough to connect all that such pairs connect."""
    def run(table: pa.Table) -> pa.Table:
        keys, sizes = table.column("d1").to_numpy(), table.column("n").to_numpy()
        roots = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        sketches = table.column("sketch")
        lengths = np.array([len(x) for x in sketches], dtype=np.int64)
        _, place, times = np.unique(np.concatenate([x.values.to_numpy() for x in sketches]), return_inverse=True,
                                    return_counts=True)
        owner, common = np.repeat(np.arange(len(keys)), lengths), times[place] > 1
        owner, place = owner[common], (np.cumsum(times > 1) - 1)[place[common]]
        bits = np.zeros((len(keys), int((times > 1).sum()) // 64 + 1), dtype=np.uint64)
        np.bitwise_or.at(bits, (owner, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        found = []
        for a in range(len(keys) - 1):
            near = np.minimum(sizes, sizes[a]) >= threshold * np.maximum(sizes, sizes[a]) - 1e-9
            near[:a + 1] = False
            rest = np.flatnonzero(near & (roots != roots[a]))
            both = np.bitwise_count(bits[rest] & bits[a]).sum(axis=1, dtype=np.int64)
            whole = np.maximum(sizes[rest], sizes[a]) <= SKETCH
            need = np.where(whole, threshold / (1 + threshold) * (sizes[rest] + sizes[a]) - 1e-9, SHARED)
            for b in rest[both >= need].tolist():
                if roots[a] != roots[b]:
                    roots[roots == roots[b]] = roots[a]
                    found.append((int(keys[a]), int(keys[b])))
        return pa.table({name: pa.array([x[k] for x in found], pa.int64()) for k, name in enumerate(("a", "b"))})

    return run


def _block_pairs(rows: DataFrame, main: Column, others: Column, blocks: Column) -> DataFrame:
    """``rows`` for every pair (i, j) of blocks to compare: the rest of a group with itself and with ``main``.

    Blocks 0 to ``others`` - 1 hold the rest, the following ``blocks`` the rows of ``main``.
    """
    spot = F.pmod(F.xxhash64("d1", F.lit(1)), blocks).cast("int")
    mine = F.when(main, others + spot).otherwise(F.pmod(F.xxhash64("d1", F.lit(3)), others).cast("int"))
    with_rest = F.transform(F.sequence(F.lit(0), others - 1),
                            lambda k: F.struct(F.least(k, "mine").alias("i"), F.greatest(k, "mine").alias("j")))
    with_main = F.transform(F.sequence(others, others + blocks - 1),
                            lambda k: F.struct(F.col("mine").alias("i"), k.alias("j")))
    return rows.withColumn("mine", mine).withColumn(
        "pair", F.explode(F.when(main, with_rest).otherwise(F.concat(with_rest, with_main))))


def _rare(rows: DataFrame, threshold: float) -> DataFrame:
    """(d1, n, gram, df): of each class the rarest n-grams of its sketch that other sketches have too."""
    rows = rows.select("d1", "n", F.explode("sketch").alias("gram"))
    shared = rows.groupBy("gram").agg(F.min("d1").alias("least"), F.max("d1").alias("other"), F.count("*").alias("df"))
    shared = shared.filter("least != other").select("gram", "df")
    exact = int(math.floor(threshold * SKETCH))
    need = F.when(F.col("n") <= exact, F.ceil(F.col("n") * threshold)).otherwise(SHARED)
    by_class = Window.partitionBy("d1")
    rare = (rows.join(shared, "gram").repartition("d1").dropDuplicates(["d1", "gram"])
            .withColumn("place", F.row_number().over(by_class.orderBy("df", "gram")))
            .withColumn("shared", F.count("*").over(by_class))
            .filter(F.col("place") <= F.col("shared") - (need - 1)))
    return rare.select("d1", "n", "gram", "df")


def _candidates(base: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of digests whose sketches allow a link; whatever can link is connected by them."""
    rows = base.filter("sketch is not null")
    rare = cut(_rare(rows, threshold))
    sketches = cut(rows.join(rare.select("d1").distinct(), "d1", "left_semi").dropDuplicates(["d1"]).select(
        "d1", "n", "sketch"))
    a, b = rare.select("gram", "df", F.col("d1").alias("a"), F.col("n").alias("na")), rare.select(
        "gram", F.col("d1").alias("b"), F.col("n").alias("nb"))
    near = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    pairs = a.filter(F.col("df") <= PAIRED).join(b.filter(F.col("df") <= PAIRED), "gram").filter(near).filter(
        "a < b").select("a", "b")
    large = rare.filter(F.col("df") > PAIRED)
    hubs = large.groupBy("gram").agg(F.min("d1").alias("b"))
    pairs = pairs.unionByName(large.join(hubs, "gram").filter("d1 != b").select(F.col("d1").alias("a"), "b")).distinct()
    both = pairs.join(sketches.toDF("a", "na", "one"), "a").join(sketches.toDF("b", "nb", "two"), "b")
    need = F.when(F.greatest("na", "nb") <= SKETCH,
                  threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9).otherwise(SHARED)
    edges = cut(both.filter(near & (F.size(F.array_intersect("one", "two")) >= need)).select("a", "b"))
    if large.isEmpty():
        return edges
    # Nodes beyond ``PAIRED`` classes: all pairs but those that are in one bucket by now.
    large = cut(large.select("d1", "gram").join(components(edges).withColumnRenamed("node", "d1"), "d1", "left").withColumn(
        "component", F.coalesce("component", "d1")))
    most = large.groupBy("gram", "component").agg(F.count("*").alias("c")).groupBy("gram").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("c"),
        (F.sum("c") - F.max("c")).alias("rest")).filter("rest > 0")
    mixed = _block_pairs(large.join(most, "gram"), F.col("component") == F.col("main"),
                         F.ceil(F.col("rest") / NODE_CLASSES).cast("int"), F.ceil(F.col("c") / NODE_CLASSES).cast("int"))
    mixed = mixed.select("d1", "gram", "component", "pair.i", "pair.j").join(sketches, "d1")
    return edges.unionByName(cut(mixed.groupBy("gram", "i", "j").applyInArrow(_sketch_links(threshold), "a long, b long")))


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                             threshold: float = 0.75) -> DataFrame:
    """(id, n, component) per row: size of its n-gram set and least id that links reach.

    A null or blank text has no n-grams and links with nothing: its component is its own id. Rows
    of a null id link like others; their component is null where all that links reach have none.
    Rows that repeat an id with other texts link each for themselves, in any order of rows.
    Columns other than the two named are not read.
    """
    # ``own`` tells rows of one id apart: a class takes its text from one row.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn(
        "own", F.xxhash64("text"))
    base = cut(rows.mapInArrow(_signatures(size), "id long, n long, d1 long, d2 long, own long, sketch array<long>"))
    filled = base.filter("n > 0")
    classes = cut(filled.groupBy("d1", "d2", "n").agg(
        F.min("id").alias("rep"), F.coalesce(F.min_by("own", "id"), F.min("own")).alias("own")))
    buckets = components(_candidates(filled, threshold))
    members = classes.join(buckets.select(F.col("node").alias("d1"), F.col("component").alias("bucket")), "d1")
    totals = members.groupBy("bucket").agg(F.sum("n").alias("grams"), F.count("*").alias("m")).filter("m > 1")
    members = members.join(totals, "bucket").withColumn("key", F.coalesce("rep", F.lit(0)))
    texts = rows.select(F.coalesce("id", F.lit(0)).alias("key"), "own", "text")
    members = cut(members.join(texts, ["key", "own"]).dropDuplicates(["key", "own"]).select(
        "text", "d1", "d2", "n", "bucket", "m", F.ceil(F.col("grams") / BLOCK_GRAMS).cast("int").alias("blocks")))
    linked = _linked(_BlockJoin(members, size, threshold).links()).join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("d1", "d2", "least")
    named = classes.join(linked, ["d1", "d2"], "left").select("d1", "d2", "n", F.coalesce("least", "rep").alias("least"))
    out = base.select("id", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    return out.select("id", "n", F.coalesce("least", "id").alias("component"))


class _BlockJoin:
    """The trees of all buckets; large buckets by blocks."""

    def __init__(self, members: DataFrame, size: int, threshold: float) -> None:
        self.members, self.run = members, _block_links(size, threshold)

    def _apply(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", "i", "j").applyInArrow(self.run, _LINKS)

    def links(self) -> DataFrame:
        spot = F.pmod(F.xxhash64("d1", F.lit(1)), F.col("blocks")).cast("int")
        pivot = F.pmod(F.xxhash64("d1", F.lit(2)), F.col("m")) < PIVOTS
        everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
        columns = ["text", "d1", "d2", "bucket", "i", "j", F.col("group.d1").alias("g1"), F.col("group.d2").alias("g2")]
        own = _class("d1", "d2")
        first = self.members.withColumn(
            "i", F.explode(F.when((F.col("blocks") > 1) & pivot, everywhere).otherwise(F.array(spot))))
        done = cut(self._apply(first.withColumn("j", F.col("i")).withColumn("group", own).select(*columns)))
        large = self.members.filter("blocks > 1")
        if large.isEmpty():
            return done
        large = cut(large.join(_linked(done), ["d1", "d2"], "left").withColumn("group", F.coalesce("component", own)).drop(
            "component"))
        sizes = large.groupBy("bucket", "group").agg(F.sum("n").alias("c"))
        most = sizes.groupBy("bucket").agg(F.max_by("group", F.struct("c", "group")).alias("main"),
                                           (F.sum("c") - F.max("c")).alias("rest")).filter("rest > 0")
        pairs = _block_pairs(large.join(most, "bucket"), F.col("group") == F.col("main"),
                             F.ceil(F.col("rest") / BLOCK_GRAMS).cast("int"), F.col("blocks"))
        return done.unionByName(self._apply(
            pairs.select("text", "d1", "d2", "bucket", "pair.i", "pair.j", "group").select(*columns)))
