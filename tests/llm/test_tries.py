"""Exact groups, prefix tries and part codes next to brute force, on small cases of every kind."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesloom.llm import ball_codes, byte_trie, prefix_trie


def sha(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


# exact groups

TEXTS = [(1, "same"), (2, "same"), (3, None), (4, ""), (5, "Same"), (6, "same "), (None, "same"), (7, "prefix"),
         (8, "prefix and more"), (9, "é" * 3000), (10, "é" * 3000), (11, "é" * 3000 + "!"), (12, "x" * 300_000),
         (13, "x" * 300_000), (12, "x" * 300_000), (None, "no id"), (None, "no id"), (14, "a\x00b"), (15, "a\x00b")]
SCHEMA = "doc_id long, text string, row long, no long, sha string, keep string"


def expected_groups(rows, keep):
    groups = collections.defaultdict(list)
    for name, text in rows:
        groups[text or ""].append(name)
    out = []
    for text, names in groups.items():
        known = [n for n in names if n is not None]
        stays = (max if keep == "max" else min)(known) if known else None
        kept = sorted(names, key=lambda n: (n is None, n if keep == "min" or n is None else -n))
        out += [(n, stays, len(names), k == 0, sha(text)) for k, n in enumerate(kept)]
    return collections.Counter(out)


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("budget", [byte_trie.TRIE_BYTES, 4_000, 10])
def test_exact_groups(spark, keep, budget):
    docs = spark.createDataFrame([(i, t, -1, -2, "x", "y") for i, t in TEXTS], SCHEMA).repartition(3)
    got = byte_trie.exact_groups(docs, keep=keep, trie_bytes=budget).collect()
    assert collections.Counter(map(tuple, got)) == expected_groups(TEXTS, keep)


def test_exact_groups_of_an_empty_table(spark):
    got = byte_trie.exact_groups(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["id", "keep_id", "size", "kept", "sha"] and got.count() == 0


def test_a_hot_text_travels_once_per_task(spark):
    rows = [(k, "hot" if k % 3 else f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = byte_trie.exact_groups(docs, keep="max").collect()
    assert collections.Counter(map(tuple, got)) == expected_groups(rows, "max")


def test_radix_trie_holds_what_it_was_given():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(2000)]
    trie = byte_trie.RadixTrie(largest=False)
    assert all(trie.insert(t, k, k, 1, [k]) for k, t in enumerate(texts))
    held = {t: (end[0], end[2], sorted(end[3])) for t, end in trie.texts(trie.root, b"")}
    assert held == {t: (ks[0], len(ks), ks) for t in set(texts) for ks in [[k for k, x in enumerate(texts) if x == t]]}
    small = byte_trie.RadixTrie(largest=False, budget=20_000)
    seen = collections.Counter()
    for k, t in enumerate(texts):
        if not small.insert(t, k, k, 1, [k]):
            seen[t] += 1
        elif small.size > small.budget:
            for spilled, end in small.give_up():
                seen[spilled] += end[2]
    settled = {t for t, _ in small.texts(small.root, b"")}
    assert seen and settled and not settled & set(seen)
    assert seen + collections.Counter({t: e[2] for t, e in small.texts(small.root, b"")}) == collections.Counter(texts)


# prefix trie

TURNS = "conv_id long, turn long, role string, text string, path string, words long, depth long"


def rebuilt_by_hand(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}")[:32], role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = own.get(conv - int(math.fmod(conv, 20)), [])[:h] + turns[h:]
    return out


def nodes_by_hand(paths):
    members = collections.defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        ends = sorted(c for c in convs if len(paths[c]) == len(path))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path],
                    sum(not children[p] for p in below), saved, sha(",".join(map(str, ends)))))
    return collections.Counter(out)


def conversations():
    rng = random.Random(5)
    rows = [(c, k, rng.choice(["user", None]), rng.choice(["a b", "a", "", None, "c c c", "long " * 2000]))
            for c in range(150) for k in range(rng.randrange(1, 6))]
    rows += [(c, k, "user", "the same words") for c in range(200, 320) for k in range(3)]     # copies of one conversation
    rows += [(1000, None, "user", "null turn"), (1000, None, None, None), (1000, 1, "a", "tie"), (1000, 1, "b", "tie"),
             (1000, 1, "b", "tie"), (None, 0, "user", "nobody's"), (-7, 0, "user", "below zero"), (-20, 0, "user", "head"),
             (2001, 0, "user", "one turn, no head"), (2002, 0, "user", "x"), (2003, 0, "user", "y")]
    rows += [(3000 + c, k, "user", f"turn {k}") for c in range(2) for k in range(300)]         # long paths
    return rows


@pytest.mark.parametrize("shard_turns", [prefix_trie.SHARD_TURNS, 40])
def test_prefix_trie(spark, shard_turns):
    rows = conversations()
    turns = spark.createDataFrame([(*r, "x", -1, -2) for r in rows], TURNS).repartition(3)
    rebuilt = prefix_trie.rebuilt(turns)
    paths = rebuilt_by_hand(rows)
    assert {r.conv_id: len(r.turns) for r in rebuilt.collect()} == {c: len(p) for c, p in paths.items()}
    got = prefix_trie.trie_nodes(rebuilt, shard_turns=shard_turns).collect()
    assert collections.Counter(map(tuple, got)) == nodes_by_hand(paths)


def test_prefix_trie_with_long_ends(spark, monkeypatch):
    """Copies of one conversation in many shards: the skeleton's ends come in pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, 0, "user", "hello you") for c in range(2000)]
    got = prefix_trie.trie_nodes(prefix_trie.paths(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string")), shard_turns=200).collect()
    ids = ",".join(map(str, range(2000)))
    assert sorted(map(tuple, got)) == [(0, 0, None, 2000, 1, 1, 1999 * 2, sha("")), (0, 1, 0, 2000, 0, 1, 1999 * 2, sha(ids))]


def test_prefix_trie_of_nothing(spark):
    turns = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie_nodes(prefix_trie.rebuilt(turns)).count() == 0
    one = spark.createDataFrame([(2001, 0, "user", "x", "", 0, 0)], TURNS)   # its only turn is before its first h
    assert zlib.crc32(b"2001") % 4 > 0
    assert [tuple(r) for r in prefix_trie.trie_nodes(prefix_trie.rebuilt(one)).collect()] == [
        (2001, 0, None, 1, 0, 1, 0, sha("2001"))]


def test_skeleton_is_the_trie_of_splitters():
    a, b, c = (bytes([x]) * prefix_trie.TURN for x in (1, 2, 3))
    trie = prefix_trie.Skeleton([(a + b, 1), (a + c, 5), (a + c, 9)])
    assert trie.depth == [0, 1, 2, 2] and trie.parent == [-1, 0, 1, 1] and trie.own[1] == trie.own[2] == [0, 1, 3]


# part codes

def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
            if v is not None and None not in v and all(map(math.isfinite, v))]
    size = collections.Counter(len(v) for _, _, v in kept)
    if not size:
        return collections.Counter()
    n = max(size, key=lambda k: (size[k], k))
    kept = [r for r in kept if len(r[2]) == n]
    width = n // parts
    cut = lambda v: [tuple(v[p * width:(p + 1) * width]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]) if r[0] is not None else (True, 0, r[2]))[:entries]
    books = [[cut(v)[p] for _, _, v in first] for p in range(parts)]

    def assigned():
        return [[min(range(len(books[p])), key=lambda k: (sum((a - b) ** 2 for a, b in zip(x, books[p][k])), k))
                 for p, x in enumerate(cut(v))] for _, _, v in kept]

    for _ in range(rounds):
        codes = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v)[p] for (_, _, v), code in zip(kept, codes) if code[p] == k]
                if own:
                    books[p][k] = tuple(sum(x) // len(own) for x in zip(*own))
    codes = assigned()
    errors = [sum((a - b) ** 2 for p, x in enumerate(cut(v)) for a, b in zip(x, books[p][code[p]]))
              for (_, _, v), code in zip(kept, codes)]
    by_label = collections.Counter()
    for (_, label, _), error in zip(kept, errors):
        by_label[label] += error
    digest = sha(",".join(str(x) for book in books for entry in book for x in entry))
    return collections.Counter((i, "".join(f"{k:02x}" for k in code), error, by_label[label], digest)
                               for (i, label, _), code, error in zip(kept, codes, errors))


VECTORS = "vec_id long, embedding array<float>, label int, v string, code string, error long"


def vectors(n, seed=3, width=32):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([-0.25, 0.0, 0.125, rng.uniform(-1, 1)]) for _ in range(width)], rng.choice([1, 2, None]))
            for k in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.5] * (width - 1), 1), (n + 2, [float("nan")] * width, 1),
             (n + 3, [float("-inf")] * width, 2), (n + 4, [], 1), (n + 5, [0.1] * (width - 1), 1)]
    rows += [(5, rows[5][1], 2), (5, rows[6][1], 2), (None, rows[7][1], None), (n + 9, [0.0] * width, 7), (n + 9, [0.0] * width, 7)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("n", [200, 20])
def test_part_codes(spark, n):
    rows = vectors(n)
    table = spark.createDataFrame([(*r, "x", "y", -1) for r in rows], VECTORS).repartition(3)
    got = ball_codes.part_codes(table).collect()
    assert collections.Counter(map(tuple, got)) == codes_by_hand(rows)


def test_part_codes_where_little_is_left(spark):
    assert ball_codes.part_codes(spark.createDataFrame([], VECTORS)).count() == 0
    assert ball_codes.part_codes(spark.createDataFrame([(1, None, 1, "", "", 0)], VECTORS)).count() == 0
    rows = [(1, [0.5] * 16, None)]
    got = ball_codes.part_codes(spark.createDataFrame([(*r, "", "", 0) for r in rows], VECTORS)).collect()
    assert collections.Counter(map(tuple, got)) == codes_by_hand(rows)
    for bad in ([0.5] * 17, [1e30] * 16, [-1e30] * 16):
        with pytest.raises(Exception, match="cannot be cut|size after scaling"):
            ball_codes.part_codes(spark.createDataFrame([(1, bad, 1, "", "", 0)], VECTORS)).collect()


def test_rings_give_the_nearest_entry_and_skip_work():
    rng = np.random.default_rng(2)
    book = rng.integers(-40, 40, (64, 4))
    book[7] = book[3]                                        # equal entries: the lower index
    parts = np.concatenate((rng.integers(-60, 60, (3000, 4)), book + rng.integers(-1, 2, (64, 4)), (book[:32] + book[32:]) // 2))
    expected = ball_codes.nearest(parts, book)
    balls = ball_codes.Balls(book)
    for own in (rng.integers(0, 64, len(parts)), expected, np.zeros(len(parts), dtype=np.int64)):
        got, looked = balls.moved(parts, own)
        assert (got == expected).all()
    assert balls.moved(parts, expected)[1] < 64 * len(parts) * 0.7
