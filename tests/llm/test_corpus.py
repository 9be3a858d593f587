"""The numbered operators next to brute force, on planted cases and on a small table."""

from __future__ import annotations

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salesloom.llm import graph, html_blocks, mixing, ngram_join, private_data, quality_rules, queries, text, winnowing
from salesloom.llm import host_reputation, substring_dedup
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, words string"
WORD = r"[^\x20\x09-\x0D]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def sha(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def planted():
    prose = [" ".join(f"w{k}x{i}" for i in range(120)) for k in range(12)]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(prose)]
    rows += [(20, prose[0], "en", "s0"), (21, prose[0].upper(), "en", "s0"),
             (22, " ".join(prose[1].split()[:-6]), "en", None), (23, prose[2] + " one more", "de", "s1")]
    rows += [(30 + k, f"{prose[4 + k][:200]} {PASSAGE} tail{k} {'very long ' * 50 if k == 2 else ''}", None, "hot")
             for k in range(5)]
    rows += [(40, None, "en", "s1"), (41, "", "en", "s1"), (42, " \n\t", None, None), (43, "three little words", "en", "s2"),
             (44, "three little words", "en", "s2"), (44, "three little words", "en", "s2"), (None, "no id here at all", "en", "s2"),
             (45, "mail a.b@c.example.org or +1 (017) 555-7713 now 4111 1111 1111 1111 at 10.0.0.255 x@y 1.2.3.999", "en", "s2"),
             (46, "é" * 30 + " x@y.zz@q.rr, 0000000000000 " + "9" * 40, "fr", "s2"),
             (47, "again and again " * 40, "en", "s0"), (48, "Ünï çødé " * 9, "fr", "s1"), (49, " wide space x", "fr", "s1")]
    return [(i, t, lang, s, None if t is None else len(t), -1, -2, "x") for i, t, lang, s in rows]


@pytest.fixture(scope="module", params=["planted", "small", "empty"])
def docs(spark, request):
    if request.param == "small":
        return spark.read.parquet(f"{SMALL}/documents.parquet")
    return spark.createDataFrame(planted() if request.param == "planted" else [], SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same(got, expected):
    """As multisets of rows."""
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, expected))


def test_word_hashes_agree_with_split(rows):
    import pyarrow as pa
    texts = [t for _, t in rows]
    seen = {}
    for t, hashes in zip(texts, text.hashed_words(pa.array(texts, pa.string()), fold=True)):
        words = re.findall(WORD, (t or "").translate(FOLD))
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, (t or "").translate(FOLD))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    index, common = collections.defaultdict(list), collections.Counter()
    for k, s in enumerate(sets):
        for g in s:
            common.update((other, k) for other in index[g])
            index[g].append(k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_op1_components(docs, rows):
    got = ngram_join.ngram_jaccard_components(docs).select("id", "n", "component").collect()
    same(got, brute_components(rows))


def test_op1_blocks_find_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 150)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    got = ngram_join.ngram_jaccard_components(docs).select("id", "n", "component").collect()
    same(got, brute_components(rows))


WORDS = [f"t{k}" for k in range(60)]


def chain(name):
    """Three texts of which neighbours link and the ends do not."""
    return [" ".join(name + w for w in WORDS[k:k + 50]) for k in (0, 5, 10)]


A, B, C, D, E = map(chain, "abcde")
REPEATED = [(5, "something quite unlike all of the other texts here"), (5, A[0]), (7, A[1]),
            (15, B[0]), (15, B[2]), (17, B[1]), (13, B[2].upper()), (60, C[0]), (None, C[1]), (61, C[2]),
            (None, D[0]), (None, D[0]), (None, D[1]), (None, "nothing of this links"),
            *[(9, E[0])] * 4, (9, E[1]), (8, E[2]), (0, E[2]), (None, E[2])]


@pytest.mark.parametrize("rows", [REPEATED, REPEATED[::-1]])
def test_op1_repeated_and_null_ids(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 60)
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.collect(), brute_components(rows))


def buckets(spark, texts):
    """Sets of row numbers that ``ngram_join`` puts in one bucket."""
    rows = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "id long, text string, own long")
    base = rows.mapInArrow(ngram_join._signatures(5), "id long, n long, d1 long, d2 long, own long, sketch array<long>")
    found = graph.components(ngram_join._candidates(base, 0.75)).join(base, F.col("node") == F.col("d1"))
    return sorted(sorted(x.ids) for x in found.groupBy("component").agg(F.collect_set("id").alias("ids")).collect())


@pytest.mark.parametrize("paired", [32, 1])
def test_op1_passages_in_common_do_not_make_a_bucket(spark, monkeypatch, paired):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "NODE_CLASSES", 3)
    texts = []
    for k in range(12):  # three near copies; one of them has seven words in common with one of the next three
        own, before, after = ([f"{name}x{i}" for i in range(n)] for name, n in ((f"p{k}", 50), (f"c{k}", 7), (f"c{k + 1}", 7)))
        texts += [" ".join(before + own), " ".join(own), " ".join(own + after)]
    assert buckets(spark, texts) == [[k, k + 1, k + 2] for k in range(0, 36, 3)]


@pytest.mark.parametrize("words", [50, 150])
def test_op1_large_nodes_keep_what_their_hub_does_not_link(spark, monkeypatch, words):
    monkeypatch.setattr(ngram_join, "PAIRED", 1)
    monkeypatch.setattr(ngram_join, "NODE_CLASSES", 2)
    texts = [" ".join(f"{name}{i}" for i in range(k, k + words)) for name in "abc" for k in range(0, words, words // 10)]
    rows = list(enumerate(texts))
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.collect(), brute_components(rows))


def test_tree_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 1 << 62, 80, dtype=np.uint64))
        for _ in range(rng.integers(1, 9)):
            sets.append(np.unique(np.concatenate((rng.choice(base, 70, replace=False),
                                                  rng.integers(0, 1 << 62, rng.integers(0, 12), dtype=np.uint64)))))
    def parts(links):
        label = list(range(len(sets)))
        for a, b in links:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        return label
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)
             if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - c)]
    assert parts(ngram_join.tree_links(sets, 0.75)) == parts(pairs)


def test_unsettled_components_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        graph.components(edges, max_rounds=2)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 201), (300, 300)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200, **{1000 + i: 1000 for i in range(40)}}


def test_op2_mix(docs, rows):
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    sources = collections.defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sources[r.source] += r.size
    names = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sources.values()), set()
    while True:
        free = [s for s in names if s not in full]
        share = (total - sum(3 * sources[s] for s in full)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if share * weight[s] >= 3 * sources[s]}
        if not over:
            break
        full |= over
    for s in names:
        target = 3 * sources[s] if s in full else share * weight[s]
        own = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, target, abs_tol=1e-6) and r.source_size == sources[s] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 2 + 3 * total / mixing.SLOTS
    same(mixing.mixed(docs).collect(), got)


def test_op2_targets_to_the_word(spark, monkeypatch):
    """Slots larger than small sources: each source still gets its target."""
    for name, value in (("SLOT_BITS", 3), ("SLOTS", 8), ("CELLS", 4)):
        monkeypatch.setattr(mixing, name, value)
    sizes = [("big", 700)] * 6 + [("mid", 90)] * 5 + [("small", 2), ("tiny", 1), (None, 7), ("zero", 0), ("mid", 3), ("small", 2)]
    docs = spark.createDataFrame([(k, "w " * n, s) for k, (s, n) in enumerate(sizes)], "doc_id long, text string, source string")
    got = collections.defaultdict(list)
    for r in mixing.mixed(docs).collect():
        assert 0 <= r.taken <= 3 * r.size
        got[r.source].append(r)
    for of in got.values():
        assert sum(r.taken for r in of) == math.floor(of[0].target + 0.5)
    pieces = mixing.schedule(spark, mixing.source_targets(mixing.document_sizes(docs))).collect()
    of_slot = collections.Counter()
    for p in pieces:
        of_slot[p.slot] += p.stop - p.start
    total = sum(n for _, n in sizes)
    assert len(of_slot) == 8 and all(abs(n - total / 8) <= 5 for n in of_slot.values())


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def test_op3_private_data(docs, rows):
    expected = []
    for i, t in rows:
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        count = collections.Counter(k for k, _, _ in spans)
        expected.append((i, *[count[k] for k in BASE], ",".join(f"{k}:{s}:{e}" for k, s, e in spans)))
    report = private_data.private_data_report(docs)
    same(report.select("id", "n_email", "n_ip", "n_card", "n_phone", "base").collect(), expected)
    for r in report.collect():
        assert r.spans.startswith(r.base)


def test_op3_contexts_find_unseen_identifiers(spark):
    rows = [(k, f"note {k} member: u{k}@mail.example.com fine") for k in range(8)] + [(9, "note member: ZX-90817-Q fine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.id: r.spans for r in private_data.private_data_report(docs).collect()}
    assert spans[9] == "found:13:23"
    masked = {r.doc_id: r.text for r in private_data.masked(docs).collect()}
    assert masked[9] == "note member: <found> fine" and masked[3] == "note 3 member: <email> fine"


def test_op3_labels_of_secrets_and_common_words(spark):
    def secret(k):
        return hashlib.sha1(str(k).encode()).hexdigest()
    rows = [(k, f'the text token = "{secret(k)}" ends the day') for k in range(9)]
    rows += [(20, "password=hunter2-44 is no seed, token = \"abc123xyz\" is found"), (21, "the 123456 is no secret"),
             (22, f"commit {secret(99)} has no label"), (23, None), (24, ""), (25, "token = none token = \"1\"")]
    rows += [(30 + k, f"the u{k}@mail.example.com") for k in range(8)] + [(50, "the way " * 200)]
    rows += [(60 + k, f"key: {secret(k)[:20]}") for k in range(6)] + [(70, "key: abc123xyz, key: 77-4411-9.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("token", F.lit("x"))
    spans = {r.id: r.spans for r in private_data.private_data_report(docs).collect()}
    assert all(spans[k] == "found:18:58" for k in range(9))
    start = rows[9][1].index("abc123xyz")
    assert spans[20] == f"found:{start}:{start + 9}"
    assert spans[21] == spans[22] == spans[23] == spans[24] == spans[25] == spans[50] == ""
    assert spans[30] == "email:4:23" and spans[60] == "found:5:25" and spans[70] == "found:5:14,found:21:30"


def test_op3_marks_overlaps_like_brute_force(spark):
    rng = np.random.default_rng(4)
    seeds = [(int(r), int(s), int(s + n)) for r, s, n in rng.integers(1, 60, (300, 3))]
    seen = [(int(r), "p ", "x" * int(n), int(s)) for r, s, n in rng.integers(1, 60, (300, 3))]
    out = private_data.marked_contexts(spark.createDataFrame(seeds, "row long, start int, end int"),
                                       spark.createDataFrame(seen, "row long, pattern string, token string, start int"))
    expected = [(r, t, s, any(q == r and a < s + len(t) and e > s for q, a, e in seeds)) for r, _, t, s in seen]
    assert sorted(map(tuple, out.select("row", "token", "start", "hit").collect())) == sorted(expected)


def brute_hits(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows, sizes = collections.defaultdict(set), set()
    for i, t in items:
        w = words(t)
        if w:
            size = min(13, len(w))
            sizes.add(size)
            for k in range(len(w) - size + 1):
                windows[tuple(w[k:k + size])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (x := windows.get(tuple(w[k:k + size]))):
                    hit.update(range(k, k + size))
                    found |= x
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_op4_winnowing(spark, docs, rows):
    items = [(1, PASSAGE[:200]), (10, "w1x5 w1x6 w1x7 w1x8 w1x9 w1x10 w1x11 w1x12 w1x13 w1x14 w1x15 w1x16 w1x17 w1x18"),
             (2, "Three LITTLE"), (3, None), (4, " .. "), (5, "again and again and nothing"), (2, "çødé Ünï çødé"), (6, "at all")]
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()
    items += [tuple(r) for r in bench]
    got = winnowing.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = got.select("id", "n_words", "n_hit", "n_items", queries.sha256(F.concat_ws(",", "items")), "contaminated")
    same(got.collect(), brute_hits(rows, items))


def test_op4_without_items(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r for r in winnowing.contamination(docs, none).collect() if r.contaminated or r.n_hit] == []


def test_op5_held_out_accuracy(spark):
    rows = queries.op5_neighbour_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert rows.filter("score < 0 or score > 1 or score is null").count() == 0
    held = rows.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_op5_odd_rows(spark):
    from salesloom.llm.knn_quality import score_quality
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame(planted(), SCHEMA)
    assert score_quality(odd, labels).filter("score between 0 and 1").count() == len(planted())
    assert {r.score for r in score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert score_quality(odd.limit(0), labels).collect() == []


def test_op6_rules_and_reputation(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1?q", "http://www.example.com/en/", "http://x.net/es/1", "http://x.net/de/1",
            "http://com", None, "nothing", "http://m.www.example.com/en/2#f", "http://bad.org/1", "http://good.org/1", "http://net/fr/", ""]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("bad.org", 0)] * 30 + [("good.org", 1)] * 30 + [("good.org", None)], "host string, good int")
    rules = spark.createDataFrame(list(host_reputation.RULES), "action string, host string, path string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(pages, outcomes, rules).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2][2:] == got[8][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("net/es/", "block")
    assert got[4][2] is None and got[5] == ("com", "", None, got[5][3]) and got[11] == ("net", "/fr/", "net/fr/", "block")
    assert got[6][:3] == got[7][:3] == got[12][:3] == ("", "", None)
    assert got[9][3] == "block" and got[10][3] == "allow"


def test_op7_main_text(spark):
    page = ("<html><head><title>no</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy this now</div>"
            "<article><h1>Title</h1><p>One &amp; <b>t</b>wo\n three<br>four<script>if (a</p>)</script></p><div id=comments><p>reader says</div>"
            "<p>end</article><footer>copy</footer>")
    assert html_blocks.main_text(page) == "Title One & two three four end"
    assert html_blocks.main_text(None) == html_blocks.main_text("") == ""
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        assert html_blocks.main_text(r.html) == " ".join(html.unescape(inner).split())


LONG = " ".join(f"word{k}" for k in range(70))


@pytest.mark.parametrize("before", [
    "<svg width='1' />", "<svg/>", "<datalist id=a><option value=b><option value=c></datalist>", "<title-bar>x</title-bar>",
    "<select-box>x</select-box>", "<div><object data=x></div>", "<div><svg><path d=x></div>", "<script src='x' />",
    "<select><option>no<option>no</select>", "<noscript><p>no</p></noscript>", "<svg><g><text>no</text></g></svg>",
    "<object><div>no</div></object>", "<template><svg><p>no</p></svg></template>"])
def test_op7_dropped_elements_end(before):
    assert html_blocks.main_text(f"<article>{before}<p>{LONG}</p></article>").removeprefix("x ") == LONG
    assert html_blocks.main_text(f"<body>{before}<div><p>{LONG}</p><p>{LONG}</p></div>").endswith(f"{LONG} {LONG}")


@pytest.mark.parametrize("opening, closing", [
    ("<div class='content has-sidebar'>", "</div>"), ("<article class='post share-enabled'>", "</article>"),
    ("<div class='page with-sidebar'><div id=post-share>", "</div></div>"),
    ("<div class='no-comments'><article>", "</article></div>")])
def test_op7_wrappers_with_keywords(opening, closing):
    page = f"<nav><a href=x>menu</a></nav>{opening}<p>{LONG}</p><p>{LONG}</p><div class=sidebar><p>{LONG[:90]}</p></div>{closing}"
    assert html_blocks.main_text(page) == f"{LONG} {LONG}"


@pytest.mark.parametrize("tag", [
    '<p title="a > b">', "<p title='a > b'>", """<p data-x='{"a":"<b>x</b>"}'>""", '<p title = "a<b" class=x>',
    '<p title="open>', "<p title=don't>", "<p title='a' data-y=\"b'>c\">", '<p "odd>', '<p a="1"b="2">'])
def test_op7_quoted_values(tag):
    rest = f"<p>{LONG}</p><p title='x' lang=\"en\">{LONG}</p>"
    assert html_blocks.main_text(f"<article>{tag}{LONG}</p>{rest}</article>") == f"{LONG} {LONG} {LONG}"


def test_op7_keywords_still_count():
    comments = f"<div id=comments><article class=comment><p>{LONG}</p></article><article class=comment><p>{LONG}</p></article></div>"
    assert html_blocks.main_text(f"<article><h1>Title</h1><p>{LONG[:200]}</p></article>{comments}") == f"Title {LONG[:200].strip()}"
    assert html_blocks.main_text("<div class=cookie-consent><p>we use cookies and so on</p></div>") == ""


def test_op8_counts(docs, rows):
    expected = []
    for i, t in rows:
        w, covered = re.findall(WORD, t or ""), set()
        seen = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        for k in range(len(w) - 7):
            if seen[tuple(w[k:k + 8])] > 1:
                covered.update(range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        expected.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)),
                         len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = quality_rules.quality_verdicts(docs)
    same(got.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), expected)
    assert got.filter("kept and base_failed or kept is null").count() == 0


def test_op9_equal_windows_choose_equal_runs():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    other = rng.integers(0, 1 << 62, 20, dtype=np.uint64)
    for window in range(11, 61):
        passage = shared[:window]
        for size in substring_dedup._levels(window):
            places = set()
            for lead in range(0, 20, 3):
                hashes = np.concatenate((other[:lead], passage, other[lead:]))
                at = substring_dedup._extended(substring_dedup._choices(hashes, window), window, size)[lead]
                assert lead <= at <= lead + window - size
                places.add(int(at) - lead)
            assert len(places) == 1


@pytest.mark.parametrize("window", [20, 45])
def test_op9_repeats(docs, rows, window):
    flagged, first = collections.defaultdict(set), {}
    where = sorted((math.inf if i is None else i, k, tuple(re.findall(WORD, t or "")), i) for i, t in rows
                   for k in range(max(0, len(re.findall(WORD, t or "")) - window + 1)))
    for key, k, w, _ in where:
        part = w[k:k + window]
        if first.setdefault(part, (key, k)) < (key, k):
            flagged[(key, w)].update(range(k, k + window))
    expected = []
    for i, t in rows:
        w = tuple(re.findall(WORD, t or ""))
        gone = flagged[(math.inf if i is None else i, w)]
        expected.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = substring_dedup.remove_repeats(docs, window=window).select("id", "n", "n_removed", F.when(
        F.col("kept").isNull(), F.col("words_sha")).otherwise(queries.sha256(F.col("kept"))))
    same(got.collect(), expected)


def test_op10_base_and_model(docs, rows):
    from salesloom.llm.brown_lm import score_texts
    def tokens(t):
        return re.findall(WORD, (t or "").translate(FOLD)) + [""]
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows}
    counts = collections.Counter(x for i, t in rows if not held[i] for x in tokens(t))
    total = sum(counts.values())
    expected = [(i, held[i], len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), total, round(sum(
        math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in tokens(t)), 4)) for i, t in rows]
    got = score_texts(docs).collect()
    same([(r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], expected)
    assert all(r.score <= 1e-9 for r in got)


def test_op10_classes_of_all_words(spark, monkeypatch):
    """Words outside the broadcast head have classes and transitions like all others."""
    from salesloom.llm import brown_lm
    docs = spark.createDataFrame(planted(), SCHEMA)
    def scores():
        return sorted(((r.id is None, r.id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
                       for r in brown_lm.score_texts(docs).collect()), key=str)
    whole = scores()
    for head in (40, 0):
        monkeypatch.setattr(brown_lm, "HEAD", head)
        assert scores() == whole


def test_op10_rounds_read_each_pair_once(spark, monkeypatch):
    """A round reads one entry for each distinct pair and side, not every use of it again."""
    from salesloom.llm import brown_lm
    monkeypatch.setattr(brown_lm, "removed", lambda frame: None)
    monkeypatch.setattr(brown_lm, "ROUNDS", 1)
    texts = ["a b a b c", "a b", ""] * 100
    model = brown_lm.BrownModel(spark.createDataFrame(
        [(i, False, t) for i, t in enumerate(texts)], "id long, held_out boolean, text string"))
    pairs = collections.Counter(x for t in texts for x in zip([""] + t.split(), t.split() + [""]))
    got = model.started.filter("block < 0").agg(F.sum(F.octet_length("pairs")) / 4).first()[0]
    assert set(model.head) == {"a", "b", "c"} and got == 2 * len(pairs)


def test_op10_parts_and_sums_change_nothing(spark, monkeypatch):
    """Head blocks cut into parts, and summed in two steps, give the same classes."""
    from salesloom.llm import brown_lm
    monkeypatch.setattr(brown_lm, "ROUNDS", 2)
    docs = spark.createDataFrame([(i, False, f"a b w{i % 7} a v{i % 3} b") for i in range(300)],
                                 "id long, held_out boolean, text string")
    whole = brown_lm.BrownModel(docs)
    monkeypatch.setattr(brown_lm, "PART_USES", 1_000)
    monkeypatch.setattr(brown_lm, "_TASKS", 0)
    parts = brown_lm.BrownModel(docs)
    assert whole.parts.max() == 1 < parts.parts.max()
    assert parts.head == whole.head and parts.moves == whole.moves and (parts.classes == whole.classes).all()
    assert (parts.transition == whole.transition).all()


def test_pipeline_next_to_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {r.id for r in quality_rules.quality_verdicts(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    least = {i: c for i, _, c in brute_components(rows)}
    rows = [(i, t) for i, t in rows if least[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    left = {r[0] for r in brute_hits(rows, items) if not r[5]}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == left and len(got) == len(left)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
