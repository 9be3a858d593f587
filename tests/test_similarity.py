from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from salesloom.operators import documents, index, retrieval, similarity
from salesloom.plans import context
from salesloom.sources import index_table
from salesloom.sources.index_table import cache_index, newest_version, read_index, write_index
from salesloom.streaming.index_stream import upsert_stream

PLANS = {"broadcast index": {}, "broadcast queries": {"broadcast_rows": 30},
         "blocks": {"broadcast_rows": 1, "block_rows": 5}}


def cosine(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    if len(a) != len(b) or na == 0 or nb == 0:
        return 0.0
    return sum(x * y for x, y in zip(a, b)) / (na * nb)


def l2(a, b):
    return 1 / (1 + sum((x - y) ** 2 for x, y in zip(a, b))) if len(a) == len(b) else 0.0


def brute_force(stored, asked, k, score):
    out = []
    for q, query in asked:
        ranked = sorted(((round(score(query, v), 12), pos) for pos, v in stored),
                        key=lambda r: (-r[0], r[1]))[:k]
        out += [(q, i, pos, pytest.approx(s, abs=1e-9)) for i, (s, pos) in enumerate(ranked, 1)]
    return out


def run(spark, stored, asked, k, metric="cosine", many_equal=False, **limits):
    rows = spark.createDataFrame([(f"d{p}", p, v) for p, v in stored],
                                 "id string, pos long, embedding array<double>")
    queries = spark.createDataFrame(asked, "q int, embedding array<double>")
    found = similarity.top_k(rows.repartition(3), queries, k, metric, many_equal=many_equal,
                             **limits)
    assert found.columns == ["q", "rank", "id", "pos", "score"]
    return [(r.q, r["rank"], r.pos, r.score) for r in found.orderBy("q", "rank").collect()]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("metric, score, many_equal", [
    ("cosine", cosine, False), ("cosine", cosine, True), ("l2", l2, False)])
def test_top_k_against_brute_force(spark, plan, metric, score, many_equal):
    rng = random.Random(1)
    # One vector makes up a third of all rows; others repeat, are zero or of other length.
    hot = [3.0, 1.0, 2.0]
    stored = [(p, hot if p % 3 == 0 else [float(rng.randint(0, 3)) for _ in range(3)])
              for p in range(150)]
    stored += [(150, [0.0, 0.0, 0.0]), (151, [1.0, 2.0])]
    asked = [(q, [float(rng.randint(0, 4)) for _ in range(3)]) for q in range(25)]
    asked += [(25, [0.0, 0.0, 0.0]), (26, [2.0, 4.0])]
    found = run(spark, stored, asked, 4, metric, many_equal, **PLANS[plan])
    assert found == brute_force(stored, asked, 4, score)


@pytest.mark.parametrize("k", [0, -1])
def test_no_rows_for_no_k(spark, k):
    assert run(spark, [(0, [1.0])], [(0, [1.0])], k) == []


def test_default_k_and_short_index(spark):
    stored = [(p, [1.0, float(p)]) for p in range(9)]
    assert len(run(spark, stored, [(0, [1.0, 1.0])], None)) == 5
    assert len(run(spark, stored[:2], [(0, [1.0, 1.0])], 5)) == 2
    with pytest.raises(ValueError, match="dot"):
        run(spark, stored, [(0, [1.0, 1.0])], 5, "dot")


@pytest.mark.parametrize("plan", PLANS)
def test_empty_sides(spark, plan):
    assert run(spark, [], [(0, [1.0])], 5, **PLANS[plan]) == []
    assert run(spark, [(0, [1.0])], [], 5, **PLANS[plan]) == []


def fake_vectors(texts: pd.Series) -> list[list[float]]:
    return [[1.0, 0.0] if "headphones" in t.lower() else
            [0.0, 1.0] if "apples" in t.lower() else [0.0, 0.0] for t in texts]


@pytest.fixture
def shop(sales_frame):
    return sales_frame([("2024-03-10", 1200000.0, "Electronics", "Wireless Headphones", 0),
                        ("2024-03-11", 80000.0, "Groceries", "Fresh Apples", 1)],
                       "date string, amount double, category string, product string, key long")


def test_document_text(spark, sales_frame):
    tx = sales_frame([("2024-03-10 08:00:00.5", 12000000.5, "", None, 7, "web")],
                     "date string, amount double, category string, product string, key long,"
                     " channel string")
    row = documents.documents(tx, "key").first()
    assert row.text == ("Transaction txn-7 on 2024-03-10T08:00:00.500000, with amount "
                        "12000000.5, via channel web.")
    assert (row.metadata.category, row.metadata.product, row.metadata.row_index) == ("", None, 7)
    bare = tx.select(F.lit(None).cast("timestamp_ntz").alias("date"),
                     F.lit(None).cast("double").alias("amount"), "key")
    assert documents.documents(bare, "key").first().text == "Transaction txn-7."


def test_search_with_a_provider(spark, shop):
    rows = documents.index_rows(shop, "key", fake_vectors)
    asked = spark.createDataFrame([(0, "customer bought new headphones"), (1, "nothing")],
                                  "q int, query string")
    found = retrieval.search(asked, rows, "query", ["q"], 1, fake_vectors).orderBy("q").collect()
    assert [(r.q, r.id, r.score) for r in found] == [(0, "txn-0", 1.0), (1, "txn-0", 0.0)]
    assert "Wireless Headphones" in found[0].text
    only = retrieval.search(asked, rows, "query", ["q"], 5, fake_vectors,
                            where=F.col("metadata.category") == "Groceries")
    assert {r.id for r in only.collect()} == {"txn-1"}


def test_provider_must_answer_every_text(spark, shop):
    with pytest.raises(Exception, match="1 vectors for"):
        documents.embed(documents.documents(shop.coalesce(1), "key"), "text",
                        lambda texts: [[1.0]]).collect()


def test_empty_index_keeps_questions(spark, shop):
    rows = documents.index_rows(shop.limit(0), "key")
    asked = spark.createDataFrame([(0, "anything")], "q int, query string")
    typed = retrieval.retrieved_rows(retrieval.search(asked, rows, "query", ["q"]))
    assert typed.count() == 0 and retrieval.context_block(typed, ["q"]).count() == 0
    context_row = retrieval.contexts(asked, typed, ["q"]).first()
    assert context_row.matches == [] and context_row.top_k == 5
    assert retrieval.contexts(asked, typed, ["q"], top_k_rows=None).first().top_k == 0


MATCH = ("q int, rank int, id string, pos long, score double, text string, "
         "metadata struct<transaction_id string, date string, amount double, category string, "
         "product string, customer_id string, channel string, row_index long>")


@pytest.fixture
def matches(spark):
    full = ("txn-1", "2024-03-10", 1200000.0, "Electronics", "Headphones", "c1", "web", 1)
    return spark.createDataFrame([
        (0, 1, "m1", 0, 0.9876, "some text", full),
        (0, 2, "m2", 1, 0.5, None, (None,) * 8),
        (1, 1, "m3", 2, 0.25, "", (None, "2024-03-11", 1.5, None, None, None, None, None)),
    ], MATCH)


def test_typed_rows_and_fallbacks(spark, matches):
    typed = retrieval.retrieved_rows(matches)
    rows = {r.id: r for r in typed.collect()}
    assert (rows["m1"].transaction_id, rows["m1"].amount) == ("txn-1", 1200000.0)
    assert (rows["m2"].transaction_id, rows["m2"].date) == ("m2", None)
    asked = spark.createDataFrame([(0, "a"), (1, "b")], "q int, query string")
    docs = {r.metadata.id: r for r in retrieval.retrieved_documents(
        typed, asked, ["q"], top_k_rows=None).collect()}
    assert docs["m1"].page_content == "some text" and docs["m1"].metadata.top_k == 2
    assert docs["m2"].page_content == "Retrieved transaction m2"
    assert docs["m3"].page_content == "Retrieved transaction m3: date=2024-03-11, amount=1.5"


def test_json_and_filters(spark, matches):
    typed = retrieval.retrieved_rows(matches)
    asked = spark.createDataFrame([(0, "a"), (7, "none")], "q int, query string")
    merged = retrieval.merged_filters({"month": "3", "year": "2023"}, {"year": "2024"})
    assert merged == {"month": "3", "year": "2024"}
    found = retrieval.contexts(asked, typed, ["q"], top_k_rows=None, language="id",
                               filters=retrieval.filters_column(merged))
    texts = {r.q: r.context_json for r in retrieval.context_json(found, ["q"]).collect()}
    assert texts[7] == ('{"query":"none","top_k":0,"language":"id",'
                        '"filters":{"month":"3","year":"2024"},"matches":[]}')
    assert '"id":"m2","score":0.5,"transaction_id":"m2","date":null' in texts[0]


def test_lines_and_blocks(matches):
    typed = retrieval.retrieved_rows(matches)
    lines = {(r.q, r["rank"]): r.line for r in retrieval.result_lines(typed, ["q"]).collect()}
    assert lines[0, 1] == ("1. 2024-03-10 | id=txn-1 | category=Electronics | product=Headphones"
                           " | amount=1200000.0 | similarity=0.988")
    assert lines[0, 2] == "2. ? | id=m2 | category=? | product=? | amount=? | similarity=0.500"
    blocks = {r.q: r.block for r in retrieval.context_block(typed, ["q"]).collect()}
    assert blocks[0] == (
        "[RAG context: relevant transactions]\n"
        "1. 2024-03-10 | category=Electronics | product=Headphones | amount=1,200,000.00 | "
        "similarity=0.988\n"
        "2. ? | category=- | product=- | amount=n/a | similarity=0.500")
    short = {r.q: r.block for r in retrieval.context_block(
        typed, ["q"], "id", "report", max_items=1, max_chars=60, marker=True).collect()}
    assert short[0].startswith("[Konteks RAG: contoh transaksi]\n1. 2024-03-10 | kategori=")
    assert short[0].endswith("\n[Context truncated for length]")


def test_question_query(spark):
    asked = spark.createDataFrame([(" why? ", 12.5, 3), ("", 0.0, 0)],
                                  "question string, total_revenue double, n_transactions long")
    asked = asked.withColumn("o", F.struct("total_revenue", "n_transactions"))
    head = "transactions that help answer the following business question: "
    assert [r[0] for r in asked.select(
        context.question_query(F.col("question"), F.col("o"))).collect()] == [
        head + "why?; overall revenue around 12.50; 3 transactions total",
        head + "overall revenue around 0.00; 0 transactions total"]


# ---------------------------------------------------------------------------
# Index tables
# ---------------------------------------------------------------------------


def merged_by_hand(old, new):
    """(id, text) in index order: last write wins, known ids keep their place."""
    table = dict(old)
    for key, text in new:
        table[key] = text
    return list(table.items())


def index_frame(spark, rows):
    return spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)],
                                 "id string, pos long, text string")


@pytest.mark.parametrize("old, new", [
    ([("a", "1"), ("b", "2")], [("c", "3"), ("b", "9")]),
    ([], [("x", "1"), ("y", "2")]),
    ([("a", "1")], []),
    ([("a", "1"), ("b", "2")], [("b", "first"), ("z", "4"), ("b", "last"), ("y", "5")]),
])
def test_upsert(spark, old, new):
    found = index.upsert(index_frame(spark, old), index_frame(spark, new))
    assert [(r.id, r.text) for r in found.orderBy("pos").collect()] == merged_by_hand(old, new)


def test_last_state_of_a_batch_wins(spark, sales_frame):
    columns = "date string, amount double, key long, seq long"
    old = sales_frame([("2024-01-01", 1.0, 7, 0), ("2024-01-01", 2.0, 3, 1)], columns)
    new = sales_frame([("2024-01-02", 5.0, 9, 10), ("2024-01-02", 4.0, 7, 11),
                       ("2024-01-03", 6.0, 9, 12)], columns)
    rows = [documents.index_rows(tx, "key", pos_col="seq") for tx in (old, new)]
    found = index.upsert(*rows).orderBy("pos").collect()
    assert [(r.id, r.metadata.amount) for r in found] == [
        ("txn-7", 4.0), ("txn-3", 2.0), ("txn-9", 6.0)]


def test_index_table(spark, shop, tmp_path):
    path = str(tmp_path)
    assert read_index(spark, path, "shop") is None
    rows = documents.index_rows(shop, "key")
    write_index(rows.where("id = 'txn-0'"), path, "shop")
    write_index(rows.where("id = 'txn-1'"), path, "shop")
    assert [r.id for r in read_index(spark, path, "shop").orderBy("pos").collect()] == [
        "txn-0", "txn-1"]
    write_index(rows.where("id = 'txn-1'"), path, "shop", rebuild=True)
    assert [r.id for r in read_index(spark, path, "shop").collect()] == ["txn-1"]
    (tmp_path / "shop" / "v000009").mkdir()  # an unfinished build is not read
    assert read_index(spark, path, "shop").count() == 1
    cached = cache_index(read_index(spark, path, "shop"), "shop_index")
    assert spark.table("shop_index").count() == cached.count() == 1


def test_stream_keeps_the_index_up_to_date(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.csv").write_text("key,order_date,total_price\n1,2024-01-05,10\n2,bad,5\n")
    columns = {"date": "order_date", "amount": "total_price"}

    def run_once():
        raw = (spark.readStream.schema("key string, order_date string, total_price string")
               .option("header", True).csv(str(inbox)))
        upsert_stream(raw, "key", str(tmp_path / "index"), "tx", str(tmp_path / "check"),
                      columns, once=True).awaitTermination()
        rows = read_index(spark, str(tmp_path / "index"), "tx").orderBy("pos").collect()
        return [(r.id, r.metadata.amount) for r in rows]

    assert run_once() == [("txn-1", 10.0)]
    (inbox / "2.csv").write_text("key,order_date,total_price\n1,2024-01-05,11\n3,2024-1-6,7\n")
    assert run_once() == [("txn-1", 11.0), ("txn-3", 7.0)]


def listed(tmp_path, name="i"):
    version = newest_version(SparkSession.active(), str(tmp_path), name)
    return {b: folder for b, (folder, _, _) in version.folders.items()}


def files_below(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_an_update_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path)
    old = [(f"id{k}", k) for k in range(200)]
    frame = spark.createDataFrame([(i, k, f"old {k}") for i, k in old], "id string, pos long, text string")
    write_index(frame, path, "i", buckets=16)
    before, files = listed(tmp_path), files_below(tmp_path / "i")
    new = spark.createDataFrame([("id7", 0, "new"), ("id300", 1, "more"), ("id9", 2, "new")],
                                "id string, pos long, text string")
    version = write_index(new, path, "i")
    after = listed(tmp_path)
    touched = {r[0] for r in new.select(index_table.bucket_of(F.col("id"), 16)).collect()}
    assert {b for b in after if before.get(b) != after[b]} == touched and len(touched) < 4
    assert all(files_below(tmp_path / "i")[f] == at for f, at in files.items())  # nothing was written anew
    rows = {r.id: (r.pos, r.text) for r in read_index(spark, path, "i").collect()}
    expected = {i: (k, f"old {k}") for i, k in old} | {"id7": (7, "new"), "id9": (9, "new"), "id300": (201, "more")}
    assert rows == expected and version.rows == 201 and version.end == 201
    few = index_table.read_ids(spark, path, "i", ["id7", "id300", "unknown"])
    assert {r.id for r in few.collect()} == {"id7", "id300"}
    assert len(few.inputFiles()) < len(read_index(spark, path, "i").inputFiles())


def test_old_versions_go_and_readers_of_kept_ones_stay(spark, tmp_path):
    path = str(tmp_path)

    def batch(k):
        return spark.createDataFrame([("same", 0, f"state {k}"), (f"only {k}", 1, "x")], "id string, pos long, text string")

    write_index(batch(0), path, "i", buckets=4)
    running = read_index(spark, path, "i")
    for k in range(1, 5):
        write_index(batch(k), path, "i", keep=2)
        if k == 1:
            assert running.where("id = 'same'").first().text == "state 0"  # still among the kept ones
    assert sorted(f.name for f in (tmp_path / "i" / "versions").glob("*.json")) == ["v000004.json", "v000005.json"]
    kept = {folder for n in (4, 5) for folder, _, _ in index_table._load(spark, f"{path}/i", n).folders.values()}
    assert {str(f.parent.relative_to(tmp_path / "i")) for f in (tmp_path / "i").rglob("*.parquet")} == kept
    rows = {r.id: r.text for r in read_index(spark, path, "i").collect()}
    assert rows == {"same": "state 4"} | {f"only {k}": "x" for k in range(5)}


def test_a_writer_that_comes_second_merges_again(spark, tmp_path, monkeypatch):
    path, columns = str(tmp_path), "id string, pos long, text string"
    write_index(spark.createDataFrame([("a", 0, "1")], columns), path, "i", buckets=2)
    publish, raced = index_table.shared_files.publish, []

    def slow(session, target, text, draft):
        if not raced:
            raced.append(True)
            write_index(spark.createDataFrame([("b", 0, "other"), ("a", 1, "other")], columns), path, "i")
        return publish(session, target, text, draft)

    monkeypatch.setattr(index_table.shared_files, "publish", slow)
    version = write_index(spark.createDataFrame([("a", 0, "mine"), ("c", 1, "mine")], columns), path, "i")
    rows = {r.id: (r.pos, r.text) for r in read_index(spark, path, "i").collect()}
    assert version.number == 3 and rows == {"a": (0, "mine"), "b": (1, "other"), "c": (3, "mine")}


def test_an_empty_batch_and_an_empty_index(spark, tmp_path):
    path, columns = str(tmp_path), "id string, pos long, text string"
    write_index(spark.createDataFrame([], columns), path, "i")
    assert read_index(spark, path, "i").count() == 0
    write_index(spark.createDataFrame([("a", 5, "1"), (None, 6, "no id")], columns), path, "i")
    write_index(spark.createDataFrame([], columns), path, "i")
    assert {(r.id, r.pos) for r in read_index(spark, path, "i").collect()} == {("a", 0), (None, 1)}
    with pytest.raises(ValueError, match="at least 1"):
        write_index(spark.createDataFrame([], columns), path, "i", buckets=0)
