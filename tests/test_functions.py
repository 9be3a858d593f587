from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.functions import formatting as fmt
from salesloom.functions import labels, parsing, vectors
from salesloom.operators.documents import local_embedding


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("x"))).collect()]


def test_float_text_is_python_repr(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 1.0, 12000000.5, 1e16, 1e15, 1e-4, 1.5e-5, 123456789.25, 1e22, 1e-7,
              0.1, 2.5, 9999999.99, 1e7, 0.00012345, float("inf"), float("-inf"), 1.5e300]
    values += [round(rng.uniform(-1e6, 1e6), 2) for _ in range(200)]
    values += [round(rng.uniform(0, 10 ** rng.randint(0, 15)), rng.randint(0, 6))
               for _ in range(200)]
    assert column(spark, values, "double", fmt.float_text) == [repr(v) for v in values]


def test_numbers_round_half_even_on_the_binary_value(spark):
    values = [2.5, 3.5, 2.675, 1234567.005, -0.4, 0.125, 1e12 + 0.5, -1234.565]
    assert column(spark, values, "double", lambda x: fmt.number(x, 2)) == [
        f"{v:,.2f}" for v in values]
    assert column(spark, values, "double", lambda x: fmt.percent(x)) == [
        f"{v:.2f}%" for v in values]
    assert column(spark, values, "double", fmt.currency) == [
        "Rp" + f"{v:,.0f}".replace(",", ".") for v in values]
    assert column(spark, [None], "double", fmt.currency) == ["N/A"]
    assert column(spark, [None], "double", fmt.percent) == ["N/A"]


def test_number_parsing(spark):
    good = {" 12 ": 12.0, "1e3": 1000.0, "inf": float("inf"), "-Infinity": float("-inf"),
            ".5": 0.5, "7.": 7.0, "+3": 3.0}
    bad = ["1,000", "1d", "1f", "1_000", "0x1A", "true", "", "abc", "1e400", "nan", "1 2", None]
    parse = lambda x: parsing.parse_number(x, T.StringType())
    assert column(spark, list(good), "string", parse) == list(good.values())
    assert column(spark, bad, "string", parse) == [None] * len(bad)
    nan_free = lambda x: parsing.parse_number(x, T.DoubleType())
    assert column(spark, [1.5, float("nan")], "double", nan_free) == [1.5, None]


def test_date_parsing(spark):
    parse = lambda x: parsing.parse_date(x, T.StringType(), "%Y-%m-%d").cast("string")
    good = {"2024-01-05": "2024-01-05 00:00:00", "2024-1-5": "2024-01-05 00:00:00",
            "2024-02-29": "2024-02-29 00:00:00"}
    bad = ["2024-02-30", "2024-01-05 10:00", " 2024-01-05", "20240105", "24-1-5", "2024-13-01",
           "NA", None]
    assert column(spark, list(good), "string", parse) == list(good.values())
    assert column(spark, bad, "string", parse) == [None] * len(bad)
    timed = lambda x: parsing.parse_date(
        x, T.StringType(), "%d/%m/%Y %H:%M").cast("string")
    assert column(spark, ["5/1/2024 7:30", "2024-01-05"], "string", timed) == [
        "2024-01-05 07:30:00", None]
    free = lambda x: parsing.parse_date(x, T.StringType(), None).cast("string")
    assert column(spark, ["2024-01-05T10:00:00", "soon"], "string", free) == [
        "2024-01-05 10:00:00", None]


def counts(text: str) -> list[float]:
    return [float(len(text)), float(sum(c.isalpha() for c in text)),
            float(sum(c.isdigit() for c in text)), float(sum(c.isspace() for c in text))]


def test_local_embedding_counts_like_python(spark):
    texts = ["", "Hello 42", "½ ² ³ ① Ⅷ ٣ 中文字 é́   　\x1c\x85x", "a\tb\nc\r\x0b\x0c",
             "🄀😀 𐩀 𝟘 ªº ʰ", "x" * 5000 + "9" * 300]
    rng = random.Random(3)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250),
                                      rng.randrange(0x370, 0x1FFF), rng.randrange(0x2000, 0x2BFF)]))
                      for _ in range(60)) for _ in range(100)]
    # Characters that every Unicode version in use knows.
    known = unicodedata.ucd_3_2_0.category
    texts[6:] = ["".join(c for c in t if known(c) not in ("Cn", "Cs")) for t in texts[6:]]
    found = column(spark, texts, "string", local_embedding)
    assert found == [counts(t) for t in texts]
    assert column(spark, [None], "string", local_embedding) == [[0.0] * 4]


def test_local_embedding_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for row in docs.select("text", local_embedding(F.col("text")).alias("e")).collect():
        assert row.e == counts(row.text)


def test_texts(spark):
    names = ["plain", "it's", 'both \' and "', "back\\slash", "line\nbreak"]
    assert column(spark, names, "string", fmt.quoted) == [repr(n) for n in names]
    assert column(spark, ["short", "much longer"], "string",
                  lambda x: fmt.cut(x, 5, "…")) == ["short", "much …"]
    assert column(spark, ["much longer"], "string",
                  lambda x: fmt.cut(x, 5, "…", strip=True)) == ["much…"]
    assert column(spark, ["v"], "string", lambda x: fmt.fill("a {n} b", n=x)) == ["a v b"]
    assert column(spark, ["v"], "string", lambda x: fmt.fill("a {m} b", n=x)) == ["a {m} b"]
    assert column(spark, ["v"], "string", lambda x: fmt.fill("a {n b", n=x)) == ["a {n b"]
    moments = ["2024-01-05 10:00:00", "2024-01-05 10:00:00.5", "2024-01-05"]
    assert column(spark, moments, "string", lambda x: fmt.iso_timestamp(x.cast("timestamp_ntz"))
                  ) == ["2024-01-05T10:00:00", "2024-01-05T10:00:00.500000",
                        "2024-01-05T00:00:00"]


def test_languages_and_labels(spark):
    asked = ["id", "ID-id", " indonesian", "en", "de", "", None]
    expected = ["id", "id", "en", "en", "en", "en", "en"]
    assert [fmt.language_code(x) for x in ["id", "ID-id", "en", "de", "", None]] == [
        "id", "id", "en", "en", "en", "en"]
    assert column(spark, asked, "string", fmt.language_column)[:2] == expected[:2]
    assert labels.label("report.title", "id") == "LAPORAN INSIGHT KEUANGAN"
    assert labels.label("report.title", "xx") == "FINANCIAL INSIGHT REPORT"
    assert labels.label("no.such.key", "id") == "no.such.key"
    assert set(labels.LABELS["en"]) == set(labels.LABELS["id"])


def test_cosine(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]),
            ([1.0], [1.0, 2.0]), ([], [])]
    frame = spark.createDataFrame(rows, "a array<double>, b array<double>")
    found = [r[0] for r in frame.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert found == [1.0, 0.0, 0.0, 0.0, 0.0]
