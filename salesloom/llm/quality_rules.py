"""Quality rules: counts of a text, and how far its histograms lie from those of its language.

Columns and DataFrame functions only. Every text is read whole, once; a row of counts per document
is kept in the checkpoint folder. The references are the histograms of all documents of a language
taken together. Jensen-Shannon distances (base 2, square root of the divergence) compare

* character classes: share of lower case, upper case, digits, symbols, other ASCII, other letters;
* common words: share of each of ``COMMON_WORDS`` among them, and of none of them.

A distance counts only from a least length on (``MIN_CHARS``, ``MIN_COMMON_WORDS_LENGTH``), since the histogram
of a short text is far from any reference by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.storage import cut
from salesloom.llm.text import SPACE_PATTERN, let, words

# Function words of four languages.
COMMON_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was",
                "der", "die", "und", "den", "das", "ist", "nicht", "mit", "von", "zu",
                "la", "de", "que", "los", "las", "el", "en", "y",
                "le", "les", "des", "et", "un", "une", "du", "pour")
CHARACTER_CLASSES = ("lower", "upper", "digit", "symbol", "ascii", "other")
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8

MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
MIN_CHARS, MIN_COMMON_WORDS_LENGTH = 200, 120
MAX_CHARACTER_DISTANCE, MAX_WORD_DISTANCE = 0.34, 0.25


def _covered(hashes: Column) -> Column:
    """Number of words in windows whose hash stands twice or more."""
    def of_sorted(sorted_: Column) -> Column:
        doubled = F.filter(sorted_, lambda x, i: (
            F.coalesce(F.get(sorted_, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(sorted_, i + 1)["h"] == x["h"], F.lit(False))))
        return let(F.sort_array(F.transform(doubled, lambda x: x["i"])), lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x))

    return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def repeat_words(word_list: Column) -> Column:
    """Words inside runs of ``WINDOW`` words that stand twice or more in the list."""
    def windows(one: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(one) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(one, i + k) for k in range(WINDOW)]))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _covered(hashes)).otherwise(0)

    hashed = F.transform(word_list, lambda x: F.xxhash64(x))
    return F.when(F.size(word_list) > WINDOW, let(hashed, lambda one: let(windows(one), count))).otherwise(0)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str | None = "lang") -> DataFrame:
    """One row per document: the counts the rules need, as longs; ``chars`` and ``common`` are histograms."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), text.alias("text"), words(text).alias("w"))
    rest = F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "id", "lang", "w", F.char_length(F.concat_ws("", "w")).alias("word_chars"),
        let(rest, lambda r: F.struct(
            F.char_length(r).alias("rest"),
            *[(F.char_length(r) - F.char_length(F.regexp_replace(r, pattern, ""))).alias(name) for name, pattern in
              (("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", SYMBOLS), ("other", r"[^\x00-\x7F]+"))])).alias("r"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        F.filter("w", lambda x: x.isin(*COMMON_WORDS)).alias("kept_words"))
    r = F.col("r")
    return rows.select(
        "id", "lang", F.size("w").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        r["symbol"].cast("long").alias("n_symbols"), F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.array(F.col("word_chars") - r["rest"], r["upper"], r["digit"], r["symbol"],
                r["rest"] - r["upper"] - r["digit"] - r["symbol"] - r["other"], r["other"]).alias("chars"),
        F.concat(let(F.col("kept_words"), lambda kept: F.transform(
            F.array(*[F.lit(x) for x in COMMON_WORDS]), lambda c: F.size(F.filter(kept, lambda x: x == c)))),
            F.array(F.size("w") - F.size("kept_words"))).alias("common"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda t, x: t + x)
    return let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(0.0)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance from 0 to 1 between two arrays of shares."""
    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    both = F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda t, x: t + x)))


def language_references(counts: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_common): the histograms of all documents of a language, added up."""
    def added(column: str, n: int) -> Column:
        return F.array(*[F.sum(F.get(column, F.lit(i))).cast("double") for i in range(n)])

    return counts.groupBy("lang").agg(
        _shares(added("chars", len(CHARACTER_CLASSES))).alias("ref_chars"),
        _shares(added("common", len(COMMON_WORDS) + 1)).alias("ref_common"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str | None = "lang") -> DataFrame:
    """Counts, distances, ``base_failed`` and ``kept`` of every row.

    A null or blank text has no words and fails. A null language is a language of its own. Rows
    that repeat an id are judged each for itself. An empty table gives no rows.
    """
    counts = cut(text_counts(docs, id_col, text_col, lang_col))
    rows = counts.join(language_references(counts).withColumnRenamed("lang", "ref_lang"),
                       F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    rows = rows.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words").alias("base_failed"),
        F.when(F.col("word_chars") >= MIN_CHARS, jensen_shannon(_shares(F.col("chars")), F.col("ref_chars")))
        .alias("character_distance"),
        F.when(F.col("n_words") >= MIN_COMMON_WORDS_LENGTH,
               jensen_shannon(_shares(F.col("common")), F.col("ref_common"))).alias("word_distance"))
    near = (F.coalesce(F.col("character_distance") <= MAX_CHARACTER_DISTANCE, F.lit(True))
            & F.coalesce(F.col("word_distance") <= MAX_WORD_DISTANCE, F.lit(True)))
    return rows.withColumn("kept", ~F.col("base_failed") & near)
