"""Personal data: four kinds by pattern, and unseen identifiers by bootstrapped contexts.

Columns and DataFrame functions only. A lexical pattern is what stands before a token: a label with its sign
and quote (``token = "``, ``member: ``), or a word and a space. Candidates are tokens of ``MIN_SIZE`` characters
or more that hold a digit or @. Seeds are candidates that a match of the four kinds overlaps, and those
with the shape and entropy of a secret (``SECRET``, ``MIN_ENTROPY``). In a graph of patterns and tokens

* a pattern's confidence is the sum of its distinct tokens' scores over their number, plus one that failed, and
  is nothing with fewer than ``MIN_SUPPORT`` tokens that score. A label's tokens are all that follow it; for
  a word, each of its other uses anywhere in the corpus is one that failed, which rules out common words;
* a token's score is 1 for a seed, else the best confidence among its patterns, if that reaches
  ``MIN_CONFIDENCE``.

Confidence is cut to hundredths and only grows, so rounds end by themselves: when none changes. Candidates
that follow a trusted pattern give spans of kind ``found`` where no match of the four kinds overlaps them; a
secret without a trusted pattern before it gives none. An empty table gives no rows, and ties don't arise:
every decision is a sum or a maximum. Added columns are taken from ``docs`` by name only where named.

Places come from running sums over the gaps between matches, one row per match, so a text with any
number of matches takes linear time. The patterns start at the beginning of a run of characters and
are possessive: no text makes them backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesloom.llm.storage import cut

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|(?<=0))"
VALUE = r"[^\s\"'<>,;]"
CONTEXT = (r"(?<![\p{L}\p{N}_.-])[\p{L}_][\p{L}\p{N}_.-]*+\s*+[:=]\s*+[\"']?+(?=(" + VALUE + "++))"
           r"|(?<!\S)[^\s0-9@:=]++\s++(?=((?:(?![0-9@])" + VALUE + ")*+[0-9@]" + VALUE + "*+))")
SECRET = r"^(?=(?:[^0-9]*[0-9]){4})(?=(?:[^A-Za-z]*[A-Za-z]){4})[A-Za-z0-9+/_=-]{16,}$"
FOUND = "found"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SIZE, MIN_ENTROPY = 5, 0.6, 6, 2.8


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))


def _luhn(digits: Column) -> Column:
    """Whether a text of digits passes; every second one from the right counts double."""
    def value(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0),
                       lambda total, x: total + x) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    size = F.length(digits)
    return (F.when(kind == "ip", F.regexp_like(match, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$")))
            .when(kind == "card", F.when(size.between(13, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", size.between(9, 15))
            .otherwise(True))


def _pieces(text: Column, pattern: str) -> Column:
    """Per match: length of the gap before it, and the match."""
    return F.zip_with(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      lambda gap, match: F.struct(F.char_length(gap).alias("gap"), match.alias("match")))


def _placed(rows: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Adds ``end``, the running sum of gaps and sizes in the order of ``at``."""
    order = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum(F.col("gap") + size).over(order).cast("int"))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kind, start, end, match): valid matches of the patterns, in code points, end exclusive."""
    rows = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.regexp_like("text", F.lit("[0-9@]"))).dropDuplicates(["row"])
    needed = {"email": F.contains("text", F.lit("@")), "ip": F.regexp_like("text", F.lit(r"[0-9]\.[0-9]")),
              "card": F.regexp_like("text", F.lit("[0-9]")), "phone": F.regexp_like("text", F.lit(r"\+[0-9]"))}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(needed[k], _pieces(F.col("text"), PATTERNS[k])).alias("pieces"))
                      for k in KINDS])
    found = rows.select("row", F.inline(kinds)).select("row", "kind", F.posexplode("pieces").alias("at", "p"))
    found = found.select("row", "kind", "at", "p.gap", "p.match").filter("match is not null")
    found = _placed(found, ["row", "kind"], F.char_length("match"))
    found = found.filter(_valid(F.col("kind"), F.col("match")))
    return found.select("row", "kind", (F.col("end") - F.char_length("match")).alias("start"), "end", "match")


def contexts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, pattern, token, start): what follows labels, tokens with a digit or @ after words, and where they start."""
    rows = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.regexp_like("text", F.lit("[0-9@:=]"))).dropDuplicates(["row"])
    text, pattern = F.col("text"), F.lit(CONTEXT)
    zipped = F.arrays_zip(F.transform(F.split(text, CONTEXT), lambda x: F.char_length(x)).alias("gap"),
                          F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
                          F.regexp_extract_all(text, pattern, F.lit(1)).alias("labelled"),
                          F.regexp_extract_all(text, pattern, F.lit(2)).alias("other"))
    found = rows.select("row", F.posexplode(zipped).alias("at", "p")).filter("p.whole is not null").select(
        "row", "at", F.col("p.gap").alias("gap"), F.char_length("p.whole").alias("whole"),
        F.lower(F.regexp_replace("p.whole", r"\s+", " ")).alias("pattern"),
        F.regexp_replace(F.concat("p.labelled", "p.other"), r"[.!?:)\]]++$", "").alias("token"))
    return _placed(found, ["row"], F.col("whole")).filter("token <> ''").select(
        "row", "pattern", "token", F.col("end").alias("start"))


def is_candidate(token: Column) -> Column:
    return (F.char_length(token) >= MIN_SIZE) & F.regexp_like(token, F.lit("[0-9@]"))


def is_secret(token: Column) -> Column:
    """Whether a token has the shape of a secret, and characters of ``MIN_ENTROPY`` bits or more on average."""
    letters = F.split(token, "")
    size = F.size(letters)

    def bits(letter: Column) -> Column:
        share = F.size(F.filter(letters, lambda x: x == letter)) / size
        return -share * F.log2(share)

    entropy = F.aggregate(F.transform(F.array_distinct(letters), bits), F.lit(0.0), lambda total, x: total + x)
    return F.regexp_like(token, F.lit(SECRET)) & (entropy >= MIN_ENTROPY)


def trusted(graph: DataFrame, failed: DataFrame) -> DataFrame:
    """(pattern, confidence) of the trusted patterns, after as many rounds as change any.

    ``graph`` holds (pattern, token, candidate, seed): the distinct pairs, and 1.0 if the token is a seed;
    ``failed`` (pattern, failed): further uses that count as failed.
    """
    scores, before = graph.withColumn("score", F.col("seed")), None
    while True:
        patterns = scores.groupBy("pattern").agg(
            F.sum("score").alias("total"), F.count("*").alias("tokens"),
            F.sum((F.col("score") > 0).cast("int")).alias("support")).filter(F.col("support") >= MIN_SUPPORT)
        confidence = F.col("total") / (F.col("tokens") + F.coalesce("failed", F.lit(0)) + 1)
        patterns = cut(patterns.join(failed, "pattern", "left").select(
            "pattern", (F.floor(confidence * 100) / 100).alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE))
        state = patterns.agg(F.count("*"), F.sum(F.round(F.col("confidence") * 100).cast("long"))).first()
        if state == before or not state[0]:
            return patterns
        before = state
        best = graph.filter("candidate").join(patterns, "pattern").groupBy("token").agg(F.max("confidence").alias("best"))
        scores = graph.join(best, "token", "left").select("pattern", "token", F.greatest(
            "seed", F.when(F.col("candidate"), F.coalesce("best", F.lit(0.0))).otherwise(0.0)).alias("score"))


def _failed(docs: DataFrame, text_col: str, seen: DataFrame) -> DataFrame:
    """(pattern, failed): uses of the words among the patterns that no candidate follows."""
    hits = seen.filter("candidate and not rlike(pattern, '[:=]')").groupBy("pattern").agg(F.count("*").alias("hits"))
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"\s+")).alias("word"))
    uses = words.groupBy("word").agg(F.count("*").alias("uses")).withColumn("pattern", F.concat("word", F.lit(" ")))
    return uses.join(hits.filter(F.col("hits") >= MIN_SUPPORT), "pattern").select(
        "pattern", F.greatest(F.col("uses") - F.col("hits"), F.lit(0)).alias("failed"))


def marked_contexts(seeds: DataFrame, seen: DataFrame) -> DataFrame:
    """``seen`` with ``hit`` (a match overlaps the token), ``candidate`` and ``seed``.

    Matches and tokens of a row pass by once, in the order of where a match starts and a token ends: a token is
    overlapped where the largest end of the matches before it lies behind its start.
    """
    none = F.lit(None)
    spans = seeds.select("row", none.cast("string").alias("pattern"), none.cast("string").alias("token"),
                         F.col("start").alias("at"), F.col("end").alias("reach"), none.cast("int").alias("start"))
    tokens = seen.select("row", "pattern", "token", (F.col("start") + F.char_length("token")).alias("at"),
                         none.cast("int").alias("reach"), "start")
    order = Window.partitionBy("row").orderBy("at", F.col("token").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = tokens.unionByName(spans).withColumn("passed", F.max("reach").over(order)).filter("token is not null")
    hit, candidate = F.coalesce(F.col("passed") > F.col("start"), F.lit(False)), is_candidate(F.col("token"))
    out = out.select("row", "pattern", "token", "start", hit.alias("hit"), candidate.alias("candidate"))
    secret = F.when(F.char_length("token") >= 16, is_secret(F.col("token"))).otherwise(False)
    return out.withColumn("seed", (F.col("candidate") & (F.col("hit") | secret)).cast("double"))


def find_private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kind, start, end) of every document row with spans; ``row`` is ``row_key``.

    A null or empty text has no spans. Rows of equal id and text share their row key.
    """
    seeds = cut(base_spans(docs, id_col, text_col))
    seen = cut(marked_contexts(seeds, contexts(docs, id_col, text_col)))
    graph = cut(seen.groupBy("pattern", "token").agg(F.max("candidate").alias("candidate"), F.max("seed").alias("seed")))
    patterns = trusted(graph, cut(_failed(docs, text_col, seen)))
    found = seen.filter("candidate and not hit").join(patterns, "pattern").select(
        "row", F.lit(FOUND).alias("kind"), "start", (F.col("start") + F.char_length("token")).alias("end"))
    return seeds.select("row", "kind", "start", "end").unionByName(found)


def rank(kind: Column) -> Column:
    """Place of a kind in reports."""
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, FOUND)]), kind)


def private_data_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_email, n_ip, n_card, n_phone, base, spans) of every row, in the order of kinds, then starts.

    ``base`` and ``spans`` are texts of kind:start:end, joined by commas; ``base`` without the found ones.
    """
    item = F.struct(rank(F.col("kind")).alias("k"), "start",
                    F.concat_ws(":", "kind", "start", "end").alias("text"))
    spans = find_private_data(docs, id_col, text_col)
    rows = spans.groupBy("row").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(item)).alias("items"))

    def joined(items: Column) -> Column:
        return F.concat_ws(",", F.transform(items, lambda x: x["text"]))

    rows = rows.select("row", *[f"n_{k}" for k in KINDS], joined(F.col("items")).alias("spans"),
                       joined(F.filter("items", lambda x: x["k"] <= len(KINDS))).alias("base"))
    out = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row")).join(rows, "row", "left")
    return out.select("row", "id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; columns and rows stay.

    Spans that overlap are masked as one, under the kind that starts first.
    """
    row = row_key(id_col, text_col)
    before = Window.partitionBy("row").orderBy("start", "k", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = find_private_data(docs, id_col, text_col).withColumn("k", rank(F.col("kind")))
    spans = spans.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    spans = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "k", "end", "covered", "kind"))).alias("spans"))
    spans = spans.select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    text = F.col(text_col)

    def piece(x: Column, i: Column) -> Column:
        """The mask of a span, and what follows it up to the next one."""
        begin = F.greatest(x["covered"], x["end"])
        after = F.coalesce(F.get(F.col("__spans"), i + 1)["start"], F.char_length(text))
        return F.concat(F.when(x["start"] >= x["covered"], F.concat(F.lit("<"), x["kind"], F.lit(">"))).otherwise(""),
                        F.substring(text, begin + 1, F.greatest(after - begin, F.lit(0))))

    whole = F.concat(F.substring(text, F.lit(1), F.get(F.col("__spans"), F.lit(0))["start"]),
                     F.concat_ws("", F.transform("__spans", piece)))
    kept = docs.withColumn("__row", row).join(spans, "__row", "left")
    return kept.withColumn(text_col, F.when(F.col("__spans").isNull(), text).otherwise(whole)).drop("__row", "__spans")
