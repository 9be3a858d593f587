"""URL rules, and host reputation by empirical Bayes.

Columns and DataFrame functions only. Rules are joined to hosts on equality: a host has one row per
suffix of its labels, a rule one host; of those whose path the url's path starts with, the longest
holds. Other urls are judged by their host: labelled outcomes of pages are counted per host,
registered domain and public suffix, and a share of good pages is shrunk from level to level by a
beta prior around the level above. How strong a prior is comes from the spread of the shares below
it (method of moments). A host passes if the lower bound of its posterior reaches ``MIN_BOUND``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Public suffixes of two labels; others are the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
MIN_BOUND, DEVIATIONS = 0.5, 1.645
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 200.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def public_suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, action): the longest fitting rule of each distinct url that has one.

    ``urls``: url, host, path. ``rules``: action, host, path. Of equal length, the first rule text.
    """
    parts = F.split("host", r"\.")
    suffixes = urls.select("url", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))).alias("suffix"))
    rule = F.concat(F.col("host"), F.col("path"))
    wanted = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "action", rule.alias("rule"))
    fits = suffixes.join(wanted, "suffix").filter(F.expr("startswith(path, start)"))
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), F.col("rule")))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.action")


def _strength(share: Column, prior: Column, n: Column) -> Column:
    """Prior strength by moments: how much shares below a level differ beyond chance."""
    seen = F.sum(n * (share - prior) ** 2) / F.sum(n)
    chance = F.sum(prior * (1 - prior)) / F.sum(n)
    between = F.greatest(seen - chance, F.lit(1e-9))
    spread = F.sum(n * prior * (1 - prior)) / F.sum(n)
    return F.least(F.greatest(spread / between - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def _shrunk(level: DataFrame, prior: Column) -> DataFrame:
    """Adds ``mean`` (shrunk share) and ``strength`` to rows with n and good."""
    level = level.withColumn("prior", prior)
    strength = level.filter("n > 0").agg(F.coalesce(
        _strength(F.col("good") / F.col("n"), F.col("prior"), F.col("n")), F.lit(LEAST_STRENGTH)).alias("strength"))
    level = level.join(F.broadcast(strength))
    return level.withColumn("mean", (F.col("good") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))


def reputations(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, good, mean, bound) of all ``hosts``.

    ``outcomes``: host and good (1 or 0) per labelled page. Without any, every mean is one half.
    """
    counted = outcomes.filter(F.col("good").isin(0, 1)).groupBy("host").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"))
    rows = hosts.select("host").distinct().join(counted, "host", "left").select(
        "host", registered_domain(F.col("host")).alias("domain"), public_suffix(F.col("host")).alias("suffix"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    total = rows.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("share"))
    by_suffix = rows.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).join(F.broadcast(total))
    by_suffix = _shrunk(by_suffix, F.col("share")).select("suffix", F.col("mean").alias("suffix_mean"))
    by_domain = rows.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    by_domain = _shrunk(by_domain.join(by_suffix, "suffix"), F.col("suffix_mean")).select(
        "domain", F.col("mean").alias("domain_mean"))
    by_host = _shrunk(rows.join(by_domain, "domain"), F.col("domain_mean"))
    mean = F.col("mean")
    bound = mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (F.col("n") + F.col("strength") + 1))
    return by_host.select("host", "n", "good", "mean", bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, bound, verdict) of every row.

    A url that is null or has no ``://`` has an empty host and path and no rule; it is judged by
    the reputation of the empty host. Rows that repeat a url are judged alike.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    matches = rule_matches(rows.filter("host != ''").select("url", "host", "path").distinct(), rules)
    known = reputations(rows.select("host"), outcomes)
    out = rows.join(matches, "url", "left").join(known.select("host", "bound"), "host", "left")
    verdict = F.coalesce("action", F.when(F.col("bound") >= MIN_BOUND, F.lit("allow")).otherwise(F.lit("block")))
    return out.select("id", "host", "path", "rule", "bound", verdict.alias("verdict"))
