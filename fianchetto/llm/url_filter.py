"""URL rules by host suffix and path prefix, with built-in DataFrame functions only.

Each URL is expanded into the expressions host suffix + path prefix that a rule could have; their SHA-256 digests meet
the rules' digests by equi-join on a short prefix, are confirmed in full, and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest by which URLs and rules are joined.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Host suffixes of the given numbers of labels, each with the path prefixes of the given lengths, as an array of
    ``suffix, new line, prefix``.  Only sizes that occur among the rules are worth making; no others can match."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.array(*[F.when((host != "") & (F.size(parts) >= n), F.array_join(F.slice(parts, -n, n), ".")) for n in labels])
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    both = F.transform(F.array_compact(suffixes), lambda s: F.transform(F.array_compact(prefixes), lambda p: F.concat(s, F.lit("\n"), p)))
    return F.array_distinct(F.flatten(both))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) by their expression: rule, verdict, digest, prefix. Of rules with the same host and
    path, block wins over allow; rules with a null or empty host, or a null path, fit nothing."""
    r = rules.where("host <> '' AND path IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    return r.select(F.concat("host", "path").alias("rule"), "verdict", digest.alias("rule_digest"),
                    F.left(digest, F.lit(PREFIX_DIGITS)).alias("digest_prefix"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every row's url by the rules (host, path, verdict "allow" or "block").

    Returns page_id, host, path, rule (the deciding rule's host and path; null if none fits), verdict (the rule's, else
    ``default``).  A rule fits its host and all subdomains if the url's path starts with the rule's path; of those that
    fit, the longest (characters of host and path) decides, then block before allow.  Null urls and urls without ``://``
    have empty host and path and fit no rule.  Repeated rows stay; a null page_id stays null.  Other columns are not read.

    ``rules`` is joined as a table of any size; only its distinct numbers of host labels and path lengths reach the
    driver.  Rows of one url meet again by a row number made before the join, so that a hot host is spread.
    """
    table = rule_table(rules)
    sizes = rules.where("host <> '' AND path IS NOT NULL").agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.", -1)))), F.sort_array(F.collect_set(F.length("path")))).first()
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not sizes[0]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    each = rows.withColumn("_expr", F.explode_outer(expressions(F.col("host"), F.col("path"), *sizes)))
    each = each.withColumn("_digest", F.sha2("_expr", 256)).withColumn("digest_prefix", F.left("_digest", F.lit(PREFIX_DIGITS)))
    met = each.join(table, "digest_prefix", "left")
    fits = F.col("_digest") == F.col("rule_digest")
    order = F.struct(F.length("rule").alias("n"), F.col("verdict").alias("v"), F.col("rule").alias("r"))
    best = met.groupBy("_row", "page_id", "host", "path").agg(F.max(F.when(fits, order)).alias("_best"))
    return best.select("page_id", "host", "path", F.col("_best.r").alias("rule"), F.coalesce("_best.v", F.lit(default)).alias("verdict"))
