"""URL filters (operator 1): host-suffix and path-prefix expressions against a rule list.

Every URL is expanded into the host suffixes at label borders times the path
prefixes of the lengths that the rules have. Expressions meet rules in an equi-join
on the first four bytes of their SHA-256 digests; the full digest confirms each meeting,
and the longest rule wins.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and gets the default verdict. Rules may repeat; where two of the same length fit,
the one with the longer host wins, then ``block`` before ``allow``. Repeated rows are each
judged. An empty rule list gives every URL the default, an empty table no rows. Very long URLs are read whole;
only prefixes of the lengths that rules have are made of them. Columns of the input other than
the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than this are joined by shuffle instead of being broadcast.
MAX_BROADCAST_RULES = 200_000


def host_and_path(url):
    """Columns for a URL's host (A-Z lower-cased) and path; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    authority = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(authority) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(authority, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host):
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(text):
    return F.sha2(text, 256)


def rule_expressions(rules: DataFrame) -> DataFrame:
    """rule, host length, verdict, full digest and short prefix of each rule (host, path, verdict)."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    rule = F.concat(host, F.coalesce(F.col("path"), F.lit("")))
    return rules.where(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block")).select(
        rule.alias("rule"), F.length(host).alias("rule_host"), F.col("verdict").alias("rule_verdict"), _digest(rule).alias("rule_digest"), F.substring(_digest(rule), 1, 8).alias("short")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: its id, host, path, the winning rule (or null) and the verdict."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    # How long the rules' paths are, and of how many labels their hosts: a few small numbers. A URL gets expressions of these alone, however long it is.
    lengths = sorted(r[0] for r in rules.select(F.length(F.coalesce("path", F.lit("")))).distinct().collect())
    depths = sorted(r[0] for r in rules.where(F.col("host").isNotNull()).select(_labels(F.col("host"))).distinct().collect())
    few = rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES
    known = rule_expressions(rules)
    known = F.broadcast(known) if few else known

    suffixes = F.array_compact(F.array(*[F.when(_labels(F.col("host")) >= k, F.substring_index("host", ".", -k)) for k in depths])) if depths else F.array().cast("array<string>")
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    best = (
        urls.where(F.col("host") != "").select("host", "path").distinct()
        .withColumn("expression", F.explode(expressions))
        .withColumn("digest", _digest(F.col("expression")))
        .withColumn("short", F.substring("digest", 1, 8))
        .join(known, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy(F.col("host").alias("h"), F.col("path").alias("p"))
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule_host", (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict")).alias("best"))
    )
    # Read back from storage, it has no aggregate in front of the join, so that a frequent URL can be split; URLs without a host, which are all alike, aren't joined.
    best = checkpoint(best)
    met = urls.where(F.col("host") != "").join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    bare = urls.where(F.col("host") == "").select("*", *[F.lit(None).cast(best.schema[c].dataType).alias(c) for c in ("h", "p", "best")])
    return met.unionByName(bare).select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )
