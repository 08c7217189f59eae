"""URL filters by hashed host-suffix and path-prefix expressions.

Every distinct URL is expanded into the host suffixes and path prefixes a rule could name. Expressions meet the rules on
the first eight hex digits of their SHA-256; the full digest confirms a match and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case. Else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``. Else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: int) -> Column:
    """``a.b.c`` as ``[a.b.c, b.c, c]``, of those with at most ``most`` labels."""
    labels = F.slice(F.reverse(F.split(host, r"\.")), 1, most)
    return F.transform(labels, lambda _, i: F.array_join(F.reverse(F.slice(labels, 1, i + 1)), "."))


def path_prefixes(path: Column, lengths: list[int], longest: int) -> Column:
    """The prefixes of a path that end in a slash, up to ``longest`` characters, and those of the given lengths."""
    parts = F.split(F.substring(path, 1, longest), "/")
    slashed = F.transform(F.slice(parts, 1, F.size(parts) - 1),
                          lambda _, i: F.concat(F.array_join(F.slice(parts, 1, i + 1), "/"), F.lit("/")))
    cut = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_distinct(F.concat(slashed, F.array_compact(F.array(*cut)))) if cut else F.array_distinct(slashed)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules ``(host, path, verdict)`` as one row per host and path, with digest. Where both verdicts are given, block
    holds. Rules without host, or whose path neither is empty nor starts with a slash, can fit no URL and go."""
    rule = F.concat("host", "path")
    return (rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
            .filter((F.col("host") != "") & ((F.col("path") == "") | F.col("path").startswith("/")) & F.col("verdict").isNotNull())
            .groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
            .select(F.sha2(rule, 256).alias("digest"), rule.alias("rule"), F.length("host").alias("host_length"),
                    F.length("path").alias("path_length"),
                    F.size(F.split("host", r"\.")).alias("labels"), F.col("path").endswith("/").alias("slashed"), "blocks"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The columns of ``pages`` and ``host, path, rule, verdict`` (columns of those names are replaced).

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule wins (host and path
    together, then the longer host). No rule, null, empty or unreadable URLs: rule null and the default verdict. Repeated
    URLs are judged once; equal rows stay apart. A URL is expanded as far as rules have labels and characters, so time grows with its length
    only, however long it is. The lengths of rule paths that do not end in a slash go to the driver: as many numbers as the longest
    such path has characters at most."""
    ready = prepared_rules(rules)
    lengths = sorted(r[0] for r in ready.filter(~F.col("slashed")).select("path_length").distinct().collect())
    labels, longest = (x or 0 for x in ready.agg(F.max("labels"), F.max("path_length")).first())
    own = "__url"
    while own in pages.columns or own + "_best" in pages.columns:
        own += "_"
    best_name = own + "_best"
    expressions = F.flatten(F.transform(host_suffixes(F.col("_host"), max(labels, 1)), lambda h: F.transform(
        path_prefixes(F.col("_path"), lengths, longest), lambda p: F.concat(h, p))))
    expanded = (pages.select(F.col(url).alias(own)).filter(F.col(own).isNotNull()).distinct()
                .select(own, url_host(F.col(own)).alias("_host"), url_path(F.col(own)).alias("_path"))
                .filter(F.col("_host") != "")
                .select(own, F.explode_outer(expressions).alias("_expression"))
                .select(own, F.sha2("_expression", 256).alias("_digest")))
    met = expanded.withColumn("_short", F.substring("_digest", 1, PREFIX_DIGITS)).join(
        ready.withColumn("_short", F.substring("digest", 1, PREFIX_DIGITS)), "_short")
    best = (met.filter(F.col("_digest") == F.col("digest"))
            .groupBy(own).agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "blocks")).alias(best_name)))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    found = F.col(best_name)
    return (pages.withColumn(own, F.col(url)).join(best, own, "left")
            .select(*[F.col(c) for c in kept], url_host(F.col(own)).alias("host"), url_path(F.col(own)).alias("path"),
                    found["rule"].alias("rule"),
                    F.when(found.isNull(), F.lit(default)).when(found["blocks"], F.lit("block"))
                    .otherwise(F.lit("allow")).alias("verdict")))
