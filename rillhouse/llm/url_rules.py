"""URL filtering by host-suffix and path-prefix rules, matched on short hash prefixes.

A rule is a host and the start of a path (``example.com/en/``); it fits a URL whose host is the
rule's or a subdomain of it and whose path starts with the rule's. Each distinct URL is expanded into
the host suffixes and path starts that any rule could name, each expression is hashed, an equi-join
on a short prefix of the digest finds candidate rules, and the full digest confirms them. The longest
expression wins; if it is listed for both, allow wins. A URL that no rule fits gets the default.

Null URLs and URLs without ``://`` have an empty host and path, which no rule fits. Repeated rows and
null or equal ids keep their rows; the input may have further columns of any name, as only the two
named ones are read. An empty rule table leaves every URL to the default.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of the joined digest prefix (32 bits).
PREFIX = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) rows of a literal list."""
    kind = "array<struct<verdict string, rule string>>"
    values = F.array(*(F.struct(F.lit(v), F.lit(r)) for v, r in rules)).cast(kind)
    return spark.range(1).select(F.inline(values))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands behind the first ``://``: the host, A-Z in lower case, and the path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _digest(rule: Column) -> Column:
    return F.sha2(rule, 256)


def judge(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    prefix: int = PREFIX,
) -> DataFrame:
    """(key, host, path, rule, verdict) of each row; ``rules`` has columns verdict and rule."""
    cut = F.instr("rule", "/")
    rules = (
        rules.select("verdict", "rule")
        .where(cut > 1)
        .select(
            "rule",
            F.col("verdict").alias("rule_verdict"),
            F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("labels"),
            (F.char_length("rule") - cut + 1).alias("length"),
            _digest(F.col("rule")).alias("rule_digest"),
        )
        .withColumn("prefix", F.substring("rule_digest", 1, prefix))
    )
    # Label counts and path lengths that occur in rules: no more than a host has labels times a path characters.
    shapes = rules.select("labels", "length").distinct().collect()
    pages = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    pairs = F.array(*(F.struct(F.lit(s.labels), F.lit(s.length)) for s in shapes)).cast(
        "array<struct<labels int, length int>>"
    )
    n_labels = F.size(F.split("host", r"\."))
    expanded = (
        urls.select("url", "host", "path", F.explode(pairs).alias("shape"))
        .where((n_labels >= F.col("shape.labels")) & (F.char_length("path") >= F.col("shape.length")))
        .select(
            "url",
            _digest(
                F.concat(
                    F.expr("substring_index(host, '.', -shape.labels)"),
                    F.expr("substring(path, 1, shape.length)"),
                )
            ).alias("digest"),
        )
        .withColumn("prefix", F.substring("digest", 1, prefix))
    )
    best = F.max(
        F.struct(F.char_length("rule").alias("size"), F.col("rule_verdict") == "allow", "rule", "rule_verdict")
    )
    found = (
        expanded.join(rules, "prefix")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("url")
        .agg(best.alias("best"))
    )
    return pages.join(found, "url", "left").select(
        F.col("key").alias(key),
        host.alias("host"),
        path.alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
