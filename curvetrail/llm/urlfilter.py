"""Host and path rules over URLs, by hashed expressions.

A URL expands into expressions host-suffix + path-prefix. Host suffixes start at a label; path prefixes have the
lengths that occur among the rules (a bounded list of numbers), so every fitting rule is among the expressions.
Expressions meet rules by the first 32 bits of their SHA-256, then the whole digest must agree, and of the rules that
fit the longest wins (ties: the longer host, then block). Expansion happens once per distinct URL.

Expressions of a URL are one for each pair of a host suffix and a path prefix; suffixes with more labels than any rule
are not built, so a host of thousands of labels gives as many expressions as one of a few. A URL that a third of all
rows share is judged once, and its rows are dealt over several tasks when they meet their verdict.

Null URLs and those without "://" have an empty host and path and no rule; an empty rule table leaves the default
verdict; an empty input gives an empty result. Repeated rows each get their verdict. Columns of the input called host,
path, rule or verdict are replaced; others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvetrail.llm.common import salted_join

#: Rules are broadcast up to this many; more are joined by shuffle.
BROADCAST_RULES = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first "://" up to /, ?, # or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to urls. rules: host, path, verdict."""
    rules = rules.where("host is not null and path is not null and verdict is not null")
    labels = lambda host: F.split(host, r"\.")
    shape = rules.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths"), F.max(F.size(labels(F.col("host")))).alias("labels")).first()
    lengths, most = list(shape["lengths"] or []), shape["labels"] or 0
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block over allow if both are given
    rules = rules.withColumn("digest", F.sha2(F.concat_ws("\x00", "host", "path"), 256))
    rules = rules.select(F.substring("digest", 1, 8).alias("short"), F.col("digest").alias("rule_digest"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"), F.length("host").alias("host_len"))
    if shape["n"] <= broadcast_rules:
        rules = F.broadcast(rules)
    kept = F.struct(*[F.col(c) for c in urls.columns]) if urls.columns else F.struct()
    parsed = urls.select(kept.alias("row"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    parts = parsed.where("host <> ''").select("host", "path").distinct()
    own = parts.withColumn("labels", labels(F.col("host"))).withColumn("n", F.size("labels"))
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.col("n") - most + 1), F.col("n")), lambda i: F.array_join(F.slice("labels", i, F.col("n")), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(int(n)) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    terms = own.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes)).select("host", "path", "suffix", "prefix")
    terms = terms.withColumn("digest", F.sha2(F.concat_ws("\x00", "suffix", "prefix"), 256)).withColumn("short", F.substring("digest", 1, 8))
    hits = terms.join(rules, "short").where("digest = rule_digest")
    best = F.max(F.struct(F.length("rule").alias("n"), "host_len", "rule_verdict", "rule")).alias("best")
    best = hits.groupBy("host", "path").agg(best)
    judged = salted_join(parsed, best, ["host", "path"], F.monotonically_increasing_id())
    others = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(
        *[F.col("row").getField(c).alias(c) for c in others], "host", "path",
        F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
