"""URL filters by hashed host-suffix and path-prefix expressions.

A url is expanded into the expressions ``host suffix + path prefix`` that a rule could have. Only suffix label counts
and prefix lengths that occur among the rules are expanded, so the number of expressions per url does not depend on
the url's length. Expressions meet rules in an equi-join on a short prefix of their SHA-256 digest; the full digests
are then compared and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import ascii_lower, free_prefix

#: Hexadecimal digits of a digest by which expressions and rules are joined.
SHORT = 8
#: Rules are broadcast up to this count, at most some 100 bytes each; longer lists are joined by shuffle.
BROADCAST_RULES = 50_000


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path prefix) as a DataFrame."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _expression(host: Column, path: Column) -> Column:
    """A rule's identity. A path is empty or starts with a slash, which no host holds, so a newline before it keeps host and path apart."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Append ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    A rule fits its host and all subdomains of it if the url's path starts with the rule's path. Of several the longest
    wins (host and path together, then the longer host); of equal rules with different verdicts, ``block`` wins. Without
    a rule ``rule`` is null and ``verdict`` is ``default``. Null urls and urls without ``://`` have an empty host and
    path and fit no rule. All rows stay, repeated ones too; columns of ``pages`` named like the four new ones are
    replaced, others stay. An empty table gives an empty table.
    """
    rules = rules.where(F.col("host").isNotNull() & (F.col("host") != "")).select(
        F.lower("verdict").alias("r_verdict"), ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path")
    )
    rules = rules.groupBy("r_host", "r_path").agg(F.max(F.struct((F.col("r_verdict") == "block").alias("b"), "r_verdict"))["r_verdict"].alias("r_verdict"))
    shape = rules.agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.collect_set(F.length("r_path")).alias("lengths"),
    ).first()
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    w = free_prefix(pages)
    id_, key_, best_ = w + "id", w + "key", w + "best"
    out = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    if not shape["n"]:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    urls = out.where(F.col("host") != "").select("host", "path").distinct()
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in sorted(shape["labels"]))))
    prefixes = F.array_distinct(F.array(*(F.substring("path", 1, k) for k in sorted(shape["lengths"]))))
    fits = F.col("path").startswith(F.col("r_path"))
    urls = (
        urls.withColumn("x_host", F.explode(suffixes))
        .withColumn("x_path", F.explode(prefixes))
        .withColumn("x_digest", _expression(F.col("x_host"), F.col("x_path")))
        .withColumn("x_short", F.substring("x_digest", 1, SHORT))
    )
    keyed = rules.withColumn("r_digest", _expression(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, SHORT))
    if shape["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    found = urls.join(keyed, F.col("x_short") == F.col("r_short")).where((F.col("x_digest") == F.col("r_digest")) & fits)
    text = F.concat("r_host", "r_path")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), F.length("r_host").alias("h"), text.alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    # The join goes by a digest of its own, so that both sides are exchanged for it and Spark can split a hot url; that is a part of
    # adaptive execution, which must be on, as it is by default.
    best = best.select(F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias(key_), F.col("best").alias(best_))
    out = out.withColumn(id_, F.sha2(F.concat("host", F.lit("\n"), "path"), 256))
    joined = out.join(best, F.col(id_) == F.col(key_), "left")
    return joined.select(*kept, "host", "path", F.col(f"{best_}.rule").alias("rule"), F.coalesce(F.col(f"{best_}.verdict"), F.lit(default)).alias("verdict"))
