"""URL filters: a URL's host suffixes and path prefixes are looked up among rules by short hash prefixes.

Each URL is expanded into expressions host suffix + path prefix, which covers every rule that can fit: the suffixes have as
many labels as some rule's host, and path prefixes are cut as long as the rules of that very host suffix are, looked up first
by the suffix's own hash, so that a URL has no more expressions than rules of its host have lengths. The first 32 bits of an
expression's SHA-256 are equi-joined with those of the rules; a hit counts only if the full digests agree. Of the rules that fit, the longest wins; of equally long ones the one
with the longer host, then block before allow. URLs that no rule fits get the default verdict.

A null URL or one without "://" has an empty host and path and gets the default. Very long URLs are judged whole. Null or repeated page_ids stay rows of
their own; an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: verdict, host, path prefix; fixed values
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between the first :// and the next /, ? or #, in lower case; path from there up to ? or #."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, *LOWER), path


def rule_table(spark_df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    spark = spark_df.sparkSession
    made = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")
    digest = F.sha2(F.concat_ws("", "rule_host", "rule_path"), 256)
    return made.select("verdict", "rule_host", F.concat("rule_host", "rule_path").alias("rule"), digest.alias("digest"), F.substring(digest, 1, 8).alias("short"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null: none fits), verdict."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    n = F.size(labels)
    depths = sorted({h.count(".") + 1 for _, h, _ in rules})
    suffixes = F.array(*(F.when(n >= k, F.array_join(F.slice(labels, n - k + 1, F.lit(k)), ".")) for k in depths))
    # the first expression is none: it keeps a row of every page and counts it
    each = rows.select("page_id", "host", "path", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.filter(suffixes, lambda s: s.isNotNull()))).alias("nth", "suffix"))
    each = each.withColumn("host_short", F.substring(F.sha2("suffix", 256), 1, 8))
    known = rule_table(pages, rules)
    lengths = known.groupBy("rule_host").agg(F.collect_set(F.length("rule") - F.length("rule_host")).alias("lengths"))
    lengths = lengths.select(F.substring(F.sha2("rule_host", 256), 1, 8).alias("host_short"), "rule_host", "lengths")
    # by the short hash, then by the host itself
    each = each.join(lengths, "host_short", "left").withColumn("fits", F.coalesce(F.col("suffix") == F.col("rule_host"), F.lit(False)))
    prefixes = F.transform(F.filter("lengths", lambda k: k <= F.length("path")), lambda k: F.concat("suffix", F.substring(F.col("path"), F.lit(1), k)))
    each = each.where((F.col("nth") == 0) | F.col("fits")).select("page_id", "host", "path", "nth", F.explode_outer(F.when(F.col("fits"), prefixes)).alias("expression"))
    digest = F.sha2("expression", 256)
    each = each.select("page_id", "host", "path", "nth", digest.alias("own"), F.substring(digest, 1, 8).alias("short"))
    hits = each.join(known, "short", "left")
    same = F.coalesce(F.col("own") == F.col("digest"), F.lit(False))
    hits = hits.withColumns({c: F.when(same, F.col(c)) for c in ("rule", "rule_host", "verdict")})
    rank = F.struct(F.length("rule").alias("length"), F.length("rule_host").alias("host_length"), (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    best = hits.groupBy("page_id", "host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), rank)).alias("best"), F.sum(F.when(F.col("nth") == 0, 1)).alias("rows")
    )
    out = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    return out.drop("copy")
