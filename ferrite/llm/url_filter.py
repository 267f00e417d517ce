"""URL rules by host suffix and path prefix, matched through short hash prefixes. DataFrame functions only.

A URL's host and path are expanded into every (host suffix, path prefix) pair that a rule could have: suffixes by the
numbers of labels and prefixes by the lengths that occur among the rules. Expressions and rules meet in an equi-join on
the first 32 bits of a SHA-256; the full digest then confirms the match and the longest rule wins.

Defined results: a null URL or one without ``://`` has an empty host and path and can only meet a rule with both empty.
Rules with a null or invalid verdict, host or path are ignored. Of two rules with equal text, block wins; of two fitting
rules of equal total length, the one with the longer host. Repeated rows each get a row. Without rules every URL gets
the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Up to this many rules are broadcast (a digest and four numbers each); more are joined by shuffle.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL, both empty for null or where there is no ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.when(has, F.translate(raw, UPPER, LOWER)).otherwise(""), F.when(has, path).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\t", host, path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(short, digest, weight, labels, cut) of rules (host, path, verdict); weight orders rules that fit one URL."""
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.col("path")
    weight = F.struct((F.length(host) + F.length(path)).alias("total"), F.length(host).alias("host"), (F.col("verdict") == "block").alias("block"))
    return (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
        .select(_digest(host, path).alias("digest"), weight.alias("weight"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("cut"))
        .groupBy("digest")
        .agg(F.max("weight").alias("weight"), F.max("labels").alias("labels"), F.max("cut").alias("cut"))
        .withColumn("short", _short(F.col("digest")))
    )


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of ``pages``."""
    ruled = prepare_rules(rules)
    # As many label counts and prefix lengths as occur: a few hundred, however many rules there are.
    shape = ruled.agg(F.collect_set("labels").alias("labels"), F.collect_set("cut").alias("cuts"), F.count("*").alias("n")).first()
    labels, cuts = sorted(shape["labels"]), sorted(shape["cuts"])
    host, path = split_url(F.col("_url"))
    urls = pages.select(F.col(key), F.col(url).alias("_url")).select(F.monotonically_increasing_id().alias("_row"), key, host.alias("host"), path.alias("path"))
    if not labels:
        return urls.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.array(*[F.lit(k) for k in labels]), lambda k: k <= F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(k) for k in cuts]), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p))))
    expressions = urls.select("_row", key, "host", "path", F.explode_outer(digests).alias("_digest")).withColumn("_short", _short(F.col("_digest")))
    side = ruled.select("short", "digest", "weight")
    if shape["n"] <= BROADCAST_RULES:
        side = F.broadcast(side)
    met = expressions.join(side, (F.col("_short") == F.col("short")) & (F.col("_digest") == F.col("digest")), "left")
    best = met.groupBy("_row", key, "host", "path").agg(F.max("weight").alias("_w"))
    host_len = F.col("_w.host")
    # The fitting rule is the URL's own suffix and prefix of these lengths.
    rule = F.concat(F.substring(F.col("host"), F.length("host") - host_len + 1, host_len), F.substring(F.col("path"), F.lit(1), F.col("_w.total") - host_len))
    return best.select(key, "host", "path", F.when(F.col("_w").isNotNull(), rule).alias("rule"), F.when(F.col("_w").isNull(), default).when(F.col("_w.block"), "block").otherwise("allow").alias("verdict"))


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every page's URL judged by five rules."""
    return judge(common.table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path, row_number() OVER () AS rid FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT hp.rid, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY hp.rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM hp JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM hp LEFT JOIN m ON m.rid = hp.rid AND m.k = 1
"""
