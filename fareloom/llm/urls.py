"""URL filter: rules of hosts and paths, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 512-bit blocks (eight words of 64 bits). A key sets one bit in each word of one block. A
URL whose bits are all set is a possible hit and goes to an exact join with the list, which removes false positives;
other URLs never reach that join. Nothing is broadcast by hint: the planner and AQE know the measured sizes.

Host and path are literal: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#`
or the end. A null URL or one without `://` has both empty, fits no rule and is on no list. Repeated rows are judged
row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdict, host, path. A rule holds for its host and all subdomains if the path starts with the rule's path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
BITS_A_KEY = 16
WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without slashes at its end, query without tracking; null where there is no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[^=&]*|ref)=[^&]*", ""), "^&", "")
    name = F.regexp_replace(host(url), r"^www\.", "")
    text = F.concat(name, F.regexp_replace(path(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(F.coalesce(host(url), F.lit("")) != "", text)


def rule_of(hosts: Column, paths: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((hosts == rule_host) | hosts.endswith("." + rule_host)) & paths.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bit_of(key: Column, word: int) -> Column:
    """The bit that a key sets in a word of its block."""
    place = F.pmod(F.xxhash64(key, F.lit(word)), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(listed: DataFrame, keys: int) -> tuple[DataFrame, int]:
    """The filter over `listed` (listed_url), one row per block that holds a key, and its number of blocks."""
    blocks = max(1, -(-keys * BITS_A_KEY // (64 * WORDS)))
    key = F.col("listed_url")
    words = [F.bit_or(bit_of(key, w)).alias(f"word{w}") for w in range(WORDS)]
    return listed.groupBy(block_of(key, blocks).alias("block")).agg(*words), blocks


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of `pages` (page_id, url); `listed` has one column of canonical URLs."""
    listed = listed.toDF("listed_url").where("listed_url is not null").distinct()
    filled, blocks = bloom_blocks(listed, listed.count())
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    open_rows, ruled = rows.where("by_rule is null and canonical is not null"), rows.where("by_rule is not null or canonical is null")
    key = F.col("canonical")
    probed = open_rows.withColumn("block", block_of(key, blocks)).join(filled, "block", "left")
    hit = F.coalesce(reduce(Column.__and__, [F.col(f"word{w}").bitwiseAND(bit_of(key, w)) != 0 for w in range(WORDS)]), F.lit(False))
    columns = ["page_id", "host", "path", "rule"]
    exact = probed.where(hit).join(listed, key == F.col("listed_url"), "left")
    on_list = F.when(F.col("listed_url").isNotNull(), "block").otherwise("allow")
    return (
        ruled.select(*columns, F.coalesce("by_rule", F.lit("allow")).alias("verdict"))
        .unionByName(probed.where(~hit).select(*columns, F.lit("allow").alias("verdict")))
        .unionByName(exact.select(*columns, on_list.alias("verdict")))
    )


def repeated(pages: DataFrame) -> DataFrame:
    """Canonical URLs that two or more pages have: the list of the registered query."""
    urls = pages.select(canonical(F.col("url").cast("string")).alias("listed_url")).where("listed_url is not null")
    return urls.groupBy("listed_url").count().where("count > 1").select("listed_url")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; listed are the canonical URLs that several pages share."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, repeated(pages))


OP7_SQL = r"""
WITH cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), ''),
      '(^|&)(utm_[^=&]*|ref)=[^&]*', '', 'g'), '^&', '') AS query
  FROM pages),
named AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN
    regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical
  FROM cut),
listed AS (SELECT canonical AS url FROM named WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
judged AS (
  SELECT n.*, (SELECT arg_max({'rule': h || p, 'verdict': r.verdict}, length(h || p)) FROM rules r
    WHERE (n.host = h OR ends_with(n.host, '.' || h)) AND starts_with(n.path, p)) AS best
  FROM named n)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN listed l ON canonical = l.url
"""
