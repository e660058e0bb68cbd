"""Query op7_url_filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table
from larkspur.llm.url_filter import canonical, host_of, judge, lookups, path_of

#: Fixed values: (verdict, host, path) rules, and hosts that serve junk.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
LISTED = [
    f"{name}.example.{tld}/"
    for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for tld in ("com", "net", "org")
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: hosts that serve junk, and the canonical URL of every page that a crawl found there, so it grows with the pages."""
    pages, hosts = table(spark, sf_dir, "pages"), F.array(*[F.lit(x) for x in LISTED])
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    junk = seen.where(F.arrays_overlap(lookups(F.col("host"), F.col("path")), hosts)).select(canonical(F.col("host"), F.col("path")).alias("entry"))
    return judge(pages, RULES, spark.range(1).select(F.explode(hosts).alias("entry")).unionByName(junk))


SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(repr(r) for r in RULES)}),
listed(entry) AS (VALUES {", ".join(f"('{x}')" for x in LISTED)}),
u AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
best AS (
  SELECT u.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT url, host, path FROM u) u JOIN rules r
    ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.url
),
hit AS (
  SELECT DISTINCT u.url FROM u JOIN listed l ON u.host <> '' AND (
    l.entry = regexp_replace(u.host, '^www\\.', '') || '/'
      || regexp_replace(regexp_replace(u.path, '^/+', ''), '/+$', '')
    OR l.entry = u.host || '/' OR ends_with(u.host, '.' || rtrim(l.entry, '/')))
)
SELECT u.page_id, u.host, u.path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN hit.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  hit.url IS NOT NULL AS listed
FROM u LEFT JOIN best ON u.url = best.url LEFT JOIN hit ON u.url = hit.url
"""
