"""URL filters: longest-rule verdicts, then a listed-URL check by a blocked Bloom filter and an exact hash join.

The listed entries are canonical URLs: ``host/path`` without scheme, leading ``www.``, query, fragment and
final slashes. An entry ``host/`` lists the host and its subdomains. Each URL is looked up by its own canonical
form and by its host suffixes. Look-ups first meet a blocked Bloom filter (blocks of 8 words of 64 bits, one
bit set in each word); what passes goes to a hash join with the list, which removes false positives.
DataFrame functions only. The filter is always broadcast: it has at most ``MOST_BLOCKS`` blocks, so a longer list only makes it let more
through to the join. A null URL, or one without ``://``, has an empty host and path, is looked up nowhere and is allowed; an empty
list, or one of nulls, blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import let, materialize

WORDS = 8
#: A block has 512 bits; at 32 entries a block, 16 bits an entry.
ENTRIES_PER_BLOCK = 32
#: The most blocks of a filter (16 MB): eight million entries at 16 bits each; longer lists get fewer bits an entry.
MOST_BLOCKS = 1 << 18
#: Lists, and URLs found on them, are broadcast up to this many, and joined by shuffle beyond.
BROADCAST_ENTRIES = 20_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits: struct(length, rule, verdict), or null. Rules: (verdict, host, path)."""
    best = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*best))


def canonical(host: Column, path: Column) -> Column:
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.concat(bare, F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"/+$", ""))


def lookups(host: Column, path: Column) -> Column:
    """The canonical URL and ``suffix/`` for each suffix of the host with two labels or more."""
    labels = F.split(host, r"\.")
    suffixes = let(
        labels,
        lambda a: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))),
            lambda i: F.concat(F.array_join(F.slice(a, i, F.size(a)), "."), F.lit("/")),
        ),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(F.array(canonical(host, path)), suffixes))
    )


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit in each of the 8 words, from the bytes of a second hash."""
    h = F.xxhash64(key, F.lit("bloom"))
    one = F.lit(1).cast("long")
    return [
        F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * w).bitwiseAND(F.lit(63)).cast("int"))
        for w in range(WORDS)
    ]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of listed(entry): rows (block, w0 .. w7), one for each block in use."""
    rows = listed.select(_block(F.col("entry"), blocks).alias("block"), *[m.alias(f"w{w}") for w, m in enumerate(_masks(F.col("entry")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def entries_of(listed: DataFrame) -> tuple[DataFrame, int]:
    """The distinct entries of listed(entry), written once, and their number."""
    entries = materialize(listed.select("entry").where(F.col("entry").isNotNull()).distinct(), "listed")
    return entries, entries.count()


def possible_urls(urls: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """(url, entry) of the look-ups of urls(url, host, path) that the filter of n entries lets through."""
    blocks = min(max(1, -(-n // ENTRIES_PER_BLOCK)), MOST_BLOCKS)
    keys = urls.where("host != ''").select("url", F.explode(lookups(F.col("host"), F.col("path"))).alias("entry"))
    probe = keys.withColumn("block", _block(F.col("entry"), blocks)).join(F.broadcast(bloom_filter(entries, blocks)), "block")
    passed = F.array_min(F.array(*[F.col(f"w{w}").bitwiseAND(m) == m for w, m in enumerate(_masks(F.col("entry")))]))
    return probe.where(passed).select("url", "entry")


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct url of urls(url, host, path) that the list listed(entry) holds."""
    entries, n = entries_of(listed)
    exact = F.broadcast(entries) if n <= BROADCAST_ENTRIES else entries
    return possible_urls(urls, entries, n).join(exact, "entry", "left_semi").select("url").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """pages(page_id, url, ...) to page_id, host, path, rule, verdict, listed.

    The verdict is the longest fitting rule's; without one, a listed URL is blocked and any other allowed.
    A row for every row of pages; null page_id and repeated rows are kept; other columns are ignored.
    """
    urls = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    hits = materialize(listed_urls(urls.select("url", "host", "path"), listed), "hits").withColumn("listed", F.lit(True))
    if hits.count() <= BROADCAST_ENTRIES:
        hits = F.broadcast(hits)
    fit = rule_of(F.col("host"), F.col("path"), rules)
    # what has no host is on no list; it would meet in one task
    found = urls.where("host != ''").join(hits, "url", "left").unionByName(urls.where("host = ''").withColumn("listed", F.lit(None).cast("boolean")))
    return (
        found.withColumn("fit", fit)
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
            F.coalesce(F.col("listed"), F.lit(False)).alias("listed"),
        )
    )
