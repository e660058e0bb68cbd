"""Long lists of canonical URLs against plain Python, and what the Bloom filter lets through."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.llm import url_filter

RULES = [("block", "org", "/en/"), ("allow", "ok.org", "/en/1")]


def plain(url, listed):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h + p), v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    labels = host.split(".")
    keys = {re.sub(r"^www\.", "", host) + "/" + path.strip("/")} | {".".join(labels[i:]) + "/" for i in range(max(1, len(labels) - 1))}
    hit = bool(host) and bool(keys & listed)
    return host, path, max(fits)[1] if fits else "block" if hit else "allow", hit


def urls_of(rng, n):
    hosts = [f"{rng.choice(['', 'www.', 'm.'])}site{k}.{rng.choice(['com', 'net', 'org', 'co.uk'])}" for k in range(60)]
    return [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['', '/', f'/en/{rng.randrange(900)}', f'/a/{rng.randrange(900)}/'])}{rng.choice(['', '?q=1', '#top'])}" for _ in range(n)]


@pytest.mark.parametrize(("broadcast", "most"), [(20_000, 1 << 18), (0, 1 << 18), (20_000, 2)])
def test_long_lists_equal_plain_python(spark, monkeypatch, broadcast, most):
    monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", broadcast)
    monkeypatch.setattr(url_filter, "MOST_BLOCKS", most)
    rng = random.Random(2)
    urls = urls_of(rng, 3000) + [None, "", "no scheme", "http://", "http://WWW.Site1.com/a/1/"] + ["http://hot.example.com/en/7"] * 300
    listed = {re.sub(r"^www\.", "", h) + "/" + p.strip("/") for h, p in (re.match(r"(?i)https?://([^/?#]*)([^?#]*)", u).groups() for u in rng.sample(urls[:3000], 900))} | {"site7.net/", f"x{'y' * 500}/"} | {f"never{k}.com/p/{k}" for k in range(5000)}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"entry": F.lit(1), "block": F.lit(2), "listed": F.lit("own"), "host": F.lit(0)})
    entries = spark.createDataFrame([(x,) for x in listed] + [(None,), ("site7.net/",)], "entry string")
    got = {r.page_id: (r.host, r.path, r.verdict, r.listed) for r in url_filter.judge(pages, RULES, entries).collect()}
    assert got == {k: plain(u, listed) for k, u in enumerate(urls)}


def test_filter_lets_little_through(spark):
    n = 20_000
    entries = spark.range(n).select(F.concat(F.lit("listed"), "id", F.lit(".com/p")).alias("entry"))
    urls = spark.range(n).select(F.concat(F.lit("http://other"), "id", F.lit(".com/q")).alias("url")).withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    looked_up = 2 * n  # the URL and its host
    assert url_filter.possible_urls(urls, entries, n).count() < 0.01 * looked_up
    own = entries.select(F.concat(F.lit("http://"), "entry").alias("url")).withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    assert url_filter.possible_urls(own, entries, n).select("url").distinct().count() == n  # none is lost


def test_empty_tables(spark):
    none = spark.createDataFrame([], "entry string")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES, none).collect() == []
    rows = spark.createDataFrame([(1, "http://a.com/b"), (None, None)], "page_id long, url string")
    assert {(r.page_id, r.verdict, r.listed) for r in url_filter.judge(rows, RULES, none).collect()} == {(1, "allow", False), (None, "allow", False)}
