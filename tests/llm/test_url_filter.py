from pyspark.sql import functions as F

from trawlix.llm import url_filter

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("b.net", "", "block"), ("org", "/es/", "allow"), ("tie.org", "/a", "allow"), ("tie.org", "/a", "block"), (None, "/x", "block"), ("", "/", "block")]
URLS = [
    "http://a.example.com/en/71", "http://example.com/en/8", "https://EXAMPLE.com/en/7?q#f", "http://com/en/", "ftp://x.b.net#top", "http://b.net", "http://xb.net/de/1", "http://tie.org/ab", "http://u.org/es/?x=http://b.net/",
    None, "", "no scheme", "http://", "http:///en/", "x://y.com/EN/", "http://com./en/", "http://a.b.c.d.e.f.com/en/" + "z" * 5000,
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = path = ""
    for i, c in enumerate(rest + "/"):
        if c in "/?#":
            host, rest = rest[:i], rest[i:]
            break
    for c in "?#":
        rest = rest.split(c, 1)[0]
    path = rest
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a == "block", a) for h, p, a in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[1] if best else None, best[3] if best else "allow"


def test_against_plain_rules(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)] + [(0, URLS[0], "old")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    want = sorted((i, *plain(u)) for i, u in [*enumerate(URLS), (0, URLS[0])])
    key = lambda r: (r[0], r[1:4:2] and str(r))
    for shard in (url_filter.SHARD, 2):
        got = sorted(tuple(r) for r in url_filter.filter_urls(pages, rules, shard).select("page_id", "host", "path", "rule", "verdict").collect())
        assert sorted(got, key=key) == sorted(want, key=key)


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("cast(key as int) % 37 = 0")
    cascade = url_filter.Cascade(listed, universe, 20_000)
    assert len(cascade.levels) >= 2
    wrong = universe.where(cascade.has(F.col("key")) != (F.col("key").cast("int") % 37 == 0))
    assert wrong.count() == 0
    assert sum(b.bits for b in cascade.levels) < 20_000


def test_cascade_over_a_large_list_in_shards(spark):
    pages = spark.range(3000).select("id", F.concat(F.lit("http://h"), F.col("id") % 2000, F.lit(".com/p")).alias("url"), F.lit(1).alias("_block"))
    rules = spark.range(1500).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("host"), F.lit("/").alias("path"), F.when(F.col("id") % 3 == 0, F.lit("allow")).otherwise(F.lit("block")).alias("action"))
    for shard in (url_filter.SHARD, 400):
        got = url_filter.filter_urls(pages, rules, shard)
        host = F.col("id") % 2000
        wrong = got.where((F.col("verdict") != F.when((host < 1500) & (host % 3 != 0), F.lit("block")).otherwise(F.lit("allow"))) | (F.col("rule").isNotNull() != (host < 1500)) | (F.col("_block") != 1))
        assert got.count() == 3000 and wrong.count() == 0


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, action string")
    assert [tuple(r)[2:] for r in url_filter.filter_urls(pages, none).collect()] == [("a.com", "/en/", None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame(RULES[:2], "host string, path string, action string")).count() == 0
