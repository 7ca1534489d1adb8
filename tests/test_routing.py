"""Routing by many sites, against the chain of conditions."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import frontier
from newsloom.operators.frontier import _site_name


@pytest.mark.parametrize("regex, name", [
    (r".*spam-farm\.example\.org/.*", "spam-farm.example.org"), (r"http://www\.site\.com/.*", "www.site.com"),
    (r"https?://a\.b\.c/", "a.b.c"), (r".*example\.com", None), (r"(x|y)\.com/", None), (r".*[ab]c\.com/", None),
    (r".*abc?/long\.name/", "long.name"), (r".*abc+/", None), (r".*ab*c\.d/", "c.d"), (r".*ab{2,3}cd/", "cd"),
    (r".*\w+abc/", "abc"), (r"x\|y\.com/", "y.com"), (None, None), (r".*\.example\.net/", ".example.net")])
def test_names_a_regex_is_sure_of(regex, name):
    assert _site_name(regex) == name


def test_joined_as_by_the_chain(spark):
    urls = [None, "", "http://www.site.com/a", "https://a.b.c/x?u=http://site7.example.com/", "http://notsite7.example.com/", "http://site7.example.com",
            "http://site7.example.com/", "site12.example.com/a.b.c/", "http://x.org/cd/abcc/", "http://x.org/abbcd/", "http://late.example.net/x"]
    sites = [(rf".*site{i}\.example\.com/.*", f"d{i}", 100 + i) for i in range(150)]
    sites += [(r"http://www\.site\.com/.*", "site", 5), (r"https?://a\.b\.c/", "abc", 500), (r".*abc+/", "plus", 3), (r".*ab{2,3}cd/", "braces", 4),
              (r".*(net|org)/x", "wild", 900), (None, "none", 0), (r".*[0-9]\.example\.com", "digit", 120)]
    df = spark.createDataFrame(list(enumerate(urls)) + [(99, urls[6])], "k int, URL string").withColumn("domain", F.lit("old"))
    config = spark.createDataFrame(sites, "domainRegex string, domain string, o int").withColumn("collection", F.upper("domain"))
    got = {r.k: (r.domain, r.collection) for r in frontier.route_by_regex(df, "URL", config, "o", chain=10).collect()}
    want = {r.k: (r.domain, r.collection) for r in frontier.route_by_regex(df, "URL", config, "o", chain=1000).collect()}
    assert got == want and len(got) == len(urls) + 1
    assert got[6] == ("d7", "D7") and got[4] == ("d7", "D7") and got[5] == ("digit", "DIGIT") and got[0] == (None, None)


def test_a_hundred_thousand_sites(spark):
    config = spark.range(100_000).select(F.concat(F.lit(r".*\.host"), "id", F.lit(r"\.example\.com/.*")).alias("domainRegex"),
                                         F.concat(F.lit("site "), "id").alias("domain"), F.col("id").alias("o"))
    urls = spark.range(2000).select(F.concat(F.lit("http://www.host"), F.col("id") * 61, F.lit(".example.com/p/"), "id").alias("URL"), (F.col("id") * 61).alias("n"))
    got = frontier.route_by_regex(urls, "URL", config, "o", ["domain"])
    hit = F.concat(F.lit("site "), "n")
    assert got.filter(F.when(F.col("n") < 100_000, F.col("domain") == hit).otherwise(F.col("domain").isNull())).count() == 2000
