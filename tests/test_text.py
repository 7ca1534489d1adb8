"""Text, URL and date expressions against hand-worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).head()[0]


@pytest.mark.parametrize("url, skinny", [
    ("https://www.example.com/2017/jan/05/some-story-12", "www.example.com/some-story"),
    ("http://m.site.com/en/25#top", "site.com/en/top"),
    ("http://a.com/x?y=1/next", "com/next"),
    ("https://news.com/a-big-b.html", "news.com/big"),
])
def test_skinny_url(spark, url, skinny):
    assert one(spark, url, urls.skinny_url) == skinny


@pytest.mark.parametrize("stated, date", [
    ("Sat, 3 Feb 2001", dt.date(2001, 2, 3)), ("05/04/2017 10:00", dt.date(2017, 4, 5)), ("20170405", dt.date(2017, 4, 5)),
    ("2017-02-31 then 2017-02-01", None), ("1 May 1969", None), ("31-12-1960 2 May 2001", dt.date(2001, 5, 2)), ("May 2001", None),
])
def test_recognise_date(spark, stated, date):
    assert one(spark, stated, dates.recognise_date) == date


def test_sentences(spark):
    cleaned = one(spark, "  Ünïcode, é & “quotes”.  The End. A BBC man", text.clean_text)
    assert cleaned == "Unicode, e quotes . The End. A BBC man"
    assert one(spark, "Hello there. The end is. BBC news (a).", text.split_sentences) == [
        "hello there .", "he end is ."[1:] and "the end is .", "BBC news ( a ) ."]


def brute(a, b):
    """Levenshtein windows by the definition."""
    def lev(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            row, prev = [i], row
            for j, y in enumerate(t, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    short, long = (a, b) if len(a) < len(b) else (b, a)
    best, at = 1.0, None
    for k in range(len(long) - len(short) + 1):
        d = lev(short, long[k:k + len(short)]) / len(short)
        if d <= best:
            best, at = d, k
        elif best < 0.5 and d - best > 0.1:
            break
    return best, at


def test_min_window_distance(spark):
    cases = [("needle", "hay hay nedle hay needle"), ("abcdef", "zabcdefz"), ("xyz", "aaaaaa"), ("same", "same")]
    got = spark.createDataFrame(cases, "a string, b string").select(
        "a", "b", text.min_window_distance(F.col("a"), F.col("b")).alias("m")).collect()
    for r in got:
        want = brute(r.a, r.b)
        assert (round(r.m.distance, 9), r.m.offset) == (round(want[0], 9), want[1])


def test_time_and_links(spark):
    assert one(spark, "at 10:01:02 or 11:00:00", dates.time_to_sec) == 36062
    assert one(spark, "http://a/'x'\\\\", urls.escape_value) == "http://a/%27x%27"
    assert one(spark, "http://a/?ncid=rss", lambda c: urls.entry_url(c, c)) == "http://a/"
