"""The crawl and the frontier over several batches, against plain Python."""

import json
import shutil
import time

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.functions.urls import skinny_url
from newsloom.sources.config import CONFIG_SCHEMA
from newsloom.sources.consume import consume, pending
from newsloom.sources.queues import publish_by_key, read_queue
from newsloom.streaming import crawl, known

NOW = "2026-01-01 00:00:00.123456"
REQUIRED = ["URL", "skinnyURL", "domain", "title", "body", "sentences", "contentLength"]
SITE = "http://site.example.com"


def page(title, links, body="One sentence here . And another one ."):
    return f"<html><head><title>{title}</title></head><body><p>{body}</p>" + "".join(f"<a href='{u}'>x</a>" for u in links) + "</body></html>"


def config(spark):
    return spark.createDataFrame([(SITE, "news", "URL", "body", "", r"http://site\.example\.com/.*", 0)], CONFIG_SCHEMA + ", row_no int")


# (URL, html) by micro-batch: articles, a page not fetched, one of an unknown site, repeats, a changed one
BATCHES = [
    [(f"{SITE}/alpha", page("A", ["/beta", "/gamma", "/stored/old", "/broken/mirror?x=1"])),
     (f"{SITE}/delta", page("D", ["/beta", "/alpha", "http://other.example.org/else"])),
     (f"{SITE}/broken/mirror", None)],
    [(f"{SITE}/alpha", page("A", ["/beta", "/epsilon"])), (f"{SITE}/beta", page("B", ["/gamma", "/beta", "/broken/mirror?y=2"])),
     (f"{SITE}/broken/mirror", None), ("http://nowhere.example.org/page", page("N", ["http://site.example.com/zeta"]))],
    [(f"{SITE}/alpha", page("A, changed", ["/zeta", "/eta"])), (f"{SITE}/beta", page("B", [])), (f"{SITE}/gamma", page("G", ["/epsilon", "/faulty/before?z"]))],
]


def expected(skinny):
    """Articles, errors and links of every batch."""
    urls, versions, faulty = {f"{SITE}/stored/old"}, {}, {skinny[f"{SITE}/faulty/before"]}
    out = []
    for batch in BATCHES:
        articles, errors, links = [], [], []
        for u, html in batch:
            if html is None or not u.startswith(SITE):
                if skinny[u] not in faulty:
                    errors.append(u)
            elif versions.get(u) != html.split("</p>")[0]:
                versions[u] = html.split("</p>")[0]
                articles.append(u)
        faulty |= {skinny[u] for u in errors}
        urls |= set(articles)
        for u, html in batch:
            for href in [] if html is None else [x.split("'")[0] for x in html.split("href='")[1:]]:
                link = href if href.startswith("http") else SITE + href
                if not u.startswith(SITE) and href.startswith("/"):
                    continue
                if link not in urls and skinny[link] not in faulty:
                    urls.add(link)
                    links.append((link, u))
        out.append((sorted(articles), sorted(errors), sorted(links)))
    return out


def test_three_batches_and_a_replayed_one(spark, tmp_path):
    links = {x.split("'")[0] for b in BATCHES for _, h in b if h for x in h.split("href='")[1:]}
    urls = {u for b in BATCHES for u, _ in b} | {u if u.startswith("http") else SITE + u for u in links} | {f"{SITE}/faulty/before"}
    skinny = {r.u: r.s for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", skinny_url(F.col("u")).alias("s")).collect()}
    n = 0
    for k, batch in enumerate(BATCHES):
        rows = [(u, h, n + i) for i, (u, h) in enumerate(batch)]
        n += len(batch)
        spark.createDataFrame(rows, "URL string, html string, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        time.sleep(0.05)
    stored = spark.createDataFrame([(f"{SITE}/stored/old",)], "URL string")
    errors = spark.createDataFrame([(skinny[f"{SITE}/faulty/before"],)], "skinnyURL string")
    paths = crawl.CrawlPaths(*[str(tmp_path / name) for name in ("newbies", "errors", "links")])
    log = str(tmp_path / "log")

    def run():
        pages = spark.readStream.schema("URL string, html string, seq long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
        crawl.crawl_stream(pages, paths, config(spark), "row_no", REQUIRED, F.lit(NOW).cast("timestamp"), stored, stored.limit(0), errors, log, "seq").awaitTermination()

    def found():
        news, bad = spark.read.parquet(paths.newbies).collect(), spark.read.parquet(paths.errors).collect()
        sent = read_queue(spark, paths.links, StructType.fromDDL("URL string, refURL string")).collect()
        return [(sorted(r.URL for r in news if r.batch_id == k), sorted(r.URL for r in bad if r.batch_id == k),
                 sorted((r.URL, r.refURL) for r in sent if r.batch_id == k)) for k in range(3)]

    run()
    want = expected(skinny)
    assert found() == want and sum(map(len, want[0])) > 5
    # the last batch was done but not committed: it runs again under its number
    shutil.move(str(tmp_path / "log" / "commits" / "2"), str(tmp_path / "lost"))
    for crc in (tmp_path / "log" / "commits").glob(".2.crc"):
        shutil.move(str(crc), str(tmp_path / "lost.crc"))
    run()
    assert found() == want
    run()
    assert found() == want
    last = {r.URL: r for r in crawl.current_articles(spark, paths).collect()}
    assert sorted(last) == sorted({u for a, _, _ in want for u in a}) and last[f"{SITE}/alpha"].title == "A, changed"
    assert last[f"{SITE}/alpha"].parsedTs[0].microsecond == 123456
    assert {r.routing_key for r in read_queue(spark, paths.links, StructType.fromDDL("URL string")).collect()} == {"news-links", "unrouted"}


def test_a_link_on_every_page_costs_one_row_a_task(spark):
    rows = [("s", "hot", known.LINK, f"ref{i}", i, 0, None, None) for i in range(5000, 0, -1)] + [("s", "page", known.ERROR, None, 1, 0, None, "{}")] * 3
    frame = spark.createDataFrame(rows, known.SIGHTING).coalesce(1)
    got = known._first_links(frame).collect()
    assert sum(r.kind == known.ERROR for r in got) == 3 and min(r.seq for r in got if r.kind == known.LINK) == 1
    assert len(got) < 10


def test_frontier_rounds(spark, tmp_path):
    path, message = str(tmp_path / "queue"), StructType.fromDDL("URL string, refURL string")

    def publish(urls, key, batch):
        rows = [(f"{SITE}/{u}", "ref", key) for u in urls]
        publish_by_key(spark.createDataFrame(rows, "URL string, refURL string, routing_key string").coalesce(1), path, batch, "crawl")

    table = {"main": ["a3"]}

    def stored():
        main = spark.createDataFrame([(f"{SITE}/{u}",) for u in table["main"]], "URL string")
        return main, main.limit(0), spark.createDataFrame([], "skinnyURL string")

    def state():
        return {r.routing_key: r.pending for r in pending(spark, path, "frontier").collect()}

    def turn():
        crawl.frontier_run(spark, path, "news", message, 3, {"intercept": -9.0}, stored)

    publish([f"a{i}" for i in range(1, 8)], "news-links", 0)
    publish(["q"] * 8, "news", 1)
    # eight of three wait for the crawl: the first three go to the end of the line, but for the stored one
    turn()
    assert state() == {"news-links": 6, "news": 8}
    # the crawl takes four: what is left is between one and two blocks
    consume(spark, path, "news", message, lambda b, i: b.collect(), 4)
    table["main"].append("a5")
    turn()
    assert state() == {"news-links": 3, "news": 10}
    consume(spark, path, "news", message, lambda b, i: b.collect(), 6)
    # an idle crawl gets links as they are
    turn()
    turn()
    sent = read_queue(spark, path, message).filter("publisher = 'frontier'").collect()
    assert sorted((r.batch_id, r.routing_key, r.URL.rsplit("/", 1)[1]) for r in sent) == [
        (0, "news-links", "a1"), (0, "news-links", "a2"), (1, "news", "a4"), (1, "news", "a6"),
        (2, "news", "a1"), (2, "news", "a2"), (2, "news", "a7")]
    assert state()["news-links"] == 0
    assert json.loads((tmp_path / "queue/_acks/news-links/frontier.json").read_text())["acked"]["crawl"] == {"batch": 0, "row": 7}
