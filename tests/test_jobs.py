"""Graph, pages and streams on small fixtures."""

import pytest
from pyspark.sql import functions as F

from newsloom.operators import graph, pages
from newsloom.operators.frontier import train_screening
from newsloom.streaming.feeds import new_versions


def test_traversal(spark):
    edges = spark.createDataFrame([("e1", "from/01", "to/01"), ("e2", "from/02", "to/02"), ("e3", "from/02", "to/03")],
                                  "_key string, _from string, _to string")
    start = spark.createDataFrame([("from/01",)], "_id string")
    walked = graph.traverse(start, edges).collect()
    assert sorted((r.vertex, r.depth) for r in walked) == [("from/01", 0), ("to/01", 1)]


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "v/1", "v/2"), ("b", "v/2", "v/3"), ("c", "v/3", "v/1"), ("d", "v/1", "v/1")],
                                  "_key string, _from string, _to string")
    start = spark.createDataFrame([("v/1",)], "_id string")
    once = graph.traverse(start, edges, unique_vertices="global", unique_edges="none")
    assert sorted((r.vertex, r.depth) for r in once.collect()) == [("v/1", 0), ("v/2", 1), ("v/3", 2)]
    by_edge = graph.traverse(start, edges, unique_vertices="none", unique_edges="path")
    assert by_edge.agg(F.max("depth")).head()[0] == 4
    post = graph.in_order(graph.traverse(start, edges, max_depth=2), order="postorder").collect()
    assert [r.vertex for r in post] == ["v/3", "v/2", "v/1"]


def test_long_walks_end_by_themselves_or_raise(spark):
    edges = spark.createDataFrame([(f"e{i}", f"v/{i}", f"v/{i + 1}") for i in range(6)], "_key string, _from string, _to string")
    start = spark.createDataFrame([("v/0",)], "_id string")
    assert graph.traverse(start, edges).count() == 7
    with pytest.raises(RuntimeError):
        graph.traverse(start, edges, max_iterations=3)


def test_a_page_the_parser_gives_up_on(spark):
    sources = [("a", "<p>one 2020</p><![foo[bar]]>"), ("b", "<title>t</title><div>in 2001 <p>of 2002</p></div>"), ("c", None)]
    got = {r.k: r.page for r in pages.parse_html(spark.createDataFrame(sources, "k string, html string")).collect()}
    assert got["a"] is not None and got["a"].title is None and got["c"] is None
    # dated texts stand in the order of the document, the outer one first
    assert got["b"].title == "t" and [x.strip() for x in got["b"].dated] == ["in 2001 of 2002", "of 2002"]


def test_page(spark):
    html = ("<html><head><title>A &amp; B</title><meta name='k' content='v1'><meta content='v2' name='k'>"
            "<link rel='canonical' href='http://c/'></head><body><nav><p>skip</p></nav><div><span><p>One <b>two<br><p>three"
            "</span></div><div><p>four five six seven</p></div><a href='/r'>x</a><script>var p='</p>'</script></body></html>")
    df = pages.parse_html(spark.createDataFrame([(1, html), (2, None)], "id int, html string"))
    r = df.filter("id = 1").select("page", pages.metas(F.col("page")).alias("m"),
                                   pages.links(F.col("page"), F.lit("http://d")).alias("l"),
                                   pages.main_text_path(F.col("page.paras")).alias("path")).head()
    assert r.page.title == "A & B" and r.page.canonical == "http://c/" and r.m == {"k": ["v1", "v2"]}
    assert [(p.path, p.text) for p in r.page.paras] == [
        ("/html/body/nav", "skip"), ("/html/body/div", "One two"), ("/html/body/div", "three"), ("/html/body/div", "four five six seven")]
    assert sorted(r.l) == ["http://c/", "http://d/r"] and r.path == "/html/body/div"
    assert df.filter("id = 2 and page is null").count() == 1


def test_sampled_path(spark):
    html = "<html><body><div><p>alpha beta gamma delta epsilon zeta</p></div><main><p>the sample sits here.</p></main></body></html>"
    df = pages.parse_html(spark.createDataFrame([("sample sits", html), ("qqqqqqq", html)], "s string, html string"))
    df = pages.with_sample_match(df, F.col("page.paras"), "s", "match")
    got = {r.s: r.p for r in df.select("s", pages.sampled_text_path(F.col("page.paras"), F.col("match")).alias("p")).collect()}
    assert got == {"sample sits": "/html/body/main", "qqqqqqq": "/html/body/div"}


def test_versions_over_buckets(spark):
    rows = [(i, "hot", float((i * 37) % 101), i % 4 != 0) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, link string, ref double, good boolean")
    want, top = set(), None
    for i, _, ref, good in rows:
        if good and (top is None or ref > top):
            want.add(i)
            top = ref
    got = new_versions(df, ["link"], "seq", "ref", F.col("good"), width=16)
    assert {r.seq for r in got.collect()} == want


def test_trained_screening(spark):
    rows = [(f"http://bad.com/junk-{'x' * (i % 3)}", 1) for i in range(20)] + [(f"http://good.com/story/{'y' * (i % 4)}", 0) for i in range(20)]
    fitted = train_screening(spark.createDataFrame(rows, "URL string, label int"), "URL", "label", ["bad.com"])
    assert fitted["bad.com"] > 0


def test_a_collection_from_its_configuration(spark, tmp_path):
    from newsloom.sources.config import collection_settings, read_site_config

    (tmp_path / "sites.tsv").write_text("domain\tcollection\tfields\tuseForSentences\trssFeeds\tdomainRegex\n"
                                        "http://a.com\tnews\tURL,title,sentences\tmetas\t\t.*a\\.com/.*\n"
                                        "http://b.com\tblogs\tURL,links\tlinks\thttp://b.com/rss\t.*b\\.com/.*\n")
    sites = read_site_config(spark, str(tmp_path / "sites.tsv")).withColumn("row_no", F.lit(0))
    assert collection_settings(sites, "news") == (["URL", "sentences", "title"], "metas")
    html = "<title>T</title><meta name='k' content='One here . Two'><meta name='k' content='there . Three'><a href='/x y . z'>l</a>"
    rows = spark.createDataFrame([("http://a.com/1", html, "<b>Long title</b><p>A sentence. </p><p>More...</p>"), ("http://a.com/2", "<p>x<![foo[bar]]>", None), ("http://b.com/3", None, None)],
                                 "URL string, html string, value string").withColumn("summary_detail", F.struct("value")).drop("value")
    now = F.lit("2026-01-01").cast("timestamp")
    got = {r.URL[-1]: r for r in pages.parse_collection(rows, sites, "news", "row_no", now).collect()}
    assert len(got["1"].sentences) > 1 and got["1"].sentences[0].startswith("one here") or got["1"].sentences[0].startswith("One here")
    assert got["1"].sampleContent == "A sentence." and got["1"].errorCode == "allGood"
    assert got["2"].errorCode == "parsingError" and any(e.level == "ERROR" for e in got["2"].parserLog)
    assert got["3"].errorCode == "cannotDownload"
    links = {r.URL[-1]: r.sentences for r in pages.parse_collection(rows, sites, "blogs", "row_no", now).collect()}
    assert links["1"] and "x y" in links["1"][0]
    with pytest.raises(NotImplementedError):
        pages.sentence_text(rows.withColumn("n", F.lit(1)), "n")
