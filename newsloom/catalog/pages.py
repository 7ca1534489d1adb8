"""Extraction and validation of web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..functions.fields import error_code, valid_doc
from ..operators import aggregate as agg, frontier, pages as ops, scan
from ..plans import upkeep
from ..session import stored
from . import sql
from .base import Tables, query
from .fixtures import known_pages, site_config
from .text import PATHS_SQL, dated_urls

NOW = "2026-01-01 00:00:00"
REQUIRED = ["URL", "skinnyURL", "domain", "title", "body", "sentences", "contentLength"]


def now():
    return F.lit(NOW).cast("timestamp")


def unescaped(x: str) -> str:
    for name, ch in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{ch}')"
    return x


def parsed(t: Tables):
    return ops.parse_html(t.pages)


# the same pages with metadata in the head
HEAD_SQL = """h AS (SELECT page_id, url, CASE WHEN contains(url, '#') THEN 2 ELSE 1 END AS n FROM pages)"""


def with_head(t: Tables):
    url = F.col("url")
    head = F.concat(
        F.lit('<meta name="lang" content="'), F.split_part(url, F.lit("/"), F.lit(4)), F.lit('">'),
        F.when(F.contains("url", F.lit("#")), '<meta content="a &amp; b" property="lang"/>').otherwise(""),
        F.lit('<meta name="x" id="y" content="late"><link rel="canonical" href="'), F.split_part(url, F.lit("?"), F.lit(1)),
        F.lit('"><link rel="canonical" href="second"><link href="http://amp.example.com/" rel="amphtml"></head>'))
    return t.pages.withColumn("html", F.replace(F.col("html"), F.lit("</head>"), head))


@query("page_title", f"""SELECT page_id, {unescaped("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title FROM pages""")
def page_title(t: Tables):
    return parsed(t).select("page_id", F.col("page.title").alias("title"))


@query("page_metas", f"""WITH {HEAD_SQL}
SELECT page_id, 'lang' AS name, split_part(url, '/', 4) || CASE WHEN n = 2 THEN '|a & b' ELSE '' END AS value FROM h""")
def page_metas(t: Tables):
    m = ops.parse_html(with_head(t)).select("page_id", F.explode(ops.metas(F.col("page"))).alias("name", "v"))
    return m.select("page_id", "name", F.array_join("v", "|").alias("value"))


@query("page_canonical", f"""SELECT page_id, split_part(url, '?', 1) AS canonical, 'http://amp.example.com/' AS amp FROM pages""")
def page_canonical(t: Tables):
    return ops.parse_html(with_head(t)).select("page_id", "page.canonical", "page.amp")


LINKS_SQL = f"""lk AS MATERIALIZED (SELECT DISTINCT page_id, url, {sql.domain('url')} || href AS link FROM
  (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages))"""


def page_links_table(t: Tables):
    routed = frontier.route_by_regex(parsed(t), "url", site_config(t), "row_no")
    return routed.select("page_id", F.col("url").alias("URL"), ops.links(F.col("page"), F.col("domain")).alias("links"))


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, {unescaped('link')} AS link FROM lk WHERE link IS NOT NULL")
def page_links(t: Tables):
    return page_links_table(t).select("page_id", F.explode("links").alias("link"))


PARAS_SQL = f"""cut AS (SELECT page_id, url, regexp_replace(html, '(?s)<script>.*?</script>', '', 'g') AS h FROM pages),
sp AS (SELECT page_id, string_split(h, '<p>')[2:] AS parts FROM cut),
pr AS MATERIALIZED (SELECT page_id, i::INT AS pos, {unescaped("regexp_replace(regexp_extract(parts[i + 1], '(?s)^(.*?)(?:</p>|</article>|<footer>|$)', 1), '<[^>]*>', '', 'g')")} AS txt
  FROM sp, unnest(generate_series(0, len(parts) - 1)) AS u(i)),
bd AS MATERIALIZED (SELECT page_id, {sql.clean("string_agg(txt, ' ' ORDER BY pos)")} AS body FROM pr GROUP BY page_id)"""


@query("page_paragraphs", f"""WITH {PARAS_SQL} SELECT page_id, pos, '/html/body/article' AS path, txt FROM pr""")
def page_paragraphs(t: Tables):
    p = parsed(t).select("page_id", F.posexplode("page.paras").alias("pos", "p"))
    return p.select("page_id", "pos", "p.path", F.col("p.text").alias("txt"))


@query("main_text_path", f"""WITH {PARAS_SQL}, w AS (SELECT page_id, CASE WHEN pos = 0 THEN '/a' WHEN contains(txt, ',') THEN '/b' ELSE '/c' END AS path,
  pos, len({sql.words('txt')}) AS n FROM pr),
g AS (SELECT page_id, path, sum(n) AS n, min(pos) AS first FROM w GROUP BY ALL)
SELECT page_id, arg_max(path, (n, -first)) AS path FROM g GROUP BY page_id""")
def main_text_path(t: Tables):
    """Over paragraphs told apart by a comma, as all of a page share one container."""
    def place(p, i):
        path = F.when(i == 0, "/a").when(F.contains(p["text"], F.lit(",")), "/b").otherwise("/c")
        return F.struct(path.alias("path"), p["text"].alias("text"))

    paras = parsed(t).select("page_id", F.transform("page.paras", place).alias("paras")).filter(F.size("paras") > 0)
    return paras.select("page_id", ops.main_text_path(F.col("paras")).alias("path"))


@query("main_text_sampled")
def main_text_sampled(t: Tables):
    """The advertisement text stands for the feed's sample of the article."""
    ad = t.pages.withColumn("sample", F.regexp_extract("html", '<div class="ad">([^<]*)</div>', 1))
    paras = F.col("page.paras")
    found = ops.with_sample_match(ops.parse_html(ad), paras, "sample", "match")
    return found.select("page_id", F.when(F.length("sample") > 0, ops.sampled_text_path(paras, F.col("match"))).alias("path"))


@query("page_body", f"WITH {PARAS_SQL} SELECT page_id, body FROM bd")
def page_body(t: Tables):
    paras = F.col("page.paras")
    return parsed(t).filter(F.size(paras) > 0).select("page_id", ops.body(paras, ops.main_text_path(paras)).alias("body"))


@query("page_sentences", f"""WITH {PARAS_SQL}, ps AS (SELECT page_id, {sql.sentences(sql.tokenise('body'))} AS s FROM bd)
SELECT page_id, len(s) AS n_sentences, s[-1] AS last FROM ps""")
def page_sentences(t: Tables):
    paras = F.col("page.paras")
    s = parsed(t).filter(F.size(paras) > 0).select(
        "page_id", text.split_sentences(ops.body(paras, ops.main_text_path(paras))).alias("s"))
    return s.select("page_id", F.size("s").cast("long").alias("n_sentences"), F.element_at("s", -1).alias("last"))


def judged(t: Tables):
    pages = t.pages.withColumn("html", F.when(~F.contains("url", F.lit("/es/")), F.col("html")))
    return ops.parse_pages(pages.withColumnRenamed("url", "URL"), site_config(t), "row_no", REQUIRED, now())


JUDGED_SQL = f"""{PARAS_SQL}, dm AS MATERIALIZED (SELECT page_id, url, {sql.domain('url')} AS domain, contains(url, '/es/') AS gone FROM pages),
jd AS MATERIALIZED (SELECT page_id, url, domain, CASE WHEN gone THEN 'cannotDownload' WHEN domain IS NULL THEN 'unknownDomain'
  WHEN coalesce(body, '') = '' THEN 'empty' ELSE 'allGood' END AS code,
  CASE WHEN gone OR coalesce(body, '') = '' THEN 0 ELSE
    CAST(list_sum(list_transform({sql.sentences(sql.tokenise('body'))}, lambda x: length(x))) AS BIGINT) END AS content_length
  FROM dm LEFT JOIN bd USING (page_id))"""


@query("parse_pages", f"""WITH {JUDGED_SQL} SELECT page_id, domain, code AS "errorCode", content_length FROM jd""")
def parse_pages(t: Tables):
    return judged(t).select("page_id", "domain", "errorCode", F.col("contentLength").alias("content_length"))


# pages as they come from a feed: its time and headers, tags, where it links from; a seventh breaks off in the middle of a declaration
FED_SQL = f"""{JUDGED_SQL}, fd AS (SELECT page_id, url, code, page_id % 7 = 3 AND NOT contains(url, '/es/') AS broken, contains(url, '/es/') AS gone FROM jd)"""


@query("parse_feed_pages", f"""WITH {FED_SQL}
SELECT page_id, CASE WHEN gone THEN 'cannotDownload' WHEN broken THEN 'parsingError' ELSE code END AS "errorCode",
  CASE page_id % 5 WHEN 0 THEN '2011-05-06' WHEN 1 THEN '2001-02-03' WHEN 2 THEN '1999-12-31' END AS created,
  CASE WHEN page_id % 3 > 0 THEN 'http://feed.example.com/' || page_id % 3 END AS "refURL", 'a' || CASE WHEN page_id % 2 = 0 THEN ',b' ELSE '' END AS tags,
  CAST(broken AS INT) AS errors_logged FROM fd""")
def parse_feed_pages(t: Tables):
    k, none = F.col("page_id"), F.lit(None)
    html = F.when(k % 7 == 3, F.concat("html", F.lit("<![foo[bar]]>"))).otherwise(F.col("html"))
    fed = t.pages.select(
        "page_id", F.when(k % 4 > 0, F.col("url")).alias("URL"), F.when(k % 4 == 0, F.concat("url", F.lit("?ncid=rss"))).alias("feedburner_origlink"),
        F.when(~F.contains("url", F.lit("/es/")), html).alias("html"),
        F.when(k % 5 == 0, F.lit("2011-05-06 07:08:09")).cast("timestamp").alias("published_parsed"),
        F.when(k % 5 == 1, "Sat, 3 Feb 2001 10:00:00 GMT").alias("published"),
        F.when(k % 5 == 2, F.array(F.lit("text/html"), F.lit("1 Jan 2000"), F.lit("31 Dec 1999"), F.lit("1 Mar 1985"))).alias("headers"),
        F.struct(F.when(k % 3 > 0, F.concat(F.lit("http://feed.example.com/"), (k % 3).cast("string"))).alias("base")).alias("title_detail"),
        F.array(F.struct(F.lit("a").alias("term")), F.struct(F.when(k % 2 == 0, "b").alias("term"))).alias("tags"))
    parsed = ops.parse_pages(fed, site_config(t), "row_no", REQUIRED, now())
    return parsed.select(
        "page_id", "errorCode", F.when(k % 5 < 3, F.date_format("createdTs", "yyyy-MM-dd")).alias("created"), "refURL",
        F.array_join("rssTags", ",").alias("tags"), F.size(F.filter("parserLog", lambda e: e["level"] == "ERROR")).alias("errors_logged"))


@query("title_sentences", f"""WITH tt AS (SELECT page_id, {unescaped("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title FROM pages),
ts AS (SELECT page_id, {sql.sentences(sql.tokenise('title'))} AS s FROM tt WHERE title <> '')
SELECT page_id, len(s) AS n_sentences, s[-1] AS last FROM ts""")
def title_sentences(t: Tables):
    """Sentences of a collection whose sites name the title as their source."""
    config = site_config(t).withColumn("useForSentences", F.lit("title"))
    parsed = ops.parse_collection(t.pages.withColumnRenamed("url", "URL"), config, "com", "row_no", now())
    found = parsed.filter(F.col("sentences").isNotNull())
    return found.select("page_id", F.size("sentences").cast("long").alias("n_sentences"), F.element_at("sentences", -1).alias("last"))


@query("error_code", f"""WITH {JUDGED_SQL} SELECT page_id, CASE WHEN domain IS NULL THEN 'unknownDomain' WHEN code = 'cannotDownload' THEN 'dodgy'
  WHEN contains(url, 'www.') THEN 'parsingError' WHEN content_length = 0 THEN 'empty' ELSE 'allGood' END AS "errorCode" FROM jd""")
def error_code_query(t: Tables):
    """Codes with a log, and an earlier code on the pages that were not fetched."""
    docs = judged(t)
    gone = F.col("errorCode") == "cannotDownload"
    level = F.when(~gone & F.contains("URL", F.lit("www.")), "ERROR").otherwise("OK")
    length = F.when(gone, F.lit(1)).otherwise(F.col("contentLength"))
    return docs.select("page_id", error_code(
        ["domain", "parserLog", "contentLength"], domain=F.col("domain"), sentences=F.col("sentences"),
        content_length=length, existing=F.when(gone, "dodgy"), log_levels=F.array(level)).alias("errorCode"))


@query("field_validity", f"""WITH {JUDGED_SQL} SELECT count(*) AS "valid_URL", count(domain) AS valid_domain,
  count(*) FILTER (code <> 'cannotDownload' AND content_length > 0) AS valid_sentences, count(*) AS "valid_contentLength",
  count(*) AS "valid_parsedTs", 0::BIGINT AS valid_metas, count(*) AS "valid_errorCode" FROM jd""")
def field_validity(t: Tables):
    return frontier.field_validity(judged(t), ["URL", "domain", "sentences", "contentLength", "parsedTs", "metas", "errorCode"], now())


@query("validate_split", f"""WITH {JUDGED_SQL} SELECT page_id, domain IS NOT NULL AND content_length > 0 AS valid FROM
  (SELECT jd.page_id, jd.domain, CASE WHEN bd.body IS NULL THEN 0 ELSE length(bd.body) END AS content_length FROM jd LEFT JOIN bd USING (page_id))""")
def validate_split(t: Tables):
    """Pages that were not fetched the first time are extracted from the full table."""
    pages = t.pages.select(F.col("url").alias("URL"), "html")
    good, bad = ops.validate(judged(t), pages, site_config(t), "row_no", REQUIRED, now())
    return good.select("page_id", F.lit(True).alias("valid")).unionByName(bad.select("page_id", F.lit(False).alias("valid")))


@query("requeue_rows", f"""WITH {JUDGED_SQL} SELECT url AS "URL", {sql.skinny('url')} AS "skinnyURL", domain, 'news' AS routing_key FROM jd
WHERE code NOT IN ('allGood') OR domain IS NULL OR content_length = 0""")
def requeue_rows(t: Tables):
    docs = judged(t)
    return frontier.requeue_invalid(docs, valid_doc(REQUIRED, docs.columns, now()) & (F.col("errorCode") == "allGood"), "newsNewbies")


@query("revalidate_sample")
def revalidate_sample(t: Tables):
    """Documents of one drawn partition (a site) that have to be extracted again."""
    docs = stored(judged(t).withColumn("partition", F.coalesce("domain", F.lit("none"))), "judged")
    drawn = (docs.select("partition").distinct().orderBy(F.xxhash64("partition", F.lit(3)), "partition").limit(1))
    some = docs.join(drawn, "partition", "left_semi")
    return frontier.requeue_invalid(some, valid_doc(REQUIRED, docs.columns, now()), "newsNewbies")


@query("revalidate_partitions", f"""WITH {JUDGED_SQL}, pt AS (SELECT url, page_id % 13 AS partition, code <> 'allGood' AS bad FROM jd),
dr AS (SELECT partition FROM (SELECT DISTINCT partition FROM pt) ORDER BY md5('5 ' || partition), partition LIMIT 4),
g AS MATERIALIZED (SELECT url, {sql.skinny('url')} AS sk, partition FROM pt WHERE bad AND partition IN (SELECT partition FROM dr)),
er AS (SELECT DISTINCT {sql.skinny('url')} AS sk FROM pages WHERE contains(url, '#'))
SELECT 'main' AS tab, url AS id, NULL::BIGINT AS n FROM pt WHERE url NOT IN (SELECT url FROM g)
UNION ALL SELECT 'queue', url, NULL FROM g UNION ALL SELECT 'errors', sk, NULL FROM er WHERE sk NOT IN (SELECT sk FROM g)
UNION ALL SELECT 'pivot', partition::VARCHAR, count(*) - count(*) FILTER (url IN (SELECT url FROM g)) FROM pt GROUP BY partition""")
def revalidate_partitions(t: Tables):
    """Four drawn partitions are checked; what is invalid leaves all tables for the queue."""
    docs = judged(t).withColumn("partition", F.col("page_id") % 13).checkpoint()
    listed = t.pages.filter(F.contains("url", F.lit("#"))).select(urls.skinny_url(F.col("url")).alias("skinnyURL")).distinct()
    tables = upkeep.Corpus(docs, docs.limit(0), listed, agg.count_by(docs, "partition").withColumnRenamed("n", "nDocs"))
    ok = valid_doc(REQUIRED, docs.columns, now()) & (F.col("errorCode") == "allGood")
    after, messages = upkeep.revalidate_sample(tables, 4, 5, ok, "newsNewbies")
    none = F.lit(None).cast("long").alias("n")
    parts = [after.main.select(F.lit("main").alias("tab"), F.col("URL").alias("id"), none),
             messages.select(F.lit("queue").alias("tab"), F.col("URL").alias("id"), none),
             after.errors.select(F.lit("errors").alias("tab"), F.col("skinnyURL").alias("id"), none),
             after.pivots.select(F.lit("pivot").alias("tab"), F.col("partition").cast("string").alias("id"), F.col("nDocs").alias("n"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("docs_by_url", """SELECT url AS "URL", page_id, NULL::VARCHAR AS author FROM pages WHERE contains(url, '/en/')""")
def docs_by_url(t: Tables):
    """Documents at the URLs asked for, some of which are asked for twice and some unknown."""
    docs = t.pages.withColumnRenamed("url", "URL")
    asked = docs.filter(F.contains("URL", F.lit("/en/"))).select("URL")
    asked = asked.unionByName(asked).unionByName(docs.select(F.concat(F.lit("http://unknown/"), "URL").alias("URL")))
    return scan.docs_by_url(asked, docs, ["page_id", "author"])


# one valid value and two that are not, for every field with a rule
FIELD_VALUES = {
    "URL": ("'http://a.b/'", "'ftp://a'", "''"), "refURL": ("'www.a.b'", "'a.b'", "' http://a'"), "ampLink": ("'https://a'", "'amp'", "''"),
    "canonicalLink": ("'http://c'", "'/c'", "''"), "skinnyURL": ("'a/b'", "''", "''"), "title": ("'T'", "''", "''"), "body": ("'b.'", "''", "''"),
    "sampleContent": ("'s.'", "''", "''"), "usedForBody": ("'/html'", "''", "''"), "domain": ("'http://d'", "'unknown'", "''"),
    "contentLength": ("0L", "-1L", "-7L"), "createdTs": ("timestamp '2020-01-01'", "timestamp '1989-12-31'", "timestamp '2026-01-03'"),
    "parsedTs": ("array(timestamp '2020-01-01')", "array(timestamp '1980-01-01')", "array(timestamp '2020-01-01', timestamp '2030-01-01')"),
    "sentences": ("array('', 'a')", "array('')", "cast(array() AS array<string>)"), "rssTags": ("array('t')", "array('', '')", "cast(array() AS array<string>)"),
    "metas": ("map('a', 'b')", "cast(map() AS map<string, string>)", "cast(map() AS map<string, string>)"),
    "headers": ("array('h')", "cast(array() AS array<string>)", "cast(array() AS array<string>)"),
    "links": ("array('x', 'http://l')", "array('x')", "cast(array() AS array<string>)"), "errorCode": ("'duplicated'", "'fine'", "''")}


@query("field_rules", "WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 4 = 0) SELECT " + ", ".join(f'n AS "valid_{f}"' for f in FIELD_VALUES) + " FROM n")
def field_rules(t: Tables):
    """Every rule on valid, invalid and missing values."""
    turn = F.col("o_orderkey") % 4
    rows = t.orders.select(*[F.when(turn == 0, F.expr(a)).when(turn == 1, F.expr(b)).when(turn == 2, F.expr(c)).alias(f)
                             for f, (a, b, c) in FIELD_VALUES.items()])
    return frontier.field_validity(rows, list(FIELD_VALUES), now())


@query("created_ts", f"""WITH {PATHS_SQL}
SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' AND o_totalprice > 300000 THEN '2001-02-03' WHEN o_totalprice > 200000 THEN '1999-12-31'
  WHEN o_totalprice > 100000 THEN '2004-05-06' WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(u.o_orderdate AS DATE)::VARCHAR END AS VARCHAR) AS created FROM u JOIN orders USING (o_orderkey)""")
def created_ts(t: Tables):
    price, none = F.col("o_totalprice"), F.lit(None)
    published = F.when((F.col("o_orderstatus") == "F") & (price > 300000), "Sat, 3 Feb 2001 10:00:00 GMT")
    headers = F.when(price > 200000, F.array(F.lit("text/html"), F.lit("1 Jan 2000"), F.lit("31 Dec 1999"), F.lit("1 Mar 1985")))
    texts = F.when(price > 100000, F.array(F.lit("6 5 99"), F.lit("no date here"), F.lit("on 6 May 2004"), F.lit("7 May 2004")))
    created = dates.created_ts(none.cast("timestamp"), published, headers, texts, F.col("url"))
    return dated_urls(t).select("o_orderkey", F.date_format(created, "yyyy-MM-dd").alias("created"))


FRONTIER_SQL = f"""{LINKS_SQL}, kn AS MATERIALIZED (SELECT DISTINCT link FROM lk WHERE contains(url, '#') AND link IS NOT NULL),
fs AS (SELECT {unescaped('link')} AS "URL", arg_min(url, page_id) AS "refURL" FROM lk WHERE link IS NOT NULL AND length(link) <= 250
  AND NOT regexp_matches(link, '[{{}}]') GROUP BY 1),
fr AS MATERIALIZED (SELECT replace("URL", '''', '%27') AS "URL", "refURL" FROM fs WHERE "URL" NOT IN (SELECT {unescaped('link')} FROM kn))"""


def frontier_tables(t: Tables):
    """Links of pages with a fragment count as known."""
    docs = page_links_table(t).withColumnRenamed("page_id", "seq")
    known = docs.filter(F.contains("URL", F.lit("#"))).select(F.explode("links").alias("URL"))
    none = known.limit(0)
    return docs, known, none, none.withColumn("skinnyURL", F.lit(""))


@query("frontier_links", f"""WITH {FRONTIER_SQL}
SELECT "URL", "refURL", {sql.skinny('"URL"')} AS "skinnyURL", {sql.domain('"URL"')} AS domain,
  coalesce({sql.collection('"URL"')} || '-links', 'unrouted') AS routing_key FROM fr""")
def frontier_links(t: Tables):
    docs, main, newbies, errors = frontier_tables(t)
    return frontier.links_to_frontier(docs, "seq", main, newbies, errors, site_config(t), "row_no")


@query("publish_report", f"""WITH {FRONTIER_SQL} SELECT coalesce({sql.collection('"URL"')} || '-links', 'unrouted') AS routing_key,
count(*) AS n FROM fr GROUP BY 1 UNION ALL SELECT 'all links', count(*) FROM lk WHERE link IS NOT NULL""")
def publish_report(t: Tables):
    docs, main, newbies, errors = frontier_tables(t)
    new = frontier.links_to_frontier(docs, "seq", main, newbies, errors, site_config(t), "row_no")
    seen = docs.agg(F.lit("all links").alias("routing_key"), F.sum(F.size("links")).alias("n"))
    return agg.count_by(new, "routing_key").unionByName(seen)


@query("random_links")
def random_links(t: Tables):
    """Links of 25 drawn pages; the number of links stands for the partition."""
    docs = page_links_table(t).withColumn("partition", F.size("links"))
    return scan.random_links(docs, 25, seed=5)
