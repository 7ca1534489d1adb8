"""URL functions, site configuration, the frontier, queues and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, urls
from ..operators import aggregate as agg, frontier, mutate, scan
from ..session import scratch_path
from ..sources import config as cfg, consume, events as ev, feeds, queues
from . import sql
from .base import Tables, query
from .fixtures import SCREENING, known_pages, site_config


@query("skinny_url", f"SELECT page_id, {sql.skinny('url')} AS skinny FROM pages")
def skinny_url(t: Tables):
    return t.pages.select("page_id", urls.skinny_url(F.col("url")).alias("skinny"))


FEATURES_SQL = f"""f AS (SELECT *, length(skinny) / length(url)::DOUBLE AS "leanPct", length(url)::BIGINT AS length,
  length(url) - length(replace(url, '-', '')) AS "nDash", len(string_split(skinny, '/')) AS "nTokens"
  FROM (SELECT page_id, url, {sql.skinny('url')} AS skinny FROM pages))"""


@query("url_features", f"""WITH {FEATURES_SQL}
SELECT page_id, {sql.r6('"leanPct"')} AS lean_pct, length AS n_length, "nDash" AS n_dash, "nTokens" AS n_tokens FROM f""")
def url_features(t: Tables):
    f = urls.url_features(F.col("url"))
    return t.pages.select("page_id", (F.round(f["leanPct"], 6) + 0.0).alias("lean_pct"),
                          f["length"].cast("long").alias("n_length"), f["nDash"].cast("long").alias("n_dash"),
                          f["nTokens"].cast("long").alias("n_tokens"))


@query("url_feature_matrix", f"""WITH {FEATURES_SQL}
SELECT page_id, "nTokens"::INT AS "nTokens", list_contains(string_split(skinny, '/'), 'en')::INT AS tok_en,
  list_contains(string_split(skinny, '/'), 'fr')::INT AS tok_fr FROM f""")
def url_feature_matrix(t: Tables):
    return urls.url_feature_matrix(t.pages, "url", ["en", "fr"]).select("page_id", "nTokens", "tok_en", "tok_fr")


@query("entry_url", """
SELECT page_id, coalesce(CASE WHEN contains(url, '#') THEN regexp_replace(url || '?ncid=rss', '\\?ncid=rss$', '') END,
  'http://feed.example.com/' || page_id) AS entry FROM pages""")
def entry_url(t: Tables):
    orig = F.when(F.contains("url", F.lit("#")), F.concat("url", F.lit("?ncid=rss")))
    link = F.concat(F.lit("http://feed.example.com/"), F.col("page_id").cast("string"))
    return t.pages.select("page_id", urls.entry_url(orig, link).alias("entry"))


@query("clean_links", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) || CASE WHEN contains(url, '#')
  THEN '{}' WHEN contains(url, '?') THEN '''s\\\\' ELSE '' END AS link FROM pages)
SELECT page_id, replace(regexp_replace(link, '\\\\+$', ''), '''', '%27') AS link FROM l
WHERE length(link) <= 250 AND NOT regexp_matches(link, '[{}]')""")
def clean_links(t: Tables):
    tail = (F.when(F.contains("url", F.lit("#")), "{}").when(F.contains("url", F.lit("?")), "'s\\\\").otherwise(""))
    links = t.pages.select("page_id", tail.alias("tail"),
                           F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return scan.clean_links(links.select("page_id", F.concat("href", "tail").alias("link")), "link")


# one site row per host, with the fields its pages can fill
HOSTS_SQL = """sites AS (SELECT split_part(url, '/', 3) AS domain, split_part(split_part(url, '/', 3), '.', -1) AS collection,
  'URL,skinnyURL,domain' || CASE WHEN bool_or(contains(url, '?')) THEN ',links' ELSE '' END
  || CASE WHEN bool_or(contains(url, '#')) THEN ',metas' ELSE '' END AS fields,
  'http://' || split_part(url, '/', 3) || '/rss,http://' || split_part(url, '/', 3) || '/atom' AS feeds
  FROM pages GROUP BY ALL)"""


def host_config(t: Tables):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    flags = t.pages.groupBy(host.alias("domain")).agg(
        F.bool_or(F.contains("url", F.lit("?"))).alias("q"), F.bool_or(F.contains("url", F.lit("#"))).alias("h"))
    return flags.select(
        "domain", F.split_part("domain", F.lit("."), F.lit(-1)).alias("collection"),
        F.concat(F.lit("URL,skinnyURL,domain"), F.when(F.col("q"), ",links").otherwise(""),
                 F.when(F.col("h"), ",metas").otherwise("")).alias("fields"),
        F.lit("body").alias("useForSentences"),
        F.format_string("http://%s/rss,http://%s/atom", "domain", "domain").alias("rssFeeds"))


@query("site_required_fields", f"""WITH {HOSTS_SQL}
SELECT DISTINCT collection, unnest(string_split(fields, ',')) AS field FROM sites""")
def site_required_fields(t: Tables):
    return cfg.required_fields(host_config(t))


@query("site_feeds", f"""WITH {HOSTS_SQL}
SELECT domain, unnest(string_split(feeds, ',')) AS feed FROM sites""")
def site_feeds(t: Tables):
    return cfg.explode_feeds(host_config(t))


@query("ambiguous_collections", """
SELECT collection, count(DISTINCT src) AS n_sources FROM (SELECT split_part(split_part(url, '/', 3), '.', -1) AS collection,
  CASE WHEN contains(url, 'spam') THEN 'title' ELSE 'body' END AS src FROM pages) GROUP BY 1 HAVING count(DISTINCT src) > 1""")
def ambiguous_collections(t: Tables):
    sites = t.pages.select(
        F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit("."), F.lit(-1)).alias("collection"),
        F.when(F.contains("url", F.lit("spam")), "title").otherwise("body").alias("useForSentences"))
    return cfg.ambiguous_collections(sites)


@query("route_domain", f"SELECT page_id, {sql.domain('url')} AS domain, {sql.collection('url')} AS collection FROM pages")
def route_domain(t: Tables):
    return frontier.route_by_regex(t.pages, "url", site_config(t), "row_no").select("page_id", "domain", "collection")


# a site for every host, one for every second part of a host's name behind them, and one for the rest of a top-level domain
MANY_SQL = """hs AS (SELECT DISTINCT split_part(url, '/', 3) AS host FROM pages), sites AS MATERIALIZED (
SELECT 'https?://' || replace(host, '.', '\\.') || '/[a-d].*' AS rgx, 'host ' || host AS domain, 1000 + length(host) AS o FROM hs
UNION ALL SELECT DISTINCT '.*' || split_part(host, '.', 2) || '\\.' || split_part(host, '.', -2) || '\\.' || split_part(host, '.', -1) || '/.*',
  'name ' || split_part(host, '.', 2), 5000 + length(split_part(host, '.', 2)) FROM hs
UNION ALL SELECT '.*(org|net).*', 'wild', 9000)"""


@query("route_many_sites", f"""WITH {MANY_SQL}
SELECT page_id, arg_min(domain, (o, domain)) AS domain FROM pages LEFT JOIN sites ON regexp_matches(url, '^(?:' || rgx || ')') GROUP BY page_id""")
def route_many_sites(t: Tables):
    host = t.pages.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("h")).distinct()
    second, esc = F.split_part("h", F.lit("."), F.lit(2)), F.lit("\\.")
    end = F.concat(F.split_part("h", F.lit("."), F.lit(-2)), esc, F.split_part("h", F.lit("."), F.lit(-1)), F.lit("/.*"))
    sites = (host.select(F.concat(F.lit("https?://"), F.replace("h", F.lit("."), esc), F.lit("/[a-d].*")).alias("domainRegex"),
                         F.concat(F.lit("host "), "h").alias("domain"), (1000 + F.length("h")).alias("o"))
             .unionByName(host.select(F.concat(F.lit(".*"), second, esc, end).alias("domainRegex"), F.concat(F.lit("name "), second).alias("domain"),
                                      (5000 + F.length(second)).alias("o")).distinct())
             .unionByName(t.spark.range(1).select(F.lit(".*(org|net).*").alias("domainRegex"), F.lit("wild").alias("domain"), F.lit(9000).alias("o"))))
    return frontier.route_by_regex(t.pages, "url", sites, "o", ["domain"], chain=0).select("page_id", "domain")


@query("domain_breakdown", f"SELECT {sql.domain('url')} AS domain, count(*) AS n FROM pages GROUP BY 1")
def domain_breakdown(t: Tables):
    return agg.count_by(frontier.route_by_regex(t.pages, "url", site_config(t), "row_no"), "domain")


# values asked for: every page URL, half of them spelt with a quote that gets encoded
@query("exist_values", f"""WITH {sql.KNOWN}
SELECT DISTINCT "skinnyURL" FROM p WHERE NOT regexp_matches("skinnyURL", '[{{}}]') AND "skinnyURL" IN
  (SELECT "skinnyURL" FROM main UNION ALL SELECT "skinnyURL" FROM errors)""")
def exist_values(t: Tables):
    pages, main, _, errors = known_pages(t)
    return frontier.exist(pages, "skinnyURL", [main, errors])


@query("missing_values", f"""WITH {sql.KNOWN}
SELECT DISTINCT "URL" FROM p WHERE "URL" NOT IN (SELECT "URL" FROM main UNION ALL SELECT "URL" FROM newbies)""")
def missing_values(t: Tables):
    pages, main, newbies, _ = known_pages(t)
    return frontier.missing(pages, "URL", [main, newbies])


@query("missing_from_all", f"""WITH {sql.KNOWN}
SELECT DISTINCT "URL", "skinnyURL" FROM p WHERE "URL" NOT IN (SELECT "URL" FROM main UNION ALL SELECT "URL" FROM newbies)
  AND "skinnyURL" NOT IN (SELECT "skinnyURL" FROM errors)""")
def missing_from_all(t: Tables):
    return frontier.missing_from_all(*known_pages(t))


ERR_SQL = """CASE WHEN contains("URL", 'spam') THEN 'dodgy' WHEN contains("URL", 'utm_') THEN 'parsingError'
  WHEN contains("URL", '#') THEN 'allGood' WHEN contains("URL", '?') THEN 'empty' END"""


def judged_pages(t: Tables):
    pages = known_pages(t)[0]
    code = (F.when(F.contains("URL", F.lit("spam")), "dodgy").when(F.contains("URL", F.lit("utm_")), "parsingError")
            .when(F.contains("URL", F.lit("#")), "allGood").when(F.contains("URL", F.lit("?")), "empty"))
    return pages.withColumn("errorCode", code)


@query("new_errors", f"""WITH {sql.KNOWN}, j AS (SELECT *, {ERR_SQL} AS "errorCode" FROM p)
SELECT "URL", "skinnyURL", "errorCode" FROM j WHERE "errorCode" <> 'allGood'
  AND "skinnyURL" NOT IN (SELECT "skinnyURL" FROM errors)""")
def new_errors(t: Tables):
    return frontier.new_errors(judged_pages(t).drop("skinnyURL"), known_pages(t)[3]).drop("raisedTs")


@query("error_breakdown", f"""SELECT {ERR_SQL.replace('"URL"', 'url')} AS "errorCode", count(*) AS n FROM pages GROUP BY 1""")
def error_breakdown(t: Tables):
    return agg.count_by(judged_pages(t), "errorCode")


@query("upsert_docs", f"""WITH {sql.KNOWN}
SELECT coalesce(m."URL", n."URL") AS "URL", coalesce(n."skinnyURL", m."skinnyURL") AS "skinnyURL",
  coalesce(n.score, m.score) AS score FROM
  (SELECT "URL", "skinnyURL", page_id AS score FROM p WHERE NOT contains("URL", '.html')) m
  FULL JOIN (SELECT "URL", 'new' AS "skinnyURL", CASE WHEN contains("URL", '#') THEN NULL ELSE -page_id END AS score
             FROM p WHERE NOT contains("URL", '?')) n ON m."URL" = n."URL" """)
def upsert_docs(t: Tables):
    pages = known_pages(t)[0]
    table = pages.filter(~F.contains("URL", F.lit(".html"))).select("URL", "skinnyURL", F.col("page_id").alias("score"))
    docs = pages.filter(~F.contains("URL", F.lit("?"))).select(
        "URL", F.lit("new").alias("skinnyURL"),
        F.when(~F.contains("URL", F.lit("#")), -F.col("page_id")).alias("score"))
    return mutate.upsert_docs(table, docs)


@query("delete_everywhere", f"""WITH {sql.KNOWN}, d AS (SELECT * FROM p WHERE contains("URL", 'example.net'))
SELECT 'main' AS tab, "URL" FROM main WHERE "URL" NOT IN (SELECT "URL" FROM d)
UNION ALL SELECT 'newbies', "URL" FROM newbies WHERE "URL" NOT IN (SELECT "URL" FROM d)
UNION ALL SELECT 'errors', "URL" FROM errors WHERE "skinnyURL" NOT IN (SELECT "skinnyURL" FROM d)""")
def delete_everywhere(t: Tables):
    pages, main, newbies, errors = known_pages(t)
    left = mutate.delete_everywhere(pages.filter(F.contains("URL", F.lit("example.net"))), main, newbies, errors)
    return scan.union_like(dict(zip(["main", "newbies", "errors"], left)), "", ["URL"]).withColumnRenamed("src", "tab")


Z_SQL = """-3.0 + 2.5 * "leanPct" + 0.02 * length + 0.4 * "nDash" + 0.3 * "nTokens"
  + 2.0 * list_contains(string_split(skinny, '/'), 'spam-farm.example.org')::INT
  - 0.5 * list_contains(string_split(skinny, '/'), 'en')::INT"""


@query("screen_urls", f"""WITH {FEATURES_SQL}, s AS (SELECT page_id, url, 1 / (1 + exp(-({Z_SQL}))) AS p FROM f)
SELECT page_id, {sql.r6('p')} AS p_dodgy FROM s WHERE p <= 0.55 OR contains(url, 'reuters') OR contains(url, 'bbc')""")
def screen_urls(t: Tables):
    kept = frontier.screen_urls(t.pages, "url", SCREENING, 0.55)
    return kept.select("page_id", (F.round("pDodgy", 6) + 0.0).alias("p_dodgy"))


@query("screen_threshold", f"""SELECT event_type AS queue, {sql.r6('greatest(0.5, 1 / (1 + ln(1 + count(*) / 900.0)))')} AS threshold
FROM events GROUP BY 1""")
def screen_threshold(t: Tables):
    pending = t.events.groupBy(F.col("event_type").alias("queue")).agg(F.count(F.lit(1)).alias("n"))
    return pending.select("queue", (F.round(frontier.screen_threshold(F.col("n"), 900), 6) + 0.0).alias("threshold"))


@query("publish_counts", f"""SELECT coalesce({sql.collection('url')}, 'unrouted') || '-links' AS routing_key, count(*) AS n
FROM pages GROUP BY 1""")
def publish_counts(t: Tables):
    """Published twice under one batch id: a replay must not double the messages."""
    routed = frontier.route_by_regex(t.pages.select("page_id", "url"), "url", site_config(t), "row_no")
    messages = routed.select("page_id", "url", F.concat(
        F.coalesce("collection", F.lit("unrouted")), F.lit("-links")).alias("routing_key"))
    path = scratch_path(t.spark, "queue")
    for _ in range(2):
        queues.publish_by_key(messages, path, batch_id=1)
    return agg.count_by(queues.read_queue(t.spark, path, t.pages.select("page_id", "url").schema), "routing_key")


@query("queue_backlog", """
SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type || '-links' ELSE event_type END AS routing_key,
  count(*) AS pending FROM events GROUP BY 1""")
def queue_backlog(t: Tables):
    key = F.when(F.col("event_type").isin("click", "view"), F.concat("event_type", F.lit("-links"))).otherwise(F.col("event_type"))
    return queues.backlog(t.events.withColumn("routing_key", key))


# messages a consumer of clicks takes in a run
TAKEN = 700


@query("queue_pending", f"""
SELECT event_type AS routing_key, count(*) - CASE WHEN event_type = 'click' THEN least(2 * {TAKEN}, count(*)) ELSE 0 END AS pending
FROM events GROUP BY 1""")
def queue_pending(t: Tables):
    """What is left of the events, published in three batches, after two bounded runs took clicks."""
    messages = t.events.withColumn("routing_key", F.col("event_type")).drop("event_type")
    path = scratch_path(t.spark, "queue")
    for k in range(3):
        queues.publish_by_key(messages.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k), path, k)
    schema = messages.drop("routing_key").schema
    for _ in range(2):
        consume.consume(t.spark, path, "click", schema, lambda batch, _: batch.write.format("noop").mode("overwrite").save(), TAKEN)
    return consume.pending(t.spark, path)


@query("site_event_counts", """
SELECT 'site' || user_id % 7 AS site, count(*) FILTER (event_type = 'error') AS flagged, count(*) AS n,
  CAST(sum(json_extract(props, '$.k')::BIGINT) AS BIGINT) AS k_sum FROM events GROUP BY 1""")
def site_event_counts(t: Tables):
    """Events of seven sites, written and read back."""
    data = t.events.withColumn("k", F.get_json_object("props", "$.k"))
    site = F.concat(F.lit("site"), (F.col("user_id") % 7).cast("string"))
    stamped = ev.stamp_events(data, site, ["event_type", "k"], F.col("ts"),
                              F.when(F.col("event_type") == "error", "test"))
    path = scratch_path(t.spark, "events")
    errors = F.col("_flag").eqNullSafe("test")
    for batch, rows in (("a", stamped.filter(errors)), ("b", stamped.filter(~errors)), ("a", stamped.filter(errors))):
        ev.append_events(rows, path, batch)
    back = t.spark.read.parquet(path)
    return back.groupBy("site").agg(F.count_if(F.col("_flag") == "test").alias("flagged"),
                                    F.count(F.lit(1)).alias("n"), F.sum(F.col("data")["k"].cast("long")).alias("k_sum"))


ENTRIES_SQL = """e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN 'http://example.com/' || user_id END AS link,
  CASE WHEN event_type IN ('view', 'click') OR value < 5 THEN 'http://orig.example.com/' || user_id || '?ncid=rss' END AS orig,
  event_type, value, ts FROM events)"""


def feed_entries(t: Tables):
    link = F.concat(F.lit("http://example.com/"), F.col("user_id").cast("string"))
    orig = F.concat(F.lit("http://orig.example.com/"), F.col("user_id").cast("string"), F.lit("?ncid=rss"))
    null = F.lit(None)
    return t.events.select(
        "event_id", F.when(F.col("event_type") != "error", link).alias("link"),
        F.when(F.col("event_type").isin("view", "click") | (F.col("value") < 5), orig).alias("feedburner_origlink"),
        F.col("event_type").alias("title"), F.date_format("ts", "d MMMM yyyy HH:mm:ss").alias("published"),
        F.when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("updated"),
        F.when(F.col("event_type") == "purchase", F.col("ts").cast("timestamp")).alias("published_parsed"),
        null.cast("timestamp").alias("updated_parsed"),
        F.array(F.struct(F.col("event_type").alias("term")),
                F.struct(F.when(F.col("value") > 10, F.lit("big")).alias("term"))).alias("tags"),
        F.struct(F.concat(F.lit("http://example.com/feed/"), F.col("event_type")).alias("base")).alias("title_detail"))


@query("feed_valid_entries", f"""WITH {ENTRIES_SQL}
SELECT coalesce(replace(orig, '?ncid=rss', ''), link) AS "URL", count(*) AS n FROM e WHERE coalesce(orig, link) IS NOT NULL
GROUP BY 1 UNION ALL SELECT 'malformed', count(*) FROM e WHERE coalesce(orig, link) IS NULL""")
def feed_valid_entries(t: Tables):
    entries = feed_entries(t)
    good = feeds.valid_entries(entries).select(
        urls.entry_url(F.col("feedburner_origlink"), F.col("link")).alias("URL"))
    return agg.count_by(good, "URL").unionByName(
        feeds.malformed_count(entries).select(F.lit("malformed").alias("URL"), F.col("malformed").alias("n")))


@query("feed_tags", f"""WITH {ENTRIES_SQL}
SELECT event_id, event_type || CASE WHEN value > 10 THEN ',big' ELSE '' END AS tags,
  'http://example.com/feed/' || event_type AS "refURL" FROM e""")
def feed_tags(t: Tables):
    return feed_entries(t).select("event_id", F.array_join(feeds.feed_tags(F.col("tags")), ",").alias("tags"),
                                  F.col("title_detail.base").alias("refURL"))


@query("entry_ref_ts", """
SELECT event_id, epoch_us(CASE event_type WHEN 'purchase' THEN ts ELSE date_trunc('second', ts) END) AS ref_us FROM events""")
def entry_ref_ts(t: Tables):
    e = feed_entries(t)
    ref = dates.entry_ref_ts(F.col("updated_parsed"), F.col("updated"), F.col("published_parsed"), F.col("published"))
    return e.select("event_id", F.unix_micros(ref).alias("ref_us"))
