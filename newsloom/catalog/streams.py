"""Streaming jobs run to the end of the given tables, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..session import scratch_path
from ..streaming import crawl, feeds, liveness, newbies
from ..functions.urls import escape_value
from ..operators.ranking import global_rank
from ..sources.queues import publish_by_key, read_queue
from . import sql
from .base import Tables, query
from .fixtures import SCREENING, known_pages, pivots, site_config, word_model
from .pages import JUDGED_SQL, LINKS_SQL, REQUIRED, now, page_links_table, unescaped
from .upkeep import CLEAN_SQL, PROJECTION, articles, empty_corpus
from .urls import FEATURES_SQL, Z_SQL


def stream_of(t: Tables, name: str):
    """A table as a stream, be it one file or a folder of files.

    The path is a pattern that fits this name only: of a plain path Spark takes
    a folder for the base of the files, which a single file is not.
    """
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/[{name[0]}]{name[1:]}.parquet")


def run_to_table(df, spark, name: str):
    """Run a stream to its end into a table, and read that."""
    path = scratch_path(spark, name)
    (df.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
     .option("checkpointLocation", scratch_path(spark, f"{name}-log")).start(path).awaitTermination())
    return spark.read.schema(df.schema).parquet(path)


VERSIONS_SQL = """g AS (SELECT event_id, user_id, event_type, value FROM events WHERE json_extract(props, '$.k')::INT >= 20),
b AS (SELECT *, max(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
SELECT event_id, user_id, event_type, value FROM b WHERE before IS NULL OR value > before"""


def good_entry():
    return F.get_json_object("props", "$.k").cast("int") >= 20


@query("feed_versions", f"WITH {VERSIONS_SQL}")
def feed_versions(t: Tables):
    found = feeds.new_versions(t.events, ["user_id", "event_type"], "event_id", "value", good_entry(), width=1024)
    return found.select("event_id", "user_id", "event_type", "value")


@query("feed_versions_stream", f"WITH {VERSIONS_SQL}")
def feed_versions_stream(t: Tables):
    entries = stream_of(t, "events").select("event_id", "user_id", "event_type", "value", good_entry().alias("good"))
    passed = feeds.version_stream(entries, ["user_id", "event_type"], "event_id", "value", "good", forget_ms=None)
    return run_to_table(passed, t.spark, "versions").drop("good")


POLLS_SQL = """e AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) - (SELECT CAST(min(ts) AS DATE) FROM events) AS poll,
  json_extract(props, '$.k')::INT >= 20 AS good FROM events),
p AS (SELECT DISTINCT user_id, event_type, poll FROM e),
q AS (SELECT *, CASE WHEN poll - lag(poll) OVER (PARTITION BY user_id, event_type ORDER BY poll) <= 1 THEN 0 ELSE 1 END AS opens FROM p),
r AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY poll) AS run FROM q),
b AS (SELECT e.*, max(value) OVER (PARTITION BY user_id, event_type, run ORDER BY poll, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM e JOIN r USING (user_id, event_type, poll) WHERE good)
SELECT event_id, user_id, event_type, value FROM b WHERE before IS NULL OR value > before"""


def polled(events, first):
    """Every day is a poll; a link a day did not bring is forgotten."""
    return events.select("event_id", "user_id", "event_type", "value", good_entry().alias("good"),
                         F.datediff(F.to_date("ts"), F.lit(first)).cast("long").alias("poll"))


@query("feed_versions_polls", f"WITH {POLLS_SQL}")
def feed_versions_polls(t: Tables):
    entries = polled(t.events, t.events.agg(F.to_date(F.min("ts"))).head()[0])
    found = feeds.new_versions(entries, ["user_id", "event_type"], "event_id", "value", F.col("good"), width=1024, poll="poll")
    return found.select("event_id", "user_id", "event_type", "value")


@query("feed_versions_polls_stream", f"WITH {POLLS_SQL}")
def feed_versions_polls_stream(t: Tables):
    entries = polled(stream_of(t, "events"), t.events.agg(F.to_date(F.min("ts"))).head()[0])
    passed = feeds.version_stream(entries, ["user_id", "event_type"], "event_id", "value", "good", forget_ms=None, poll="poll")
    return run_to_table(passed, t.spark, "polls").drop("good", "poll")


OUTCOME_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'timeout' ELSE 'beat' END"


def probes(events):
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "timeout").otherwise("beat")
    return events.select(F.col("user_id").alias("emitter"), F.col("ts").cast("timestamp").alias("ts"),
                         F.col("event_id").alias("seq"), outcome.alias("outcome"))


LIVENESS_SQL = f"""WITH n AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, arg_max({OUTCOME_SQL}, (ts, event_id)) AS outcome,
  max(ts) FILTER ({OUTCOME_SQL} = 'beat') AS beat FROM events GROUP BY 1)
SELECT c_custkey AS emitter, CASE WHEN outcome IS NULL THEN 'unknown (never tried)' WHEN outcome = 'timeout' THEN 'unknown (timed out)'
  WHEN beat IS NULL OR now - beat > INTERVAL 200000 SECOND THEN 'slow' WHEN outcome = 'error' THEN 'dead' ELSE 'alive' END AS status
FROM customer CROSS JOIN n LEFT JOIN s ON user_id = c_custkey"""


@query("liveness", LIVENESS_SQL)
def liveness_query(t: Tables):
    p = probes(t.events)
    emitters = t.customer.select(F.col("c_custkey").alias("emitter"))
    return liveness.liveness(p, emitters, "emitter", p.agg(F.max("ts")).scalar(), 200000)


@query("slow_gaps", """WITH g AS (SELECT user_id AS emitter, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT emitter, epoch_us(before) AS since_us, epoch_us(ts) AS until_us FROM g WHERE ts - before > INTERVAL 100000 SECOND""")
def slow_gaps(t: Tables):
    p = probes(t.events)
    gaps = liveness.slow_gaps(p, "emitter", "ts", "seq", 100000)
    return gaps.select("emitter", F.unix_micros("since").alias("since_us"), F.unix_micros("until").alias("until_us"))


@query("liveness_stream")
def liveness_stream(t: Tables):
    return run_to_table(liveness.liveness_stream(probes(stream_of(t, "events")), "emitter", 100000), t.spark, "liveness").select("emitter", "at", "status")


@query("liveness_current", LIVENESS_SQL)
def liveness_current(t: Tables):
    """The last status from a stream that gets the probes in three batches, in no order of time."""
    folder, p = scratch_path(t.spark, "probes"), probes(t.events)
    for k in range(3):
        p.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == k).repartition(1).write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    changes = run_to_table(liveness.liveness_stream(stream, "emitter", 200000, late="3650 days"), t.spark, "liveness")
    emitters = t.customer.select(F.col("c_custkey").alias("emitter"))
    return liveness.current_status(changes, emitters, "emitter", p.agg(F.max("ts")).scalar(), 200000)


@query("frontier_admit", f"""WITH {sql.KNOWN}, {FEATURES_SQL}, sc AS (SELECT page_id, url, 1 / (1 + exp(-({Z_SQL}))) AS p FROM f)
SELECT url AS "URL", 'news-links' AS routing_key FROM sc
WHERE p <= greatest(0.5, 1 / (1 + ln(1 + (SELECT count(*) FROM events WHERE event_type = 'click') / (SELECT count(*) FROM region)::DOUBLE)))
  AND url NOT IN (SELECT "URL" FROM main UNION ALL SELECT "URL" FROM newbies)
  AND {sql.skinny('url')} NOT IN (SELECT "skinnyURL" FROM errors)""")
def frontier_admit(t: Tables):
    """All pages as links in a stream, with the events as what is pending."""
    _, main, newbies_, errors = known_pages(t)
    pending = t.events.filter("event_type = 'view'").count()
    clicks = t.events.filter("event_type = 'click'").count()
    links = stream_of(t, "pages").select("page_id", F.col("url").alias("URL"))
    path = scratch_path(t.spark, "admitted")
    crawl.frontier_stream(links, path, lambda: (pending, clicks), "news", block=t.region.count(), model=SCREENING,
                          main=main, newbies=newbies_, errors=errors).awaitTermination()
    return read_queue(t.spark, path, links.schema).select("URL", "routing_key")


@query("crawl_counts", f"""WITH {JUDGED_SQL}
SELECT 'newbies' AS sink, count(*) AS n FROM jd WHERE code = 'allGood'
UNION ALL SELECT 'errors', count(*) FROM jd WHERE code <> 'allGood'""")
def crawl_counts(t: Tables):
    """Rows per sink, after the job was started once more."""
    pages = stream_of(t, "pages").withColumnRenamed("url", "URL").withColumn(
        "html", F.when(~F.contains("URL", F.lit("/es/")), F.col("html")))
    none = known_pages(t)[0].limit(0)
    paths = crawl.CrawlPaths(*[scratch_path(t.spark, n) for n in ("newbies", "errors", "links")])
    config, log = site_config(t), scratch_path(t.spark, "crawl-log")
    for _ in range(2):
        crawl.crawl_stream(pages, paths, config, "row_no", REQUIRED, now(), none, none, none, log, "page_id").awaitTermination()
    read = t.spark.read.parquet
    return (read(paths.newbies).agg(F.lit("newbies").alias("sink"), F.count(F.lit(1)).alias("n"))
            .unionByName(read(paths.errors).agg(F.lit("errors").alias("sink"), F.count(F.lit(1)).alias("n"))))


# every page comes in one of three batches, and all of them again in the last one; links of pages with a fragment are stored
CRAWL_SQL = f"""{JUDGED_SQL}, {LINKS_SQL}, ls AS (SELECT page_id, url, page_id % 3 AS batch, {unescaped('link')} AS link FROM lk WHERE link IS NOT NULL),
kn AS (SELECT replace(link, chr(39), '%27') AS link FROM ls WHERE contains(url, '#')),
fl AS (SELECT replace(link, chr(39), '%27') AS link, min(batch) AS batch, arg_min(url, (batch, page_id)) AS ref FROM ls
  WHERE NOT contains(url, '/es/') AND length(link) <= 250 AND NOT regexp_matches(link, '[{{}}]') GROUP BY 1),
er AS (SELECT page_id % 3 AS batch, url, {sql.skinny('url')} AS sk FROM jd WHERE code <> 'allGood'),
fe AS MATERIALIZED (SELECT sk, min(batch) AS batch FROM er GROUP BY sk),
sl AS (SELECT fl.*, {sql.skinny('link')} AS sk FROM fl WHERE link NOT IN (SELECT link FROM kn))"""


@query("crawl_known", f"""WITH {CRAWL_SQL}
SELECT sl.batch, 'link' AS kind, link AS "URL", ref AS "refURL" FROM sl LEFT JOIN fe ON fe.sk = sl.sk AND fe.batch <= sl.batch WHERE fe.sk IS NULL
UNION ALL SELECT page_id % 3, 'article', url, NULL FROM jd WHERE code = 'allGood'
UNION ALL SELECT er.batch, 'error', url, NULL FROM er JOIN fe ON fe.sk = er.sk AND fe.batch = er.batch""")
def crawl_known(t: Tables):
    """Links, articles and errors of three micro-batches with repeated pages; the job is started twice."""
    fetched = F.when(~F.contains("URL", F.lit("/es/")), F.col("html"))
    rows = t.pages.select("page_id", F.col("url").alias("URL"), "html").withColumn("html", fetched)
    folder, log = scratch_path(t.spark, "fetched"), scratch_path(t.spark, "crawl-log")
    part = F.col("page_id") % 3
    for k, some in enumerate((rows.filter(part == 0), rows.filter(part == 1), rows)):
        some.repartition(1).write.mode("append").parquet(folder)
    pages = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    known = page_links_table(t).filter(F.contains("URL", F.lit("#"))).select(F.explode("links").alias("URL"))
    known = known.select(escape_value(F.col("URL")).alias("URL"))
    none = known.limit(0)
    paths = crawl.CrawlPaths(*[scratch_path(t.spark, n) for n in ("newbies", "errors", "links")])
    for _ in range(2):
        crawl.crawl_stream(pages, paths, site_config(t), "row_no", REQUIRED, now(), none, known, none.withColumn("skinnyURL", F.lit("")),
                           log, "page_id").awaitTermination()
    blank = F.lit(None).cast("string").alias("refURL")
    sinks = [t.spark.read.parquet(path).select(F.col("batch_id").alias("batch"), F.lit(kind).alias("kind"), "URL", blank)
             for kind, path in (("article", paths.newbies), ("error", paths.errors))]
    links = read_queue(t.spark, paths.links, none.withColumn("refURL", F.lit("")).schema)
    links = links.select(F.col("batch_id").alias("batch"), F.lit("link").alias("kind"), "URL", "refURL")
    return sinks[0].unionByName(sinks[1]).unionByName(links)


def _round_sql(k: int, behind: str) -> str:
    return f"""a{k} AS MATERIALIZED (SELECT {k} AS batch, url FROM ok, dim WHERE part = {k}
  AND p <= greatest(0.5, 1 / (1 + ln(1 + ({2 - k} * b + ({behind})) / b::DOUBLE))))"""


@query("frontier_rounds", f"""WITH {sql.KNOWN}, {FEATURES_SQL}, dim AS (SELECT count(*) AS n, (count(*) + 2) // 3 AS b FROM pages),
sc AS (SELECT page_id, url, skinny, 1 / (1 + exp(-({Z_SQL}))) AS p, (row_number() OVER (ORDER BY page_id) - 1) // (SELECT b FROM dim) AS part FROM f),
ok AS MATERIALIZED (SELECT * FROM sc WHERE url NOT IN (SELECT "URL" FROM main UNION ALL SELECT "URL" FROM newbies)
  AND skinny NOT IN (SELECT "skinnyURL" FROM errors)),
{_round_sql(0, '0')}, {_round_sql(1, 'SELECT count(*) FROM a0')}, {_round_sql(2, '(SELECT count(*) FROM a0) + (SELECT count(*) FROM a1)')}
SELECT batch, url AS "URL", 'news-links' AS routing_key FROM (FROM a0 UNION ALL FROM a1 UNION ALL FROM a2)""")
def frontier_rounds(t: Tables):
    """Three rounds over all pages as links, while the crawl has a lot to do: what passes stands in line again."""
    _, main, newbies_, errors = known_pages(t)
    path, n = scratch_path(t.spark, "frontier"), t.pages.count()
    block = (n + 2) // 3
    line = global_rank(t.pages.select("page_id", F.col("url").alias("URL")), [F.col("page_id")], "__at")
    for k in range(3):
        # some links of the last part come twice, which fills it
        last = 3 * block - n if k == 2 else 0
        times = F.when(F.col("__at").between(2 * block, 2 * block + last - 1), 2).otherwise(1)
        here = line.filter(F.col("__at").between(k * block, k * block + block - 1)).withColumn("__times", F.explode(F.sequence(F.lit(1), times)))
        publish_by_key(here.drop("__at", "__times").withColumn("routing_key", F.lit("news-links")), path, k, "crawl")
    busy = t.events.select(F.lit(0).cast("long").alias("page_id"), F.lit("x").alias("URL"), F.lit("news").alias("routing_key"))
    publish_by_key(busy, path, 3, "crawl")
    schema = line.drop("__at").schema
    for _ in range(3):
        crawl.frontier_run(t.spark, path, "news", schema, block, SCREENING, lambda: (main, newbies_, errors))
    sent = read_queue(t.spark, path, schema).filter("publisher = 'frontier'")
    return sent.select(F.col("batch_id").cast("int").alias("batch"), "URL", "routing_key")


@query("newbies_batch", f"""WITH {CLEAN_SQL} SELECT count(*) FILTER (code = 'allGood') AS placed, count(*) FILTER (code = 'allGood') AS counted,
true AS within_size FROM judged""")
def newbies_batch(t: Tables):
    """After a round: every good article in one partition, none above twice the size."""
    batch, model, size = articles(t), word_model(t), 50
    start = empty_corpus(t, batch)
    start.main = start.main.withColumn("vec", F.lit(None).cast("array<double>"))
    start.pivots = pivots(t).withColumn("nDocs", F.lit(0).cast("long")).withColumn("URL", F.concat(F.lit("old-"), F.col("partition").cast("string")))
    after, _, _ = newbies.newbies_round(start, batch, model, PROJECTION, batch_size=1, partition_size=size)
    sizes = agg.count_by(after.main, "partition")
    counted = after.pivots.agg(F.sum("nDocs")).scalar()
    return sizes.agg(F.sum("n").alias("placed"), (F.max("n") <= 2 * size).alias("within_size")).withColumn("counted", counted)


@query("newbies_validated", """SELECT 'queue' AS tab, 'http://news.example.com/' || doc_id AS "URL" FROM documents WHERE coalesce(lang, '') <> 'en'""")
def newbies_validated(t: Tables):
    """Articles that are not valid (here: in another language) go back to the queue, and none of them is placed."""
    batch, model = articles(t).join(t.documents.select("doc_id", "lang"), "doc_id"), word_model(t)
    start = empty_corpus(t, batch)
    start.main = start.main.withColumn("vec", F.lit(None).cast("array<double>"))
    start.pivots = pivots(t).withColumn("nDocs", F.lit(0).cast("long")).withColumn("URL", F.concat(F.lit("old-"), F.col("partition").cast("string")))
    ok = F.coalesce(F.col("lang") == "en", F.lit(False))
    after, _, messages = newbies.newbies_round(start, batch, model, PROJECTION, batch_size=1, valid=ok)
    wrong = after.main.select("URL").intersect(messages.select("URL")).select(F.lit("placed all the same").alias("tab"), "URL")
    return messages.select(F.lit("queue").alias("tab"), "URL").unionByName(wrong)
