"""Text and date functions over documents, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from . import sql
from .base import Tables, query

CLEAN_SQL = f"c AS MATERIALIZED (SELECT doc_id, {sql.clean('text')} AS body FROM documents)"
TOKENS_SQL = f"{CLEAN_SQL}, k AS MATERIALIZED (SELECT doc_id, {sql.tokenise('body')} AS tokens FROM c)"
SENTENCES_SQL = f"{TOKENS_SQL}, s AS MATERIALIZED (SELECT doc_id, {sql.sentences('tokens')} AS sentences FROM k)"


@query("clean_text", f"WITH {CLEAN_SQL} SELECT doc_id, body FROM c")
def clean_text(t: Tables):
    return t.documents.select("doc_id", text.clean_text(F.col("text")).alias("body"))


@query("tokenise_text", f"WITH {TOKENS_SQL} SELECT doc_id, tokens FROM k")
def tokenise_text(t: Tables):
    return t.documents.select("doc_id", text.tokenise_text(text.clean_text(F.col("text"))).alias("tokens"))


@query("split_sentences", f"""WITH {SENTENCES_SQL}
SELECT doc_id, i::INT AS pos, sentences[i + 1] AS sentence FROM s, unnest(generate_series(0, len(sentences) - 1)) AS u(i)""")
def split_sentences(t: Tables):
    s = t.documents.select("doc_id", text.split_sentences(text.clean_text(F.col("text"))).alias("s"))
    return s.select("doc_id", F.posexplode_outer("s").alias("pos", "sentence"))


@query("content_length", f"""WITH {SENTENCES_SQL}
SELECT doc_id, len(sentences) AS n_sentences, CAST(list_sum(list_transform(sentences, lambda x: length(x))) AS BIGINT) AS content_length FROM s""")
def content_length(t: Tables):
    s = t.documents.select("doc_id", text.split_sentences(text.clean_text(F.col("text"))).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), text.content_length(F.col("s")).alias("content_length"))


FORMATS = {"1-URGENT": ("dd-MM-yyyy", "%d-%m-%Y"), "2-HIGH": ("dd/MM/yyyy", "%d/%m/%Y"),
           "3-MEDIUM": ("yyyy-MM-dd", "%Y-%m-%d"), "4-NOT SPECIFIED": ("yyyyMMdd", "%Y%m%d")}
STATED_SQL = ("o AS (SELECT o_orderkey, 'on ' || CASE o_orderpriority "
              + " ".join(f"WHEN '{p}' THEN strftime(o_orderdate, '{d}')" for p, (_, d) in FORMATS.items())
              + " ELSE CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%-d %B, %Y') "
              "WHEN 'O' THEN strftime(o_orderdate, '%b %-d %Y') ELSE strftime(o_orderdate, '%Y/%m/%d') END END "
              "|| CASE WHEN o_totalprice > 400000 THEN ' 31-02-2001' ELSE '' END AS stated, o_orderdate, o_totalprice FROM orders)")


def stated_dates(t: Tables):
    d = F.col("o_orderdate")
    shown = (F.when(F.col("o_orderstatus") == "F", F.date_format(d, "d MMMM, yyyy"))
             .when(F.col("o_orderstatus") == "O", F.date_format(d, "MMM d yyyy"))
             .otherwise(F.date_format(d, "yyyy/MM/dd")))
    for priority, (fmt, _) in FORMATS.items():
        shown = F.when(F.col("o_orderpriority") == priority, F.date_format(d, fmt)).otherwise(shown)
    wrong = F.when(F.col("o_totalprice") > 400000, " 31-02-2001").otherwise("")
    return t.orders.select("o_orderkey", "o_totalprice", "o_orderdate", F.concat(F.lit("on "), shown, wrong).alias("stated"))


@query("recognise_date", f"WITH {STATED_SQL} SELECT o_orderkey, CAST({sql.date('stated')} AS VARCHAR) AS found FROM o")
def recognise_date(t: Tables):
    return stated_dates(t).select("o_orderkey", dates.recognise_date(F.col("stated")).cast("string").alias("found"))


@query("time_to_sec", """SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sec FROM events""")
def time_to_sec(t: Tables):
    shown = F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC 10:00:00"))
    return t.events.select("event_id", dates.time_to_sec(shown).alias("sec"))


PATHS_SQL = """u AS (SELECT o_orderkey, o_orderdate, 'http://www.example.com/' || CASE o_orderstatus
  WHEN 'F' THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 'O' THEN strftime(o_orderdate, '%Y/%b/%d')
  ELSE 'news/' || strftime(o_orderdate, '%d/%B/%Y') || '/99' END || '/story-' || o_orderkey AS url FROM orders)"""


def dated_urls(t: Tables):
    d = F.col("o_orderdate")
    path = (F.when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyy/MM/dd"))
            .when(F.col("o_orderstatus") == "O", F.date_format(d, "yyyy/MMM/dd"))
            .otherwise(F.concat(F.lit("news/"), F.date_format(d, "dd/MMMM/yyyy"), F.lit("/99"))))
    return t.orders.withColumn("url", F.concat(F.lit("http://www.example.com/"), path, F.lit("/story-"),
                                               F.col("o_orderkey").cast("string")))


@query("url_date", f"""WITH {PATHS_SQL}
SELECT 'o' || o_orderkey AS id, CAST({sql.url_date('url')} AS VARCHAR) AS found FROM u
UNION ALL SELECT 'p' || page_id, CAST({sql.url_date('url')} AS VARCHAR) FROM pages""")
def url_date(t: Tables):
    orders = dated_urls(t).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), "url")
    pages = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url")
    return orders.unionByName(pages).select("id", dates.url_date(F.col("url")).cast("string").alias("found"))


@query("min_window_distance", """
WITH s AS (SELECT p_partkey, CASE WHEN length(p_name) < length(o) THEN p_name ELSE o END AS a,
    CASE WHEN length(p_name) < length(o) THEN o ELSE p_name END AS b
  FROM (SELECT *, 'a ' || lower(p_type) || ' ' || p_brand || ' blt' AS o FROM part)),
d AS (SELECT p_partkey, k, levenshtein(a, b[k + 1:k + length(a)]) / length(a)::DOUBLE AS d
  FROM s, unnest(generate_series(0, length(b) - length(a))) AS u(k)),
m AS (SELECT *, coalesce(min(d) OVER w, 1.0) AS best FROM d
  WINDOW w AS (PARTITION BY p_partkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT p_partkey, min(k) AS stop FROM m WHERE best < 0.5 AND d > best AND d - best > 0.1 GROUP BY 1)
SELECT p_partkey, round(min(d), 6) AS distance, CAST(arg_min(k, (d, -k)) AS INT) AS pos
FROM m LEFT JOIN e USING (p_partkey) WHERE stop IS NULL OR k < stop GROUP BY 1""")
def min_window_distance(t: Tables):
    other = F.concat(F.lit("a "), F.lower("p_type"), F.lit(" "), F.col("p_brand"), F.lit(" blt"))
    found = t.part.select("p_partkey", text.min_window_distance(F.col("p_name"), other).alias("m"))
    return found.select("p_partkey", F.round("m.distance", 6).alias("distance"), F.col("m.offset").alias("pos"))


@query("sample_content", """
SELECT conv_id, turn, coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
  lambda x: regexp_matches(x, '[^.]\\.$')), ' '), '') AS sample FROM conversations""")
def sample_content(t: Tables):
    return t.conversations.select("conv_id", "turn", text.sample_content(F.split("text", "\n", -1)).alias("sample"))
