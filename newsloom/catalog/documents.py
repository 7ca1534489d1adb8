"""Document tables: scans, examples, ranges, mutations, counts, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import aggregate as agg, mutate, scan, setops
from ..sources import documents as io
from .base import Tables, query


@query("scan_skip_limit", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 500")
def scan_skip_limit(t: Tables):
    return scan.scan_all(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", skip=500, limit=10)


@query("by_example", "SELECT * FROM part WHERE p_brand = 'Brand#4' AND p_type = 'SMALL'")
def by_example(t: Tables):
    return scan.by_example(t.part, {"p_brand": "Brand#4", "p_type": "SMALL"}, "p_partkey")


@query("first_example", "SELECT * FROM part WHERE p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 1")
def first_example(t: Tables):
    return scan.first_example(t.part, {"p_type": "ECONOMY"}, "p_partkey")


@query("range_closed", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000
ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 10""")
def range_closed(t: Tables):
    return scan.in_range(t.orders, "o_totalprice", 100000.0, 200000.0, "o_orderkey",
                         skip=10, limit=50).select("o_orderkey", "o_totalprice")


@query("range_open", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 100 AND o_custkey < 200""")
def range_open(t: Tables):
    return scan.in_range(t.orders, "o_custkey", 100, 200, "o_orderkey",
                         closed=False).select("o_orderkey", "o_custkey")


@query("lookup_by_keys", """
SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def lookup_by_keys(t: Tables):
    wanted = t.orders.filter("o_totalprice > 400000").select("o_custkey")
    return scan.lookup_by_keys(t.customer, "c_custkey", wanted)


@query("conditional_get", """
WITH req AS (SELECT l_orderkey AS o_orderkey, max(l_linestatus) AS want_rev,
                    max(l_returnflag) <> 'R' AS "match"
             FROM lineitem GROUP BY l_orderkey
             UNION ALL SELECT -1 - n_nationkey, 'O', true FROM nation)
SELECT r.o_orderkey,
       CASE WHEN o.o_orderkey IS NULL THEN 'missing'
            WHEN "match" <> (o.o_orderstatus = want_rev) THEN 'revision_error' ELSE 'ok' END AS status,
       CASE WHEN o.o_orderkey IS NOT NULL AND "match" = (o.o_orderstatus = want_rev)
            THEN o.o_totalprice END AS o_totalprice
FROM req r LEFT JOIN orders o ON o.o_orderkey = r.o_orderkey""")
def conditional_get(t: Tables):
    asked = (t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.max("l_linestatus").alias("want_rev"), (F.max("l_returnflag") != "R").alias("match")))
    unknown = t.nation.select((F.lit(-1).cast("long") - F.col("n_nationkey")).alias("o_orderkey"),
                              F.lit("O").alias("want_rev"), F.lit(True).alias("match"))
    return scan.conditional_get(t.orders, asked.unionByName(unknown), "o_orderkey", "o_orderstatus",
                                ["o_totalprice"])


@query("first_n", "SELECT * FROM events ORDER BY event_id LIMIT 20")
def first_n(t: Tables):
    return scan.first_n(t.events, "event_id", 20)


@query("last_n", "SELECT * FROM events ORDER BY event_id DESC LIMIT 20")
def last_n(t: Tables):
    return scan.last_n(t.events, "event_id", 20)


@query("any_doc", "SELECT * FROM documents ORDER BY md5('7 ' || doc_id), doc_id LIMIT 1")
def any_doc(t: Tables):
    return scan.any_doc(t.documents, "doc_id", seed=7)


@query("project_fields", "SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS author FROM documents")
def project_fields(t: Tables):
    return scan.project(t.documents, ["doc_id", "lang", "author"])


@query("bound_query", """
SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000 GROUP BY o_orderpriority""")
def bound_query(t: Tables):
    t.orders.createOrReplaceTempView("newsloom_orders")
    return scan.run_query(t.spark, """
        SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
        FROM newsloom_orders WHERE o_orderstatus = :status AND o_totalprice > :least
        GROUP BY o_orderpriority""", {"status": "F", "least": 250000.0})


@query("full_count", """
SELECT o_orderkey, o_totalprice, count(*) OVER () AS full_count FROM orders
WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15""")
def full_count(t: Tables):
    hit = t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return scan.with_full_count(hit, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 15)


@query("strip_private", "SELECT page_id, url FROM pages")
def strip_private(t: Tables):
    wide = t.pages.withColumn("__tree", F.col("html")).withColumn("_rev", F.lit("a"))
    return naming.strip_keys(naming.strip_keys(wide), r"^html$|^_", private=False)


@query("union_like", """
SELECT 'customer' AS src, c_custkey AS key, c_name AS name FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def union_like(t: Tables):
    def keyed(df, lead):
        return df.select(F.col(f"{lead}key").alias("key"), F.col(f"{lead[0]}_name").alias("name"), F.lit(1).alias("more"))

    tables = {"customer": keyed(t.customer, "c_cust"), "supplier": keyed(t.supplier, "s_supp").drop("more"), "part": keyed(t.part, "p_part")}
    return scan.union_like(tables, r"customer|supplier", ["key", "name"])


LEVELS_SQL = """logs AS (SELECT event_id AS id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                        WHEN 'view' THEN 4 ELSE 3 END AS level, props AS text FROM events)"""


@query("log_query", f"""
WITH {LEVELS_SQL}
SELECT * FROM logs WHERE level <= 2 AND id >= 100 AND contains(text, '"k": 7') ORDER BY id DESC LIMIT 40 OFFSET 5""")
def log_query(t: Tables):
    level = (F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2)
             .when(F.col("event_type") == "view", 4).otherwise(3))
    logs = t.events.select(F.col("event_id").alias("id"), level.alias("level"), F.col("props").alias("text"))
    return scan.log_query(logs, upto="warning", start=100, size=40, offset=5, search='"k": 7', sort="desc")


@query("cleanup_flagged", """
SELECT 'newsStats' AS "table", count(*) FILTER (event_type = 'signup') AS removed,
       count(*) FILTER (event_type <> 'signup') AS kept FROM events""")
def cleanup_flagged(t: Tables):
    stats = t.events.withColumn("_flag", F.when(F.col("event_type") == "signup", "test"))
    kept, report = scan.cleanup_flagged({"newsStats": stats})
    left = kept["newsStats"].agg(F.lit("newsStats").alias("table"), F.count(F.lit(1)).alias("kept"))
    return report.join(left, "table")


@query("import_summary", """
WITH rows AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events),
     ranked AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY event_id) AS rn FROM rows)
SELECT count(*) FILTER (rn = 1) AS created, count(*) FILTER (rn > 1) AS errors FROM ranked""")
def import_summary(t: Tables):
    """Documents keyed by the JSON property; only the first of a key is created."""
    lines = t.events.select("event_id", F.concat(
        F.lit('{"_key": "'), F.get_json_object("props", "$.k"), F.lit('"}')).alias("line"))
    return io.import_lines(lines, "line", "event_id", "_key string").summary()


@query("export_restricted", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def export_restricted(t: Tables):
    return io.export_documents(t.customer, exclude=["c_nationkey", "c_mktsegment"])


@query("insert_docs", """
SELECT c_custkey, c_name, c_nationkey FROM customer
UNION ALL SELECT c_custkey + 1000, 'new ' || c_name, c_nationkey FROM customer WHERE c_custkey + 1000 NOT IN (SELECT c_custkey FROM customer)""")
def insert_docs(t: Tables):
    """New documents, some of them under keys that are taken."""
    table = t.customer.select("c_custkey", "c_name", "c_nationkey")
    docs = table.select((F.col("c_custkey") + 1000).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), "c_nationkey")
    return mutate.insert_docs(table, docs, "c_custkey")[0]


@query("import_conflicts", """
WITH l AS (SELECT o_orderkey, o_custkey AS k, o_orderkey % 50 = 7 AS bad FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY k, bad ORDER BY o_orderkey) AS rn FROM l),
j AS (SELECT CASE WHEN bad THEN 'key is not a string' WHEN rn > 1 THEN 'duplicate key' WHEN c_custkey IS NOT NULL THEN 'key is stored' ELSE 'created' END AS outcome
  FROM f LEFT JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) ON c_custkey = k)
SELECT outcome, count(*) AS n FROM j GROUP BY 1 UNION ALL SELECT 'created, all or nothing', 0""")
def import_conflicts(t: Tables):
    """Into a table that holds some of the keys; once as far as it goes and once all or nothing."""
    key = F.concat(F.lit('"c'), F.col("o_custkey").cast("string"), F.lit('"'))
    key = F.when(F.col("o_orderkey") % 50 == 7, F.lit("17")).otherwise(key)
    lines = t.orders.select("o_orderkey", F.concat(F.lit('{"_key": '), key, F.lit("}")).alias("line"))
    stored = t.customer.filter("c_nationkey < 10").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("_key"))
    done = io.import_lines(lines, "line", "o_orderkey", "_key string", stored=stored)
    strict = io.import_lines(lines, "line", "o_orderkey", "_key string", stored=stored, complete=True)
    rows = [done.rejected.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n")),
            done.documents().agg(F.lit("created").alias("outcome"), F.count(F.lit(1)).alias("n")),
            strict.documents().agg(F.lit("created, all or nothing").alias("outcome"), F.count(F.lit(1)).alias("n"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# Changes to orders come from the line items: an order with returned lines gets
# a patch whose wanted revision is the line status.
CHANGES_SQL = """chg AS (SELECT l_orderkey AS o_orderkey, max(l_linestatus) AS want_rev,
    round(sum(l_extendedprice), 2) AS price, max(l_shipmode_) AS prio, count(*) AS n
    FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_orderkey)"""


def order_changes(t: Tables):
    return (t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.max("l_linestatus").alias("want_rev"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
                 F.max("l_returnflag").alias("prio"), F.count(F.lit(1)).alias("n")))


@query("update_docs", f"""
WITH {CHANGES_SQL}
SELECT o.o_orderkey, o.o_orderstatus,
  CASE WHEN want_rev = o.o_orderstatus AND n > 1 THEN price ELSE o.o_totalprice END AS o_totalprice,
  CASE WHEN want_rev = o.o_orderstatus AND n = 1 THEN NULL ELSE o.o_orderpriority END AS o_orderpriority
FROM orders o LEFT JOIN chg USING (o_orderkey)""")
def update_docs(t: Tables):
    patches = order_changes(t).select(
        "o_orderkey", "want_rev", F.when(F.col("n") > 1, F.col("price")).alias("o_totalprice"),
        F.when(F.col("n") == 1, F.array(F.lit("o_orderpriority"))).alias("unset"))
    table = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return mutate.update_docs(table, patches, "o_orderkey", rev="o_orderstatus")[0]


@query("replace_docs", f"""
WITH {CHANGES_SQL}
SELECT o.o_orderkey, o.o_orderstatus,
  CASE WHEN want_rev = o.o_orderstatus THEN price ELSE o.o_totalprice END AS o_totalprice,
  CASE WHEN want_rev = o.o_orderstatus THEN NULL ELSE o.o_orderpriority END AS o_orderpriority
FROM orders o LEFT JOIN chg USING (o_orderkey)""")
def replace_docs(t: Tables):
    docs = order_changes(t).select("o_orderkey", "want_rev", F.col("price").alias("o_totalprice"))
    table = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return mutate.replace_docs(table, docs, "o_orderkey", rev="o_orderstatus")[0]


@query("delete_docs", f"""
WITH {CHANGES_SQL}
SELECT o.o_orderkey, o.o_orderstatus FROM orders o LEFT JOIN chg USING (o_orderkey)
WHERE want_rev IS NULL OR want_rev <> o.o_orderstatus""")
def delete_docs(t: Tables):
    requests = order_changes(t).select("o_orderkey", "want_rev")
    return mutate.delete_docs(t.orders.select("o_orderkey", "o_orderstatus"), requests, "o_orderkey",
                              rev="o_orderstatus")[0]


@query("revision_errors", f"""
WITH {CHANGES_SQL}
SELECT chg.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'missing' ELSE 'revision_error' END AS reason
FROM chg LEFT JOIN orders o USING (o_orderkey)
WHERE o.o_orderkey IS NULL OR want_rev <> o.o_orderstatus""")
def revision_errors(t: Tables):
    requests = order_changes(t).select("o_orderkey", "want_rev")
    return mutate.delete_docs(t.orders, requests, "o_orderkey", rev="o_orderstatus")[1]


@query("update_by_example", """
SELECT p_partkey, p_type, CASE WHEN p_type = 'ECONOMY' THEN 99 ELSE p_size END AS p_size FROM part""")
def update_by_example(t: Tables):
    return mutate.update_by_example(t.part.select("p_partkey", "p_type", "p_size"),
                                    {"p_type": "ECONOMY"}, {"p_size": 99}, "p_partkey")[0]


@query("update_by_example_limited", """
SELECT count(*) AS n FROM (SELECT p_partkey FROM part WHERE p_type = 'SMALL' ORDER BY p_partkey LIMIT 30)""")
def update_by_example_limited(t: Tables):
    return mutate.update_by_example(t.part, {"p_type": "SMALL"}, {"p_size": 1}, "p_partkey", limit=30)[1]


@query("replace_by_example", """
SELECT p_partkey, CASE WHEN hit THEN NULL ELSE p_name END AS p_name,
       CASE WHEN hit THEN 'Brand#0' ELSE p_brand END AS p_brand
FROM (SELECT *, p_brand = 'Brand#4' AND p_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#4'
      ORDER BY p_partkey LIMIT 10) AS hit FROM part)""")
def replace_by_example(t: Tables):
    return mutate.replace_by_example(t.part.select("p_partkey", "p_name", "p_brand"), {"p_brand": "Brand#4"},
                                     {"p_brand": "Brand#0"}, "p_partkey", limit=10)[0]


@query("remove_by_example", "SELECT * FROM part WHERE NOT (p_brand = 'Brand#4' AND p_size = 7)")
def remove_by_example(t: Tables):
    return mutate.remove_by_example(t.part, {"p_brand": "Brand#4", "p_size": 7}, "p_partkey")[0]


@query("remove_by_keys", """
WITH k AS (SELECT DISTINCT o_custkey + 500 AS k FROM orders)
SELECT count(c_custkey) AS removed, count(*) FILTER (c_custkey IS NULL) AS ignored
FROM k LEFT JOIN customer ON c_custkey = k""")
def remove_by_keys(t: Tables):
    keys = t.orders.select((F.col("o_custkey") + 500).alias("k"))
    return mutate.remove_by_keys(t.customer, "c_custkey", keys)[1]


@query("apply_batch", """
WITH ops AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq, l_orderkey AS okey,
    CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'delete' ELSE 'create' END
                      WHEN 'A' THEN 'replace' ELSE 'update' END AS op,
    l_linenumber AS line, CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem),
p AS (SELECT *, coalesce(last_value(CASE WHEN op IN ('create', 'delete') THEN op END IGNORE NULLS) OVER w = 'create',
        okey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS present
      FROM ops WINDOW w AS (PARTITION BY okey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT * FROM p WHERE present = (op <> 'create')),
f AS (SELECT okey, max(seq) FILTER (op <> 'update') AS reset,
        coalesce(arg_max(op, seq) FILTER (op IN ('create', 'delete')), '') = 'delete' AS dead FROM v GROUP BY okey),
a AS (SELECT o_orderkey AS okey, CAST(-1 AS BIGINT) AS seq, 'status' AS attr, o_orderstatus AS val
        FROM orders WHERE o_orderstatus <> 'P'
      UNION ALL SELECT okey, seq, 'line', CAST(line AS VARCHAR) FROM v WHERE op <> 'delete'
      UNION ALL SELECT okey, seq, 'qty' || CAST(line AS VARCHAR), CAST(qty AS VARCHAR) FROM v WHERE op <> 'delete')
SELECT a.okey, a.attr, arg_max(a.val, a.seq) AS val FROM a LEFT JOIN f USING (okey)
WHERE NOT coalesce(dead, false) AND (reset IS NULL OR a.seq >= reset) GROUP BY a.okey, a.attr""")
def apply_batch(t: Tables):
    table = (t.orders.filter("o_orderstatus <> 'P'")
             .select(F.col("o_orderkey").alias("okey"), F.create_map(F.lit("status"), "o_orderstatus").alias("body")))
    # the sequence only has to order the operations of one key
    ops = t.lineitem.select(
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.col("l_orderkey").alias("okey"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "delete").otherwise("create"))
        .when(F.col("l_returnflag") == "A", "replace").otherwise("update").alias("op"),
        F.create_map(F.lit("line"), F.col("l_linenumber").cast("string"),
                     F.concat(F.lit("qty"), F.col("l_linenumber").cast("string")),
                     F.col("l_quantity").cast("long").cast("string")).alias("body"))
    state = mutate.apply_batch(table, ops, "okey")[0]
    return state.select("okey", F.explode("body").alias("attr", "val"))


@query("cap_newest", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 500")
def cap_newest(t: Tables):
    return mutate.cap_newest(t.events.select("event_id", "user_id"), "event_id", 500)


@query("cap_bytes", """
SELECT event_id, total FROM (SELECT event_id, CAST(sum(length(props) + length(event_type)) OVER
  (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events) WHERE total <= 40000""")
def cap_bytes(t: Tables):
    size = (F.length("props") + F.length("event_type")).cast("long")
    return (mutate.running_total(t.events, "event_id", size, width=4096)
            .filter(F.col("__total") <= 40000).select("event_id", F.col("__total").alias("total")))


@query("unique_violations", """
SELECT l_suppkey, l_partkey, count(*) AS n_docs FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def unique_violations(t: Tables):
    return mutate.unique_violations(t.lineitem, ["l_suppkey", "l_partkey"])


@query("count_docs", "SELECT count(*) AS n FROM documents")
def count_docs(t: Tables):
    return agg.count_docs(t.documents)


@query("table_stats", """
SELECT count(*) AS alive, (count(*) - count(*) % 100000) / 1000000.0::DOUBLE AS millions,
  count(doc_id) AS n_doc_id, count(text) AS n_text, count(lang) AS n_lang, count(source) AS n_source,
  count(n_chars) AS n_n_chars, CAST(sum(strlen(text)) + sum(strlen(source)) AS BIGINT) AS text_bytes FROM documents""")
def table_stats(t: Tables):
    return agg.table_stats(t.documents, ["text", "source"])


@query("table_checksum", """
SELECT count(*) AS n, CAST(sum(('0x' || substr(md5(
  length(o_orderkey::VARCHAR) || ':' || o_orderkey || length(o_orderpriority) || ':' || o_orderpriority || length(o_custkey::VARCHAR) || ':' || o_custkey), 1, 8))::BIGINT)
  % 4294967296 AS BIGINT) AS checksum FROM orders""")
def table_checksum(t: Tables):
    return agg.table_checksum(t.orders, ["o_orderkey", "o_orderpriority", "o_custkey"])


@query("union_keys", "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_keys(t: Tables):
    return setops.union_keys(t.customer.select(F.col("c_nationkey").alias("nationkey")),
                             t.supplier.select("s_nationkey"))


@query("subtract_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def subtract_keys(t: Tables):
    return setops.subtract_keys(t.customer.select("c_custkey"), t.orders.select("o_custkey"))


@query("rename_case", """
SELECT c_custkey AS "cCustkey", c_name AS "cName", c_nationkey AS "cNationkey", c_acctbal AS "cAcctbal",
       c_mktsegment AS "cMktsegment" FROM customer""")
def rename_case(t: Tables):
    return naming.rename_camel(naming.rename_snake(naming.rename_camel(t.customer)))


@query("registered_function", """
SELECT event_id, round(value * 1.8 + 32, 6) AS fahrenheit FROM events""")
def registered_function(t: Tables):
    from ..functions.registry import FunctionRegistry

    functions = FunctionRegistry(t.spark)
    functions.register("temperature::celsius_to_fahrenheit", "celsius DOUBLE", "DOUBLE", "celsius * 1.8 + 32")
    t.events.createOrReplaceTempView("newsloom_events")
    return t.spark.sql("SELECT event_id, round(temperature__celsius_to_fahrenheit(value), 6) AS fahrenheit "
                       "FROM newsloom_events")
