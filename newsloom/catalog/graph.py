"""Geo and fulltext search, property graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fulltext as ft, geo, graph, mutate
from ..session import scratch_path
from .base import Tables, query
from .pages import LINKS_SQL, page_links_table, unescaped

COORDS_SQL = """c AS (SELECT vec_id, 90 * CAST(embedding[1] AS DOUBLE) AS lat, 180 * CAST(embedding[2] AS DOUBLE) AS lon FROM embeddings),
g AS (SELECT vec_id, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(10.0) - radians(lat)) / 2), 2)
  + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(5.0 - lon) / 2), 2)))) AS d FROM c)"""


def places(t: Tables):
    return t.embeddings.select("vec_id", (90 * F.get("embedding", 0).cast("double")).alias("lat"),
                               (180 * F.get("embedding", 1).cast("double")).alias("lon"))


@query("geo_near", f"WITH {COORDS_SQL} SELECT vec_id, round(d, 3) AS metres FROM g ORDER BY d, vec_id LIMIT 100")
def geo_near(t: Tables):
    found = geo.near(places(t), "lat", "lon", 10.0, 5.0, "vec_id", distance_col="d")
    return found.select("vec_id", F.round("d", 3).alias("metres"))


@query("geo_within", f"WITH {COORDS_SQL} SELECT vec_id, round(d, 3) AS metres FROM g WHERE d <= 1500000")
def geo_within(t: Tables):
    found = geo.within(places(t), "lat", "lon", 10.0, 5.0, 1500000.0, "vec_id", distance_col="d")
    return found.select("vec_id", F.round("d", 3).alias("metres"))


WORDS_SQL = r"w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)"


def word_index(t: Tables) -> str:
    path = scratch_path(t.spark, "word-index")
    ft.write_index(t.documents, "text", "doc_id", path)
    return path


@query("fulltext_not", f"""WITH {WORDS_SQL} SELECT doc_id FROM w
WHERE NOT list_contains(w, 'the') AND NOT list_contains(w, 'que') OR len(list_filter(w, lambda x: starts_with(x, 'therou'))) > 0""")
def fulltext_not(t: Tables):
    return ft.search_index(t.spark, word_index(t), "-the,-que,|prefix:therou")


@query("fulltext_or", f"""WITH {WORDS_SQL} SELECT doc_id FROM w WHERE list_contains(w, 'the') OR list_contains(w, 'que')""")
def fulltext_or(t: Tables):
    return ft.search_index(t.spark, word_index(t), "the,|que")


@query("fulltext_prefix", f"""WITH {WORDS_SQL} SELECT doc_id FROM w
WHERE len(list_filter(w, lambda x: starts_with(x, 'eau'))) > 0 AND NOT list_contains(w, 'the') AND list_contains(w, 'de')""")
def fulltext_prefix(t: Tables):
    return ft.search_index(t.spark, word_index(t), "prefix:eau,-the,de")


@query("inverted_index", f"""WITH {WORDS_SQL}
SELECT x AS word, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(w) AS x FROM w) WHERE length(x) >= 5 GROUP BY 1""")
def inverted_index(t: Tables):
    return ft.index_terms(ft.postings(t.documents, "text", "doc_id", 5))


@query("postings_search", f"""WITH {WORDS_SQL} SELECT doc_id FROM w WHERE list_contains(w, 'from') AND list_contains(w, 'with')""")
def postings_search(t: Tables):
    """The index is written, and read back one word folder at a time."""
    path = scratch_path(t.spark, "postings")
    ft.write_postings(ft.postings(t.documents, "text", "doc_id", 4), path)
    return ft.search_postings(t.spark.read.parquet(path), ["From", "with"], "doc_id")


EDGES_SQL = """e AS MATERIALIZED (SELECT 'rn' || n_nationkey AS _key, 'region/' || n_regionkey AS _from, 'nation/' || n_nationkey AS _to FROM nation
UNION ALL SELECT 'nc' || c_custkey, 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
UNION ALL SELECT 'co' || o_orderkey, 'customer/' || o_custkey, 'orders/' || o_orderkey FROM orders)"""


def name(collection: str, column: str):
    return F.concat(F.lit(collection), F.col(column).cast("string"))


def edges(t: Tables):
    def part(df, tag, key, src, src_col, dst, dst_col):
        return df.select(name(tag, key).alias("_key"), name(src, src_col).alias("_from"), name(dst, dst_col).alias("_to"))

    return (part(t.nation, "rn", "n_nationkey", "region/", "n_regionkey", "nation/", "n_nationkey")
            .unionByName(part(t.customer, "nc", "c_custkey", "nation/", "c_nationkey", "customer/", "c_custkey"))
            .unionByName(part(t.orders, "co", "o_orderkey", "customer/", "o_custkey", "orders/", "o_orderkey")))


def vertices(t: Tables):
    return (t.nation.select(name("nation/", "n_nationkey").alias("_id"), F.lit(None).cast("double").alias("value"))
            .unionByName(t.region.select(name("region/", "r_regionkey").alias("_id"), F.lit(None).cast("double").alias("value")))
            .unionByName(t.customer.select(name("customer/", "c_custkey").alias("_id"), F.col("c_acctbal").alias("value")))
            .unionByName(t.orders.select(name("orders/", "o_orderkey").alias("_id"), F.col("o_totalprice").alias("value"))))


def definitions(t: Tables):
    """One edge definition per foreign key the nations and regions take part in."""
    return t.region.filter("r_regionkey = 0").select(
        F.lit("fk").alias("edge_coll"), F.array(F.lit("region"), F.lit("nation")).alias("from_colls"),
        F.array(F.lit("nation"), F.lit("customer"), F.lit("orders")).alias("to_colls"))


@query("invalid_edges", f"""WITH {EDGES_SQL}, x AS (SELECT _key, CASE WHEN _key LIKE 'rn%' AND _to = 'nation/3' THEN NULL ELSE _from END AS _from, _to FROM e)
SELECT _key, CASE WHEN _from IS NULL THEN 'missing end' ELSE 'from not allowed' END AS reason FROM x
WHERE _from IS NULL OR split_part(_from, '/', 1) = 'customer'""")
def invalid_edges(t: Tables):
    broken = edges(t).withColumn("_from", F.when(~(F.startswith("_key", F.lit("rn")) & (F.col("_to") == "nation/3")), F.col("_from")))
    return graph.invalid_edges(broken, definitions(t), "fk").select("_key", "reason")


@query("graph_vertex_collections", """SELECT unnest(['region', 'nation', 'customer', 'orders']) AS collection, false AS orphan
UNION ALL SELECT DISTINCT event_type, true FROM events""")
def graph_vertex_collections(t: Tables):
    orphans = t.events.select(F.col("event_type").alias("collection")).union(t.nation.select(F.lit("nation")))
    return graph.vertex_collections(definitions(t), orphans)


@query("edge_update", f"""WITH {EDGES_SQL} SELECT _key, _from, _to, CASE WHEN _key LIKE 'co%' AND o_totalprice > 300000 THEN o_totalprice END AS weight
FROM e LEFT JOIN orders ON _key = 'co' || o_orderkey""")
def edge_update(t: Tables):
    """A patch that also tries to move the edges: their ends stay."""
    table = edges(t).withColumn("weight", F.lit(None).cast("double"))
    patch = t.orders.filter("o_totalprice > 300000").select(
        name("co", "o_orderkey").alias("_key"), F.lit("nation/0").alias("_from"), F.lit("nation/0").alias("_to"),
        F.col("o_totalprice").alias("weight"))
    return mutate.update_docs(table, patch, "_key", protected=["_from", "_to"])[0]


@query("vertex_update", """SELECT 'customer/' || c_custkey AS _id, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS value,
  CASE WHEN c_acctbal < 0 THEN 'in debt' END AS note FROM customer""")
def vertex_update(t: Tables):
    table = t.customer.select(name("customer/", "c_custkey").alias("_id"), F.col("c_acctbal").alias("value"), F.lit(None).cast("string").alias("note"))
    patch = table.filter("value < 0").select("_id", F.lit(0.0).alias("value"), F.lit("in debt").alias("note"))
    return mutate.update_docs(table, patch, "_id")[0]


@query("edge_insert", f"""WITH {EDGES_SQL} SELECT * FROM e UNION ALL SELECT 'sn' || s_suppkey, 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier""")
def edge_insert(t: Tables):
    """Edges of suppliers, and some under keys that are taken already."""
    fresh = t.supplier.select(name("sn", "s_suppkey").alias("_key"), name("supplier/", "s_suppkey").alias("_from"), name("nation/", "s_nationkey").alias("_to"))
    again = t.customer.select(name("nc", "c_custkey").alias("_key"), F.lit("nation/0").alias("_from"), F.lit("nation/0").alias("_to"))
    return mutate.insert_docs(edges(t), fresh.unionByName(again), "_key")[0].select("_key", "_from", "_to")


@query("vertex_remove", f"""WITH {EDGES_SQL}, g AS (SELECT 'customer/' || c_custkey AS id FROM customer WHERE c_acctbal < 0),
v AS (SELECT 'nation/' || n_nationkey AS id FROM nation UNION ALL SELECT 'region/' || r_regionkey FROM region
  UNION ALL SELECT 'customer/' || c_custkey FROM customer UNION ALL SELECT 'orders/' || o_orderkey FROM orders)
SELECT 'vertex' AS kind, id FROM v WHERE id NOT IN (SELECT id FROM g)
UNION ALL SELECT 'edge', _key FROM e WHERE _from NOT IN (SELECT id FROM g) AND _to NOT IN (SELECT id FROM g)""")
def vertex_remove(t: Tables):
    """Customers in debt go, and with them the edges from their nations and to their orders."""
    gone = t.customer.filter("c_acctbal < 0").select(name("customer/", "c_custkey").alias("_id"))
    v, e = graph.remove_vertices(vertices(t), edges(t), gone)
    return v.select(F.lit("vertex").alias("kind"), F.col("_id").alias("id")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("_key").alias("id")))


WALK_SQL = f"""RECURSIVE {EDGES_SQL}, s AS (SELECT 'region/' || r_regionkey AS id FROM region),
walk AS (SELECT id AS start, id AS vertex, 0 AS depth, [id] AS path FROM s
  UNION ALL SELECT start, _to, depth + 1, list_append(path, _to) FROM walk JOIN e ON _from = vertex WHERE depth < 3)"""


@query("traverse_outbound", f"""WITH {WALK_SQL}
SELECT start, vertex, depth, array_to_string(path, '>') AS path FROM walk""")
def traverse_outbound(t: Tables):
    starts = t.region.select(name("region/", "r_regionkey").alias("_id"))
    walked = graph.traverse(starts, edges(t), max_depth=3)
    return walked.select("start", "vertex", "depth", F.array_join("path", ">").alias("path"))


@query("traverse_inbound", """
SELECT 'orders/' || o_orderkey AS start, 'region/' || n_regionkey AS vertex, 3 AS depth FROM orders
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'orders/' || o_orderkey, 'nation/' || c_nationkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey""")
def traverse_inbound(t: Tables):
    starts = t.orders.select(name("orders/", "o_orderkey").alias("_id"))
    return graph.traverse(starts, edges(t), "inbound", min_depth=2, max_depth=3).select("start", "vertex", "depth")


@query("traverse_any", """WITH v AS (SELECT 'region/' || r_regionkey AS id, r_regionkey AS region FROM region
UNION ALL SELECT 'nation/' || n_nationkey, n_regionkey FROM nation)
SELECT a.id AS start, b.id AS vertex, CASE WHEN a.id = b.id THEN 0 WHEN a.id LIKE 'region%' OR b.id LIKE 'region%' THEN 1 ELSE 2 END AS depth
FROM v a JOIN v b USING (region)""")
def traverse_any(t: Tables):
    """Every vertex reachable over region-nation edges in either direction, once per start."""
    starts = vertices(t).filter(F.col("_id").rlike("^(region|nation)/")).select("_id")
    walked = graph.traverse(starts, edges(t), "any", unique_vertices="global", unique_edges="none",
                            edge_filter=F.startswith("_key", F.lit("rn")))
    return walked.select("start", "vertex", "depth")


@query("traverse_order", f"""WITH {WALK_SQL.replace('depth < 3', 'depth < 2')}
SELECT start, vertex, CAST(row_number() OVER (PARTITION BY start ORDER BY path) AS INT) AS preorder,
  CAST(row_number() OVER (PARTITION BY start ORDER BY list_append(path, chr(1114111))) AS INT) AS postorder,
  CAST(row_number() OVER (PARTITION BY start ORDER BY depth, path) AS INT) AS breadth FROM walk""")
def traverse_order(t: Tables):
    starts = t.region.select(name("region/", "r_regionkey").alias("_id"))
    walked = graph.traverse(starts, edges(t), max_depth=2)
    walked = graph.visited(graph.visited(walked, "preorder"), "postorder", order="postorder")
    walked = graph.visited(walked, "breadth", strategy="breadthfirst")
    return walked.select("start", "vertex", *[F.col(c).cast("int") for c in ("preorder", "postorder", "breadth")])


# orders of a nation's customers, dearest first; customers by what they own
SORTED_SQL = f"""RECURSIVE {EDGES_SQL}, vs AS (SELECT 'customer/' || c_custkey AS id, c_acctbal AS value FROM customer
  UNION ALL SELECT 'orders/' || o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'nation/' || n_nationkey, NULL FROM nation),
vr AS MATERIALIZED (SELECT id, value, lpad(CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, id) AS VARCHAR), 9, '0') AS place FROM vs),
walk AS (SELECT id AS start, id AS vertex, 0 AS depth, [place] AS keys FROM vr WHERE id LIKE 'nation/%'
  UNION ALL SELECT start, _to, depth + 1, list_append(keys, place) FROM walk JOIN e ON _from = vertex JOIN vr ON vr.id = _to WHERE depth < 2)"""


@query("traverse_sorted", f"""WITH {SORTED_SQL}
SELECT start, vertex, row_number() OVER (PARTITION BY start ORDER BY keys) AS preorder,
  row_number() OVER (PARTITION BY start ORDER BY list_append(keys, 'x') DESC) AS backward FROM walk""")
def traverse_sorted(t: Tables):
    """Siblings by value; also the post-order walked backward."""
    starts = t.nation.select(name("nation/", "n_nationkey").alias("_id"))
    walked = graph.traverse(starts, edges(t), max_depth=2, vertices=vertices(t), siblings=[F.col("value").desc_nulls_last()])
    walked = graph.visited(graph.visited(walked, "preorder"), "backward", order="postorder", backward=True)
    return walked.select("start", "vertex", "preorder", "backward")


@query("traverse_folded", f"""WITH {EDGES_SQL}, o AS (SELECT o_custkey AS c, count(*) AS n, sum(o_totalprice) AS total, max(o_totalprice) AS top FROM orders GROUP BY 1),
c AS (SELECT c_nationkey AS nat, c_custkey AS cust, 1 + coalesce(n, 0) AS n, c_acctbal + coalesce(total, 0) AS total,
  greatest(c_acctbal, coalesce(top, c_acctbal)) AS top, CASE WHEN n IS NULL THEN 1 ELSE 2 END AS height FROM customer LEFT JOIN o ON c = c_custkey),
n AS (SELECT n_regionkey AS reg, n_nationkey AS nat, 1 + coalesce(sum(c.n), 0) AS n, sum(total) AS total, max(top) AS top, 1 + coalesce(max(height), 0) AS height
  FROM nation LEFT JOIN c ON c.nat = n_nationkey GROUP BY 1, 2)
SELECT vertex, CAST(n AS BIGINT) AS n_below, round(total, 2) AS total, top, CAST(height AS BIGINT) AS height FROM (
  SELECT 'customer/' || cust AS vertex, n, total, top, height FROM c UNION ALL SELECT 'nation/' || nat, n, total, top, height FROM n
  UNION ALL SELECT 'region/' || r_regionkey, 1 + coalesce(sum(n.n), 0), sum(total), max(top), 1 + coalesce(max(height), 0) FROM region LEFT JOIN n ON reg = r_regionkey GROUP BY 1)""")
def traverse_folded(t: Tables):
    """Visits below every vertex, the sum and the largest of their values, and how deep it goes."""
    starts = t.region.select(name("region/", "r_regionkey").alias("_id"))
    value = F.col("value")
    deeper = lambda own, kids: F.coalesce(own + kids, own, kids)
    one = F.lit(1).cast("long")
    found = graph.fold(graph.traverse(starts, edges(t), max_depth=3), vertices(t), {
        "n_below": graph.Fold(one, F.sum, deeper), "total": graph.Fold(value, F.sum, deeper),
        "top": graph.Fold(value, F.max, F.greatest), "height": graph.Fold(one, F.max, deeper)})
    found = found.filter(~F.startswith("vertex", F.lit("orders/")))
    return found.select("vertex", "n_below", F.round("total", 2).alias("total"), "top", "height")


@query("traverse_filtered", f"""WITH {EDGES_SQL} SELECT 'nation/' || c_nationkey AS start, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 AND o_totalprice > 100000 GROUP BY 1""")
def traverse_filtered(t: Tables):
    """Customers in debt are pruned; orders above a price are visited and summed up."""
    starts = t.nation.select(name("nation/", "n_nationkey").alias("_id"))
    v = vertices(t)
    walked = graph.traverse(starts, edges(t), min_depth=2, max_depth=2, vertices=v,
                            prune=F.startswith("vertex", F.lit("customer/")) & (F.col("value") <= 0),
                            vertex_filter=F.col("value") > 100000)
    priced = walked.join(v.withColumnRenamed("_id", "vertex"), "vertex")
    return priced.groupBy("start").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("value"), 2).alias("total"))


@query("link_graph", f"""WITH {LINKS_SQL} SELECT DISTINCT md5(url || ' ' || {unescaped('link')}) AS _key, url AS _from, {unescaped('link')} AS _to
FROM lk WHERE link IS NOT NULL""")
def link_graph(t: Tables):
    return graph.link_graph(page_links_table(t))
