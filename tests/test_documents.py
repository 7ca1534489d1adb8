"""Document tables against small literal cases."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions.naming import camel, snake
from newsloom.functions.registry import FunctionRegistry
from newsloom.operators import fulltext, geo, mutate, scan
from newsloom.operators.aggregate import table_checksum
from newsloom.operators.ranking import global_rank
from newsloom.operators.running import previous_max
from newsloom.sources.documents import import_lines


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


def values(spark, n=5):
    return spark.createDataFrame([(f"doc{i:02d}", i) for i in range(1, n + 1)], "_key string, value int")


def test_range_skips_before_it_limits(spark):
    found = scan.in_range(values(spark), "value", 2, 5, "_key", closed=True, skip=1, limit=2)
    assert [r.value for r in found.orderBy("value").collect()] == [3, 4]
    assert scan.in_range(values(spark), "value", 2, 5, "_key", closed=False).count() == 3


def test_examples_and_keys(spark):
    docs = spark.createDataFrame([("01", 1), ("02", 1), ("03", 3)], "_key string, value int")
    assert rows(scan.by_example(docs, {"value": 1}, "_key")) == [("01", 1), ("02", 1)]
    assert rows(scan.first_example(docs, {"value": 1}, "_key")) == [("01", 1)]
    changed, n = mutate.update_by_example(docs, {"value": 1}, {"value": 2}, "_key", limit=1)
    assert rows(changed) == [("01", 2), ("02", 1), ("03", 3)] and n.head()[0] == 1
    keys = spark.createDataFrame([("01",), ("03",), ("99",)], "k string")
    left, report = mutate.remove_by_keys(docs, "_key", keys)
    assert rows(left) == [("02", 1)] and tuple(report.head()) == (2, 1)


def test_revisions(spark):
    table = spark.createDataFrame([("a", "1", 1, 2), ("b", "1", 3, 4)], "_key string, _rev string, v int, w int")
    patch = spark.createDataFrame([("a", "1", 9), ("b", "2", 9), ("c", None, 9)], "_key string, want_rev string, v int")
    merged, failed = mutate.update_docs(table, patch, "_key", "_rev")
    assert rows(merged) == [("a", "1", 9, 2), ("b", "1", 3, 4)]
    assert rows(failed) == [("b", "revision_error"), ("c", "missing")]
    replaced, _ = mutate.replace_docs(table, patch, "_key", "_rev")
    assert rows(replaced) == [("a", "1", 9, None), ("b", "1", 3, 4)]


def test_merge_attributes(spark):
    df = spark.range(1).select(F.expr("map('a', 1, 'b', 2)").alias("old"), F.expr("map('b', null, 'c', 3)").alias("new"))
    kept, gone = df.select(mutate.merge_attributes(F.col("old"), F.col("new")),
                           mutate.merge_attributes(F.col("old"), F.col("new"), keep_none=False)).head()
    assert kept == {"a": 1, "b": None, "c": 3} and gone == {"a": 1, "c": 3}


def test_ordered_batch(spark):
    table = spark.createDataFrame([("d1", {"v": "1"}), ("d2", {"v": "1"}), ("d3", {"v": "1"})], "k string, body map<string,string>")
    ops = spark.createDataFrame([
        (1, "create", "d4", {"v": "4"}), (2, "update", "d1", {"w": "2"}), (3, "replace", "d2", {"x": "5"}),
        (4, "delete", "d3", None), (5, "update", "d3", {"v": "9"}), (6, "create", "d3", {"n": "0"}), (7, "create", "d1", {"v": "8"})],
        "seq int, op string, k string, body map<string,string>")
    state, rejected = mutate.apply_batch(table, ops, "k")
    assert rows(state) == [("d1", {"v": "1", "w": "2"}), ("d2", {"x": "5"}), ("d3", {"n": "0"}), ("d4", {"v": "4"})]
    assert sorted(r.seq for r in rejected.collect()) == [5, 7]


def test_partial_and_complete_import(spark):
    lines = spark.createDataFrame([(1, '{"_key": "a", "v": 1}'), (2, '{"_key": 7}'), (3, '{"_key": "b"}'),
                                   (4, '{"_key": "a"}'), (5, "nonsense")], "seq int, line string")
    done = import_lines(lines, "line", "seq", "_key string, v int")
    assert tuple(done.summary().head()) == (2, 3) and done.documents().count() == 2
    whole = import_lines(lines, "line", "seq", "_key string, v int", complete=True)
    assert tuple(whole.summary().head()) == (0, 3) and whole.documents().count() == 0


def test_capping(spark):
    t = spark.range(1, 101).toDF("seq")
    assert mutate.cap_newest(t, "seq", 10).agg(F.min("seq"), F.count("seq")).head() == (91, 10)
    # 10 bytes each: the newest four fit, over buckets of seven rows
    assert mutate.cap_bytes(t, "seq", F.lit(10), 40, width=7).agg(F.min("seq")).head()[0] == 97


def test_capping_any_order(spark):
    names = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)] + [("k049",)], "seq string")
    for size in (1, 200_000):  # ties with the last one stay, whatever the size
        assert mutate.cap_newest(names, "seq", size).count() == (2 if size == 1 else 51)
    # microseconds far apart, and a key with nearly all rows
    sparse = spark.range(0, 60).select((F.col("id") * 1_000_003_777).alias("seq"), F.lit("a").alias("k"))
    got = mutate.running_total(sparse, "seq", F.lit(1), width=7)
    assert got.filter(F.col("__total") != 60 - F.expr("seq div 1000003777")).count() == 0
    seen = previous_max(sparse, ["k"], [F.col("seq")], F.col("seq"), width=7)
    assert seen.filter(F.col("before").isNull()).count() == 1
    assert seen.filter(F.col("seq") - F.col("before") != 1_000_003_777).count() == 0


def test_repeated_keys_in_a_batch(spark):
    table = spark.createDataFrame([("a", 1, 1)], "k string, v int, w int")
    docs = spark.createDataFrame([(1, "b", 1, 1), (2, "b", 2, 2), (3, "a", 3, 3)], "n int, k string, v int, w int")
    added, refused = mutate.insert_docs(table.withColumn("n", F.lit(0)), docs, "k", order="n")
    assert sorted((r.k, r.v) for r in added.collect()) == [("a", 1), ("b", 1)]
    assert sorted((r.k, r.v, r.reason) for r in refused.collect()) == [("a", 3, "conflict"), ("b", 2, "conflict")]
    patches = spark.createDataFrame([(1, "a", 5, None), (2, "a", None, 6), (3, "c", 7, None), (4, "c", 8, 9)], "n int, k string, v int, w int")
    merged = mutate.upsert_docs(table.withColumn("n", F.lit(0)), patches, "k", order="n")
    assert sorted((r.k, r.v, r.w) for r in merged.collect()) == [("a", 5, 6), ("c", 8, 9)]


def test_checksum_tells_rows_apart(spark):
    def checksum(rows, **flags):
        return table_checksum(spark.createDataFrame(rows, "a string, b string, rev string"), ["a", "b"], "rev", **flags).head().checksum

    assert checksum([("a|b", "c", "1")]) != checksum([("a", "b|c", "1")]) and checksum([(None, "x", "1")]) != checksum([("~", "x", "1")])
    assert checksum([("a", "b", "1")]) == checksum([("a", "b", "2")]) != checksum([("a", "b", "2")], with_rev=True)
    assert checksum([("a", "b", "1")], with_data=False) == checksum([("a", "z", "1")], with_data=False)


def test_global_rank(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("x"))
    ranked = global_rank(df, [F.col("x").desc()])
    assert ranked.filter(F.col("rank") != 999 - F.col("x")).count() == 0 and ranked.count() == 1000


def test_near_and_fulltext(spark):
    places = spark.createDataFrame([(n, float(a), float(b)) for n, a, b in
                                    (("a", 1, 1), ("b", 1, 4), ("c", 4, 1), ("d", 4, 4))], "n string, lat double, lon double")
    assert rows(geo.near(places, "lat", "lon", 1.0, 1.0, "n", limit=1)) == [("a", 1.0, 1.0)]
    docs = spark.createDataFrame([(1, "Hello World!"), (2, "foo"), (3, "bar"), (4, "baz")], "k int, text string")
    assert [r.k for r in fulltext.fulltext(docs, "text", "foo,|bar", "k").collect()] == [2, 3]
    assert [r.k for r in fulltext.fulltext(docs, "text", "prefix:ba,-bar", "k").collect()] == [4]


def test_functions_and_names(spark):
    registry = FunctionRegistry(spark)
    registry.register("t::c2f", "c DOUBLE", "DOUBLE", "c * 1.8 + 32")
    assert spark.sql("SELECT t__c2f(100D)").head()[0] == 212.0
    assert registry.delete("t", group=True) == 1 and registry.list() == {}
    assert camel("wait_for_sync") == "waitForSync" and snake("waitForSync") == "wait_for_sync"
    assert [camel(n) for n in ("plain", "_id", "a__b", "x_a1b", "KEEP_THIS", "n_")] == ["plain", "Id", "aB", "xA1B", "KEEPThis", "n"]


def test_search_on_the_stored_index(spark, tmp_path):
    texts = ["Hello World!", "foo", "bar", "baz foo", None, "", "the the FOOD", "bazar", "ünder foo", *["the common word"] * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for ranges in (1, 7):
        path = str(tmp_path / f"index{ranges}")
        fulltext.write_index(docs, "text", "k", path, ranges=ranges)
        for query in ("prefix:ba,-bar,|foo", "-the,|prefix:foo", "the,common,-word,|foo", "-nothing", "complete:foo,|prefix:ü", "prefix:"):
            want = sorted(r.k for r in fulltext.fulltext(docs, "text", query, "k").collect())
            assert sorted(r.k for r in fulltext.search_index(spark, path, query).collect()) == want, query
        assert [r.k for r in fulltext.search_index(spark, path, "the", 2, 3).collect()] == [10, 11, 12]
    # one range of many is read for a word
    plan = fulltext.search_index(spark, str(tmp_path / "index7"), "bar")._jdf.queryExecution().executedPlan().toString()
    parts = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "part" in parts
    fulltext.write_index(docs.limit(0), "text", "k", str(tmp_path / "empty"))
    assert fulltext.search_index(spark, str(tmp_path / "empty"), "foo,|-bar").count() == 0
    with pytest.raises(ValueError):
        fulltext.terms_of(" , ")


def test_files_of_documents(spark, tmp_path):
    from newsloom.sources.documents import export_documents, import_file, write_documents

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"_key": "1", "x": 1}\n{"_key": "2", "x": 2}\nno json\n{"_key": "1", "x": 3}\n{"_key": 4, "x": 4}\n{"x": 5}\n')
    stored = spark.createDataFrame([("2",), ("9",)], "_key string")
    got = import_file(spark, str(tmp_path / "in"), "_key string, x int", stored=stored)
    assert sorted((r["_key"] or "", r.x) for r in got.documents().collect()) == [("", 5), ("1", 1)]
    assert sorted(r.reason for r in got.rejected.collect()) == ["duplicate key", "key is not a string", "key is stored", "not an object"]
    assert tuple(got.summary().head()) == (2, 4)
    strict = import_file(spark, str(tmp_path / "in"), "_key string, x int", complete=True, stored=stored)
    assert strict.documents().count() == 0 and tuple(strict.summary().head()) == (0, 4)
    write_documents(export_documents(got.documents(), include=["x"]), str(tmp_path / "out"))
    assert sorted(r.x for r in spark.read.json(str(tmp_path / "out")).collect()) == [1, 5]
