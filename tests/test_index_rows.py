"""A row of the stored index holds several keys of a word, and ranges stay small however large the index is."""

import pyarrow as pa

from newsloom.operators import fulltext


def test_postings_of_a_batch_are_put_together(monkeypatch):
    monkeypatch.setattr(fulltext, "GROUP", 2)
    lists = pa.array([["b", "a"], None, ["a"], [], ["a", "c"]], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, None, 8, 9]), lists], names=["k", "words"])
    out, = fulltext._by_word(iter([batch]))
    rows = sorted(zip(out["word"].to_pylist(), out["k"].to_pylist()), key=str)
    assert rows == [("a", [5, None]), ("a", [9]), ("b", [5]), ("c", [9])]
    empty, = fulltext._by_word(iter([batch.slice(1, 1)]))
    assert empty.num_rows == 0


def test_rows_and_ranges_of_an_index(spark, tmp_path, monkeypatch):
    texts = [f"the common word x{i}" for i in range(200)] + [None, "", "the the THE"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    path = str(tmp_path / "index")
    fulltext.write_index(docs, "text", "k", path, ranges=2)
    stored = spark.read.parquet(f"{path}/postings")
    # 801 postings; three frequent words have 13 rows each, and one of them goes on for one key more
    assert stored.count() == 200 + 3 * 13
    monkeypatch.setattr(fulltext, "RANGE_ROWS", 30)
    path = str(tmp_path / "finer")
    fulltext.write_index(docs, "text", "k", path, ranges=2)
    assert spark.read.parquet(f"{path}/bounds").count() > 4
    for query in ("the", "prefix:x1,-x11", "-the", "common,x7"):
        want = sorted(r.k for r in fulltext.fulltext(docs, "text", query, "k").collect())
        assert sorted(r.k for r in fulltext.search_index(spark, path, query).collect()) == want, query
