"""The frontier over tables that are folders of files, with links that pass and without any."""

from newsloom.catalog import QUERIES


def test_links_of_a_folder_of_files(spark, tmp_path):
    spark.createDataFrame([("view",)] * 40 + [("click",)] * 3, "event_type string").repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "region.parquet"))
    for name, known in (("none", True), ("one", False)):
        folder = tmp_path / name
        folder.mkdir()
        for table in ("events", "region"):
            (folder / f"{table}.parquet").symlink_to(tmp_path / f"{table}.parquet")
        rows = [(1, "http://a.example.com/one?page=2"), (2, "http://a.example.com/two#x")] + ([] if known else [(3, "http://bbc.example.com/fresh")])
        spark.createDataFrame(rows, "page_id long, url string").repartition(2).write.parquet(str(folder / "pages.parquet"))
        got = [tuple(r) for r in QUERIES["frontier_admit"](spark, str(folder)).collect()]
        assert got == ([] if known else [("http://bbc.example.com/fresh", "news-links")])
