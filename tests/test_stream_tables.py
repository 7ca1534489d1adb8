"""Tables of many files as streams."""

import pytest

from newsloom.catalog.base import Tables
from newsloom.catalog.streams import stream_of


@pytest.mark.parametrize("many", [False, True])
def test_a_table_is_one_file_or_a_folder_of_files(spark, tmp_path, many):
    spark.range(6).withColumnRenamed("id", "page_id").repartition(2 if many else 1).write.parquet(str(tmp_path / "w"))
    spark.range(3).write.parquet(str(tmp_path / "t" / "other.parquet"))
    if many:
        (tmp_path / "w").rename(tmp_path / "t" / "pages.parquet")
    else:
        next((tmp_path / "w").glob("part-*.parquet")).rename(tmp_path / "t" / "pages.parquet")
    stream = stream_of(Tables(spark, str(tmp_path / "t")), "pages")
    query = (stream.writeStream.format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "log")).start(str(tmp_path / "out")))
    query.awaitTermination()
    assert sorted(r.page_id for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()) == list(range(6))


def test_frontier_over_a_folder_of_files(spark, tmp_path):
    from newsloom.catalog import QUERIES

    for name in ("pages", "events", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    many, one = (sorted(QUERIES["frontier_admit"](spark, folder).collect()) for folder in (str(tmp_path), "/root/testdata/sf0.001"))
    assert many == one and many
