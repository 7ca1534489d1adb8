"""Dates are read from tokens that are split once."""

import datetime

from pyspark.sql import functions as F

from newsloom.functions import dates


def test_tokens_are_computed_once(spark):
    texts = [("on 31-02-2001 and 2001-01-01", None), ("5 May, 2004 and 1969-01-01", (2004, 5, 5)), ("1960/01/01 then 20040506", (2004, 5, 6)),
             ("Mar 3 1969", None), (None, None), ("", None)]
    found = spark.createDataFrame(texts, "t string, want struct<y: int, m: int, d: int>").select(dates.recognise_date(F.col("t")).alias("d"))
    assert [r.d for r in found.collect()] == [w and datetime.date(*w) for _, w in texts]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 1
