"""Edit distances of a sample to all windows of a text."""

import random

from pyspark.sql import functions as F

from newsloom.functions import text


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_words_of_any_length(spark):
    r = random.Random(1)
    for n in (1, 2, 63, 64, 65, 128, 130):
        word = "".join(r.choice("abcdé\U0001F600") for _ in range(n))
        around = "".join(r.choice("abcdé\U0001F600 ") for _ in range(n + 12))
        around = around[:4] + word[:n // 2] + around[4:]
        assert text._edits(word, around).tolist() == [edits(word, around[k:k + n]) for k in range(len(around) - n + 1)]


def test_a_long_text_is_compared_in_one_pass(spark):
    """Of 40 texts of 60 000 characters; one distance at a time took minutes for them."""
    sample, filler = "the quick brown fox jumps over the lazy dog and runs away from it all", "zyx wvu " * 7500
    df = spark.range(40).select(F.lit(sample).alias("a"), F.concat(F.lit(filler), F.lit(sample), F.lit(filler)).alias("b"))
    found = df.select(text.min_window_distance(F.col("a"), F.col("b")).alias("m"))
    assert {(r.m.distance, r.m.offset) for r in found.collect()} == {(0.0, 60000)}
    assert "levenshtein" not in found._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([("", "x"), (None, "x"), ("x", None)], "a string, b string")
    found = empty.select(text.min_window_distance(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.m for r in found] == [None] * 3
