"""What a task holds at a time is bounded, however large its batches are."""

import numpy as np
import pyarrow as pa

from newsloom.operators import embed, pages


def test_rows_are_worked_in_slices():
    lists = pa.array([["a"] * 3, None, [], ["b"] * 9, ["c"] * 2, ["d"] * 2], type=pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists], names=["k", "s"])
    parts = list(embed.slices(batch, pa.compute.list_value_length(lists), 4))
    # a row is not cut, and none is lost
    assert [p.column("k").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5]]
    assert list(embed.slices(batch.slice(0, 0), pa.array([], pa.int32()), 4)) == []


def test_scores_of_long_batches_use_little_memory(spark, monkeypatch):
    from newsloom.sources.model import WordModel

    sizes = []
    inner = embed.sentence_matrix
    model = WordModel(spark.createDataFrame([("x", 0, [1.0, 0.0]), ("y", 1, [0.0, 1.0])], "word string, idx long, vec array<double>"))
    weights = np.array([[1.0, 0.0], [0.0, 1.0]])
    monkeypatch.setattr(embed, "sentence_matrix", lambda s, w, m: sizes.append(len(s)) or inner(s, w, m))
    held = {}
    df = spark.createDataFrame([(0, ["x"])], "k long, sentences array<string>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: held.update(run=run) or self)
    embed.score_docs(df, model, "mean")
    docs = pa.RecordBatch.from_pydict({"k": list(range(40)), "sentences": [["x", "y y x"] * 1000] * 40})
    out = list(held["run"](iter([docs])))
    assert sum(sizes) == 80_000 and max(sizes) <= embed.SENTENCES and sum(b.num_rows for b in out) == 40
    assert np.allclose(np.linalg.norm(np.vstack([b.column("vec").flatten().to_numpy().reshape(-1, 2) for b in out]), axis=1), 1)
    assert weights.shape == model.shape


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    long = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 20000) AS t")
    assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 1000
    assert pages.PARSED_CHARS <= 1 << 20
