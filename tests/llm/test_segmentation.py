from __future__ import annotations

import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from common_rows import awkward, no_rows

from newsloom.llm import segmentation as s

PATH = public_tokenizers.path("piece_bpe_32k.model")


def spellings(of, word):
    """All ways to spell a word with pieces, by recursion, with their weights."""
    if not word:
        return {(): 0.0}
    out = {}
    for k in range(1, len(word) + 1):
        p = of.pieces.get(word[:k])
        if p is not None:
            for rest, w in spellings(of, word[k:]).items():
                out[(p, *rest)] = w + of.weight[p]
    return out


def test_drawn_without_replacement():
    of = s.Lattices(PATH)
    words = of.words("the cat")
    a, b = (spellings(of, w) for w in words)
    weight = {x + y: np.exp(p + q) for x, p in a.items() for y, q in b.items()}
    share = {k: v / sum(weight.values()) for k, v in weight.items()}
    every, bound = of.top([words], np.array([9], np.uint64), 1000)[0]
    assert {tuple(of.ids(x)): 0 for x, _, _ in every}.keys() == share.keys() and len(every) == len(share) and bound == -np.inf
    assert all(abs(np.exp(p) - share[tuple(of.ids(x))]) < 1e-6 for x, p, _ in every)
    assert [g for _, _, g in every] == sorted((g for _, _, g in every), reverse=True)
    n, first, second = 20000, Counter(), Counter()
    for found, _ in of.top([words] * n, np.arange(n, dtype=np.uint64) * np.uint64(977), 2):
        x, y = (tuple(of.ids(f[0])) for f in found)
        assert x != y
        first[x] += 1
        second[y] += 1
    for k, p in share.items():
        q = sum(share[o] * p / (1 - share[o]) for o in share if o != k)
        assert abs(first[k] / n - p) < 5 * (p / n) ** .5 + 1e-3 and abs(second[k] / n - q) < 5 * (q / n) ** .5 + 1e-3


def test_rows_restore_their_texts(spark):
    docs, rows = awkward(spark)
    got = s.sample_segmentations(docs, PATH, samples=3)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = Counter((i, t or "") for i, t in rows)
    seen = Counter()
    for r in got.withColumn("back", s.decode(got["ids"], PATH)).collect():
        assert r.restored and (r.doc_id, r.back) in texts and r.log_prob <= 1e-6 and r.log_inclusion <= 1e-9
        assert sp.decode(np.frombuffer(r.ids, "<u4").tolist()) == r.back
        seen[r.doc_id, r.back] += r.sample == 0
    assert seen == texts
    long = [bytes(r.ids) for r in got.filter("doc_id = 8").collect()]
    assert len(set(long)) == 3
    again = s.sample_segmentations(docs.repartition(7), PATH, samples=3)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert s.sample_segmentations(no_rows(spark), PATH).collect() == []


def test_restored_says_what_the_decoder_says():
    of = s.Lattices(PATH)
    assert of.spoken
    texts = ["the cat sat", " a space first", "two  spaces", "ends in one ", "", " ", "\n lines\n\n", "Ünï 漢字 🙂 \x00 tab\t.", "a", "▁ sign", "<s> <0x41>"]
    for text in texts:
        for ids in (of.sp.encode(text), of.ids(of.top([of.words(text)], np.array([3], np.uint64), 1)[0][0][0][0]).tolist()):
            for other in (text, text[:-1], " " + text, "the cat"):
                assert of.restored(ids, other) == (of.sp.decode(ids) == other), (text, other)
    ids, of.sp = of.sp.encode(texts[0]), None
    # the decoder's pieces are known, so plain texts need no call of it
    assert of.restored(ids, texts[0])


def test_words_are_cut_as_by_the_pattern():
    of = s.Lattices(PATH)
    for text in ("the cat", "  the  cat ", "cat\n the", "▁▁a b", " ", "a"):
        assert of.words(text) == s._SEGMENT.findall(of.sp.normalize(text))


def test_memory_of_new_words_is_bounded():
    r = np.random.default_rng(5)
    texts = [" ".join("".join(map(chr, r.integers(97, 123, 8))) for _ in range(2000)) for _ in range(120)]
    of, rows = s.Lattices(PATH), 0
    tracemalloc.start()
    for lo, hi in s._slices(texts):
        rows += len(s._sampled(of, pa.array(range(lo, hi)), texts[lo:hi], 2, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 362 MB with the slices and the number of words kept before
    assert rows == 240 and peak < 250 << 20, peak >> 20


def test_starting_anew_changes_no_row(monkeypatch):
    texts = ["the cat sat on the mat", "un été à la mer", "the cat again 漢字"] * 3
    rows = [[str(c) for b in [s._sampled(of, pa.array(range(k, k + 3)), texts[k:k + 3], 3, 1) for k in (0, 3, 6)] for c in b.columns]
            for kept, of in ((1 << 20, s.Lattices(PATH)), (0, s.Lattices(PATH))) if monkeypatch.setattr(s, "KEPT", kept) is None]
    assert rows[0] == rows[1]
