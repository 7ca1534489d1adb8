from __future__ import annotations

import hashlib
import re

import pytest
from common_rows import awkward, no_rows, prose
from hypothesis import given, settings, strategies as st

from newsloom.llm import fill_in_middle as fim

RAW = fim.checked(fim.MARKS)


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexes = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def compare(docs, rows, **options):
    done = fim.restore(fim.fill_in_middle(docs, **{k.replace("spm", "suffix_first"): v for k, v in options.items()}))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in done.collect()), key=repr)
    assert got == sorted(((i, *brute(i, t, **options), t or "") for i, t in rows), key=repr)
    return done


def test_as_by_brute_force(spark):
    rows = [(i, "\n".join(prose(3 + i % 5, i + k) for k in range(i % 9)) + "\n" * (i % 3)) for i in range(60)]
    rows += [(90, "\n\n\n"), (91, "x<M>y\nz"), (92, "<P"), (93, "a<\nP>\n<S\n>M>"), (94, "é\n\U0001F600\nü"), (95, "one\r\ntwo\rthree four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    forms = {r.form for r in compare(docs, rows).select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}
    compare(docs, rows, rate=40, spm=80)


def test_awkward_rows(spark):
    docs, rows = awkward(spark)
    done = compare(docs, rows)
    # a column called n is replaced, the others stay
    assert [c for c in done.columns if c not in ("form", "prefix_chars", "middle_chars", "output", "restored")] == docs.columns
    clash = docs.withColumnRenamed("lang", "form").withColumnRenamed("node", "output")
    assert [r.output for r in fim.fill_in_middle(clash).orderBy("doc_id", "output").collect()] == [
        r.output for r in fim.fill_in_middle(docs).orderBy("doc_id", "output").collect()]
    assert fim.restore(fim.fill_in_middle(no_rows(spark))).count() == 0
    long = spark.createDataFrame([(1, "line of text\n" * 400_000)], "doc_id long, text string")
    assert fim.restore(fim.fill_in_middle(long)).filter("restored = text AND n = 400000").count() == 1


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.data())
def test_rotations_and_their_inverse(text, data):
    buf = bytearray(text)
    lo = data.draw(st.integers(0, len(buf)))
    hi = data.draw(st.integers(lo, len(buf)))
    mid = data.draw(st.integers(lo, hi))
    fim.rotate(buf, lo, mid, hi)
    assert bytes(buf) == text[:lo] + text[mid:hi] + text[lo:mid] + text[hi:]
    fim.rotate(buf, lo, lo + hi - mid, hi)
    assert bytes(buf) == text


@settings(max_examples=200, deadline=None)
@given(st.text("<>PSM\n a", max_size=30), st.data())
def test_every_cut_comes_back(text, data):
    raw = text.encode()
    first = data.draw(st.integers(0, len(raw)))
    second = data.draw(st.integers(first, len(raw)))
    if not any(m in raw for m in RAW):
        for form in ("psm", "spm"):
            assert fim.rebuild(fim.arrange(raw, first, second, form, RAW), form, RAW) == raw


def test_marks_that_cannot_be_told_apart():
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "<<", "<M>"), ("", "<S>", "<M>"), ("<P>", "<PS>>", "<P")):
        with pytest.raises(ValueError):
            fim.checked(marks)
    assert fim.checked(("<|prefix|>", "<|suffix|>", "<|middle|>"))
