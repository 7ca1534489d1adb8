from __future__ import annotations

import itertools

import numpy as np
from common_rows import awkward, no_rows, prose

from newsloom.llm import licenses, transcripts

MIT = licenses.TEMPLATES["MIT-grant"]


def rising(a, b, pairs):
    return all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_alignment_rises_and_finds_whole_copies():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 12, rng.integers(0, 20))] for _ in range(2))
        assert rising(a, b, licenses.align(a, b))
        assert [j - 3 for _, j in licenses.align(a, ["x", "y", "z", *a])] == list(range(len(a)))


def test_anchors_are_the_longest_rising_run():
    for js in itertools.permutations(range(6)):
        best = max((c for k in range(7) for c in itertools.combinations(js, k) if list(c) == sorted(c)), key=len)
        assert len(licenses._in_order(list(enumerate(js)))) == len(best)


def test_places_of_licenses(spark):
    words = MIT.split()
    worn = " ".join(w for i, w in enumerate(words) if i % 9)
    texts = {1: prose(50, 1) + "\nReleased under the MIT License.\n" + prose(30, 2) + " Released under the MIT License.", 2: worn,
             3: " ".join(words[:40]), 4: prose(300, 3) + " license version under general public licensed", 5: MIT.upper() + prose(10, 3) + " " + MIT,
             6: "É\U0001F600 Licensed under CC BY-NC 4.0."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.start_char, r.end_char) for r in licenses.find_licenses(docs).collect())
    at = [i for i in range(len(texts[1])) if texts[1].startswith("Released", i)]
    assert [x[:2] for x in got] == [(1, "MIT-notice"), (1, "MIT-notice"), (2, "MIT-grant"), (5, "MIT-grant"), (5, "MIT-grant"), (6, "CC-BY-NC-4.0-notice")]
    assert [x[2] for x in got[:2]] == at and texts[6][got[5][2]:got[5][3]] == "Licensed under CC BY-NC 4.0"


def test_an_altered_copy_before_a_better_one():
    made = [licenses.Template("MIT", licenses.TEMPLATES["MIT-notice"], licenses.COVERAGE)]
    worn, good = "Released under the BSD ish MIT License.", "Released under the MIT License."
    for lines in ([worn, good], [worn, worn, good], [good, worn, good], [prose(40, 1), worn, prose(3, 2), good, worn, prose(40, 3), good]):
        text, want, at = " ".join(lines), [], 0
        for line in lines:
            if line in (worn, good):
                want.append((at, at + len(line) - 1))
            at += len(line) + 1
        assert [x[1:3] for x in licenses.scan(text, made)] == want
        assert all(x[3:] == (5, 1.0) for x in licenses.scan(text, made))


def test_awkward_rows(spark):
    docs, _ = awkward(spark)
    assert licenses.find_licenses(docs).count() == 0 and licenses.find_licenses(no_rows(spark)).count() == 0
    extra = spark.createDataFrame([(None, "Released under the MIT License.", "en", None, 5, .5, 1, "x")] * 2, docs.schema)
    assert [r.doc_id for r in licenses.find_licenses(docs.unionByName(extra)).collect()] == [None, None]


ROLES = ["user", "assistant"]


def conversations(n=40):
    rows = []
    for c in range(n):
        for t in range(2 + c % 5):
            role = ROLES[t % 2]
            mark = (["Q: ", "A: "] if c % 2 else ["## Human\n", "## Bot\n"])[t % 2]
            body = prose(4, c * 31 + t) + "?" if t % 2 == 0 else "\n".join(prose(12, c * 31 + t + k) + "." for k in range(1 + c % 3))
            rows.append((c, t, mark + body, role if c % 4 else None, role))
    return rows


def recovered(spark, rows):
    frame = spark.createDataFrame([r[:4] for r in rows], "conv_id long, turn long, text string, role string")
    lines = transcripts.lines_of(frame)
    return lines, transcripts.train(lines)


def test_roles_of_transcripts_without_them(spark, monkeypatch):
    rows = conversations()
    lines, model = recovered(spark, rows)
    whole = {(r.conv_id, r.turn, r.line): (r.role, r.state) for r in transcripts.recover(lines, model).collect()}
    want = {r[:2]: r[4] for r in rows}
    assert all(role == want[c, t] for (c, t, _), (role, _) in whole.items())
    # segments of two lines, chained, give the same states
    monkeypatch.setattr(transcripts, "SEGMENT", 2)
    lines, _ = recovered(spark, rows)
    cut = transcripts.recover(lines, model)
    assert {(r.conv_id, r.turn, r.line): (r.role, r.state) for r in cut.collect()} == whole
    turns = transcripts.canonical(cut).collect()
    assert len(turns) == len(rows) and sum(t.n_lines for t in turns) == len(whole)
    first = [t for t in turns if (t.conv_id, t.turn) == (1, 0)]
    assert first[0].rendered == f"<|user|>\n{prose(4, 31)}?"


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    model = transcripts.Model(rng.random(6), rng.random((6, 6)), [rng.random((6, n)) for n in transcripts.SIZES])
    seen = np.column_stack([rng.integers(0, n, 5) for n in transcripts.SIZES])
    e = model.scores(seen)

    def value(path):
        return model.start[path[0]] + e[0, path[0]] + sum(model.step[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))

    best = max(itertools.product(range(6), repeat=5), key=value)
    assert tuple(transcripts.decode(model, seen, -1, -1)) == best


def test_awkward_transcripts(spark):
    rows = [(1, 0, "User: hi", "user"), (1, 0, "User: hi", "user"), (1, None, None, None), (None, 0, "x", None), (2, 0, "", "user"),
            (2, 1, "\n\n", None), (3, 0, "word " * 5000, "assistant"), (1, 1, "Bot: yes", "assistant")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, text string, role string, segment int")
    lines = transcripts.lines_of(frame)
    got = transcripts.recover(lines, transcripts.train(lines)).collect()
    assert sorted((r.conv_id or 0, r.turn) for r in got) == [(0, 0), (1, 0), (1, 0), (1, 1), (3, 0)]
    empty = transcripts.lines_of(frame.limit(0))
    assert transcripts.canonical(transcripts.recover(empty, transcripts.train(empty))).collect() == []


def test_markers():
    shown = {"User 1: hi": "user", "Speaker2: hi": "speaker", "John Smith: hi": "john smith", "Customer Service: hi": "customer service",
             "**User**: hi": "user", "**User:** hi": "user", "[12:01] Bob: hi": "bob", "12:01:30 PM - Bob: hi": "bob", "(9:05) <Bob>: hi": "bob",
             "[user] hi": "user", "<Bob> hi": "bob", "<|user|> hi": "user", "> Bob: hi": "bob", "王小明: hi": "王小明"}
    for line, name in shown.items():
        value, end = transcripts.marker(line)
        assert (value, line[end:]) == (transcripts.marker(name.title() + ": x")[0], "hi"), line
    for line in ("<|im_start|>user", "### User", "## User:", "**User**", "[user]", "User:"):
        assert transcripts.marker(line) == (transcripts.marker("user: x")[0], len(line)), line
    for line in ("", "we met at 12:30 and so on", "http://x.y/z", "this is a test: yes", "<|im_end|>", "word" * 50_000, "Aa " * 50_000, "- item"):
        assert transcripts.marker(line) == (0, 0), line[:40]


def test_turns_do_not_depend_on_the_cuts(spark, monkeypatch):
    said = {t: prose(4, t) + "?" if t % 6 == 0 else prose(12, t) + "." for t in range(600)}
    marks = {0: "Q: ", 1: "A: "}
    rows = conversations(12) + [(99, t, marks.get(t % 6, "") + text + "\n\n", None, "") for t, text in said.items()]
    seen, kept = set(), {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions, size in (1, 20_000), (31, 20_000), (7, 2):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            monkeypatch.setattr(transcripts, "SEGMENT", size)
            lines, model = recovered(spark, rows)
            got = transcripts.canonical(transcripts.recover(lines, model)).drop("segment", "ord").collect()
            seen.add(tuple(sorted(map(tuple, got))))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(seen) == 1
    # turns and texts as they were written
    turns = [r for r in seen.pop() if r[0] == 99]
    assert [r[1] for r in turns] == [t for t in range(600) if t % 6 < 2]
    for r in turns:
        lines = [said[r[1]]] if r[1] % 6 == 0 else [said[t] for t in range(r[1], r[1] + 5)]
        assert r[4:] == (len(lines), f"<|{ROLES[r[1] % 6]}|>\n" + "\n".join(lines))
