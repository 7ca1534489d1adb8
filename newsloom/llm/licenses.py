"""License scans by patience alignment of texts with license templates.

Words that stand once in the template and once in a stretch of text are
anchors; the longest run of anchors in the same order on both sides is kept,
and the gaps between them are aligned in the same way.  The share of a
template's words that found their place is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Share of a template's words that must be aligned, and share of the words in the aligned stretch that must belong to it.
COVERAGE, DENSITY = 0.8, 0.5

# Notices as their licenses ask for them, and short forms in use.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                 "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                 "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
                 "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                         "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                         "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                         "specific language governing permissions and limitations under the License.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                  "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                  "version.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                 "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                 "conditions and the following disclaimer.",
}
_WORD = re.compile(r"[^\W_]+")


def _longest_run(a: list[str], b: list[str], box: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """The first longest run of words both sides of the box share: places and length."""
    lo, hi, start, end = box
    places: dict[str, list[int]] = {}
    for j in range(start, end):
        places.setdefault(b[j], []).append(j)
    best, ending = (lo, start, 0), {}
    for i in range(lo, hi):
        now = {}
        for j in places.get(a[i], ()):
            k = now[j] = ending.get(j - 1, 0) + 1
            if k > best[2]:
                best = (i - k + 1, j - k + 1, k)
        ending = now
    return best


def _in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, that rises in the second."""
    tails, at, before = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(tails, j)
        if place:
            before[k] = at[place - 1]
        if place == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[place], at[place] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places ``(i, j)`` of equal words, rising on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, start, end = todo.pop()
        if lo >= hi or start >= end:
            continue
        once = {w for w, n in Counter(a[lo:hi]).items() if n == 1} & {w for w, n in Counter(b[start:end]).items() if n == 1}
        where = {b[j]: j for j in range(start, end) if b[j] in once}
        anchors = _in_order([(i, where[a[i]]) for i in range(lo, hi) if a[i] in once])
        if not anchors:
            i, j, k = _longest_run(a, b, (lo, hi, start, end))
            anchors = [(i + x, j + x) for x in range(k)]
            if not anchors:
                continue
        out += anchors
        for (i, j), (k, m) in zip([(lo - 1, start - 1), *anchors], [*anchors, (hi, end)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float):
        self.name = name
        self.words = [m.group() for m in _WORD.finditer(text.lower())]
        # a text without any of these, the longest ones, cannot reach the coverage
        missing = int((1 - coverage) * len(self.words) + 1e-9)
        count, kept = 0, []
        for word, n in sorted(Counter(self.words).items(), key=lambda x: (-len(x[0]), x[0])):
            kept.append(word)
            count += n
            if count > missing:
                break
        self.keys = frozenset(kept)


def _tight(pairs: list[tuple[int, int]], density: float) -> list[tuple[int, int]]:
    """The pairs around the widest gaps are left out until what is kept is dense."""
    while len(pairs) > 1 and len(pairs) < density * (pairs[-1][1] - pairs[0][1] + 1):
        cut = max(range(1, len(pairs)), key=lambda k: pairs[k][1] - pairs[k - 1][1])
        pairs = max(pairs[:cut], pairs[cut:], key=len)
    return pairs


def scan(text: str, templates: list[Template], coverage: float = COVERAGE, density: float = DENSITY) -> list[tuple]:
    """``(name, start, end, n_words, coverage)`` of all places where a template is found, by place.

    Around each key word a window of four times the template is aligned; after
    a find the search goes on in the words before it, as a later copy may be
    found first, and behind it.
    """
    spans = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text.lower())]
    if len(text.lower()) != len(text):  # lower case of another length: places of the text as it is
        spans = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    words = [s[0] for s in spans]
    found = []
    for t in templates:
        m, keys = len(t.words), [k for k, w in enumerate(words) if w in t.keys]
        # open stretches, and the first word of each whose window was not aligned as it is now
        todo = [(0, len(words), 0)] if keys else []
        while todo:
            start, end, new = todo.pop()
            for h in keys[bisect_left(keys, new):bisect_left(keys, end)]:
                lo = max(start, h - m)
                pairs = _tight(align(t.words, words[lo:min(end, h + 3 * m)]), density)
                if len(pairs) >= coverage * m - 1e-9:
                    first, last = lo + pairs[0][1], lo + pairs[-1][1]
                    found.append((t.name, spans[first][1], spans[last][2], len(pairs), len(pairs) / m))
                    todo += [(start, first, max(start, first - 3 * m + 1)), (last + 1, end, last + 1)]
                    break
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE,
                  density: float = DENSITY) -> DataFrame:
    """``(doc_id, license, start_char, end_char, n_words, coverage)``, a row for every place of a template.

    Places are code points, the end exclusive.  A short notice inside a longer
    one is a row of its own.  Null, empty and unlicensed texts give no row;
    rows that repeat give their places again; a null id stays null.  Other
    columns are ignored.  Texts without any key word stay in the JVM.
    """
    made = [Template(name, text, coverage) for name, text in sorted(templates.items())]
    made = [t for t in made if t.words]
    keys = sorted(set().union(*(t.keys for t in made))) if made else []
    # a key that holds another one needs no test of its own
    keys = [k for k in keys if not any(o != k and o in k for o in keys)]
    low = F.lower("text")
    possible = reduce(lambda x, y: x | y, [low.contains(k) for k in keys], F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *hit) for i, text in enumerate(batch.column(1)) for hit in scan(text.as_py(), made, coverage, density)]
            who, *rest = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(who, pa.int64())),
                 *[pa.array(x, kind) for x, kind in zip(rest, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))]],
                names=["doc_id", "license", "start_char", "end_char", "n_words", "coverage"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").filter(possible).mapInArrow(
        run, f"doc_id {kind}, license string, start_char long, end_char long, n_words long, coverage double")
