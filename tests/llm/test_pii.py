from __future__ import annotations

import hashlib
import re

from common_rows import awkward, no_rows, prose

from newsloom.llm import pii

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([ -]?[0-9])+"), ("phone", r"\+[0-9][ ().0-9-]+[0-9]")]


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        if kind == "email" and "@" not in (text or ""):
            continue
        found += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if passes(kind, m.group())]
    return ",".join(x[2] for x in sorted(found))


TEXTS = ["a@b.c+d@e.f x..y@z.com.", "1.2.3.400.5.6.7 300.1.2.3.4 001.02.3.4", "+1 (017) 555-7713 4952935900253052 4952-9359 0025 3052  12",
         "é\U0001F600 foo@bar.baz +12345678901-", "1 " * 20000, "a.b" * 3000 + "@" + "c.d" * 3000, "+1--2+1 2 3 4 5 6 7 8 9 0",
         "@a.b a@b a@b. a@b..c", "0000000000000000000000000.1.2.3", "x\u00011 2\u00013 4111 1111 1111 1111", "4111111111111111 4111-1111-1111-1111"]


def test_base_spans_as_by_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in pii.digest(pii.find_private(docs)).collect():
        want = brute(TEXTS[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and row.spans == want
        assert row.n_email + row.n_ip + row.n_card + row.n_phone == (want.count(",") + 1 if want else 0)


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"{prose(20, i)} zanzibar captain jo.doe@mail.org {prose(20, 50 + i)}") for i in range(6)]
    rows += [(100 + i, f"{prose(60, 200 + i)} captain {prose(5, i)}") for i in range(400)]
    # copies of one context disclose nothing, however many there are
    rows += [(900 + i, f"{prose(10, i)} {prose(20, 77)} unusualword al.ly@mail.org {prose(20, 78)}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.term: (r.bits, r.share) for r in pii.disclosures(
        pii.find_private(docs).filter("size(base) > 0").select("text", "base"), docs).collect()}
    assert set(terms) == {"zanzibar"} and terms["zanzibar"][1] == 1.0
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zanzibar" not in clean[0] and "captain [EMAIL]" in clean[0] and clean[100] == dict(rows)[100]
    assert "unusualword [EMAIL]" in clean[900]


def test_copies_and_distance_do_not_lower_the_share(spark):
    # six passages, each three times; a name far from the address in most texts that hold both; one passage in many texts
    rows = [f"{prose(20, i)} zanzibar jo.doe@mail.org {prose(20, 50 + i)}" for i in range(6)] * 3
    rows += [f"{prose(20, 100 + i)} quillfeather {prose(20 if i > 2 else 2, 150 + i)} al.ly@mail.org {prose(20, 200 + i)}" for i in range(12)]
    rows += [f"{prose(20, 300 + i)} {prose(20, 77) if i > 2 else ''} marigold bo.bby@mail.org {prose(20, 78)}" for i in range(40)]
    # half of what holds the word is without the address; copies of either half change nothing
    rows += [f"{prose(20, 400 + i)} sometimes cy.an@mail.org {prose(20, 450 + i)}" for i in range(4)] * 5
    rows += [f"{prose(20, 500 + i)} sometimes {prose(20, 550 + i)}" for i in range(4)] + [prose(40, 600 + i) for i in range(2000)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for broadcast_rows in (0, pii.BROADCAST_TERMS):
        terms = {r.term: r.share for r in pii.disclosures(
            pii.find_private(docs).filter("size(base) > 0").select("text", "base"), docs, broadcast_rows).collect()}
        assert terms == {"zanzibar": 1.0, "quillfeather": 1.0, "marigold": 1.0, "sometimes": 0.5}
    assert not any(w in r.text for r in pii.sanitise(docs).collect() for w in ("zanzibar", "quillfeather", "marigold"))


def brute_disclosures(texts):
    """The definition in plain Python: {term: share} over different texts."""
    words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    texts, contexts = sorted(set(texts)), {}
    for text in texts:
        for m in re.finditer(PATTERNS[0][1], text):
            low, high = max(m.start() - pii.CONTEXT, 0), m.end() + pii.CONTEXT
            left, right = text[low:m.start()], text[m.end():high]
            left = re.sub(r"^[^\W_]+", "", left) if low else left
            right = re.sub(r"[^\W_]+$", "", right) if high < len(text) else right
            contexts.setdefault(m.group().lower(), set()).add(f"{left} {right}")
    out = {}
    for entity, around in contexts.items():
        for term in set().union(*map(words, around)):
            near = sum(term in words(c) for c in around)
            held = [t for t in texts if term in words(t)]
            share = sum(entity in t.lower() for t in held) / len(held)
            if near >= pii.LEAST_CONTEXTS and share >= pii.LEAST_SHARE and near / len(around) / (len(held) / len(texts)) >= 2 ** pii.LEAST_BITS:
                out[term] = max(out.get(term, 0), share)
    return out


def test_every_text_is_sanitised(spark):
    # one address in a third of all rows; short names; a name also in texts without the address
    rows = [f"{prose(30, i)} Lee sales@shop.org {prose(30, 1000 + i)}" for i in range(4)] * 100
    rows += [f"{prose(8, 5000 + i)} Quillfeather b{i % 2}@mail.org {prose(30, 6000 + i)}" for i in range(8)]
    rows += [f"{prose(8, 7000 + i)} Quillfeather {prose(3, 7100 + i)}" for i in range(3)]
    rows += [f"{prose(5, 7200 + i)} lee. {prose(5, 7300 + i)} 김 o@k.kr {prose(4, 7400 + i)}" for i in range(4)]
    rows += [f"김 {prose(9, 7500)}", "nothing to hide", ""] + [prose(25, 8000 + i) for i in range(900)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute_disclosures([r for r in rows])
    assert {"김", "lee"} <= set(want) and "quillfeather" not in want
    for broadcast_rows in (0, pii.BROADCAST_TERMS):
        got = pii.find_private(docs, broadcast_rows).collect()
        assert len(got) == len(rows)
        for r in got:
            marked = {s.value[1:]: s.value[0] for s in r.spans if s["rank"] == 4}
            outside = re.sub(PATTERNS[0][1], lambda m: " " * len(m.group()), rows[r.doc_id])
            held = {w for w in re.findall(r"[^\W_]+", outside.lower()) if w in want}
            assert marked == {w: "-" if want[w] >= pii.REMOVE_SHARE else "+" for w in held}, (rows[r.doc_id], marked)
            assert (r.text is None) == (not r.spans)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any(re.search(r"(?i)\blee\b|김|@", t) for t in clean.values())
    assert all(clean[i] == t for i, t in enumerate(rows) if i >= len(rows) - 900 or t in ("", "nothing to hide"))


def test_awkward_rows(spark):
    docs, rows = awkward(spark)
    got = pii.digest(pii.find_private(docs)).collect()
    assert len(got) == len(rows) and all(r.spans == "" for r in got)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and sorted(map(str, clean.select("doc_id", "text").collect())) == sorted(
        map(str, docs.select("doc_id", "text").collect()))
    assert pii.digest(pii.find_private(no_rows(spark))).count() == 0 and pii.sanitise(no_rows(spark)).count() == 0
