"""SQL fragments for DuckDB that several oracles share."""

from __future__ import annotations

import string

from ..functions.dates import MONTH_WORDS
from ..functions.urls import COMMON_WORDS, DATE_WORDS, MONTHS


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def clean(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(strip_accents({x}), '[^A-z 0-9.,;:!?()]', ' ', 'g'), "
            f"'  +', ' ', 'g'))")


def tokenise(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '([.,;:!?()])', ' \\1 ', 'g'), ' {{2,}}', ' ', 'g')"
    for ch in string.ascii_uppercase:
        out = f"regexp_replace({out}, '(\\. |^){ch}([^A-Z])', '\\1{ch.lower()}\\2', 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


def sentences(tokenised: str) -> str:
    return f"string_split(regexp_replace({tokenised}, '([A-z0-9]{{2,}} \\.)[^A-z]', '\\1@', 'g'), '@')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def skinny(x: str) -> str:
    """Token by token: pieces, without common words; a long piece takes the piece before it along."""
    token = "regexp_replace(tok, '^#.*|\\?.*|=.*', '')"
    pieces = (f"list_filter(regexp_extract_all(lower({token}), '[A-z]+|[^A-z]'), "
              f"lambda w: w NOT IN ({quoted(COMMON_WORDS)}))")
    joined = (f"list_aggregate(list_transform({pieces}, lambda w, i: CASE WHEN length(w) > 1 THEN "
              f"CASE WHEN i > 1 THEN {pieces}[i - 1] ELSE '' END || w ELSE '' END), 'string_agg', '')")
    one = f"regexp_replace({joined}, '^[^A-z]', '')"
    return (f"array_to_string(list_filter(list_transform(string_split({x}, '/'), lambda tok: {one}), "
            f"lambda s: s <> ''), '/')")


def date(x: str) -> str:
    """The date a string speaks of."""
    toks = f"list_filter(string_split_regex(regexp_replace({x}, '[^A-z0-9\\-/:]', ' ', 'g'), '\\s+'), lambda t: t <> '')"
    iso = ("CASE WHEN regexp_matches(t, '^[0-9]{2}[-][0-9]{2}[-][0-9]{4}') OR regexp_matches(t, '^[0-9]{2}/[0-9]{2}/[0-9]{4}') "
           "THEN substr(t, 7, 4) || '-' || substr(t, 4, 2) || '-' || substr(t, 1, 2) "
           "WHEN regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') OR regexp_matches(t, '^[0-9]{4}/[0-9]{2}/[0-9]{2}') "
           "THEN substr(t, 1, 4) || '-' || substr(t, 6, 2) || '-' || substr(t, 9, 2) "
           "WHEN regexp_matches(t, '^[0-9]{8}$') "
           "THEN substr(t, 1, 4) || '-' || substr(t, 5, 2) || '-' || substr(t, 7, 2) END")
    isos = (f"list_filter(list_transform({toks}, lambda t: {iso}), lambda d: d IS NOT NULL AND "
            f"coalesce(try_cast(d AS DATE) > DATE '1970-01-01', true))")
    month = (f"list_position([{quoted(m[:3] for m in MONTHS)}], "
             f"lower(list_filter({toks}, lambda t: lower(t) IN ({quoted(MONTH_WORDS)}))[-1])[1:3])")
    day = f"list_filter({toks}, lambda t: regexp_matches(t, '^[0-9]{{1,2}}$'))[-1]"
    year = f"list_filter({toks}, lambda t: regexp_matches(t, '^[0-9]{{4}}$'))[-1]"
    named = f"try_cast({year} || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') || '-' || lpad({day}, 2, '0') AS DATE)"
    return (f"(CASE WHEN len({isos}) > 0 THEN try_cast({isos}[1] AS DATE) "
            f"WHEN {named} > DATE '1970-01-01' THEN {named} END)")


def url_date(x: str) -> str:
    steps = (f"list_filter(string_split({x}, '/'), lambda s: lower(s) IN ({quoted(DATE_WORDS)}) "
             f"OR regexp_matches(s, '^[0-9]{{2,4}}$'))")
    return f"least({date(f'array_to_string({steps}, $$/$$)')}, {date(f'array_to_string({steps}, $$ $$)')})"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


# The pages already in the corpus, told by their URLs.
KNOWN = f"""p AS MATERIALIZED (SELECT page_id, url AS "URL", {skinny('url')} AS "skinnyURL" FROM pages),
main AS (SELECT * FROM p WHERE contains("URL", '?page')),
newbies AS (SELECT * FROM p WHERE contains("URL", '#')),
errors AS (SELECT * FROM p WHERE contains("URL", '.html'))"""

# First matching site; the rest is unknown.
SITE = """CASE WHEN regexp_matches({0}, '^.*spam-farm\\.example\\.org/.*') THEN {1}
WHEN regexp_matches({0}, '^.*example\\.com/.*') THEN {2}
WHEN regexp_matches({0}, '^.*example\\.net/.*') THEN {3} END"""


def domain(x: str) -> str:
    return SITE.format(x, "'http://spam-farm.example.org'", "'http://www.example.com'", "'http://www.example.net'")


def collection(x: str) -> str:
    return SITE.format(x, "'spam'", "'com'", "'net'")
