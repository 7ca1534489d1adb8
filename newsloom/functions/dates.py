"""Date recognition in free text, URLs and feed entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .urls import DATE_WORDS, MONTHS

EPOCH = "1970-01-01"
EARLIEST = "1990-01-01"
MONTH_WORDS = sorted({w for m in MONTHS for w in (m, m[:3])})


def _iso(token: Column) -> Column:
    """A token that starts like a full date, rearranged to year-month-day."""
    def part(start, length):
        return F.substring(token, start, length)

    day_first = F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))
    year_first = F.concat_ws("-", part(1, 4), part(6, 2), part(9, 2))
    packed = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    return (F.when(token.rlike(r"^[0-9]{2}-[0-9]{2}-[0-9]{4}|^[0-9]{2}/[0-9]{2}/[0-9]{4}"), day_first)
            .when(token.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}|^[0-9]{4}/[0-9]{2}/[0-9]{2}"), year_first)
            .when(token.rlike(r"^[0-9]{8}$"), packed))


def _valid_date(iso: Column) -> Column:
    return F.when(~F.startswith(iso, F.lit("0000")), iso.try_cast("date"))


def recognise_date(text: Column) -> Column:
    """The date a string speaks of, or null.

    The first token holding a complete date decides: it is the answer, or there
    is none when that date does not exist.  Otherwise the last day, month and
    year named separately are put together.  Only dates after 1970 count.
    """
    cleaned = F.regexp_replace(text, r"[^A-z0-9\-/:]", " ")
    tokens = F.filter(F.split(cleaned, r"\s+"), lambda t: t != "")
    return _once(_once(tokens, _date_parts), _date_of)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """A one-element transform names a value, so that it is not computed again at each use."""
    return F.get(F.transform(F.array(value), then), 0)


def _date_parts(tokens: Column) -> Column:
    """The first complete date, and the last day, month and year named separately."""
    def last(keep) -> Column:
        return F.try_element_at(F.filter(tokens, keep), F.lit(-1))

    # dates that exist but lie before 1970 are passed over, impossible ones stop the search
    isos = F.filter(F.transform(tokens, _iso), lambda iso: iso.isNotNull() & F.coalesce(
        _valid_date(iso) > F.lit(EPOCH).cast("date"), F.lit(True)))
    month_word = F.lower(last(lambda t: F.lower(t).isin(MONTH_WORDS)))
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(month_word, 1, 3))
    return F.struct(F.get(isos, 0).alias("iso"), last(lambda t: t.rlike(r"^[0-9]{1,2}$")).alias("day"),
                    month.alias("month"), last(lambda t: t.rlike(r"^[0-9]{4}$")).alias("year"))


def _date_of(parts: Column) -> Column:
    year, month, day = parts["year"], parts["month"], parts["day"]
    named = _valid_date(F.concat_ws(
        "-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")))
    complete = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return (F.when(parts["iso"].isNotNull(), _valid_date(parts["iso"]))
            .when(complete & (named > F.lit(EPOCH).cast("date")), named))


def time_to_sec(text: Column) -> Column:
    """Seconds of the day of the first HH:MM:SS in the string."""
    pattern = r"([0-9][0-9]):([0-9][0-9]):([0-9][0-9])"

    def group(i):
        return F.regexp_extract(text, pattern, i).cast("long")

    return F.when(text.rlike(pattern), group(1) * 3600 + group(2) * 60 + group(3))


def url_date(url: Column) -> Column:
    """The earliest date spelled by the date-like steps of a URL's path."""
    steps = F.filter(F.split(url, "/", -1),
                     lambda t: F.lower(t).isin(DATE_WORDS) | t.rlike(r"^[0-9]{2,4}$"))
    return F.least(recognise_date(F.array_join(steps, "/")),
                   recognise_date(F.array_join(steps, " ")))


def created_ts(published_ts: Column, published: Column, headers: Column, texts: Column,
               url: Column) -> Column:
    """When a page was written: feed time, feed date text, the earliest date
    since 1990 among response headers, the first date in page text, the URL."""
    header_dates = F.filter(F.transform(headers, recognise_date),
                            lambda d: d >= F.lit(EARLIEST).cast("date"))
    text_dates = F.filter(F.transform(F.filter(texts, lambda t: F.length(t) > 6), recognise_date),
                          lambda d: d.isNotNull())
    return F.coalesce(published_ts, recognise_date(published).cast("timestamp"),
                      F.array_min(header_dates).cast("timestamp"),
                      F.get(text_dates, 0).cast("timestamp"), url_date(url).cast("timestamp"))


def entry_ref_ts(updated_ts: Column, updated: Column, published_ts: Column, published: Column) -> Column:
    """The update time of a feed entry, else its publication time."""
    def stated(text):
        midnight = F.unix_seconds(recognise_date(text).cast("timestamp"))
        return F.timestamp_seconds(midnight + time_to_sec(text))

    return F.coalesce(updated_ts, stated(updated), published_ts, stated(published))


def append_parsed_ts(history: Column, now: Column) -> Column:
    return F.concat(F.coalesce(history, F.array().cast("array<timestamp>")), F.array(now))
