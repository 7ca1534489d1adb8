"""URL expressions: the skinny form, screening features, link hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words that carry no meaning in a URL.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august",
          "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
WEB_WORDS = ["http", "https", "html", "jpg", "css", "js"]
DATE_WORDS = sorted({w for name in MONTHS + WEEKDAYS for w in (name, name[:3])})
COMMON_WORDS = sorted(set(DATE_WORDS) | set(WEB_WORDS))
STATIC_FEATURES = ["leanPct", "length", "nDash", "nTokens"]
MAX_LINK_LENGTH = 250


def skinny_url(url: Column) -> Column:
    """The URL's words only: no query, fragment, numbers or calendar words.

    Whole-string regular expressions keep this inside generated code; a word is
    a run of two or more ``[A-z]`` characters and keeps the one separator that
    stands right before it, unless it opens its path step.
    """
    common = "|".join(sorted(COMMON_WORDS, key=len, reverse=True))
    out = F.regexp_replace(url, r"(?:(?:^|(?<=/))#|[?=])[^/\n]*", "")
    out = F.regexp_replace(F.lower(out), rf"(?<![A-z])(?:{common})(?![A-z])", "")
    out = F.regexp_replace(out, r"(?<![A-z])[A-z](?![A-z])", "")
    out = F.regexp_replace(out, r"[^A-z/](?![A-z]{2})", "")
    out = F.regexp_replace(out, r"(^|/)[^A-z/]", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"/{2,}", "/"), r"^/|/$", "")


def url_features(url: Column, skinny: Column | None = None) -> dict[str, Column]:
    skinny = skinny_url(url) if skinny is None else skinny
    tokens = F.split(skinny, "/", -1)
    return {
        "leanPct": F.length(skinny) / F.length(url),
        "length": F.length(url),
        "nDash": F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit(""))),
        "nTokens": F.size(tokens),
        "tokens": tokens,
    }


def url_feature_matrix(df: DataFrame, url: str, tokens: list[str]) -> DataFrame:
    """Static features, then one 0/1 column ``tok_<token>`` per relevant token."""
    df = df.withColumn("skinnyURL", skinny_url(F.col(url)))
    feats = url_features(F.col(url), F.col("skinnyURL"))
    static = [feats[name].alias(name) for name in STATIC_FEATURES]
    df = df.select("*", *static, feats["tokens"].alias("__tokens"))
    flags = [F.array_contains("__tokens", t).cast("int").alias(f"tok_{t}") for t in tokens]
    return df.select("*", *flags).drop("__tokens")


def usable_link(link: Column) -> Column:
    return (F.length(link) <= MAX_LINK_LENGTH) & safe_value(link)


def safe_value(value: Column) -> Column:
    return ~value.rlike(r"[{}]")


def escape_value(value: Column) -> Column:
    """Trailing backslashes go, quotes are percent-encoded."""
    return F.replace(F.regexp_replace(value, r"\\+$", ""), F.lit("'"), F.lit("%27"))


def entry_url(origlink: Column, link: Column) -> Column:
    return F.coalesce(F.regexp_replace(origlink, r"\?ncid=rss$", ""), link)


def web_url(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit("http://"), url))
