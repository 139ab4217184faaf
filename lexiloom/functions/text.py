"""Text repair and surface features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters at which a whitespace split of a Unicode string cuts.
WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The prompt layout and the text of a missing value.
DESCRIPTION_TAG = "[user description] "
CONTENT_TAG = "\n\n[tweet content] "
NULL_TEXT = "nan"


def full_text(text: str | Column, extended: str | Column) -> Column:
    """Extended text where there is one, else the plain text."""
    return F.coalesce(_col(extended), _col(text))


def full_text_nonempty(text: str | Column, extended: str | Column) -> Column:
    """As ``full_text``, but an empty extended text counts as absent; never null."""
    return F.coalesce(F.nullif(_col(extended), F.lit("")), _col(text), F.lit(""))


def safe_text(text: str | Column, null_text: str = NULL_TEXT) -> Column:
    """String form of any column; a missing value becomes ``null_text``."""
    return F.coalesce(_col(text).cast("string"), F.lit(null_text))


def prompt(description: str | Column, text: str | Column, null_text: str = NULL_TEXT) -> Column:
    """User description and tweet in one tagged text."""
    return F.concat(
        F.lit(DESCRIPTION_TAG),
        safe_text(description, null_text),
        F.lit(CONTENT_TAG),
        safe_text(text, null_text),
    )


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal, without a regex."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("int")


def word_count(text: Column) -> Column:
    """Pieces between whitespace. A regex over all these characters is far slower."""
    spaced = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.size(F.array_remove(F.split(spaced, " "), ""))


def surface_features(text: str | Column, null_text: str = NULL_TEXT) -> dict[str, Column]:
    """Length, words, hashtags, mentions and links of one text column."""
    t = safe_text(text, null_text)
    return {
        "tweet_length": F.length(t),
        "word_count": word_count(t),
        "hashtags_count": occurrences(t, "#"),
        "mentions_count": occurrences(t, "@"),
        "urls_count": occurrences(t, "http"),
    }


def metadata_features(
    text: str | Column = "full_text",
    statuses: str | Column = "user_statuses_count",
    location: str | Column = "user_location",
) -> dict[str, Column]:
    """Surface features, the user's number of texts, and whether the user gives a location."""
    return {
        **surface_features(text),
        "total_tweets": _col(statuses),
        "is_location_available": is_available(location),
    }


def is_available(value: str | Column) -> Column:
    """0 for a missing or empty string, else 1."""
    c = _col(value)
    return F.when(c.isNull() | (c == ""), 0).otherwise(1)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
