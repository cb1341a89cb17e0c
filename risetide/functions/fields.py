"""Field-level parsing: identifiers, numbers and time texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import text_or_empty

_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
_ISO = (r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,]\d+)?"
        r"(Z|[+-]\d{2}:?(?:\d{2})?)?)?$")
_RFC = (r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})[\s-]+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s-]+"
        r"(\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([a-z]+|[+-]\d{2}:?\d{2})?)?$")
# fixed values: hours east of UTC of the zone names of mail dates
ZONE_HOURS = {"EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def stable_id(prefix: str, url: Column) -> Column:
    """`prefix_` plus the first 12 hex digits of the url's md5."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(url), 1, 12))


def submission_id(url: Column) -> Column:
    """The submission id inside a forum url; null when there is none."""
    found = F.regexp_extract(url, r"(?i)/comments/([a-z0-9]+)/", 1)
    return F.when(found != "", found)


def lenient_bigint(c: Column) -> Column:
    """Numeric text to BIGINT: surrounding space allowed, fractions truncated, the rest 0."""
    text = F.trim(c.cast("string"))
    number = F.when(
        text.rlike(_NUMBER),
        F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint")),
    )
    return F.coalesce(number, F.lit(0).cast("bigint"))


def time_text(c: Column) -> Column:
    """ISO-like text to `YYYY-MM-DD HH:MM:SS`; fraction and offset are cut off, not applied."""
    plain = F.replace(collapse_edges(text_or_empty(c)), F.lit("T"), F.lit(" "))
    no_fraction = F.split_part(plain, F.lit("."), F.lit(1))
    return F.substring(F.split_part(no_fraction, F.lit("+"), F.lit(1)), 1, 19)


def collapse_edges(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def parse_time(c: Column) -> Column:
    """Timestamp of a normalised time text, without seconds or date-only allowed, null when unreadable."""
    return F.coalesce(*[
        F.try_to_timestamp(c, F.lit(f)) for f in (_TIME_FORMAT, "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    ])


def _iso_wall(c: Column) -> Column:
    """Wall-clock timestamp of an ISO 8601 text (basic or extended, short forms allowed), else null."""
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(c, _ISO, i), F.lit("")), F.lit(default))
    text = F.concat(
        part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit(" "),
        part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"),
    )
    return F.when(c.rlike(_ISO), F.try_to_timestamp(text, F.lit(_TIME_FORMAT)))


def _offset_seconds(zone: Column) -> Column:
    """Seconds east of UTC of `+0530`, `+05:30` or a zone name; unknown names count as UTC."""
    hours, minutes = (F.regexp_extract(zone, r"^[+-](\d\d):?(\d\d)?$", i) for i in (1, 2))
    number = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("0")).cast("int")
    size = number(hours) * 3600 + number(minutes) * 60
    named = F.lit(0)
    for name, east in ZONE_HOURS.items():
        named = F.when(F.upper(zone) == name, F.lit(east * 3600)).otherwise(named)
    return F.when(zone.startswith("-"), -size).when(zone.startswith("+"), size).otherwise(named)


def _rfc_wall(c: Column) -> Column:
    """Wall-clock timestamp of an RFC 822 text; the weekday, the time and seconds may be missing."""
    part = lambda i: F.regexp_extract(c, _RFC, i)
    filled = lambda i: F.lpad(F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")), 2, "0")
    month = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(part(2))) + 2) / 3).cast("int")
    year = F.when(F.length(part(3)) == 4, part(3)).when(part(3) > "68", F.concat(F.lit("19"), part(3))).otherwise(
        F.concat(F.lit("20"), part(3)))
    text = F.concat(
        year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), filled(1), F.lit(" "),
        filled(4), F.lit(":"), filled(5), F.lit(":"), filled(6),
    )
    return F.when(c.rlike(_RFC), F.try_to_timestamp(text, F.lit(_TIME_FORMAT)))


def feed_time(c: Column) -> Column:
    """UTC time text of a feed's publication time, RFC 822 or ISO 8601; null when unreadable."""
    given = collapse_edges(text_or_empty(c))
    utc = lambda wall, zone: wall - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _offset_seconds(zone))
    found = F.coalesce(
        utc(_rfc_wall(given), F.regexp_extract(given, _RFC, 7)),
        utc(_iso_wall(given), F.regexp_extract(given, _ISO, 7)),
    )
    return F.date_format(found, _TIME_FORMAT)


def published_text(c: Column, as_of: Column) -> Column:
    """An article's publication time as time text: the offset is dropped, what is no ISO time is cut
    to 19 characters, a missing value becomes `as_of`."""
    given = F.nullif(text_or_empty(c), F.lit(""))
    return F.coalesce(
        F.date_format(_iso_wall(given), _TIME_FORMAT),
        F.replace(F.substring(given, 1, 19), F.lit("T"), F.lit(" ")),
        F.date_format(as_of, _TIME_FORMAT),
    )


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds (whole part) to UTC time text."""
    return F.date_format(
        F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd HH:mm:ss"
    )

