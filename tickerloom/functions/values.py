"""Numbers, dates and null handling as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, time, timedelta

from pyspark.sql import Column, functions as F

# Every character Python's str.strip() and str.split() treat as blank.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a character class; patterns that use it start with (?U).
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def fixed(value: Column, digits: int) -> Column:
    """Text of ``value`` with ``digits`` decimals, rounded half-even on the
    exact binary value, without thousands separators."""
    return F.replace(F.format_number(value.cast("double"), digits), F.lit(","), F.lit(""))


def rounded(value: Column, digits: int) -> Column:
    """``fixed`` as a number; an infinite value stays as it is."""
    return F.coalesce(fixed(value, digits).try_cast("double"), value.cast("double"))


def exact(value: Column) -> Column:
    """Six decimals, exactly added; not-a-number and infinity count as missing."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).cast("decimal(28,6)")


def exact_sum(value: Column) -> Column:
    """A sum that is the same whatever order the rows arrive in."""
    return F.sum(exact(value)).cast("double")


def exact_mean(value: Column) -> Column:
    """Mean over ``exact_sum``; null without values."""
    return F.try_divide(exact_sum(value), F.count(exact(value)))


def share_percent(part: Column, total: Column) -> Column:
    """``part`` of ``total`` in percent; 0 when there is no total."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def pad_left(text: Column, width: int) -> Column:
    """Right-align without ever cutting longer text."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))), text)


def pad_right(text: Column, width: int) -> Column:
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))))


def percent_bar(percent: Column) -> Column:
    """One block per full five percent."""
    return F.repeat(F.lit("█"), F.floor(percent / 5).cast("int"))


def billions(value: Column) -> Column:
    return F.concat(fixed(value / 1e9, 1), F.lit("B"))


def number_text(value: Column) -> Column:
    """A double as plain digits: whole numbers without a decimal point, no
    exponent, no separators."""
    return F.call_function("format_number", value.cast("double"), F.lit("0.####################"))


def first_nonblank(columns: Sequence[Column], default: str | None = None) -> Column:
    """The first column whose stripped text is not empty, stripped."""
    found = [F.nullif(strip(c), F.lit("")) for c in columns]
    if default is not None:
        found.append(F.lit(default))
    return F.coalesce(*found)


def first_filled(columns: Sequence[Column], default: str | None = None) -> Column:
    """The first column that is neither null nor empty, as it stands."""
    found = [F.nullif(c, F.lit("")) for c in columns]
    if default is not None:
        found.append(F.lit(default))
    return F.coalesce(*found)


def display(code: Column, names: Mapping[str, str], lower: bool = False) -> Column:
    """Look ``code`` up in a small fixed mapping; unmatched codes stay."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    key = F.lower(code) if lower else code
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), code)


def lenient_timestamp(text: Column) -> Column:
    """Wall-clock timestamp; unreadable text becomes null."""
    return text.try_cast("timestamp_ntz")


# fixed values: month names of feed dates
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
FEED_DATE = r"(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2})(:\d{2})?"


def feed_timestamp(text: Column) -> Column:
    """``Tue, 31 Mar 2026 07:00:00 GMT`` -> wall clock, zone dropped.

    Weekday and seconds may be left out, as the format allows. Put together as an ISO text, so that the session's zone plays no part.
    """
    month_numbers = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])
    day, month, year, clock, seconds = (F.regexp_extract(text, FEED_DATE, i) for i in range(1, 6))
    seconds = F.when(seconds == "", F.lit(":00")).otherwise(seconds)
    date = F.concat(year, F.lit("-"), F.try_element_at(month_numbers, month), F.lit("-"), F.lpad(day, 2, "0"))
    return lenient_timestamp(F.concat(date, F.lit(" "), clock, seconds))


def wall_clock(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss[.f]``, the same in every session zone."""
    return lenient_timestamp(ts).cast("string")


def day_text(ts: Column) -> Column:
    return F.substring(wall_clock(ts), 1, 10)


def clock_text(ts: Column) -> Column:
    return F.substring(wall_clock(ts), 1, 19)


def dotted_text(ts: Column) -> Column:
    shown = wall_clock(ts)
    return F.concat(F.translate(F.substring(shown, 1, 10), "-", "."), F.lit("  "), F.substring(shown, 12, 5))


def stamp_text(ts: Column) -> Column:
    """``yymmdd``."""
    return F.replace(F.substring(wall_clock(ts), 3, 8), F.lit("-"), F.lit(""))


def month_text(day: Column) -> Column:
    return F.substring(day, 1, 7)


def publish_bounds(as_of: datetime) -> tuple[datetime, datetime]:
    """First and last moment of the crawl window seen from ``as_of``.

    Three days back at 00:00 to yesterday 23:59; seconds stay as they are.
    """

    def moment(days_back: int, hour: int, minute: int) -> datetime:
        day = as_of.date() - timedelta(days=days_back)
        return datetime.combine(day, time(hour, minute, as_of.second, as_of.microsecond))

    return moment(3, 0, 0), moment(1, 23, 59)


def in_publish_window(ts: Column, as_of: datetime) -> Column:
    first, last = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in publish_bounds(as_of))
    return ts.between(first, last)
