"""Lenient reading of numbers and times from text, and similarity of names, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
#: Epoch values below this are seconds, others milliseconds.
EPOCH_SECONDS_BELOW = 1e10


def number(text: Column) -> Column:
    """The number that a text begins with; null for none, for empty texts and for words such as nan."""
    return F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit("")).try_cast("double")


def is_number(text: Column) -> Column:
    """Whether the whole text is a number."""
    return F.coalesce(F.trim(text).rlike(NUMBER + r"\s*$"), F.lit(False))


def normal_name(name: Column) -> Column:
    """A field's name in lower case without separators."""
    return F.regexp_replace(F.lower(name), r"[_\-\s.]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _day_first(first: Column, second: Column, order: str) -> Column:
    a, b = first.try_cast("int"), second.try_cast("int")
    return F.when(a > 12, True).when(b > 12, False).otherwise(order == "international")


def timestamp(text: Column, order: str = "us") -> Column:
    """A time in UTC from ISO 8601, slashed, dashed, dotted, compact, day-of-year and epoch layouts; null if it is none.

    order, us or international, says which of two small numbers before a year is the month. Fractions
    are cut to milliseconds. Years before 1000 are null.
    """
    # Most texts are plain ISO 8601; only others come to the rest.
    plain = F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]|\s*$)"), F.date_trunc("millisecond", text.try_cast("timestamp")))
    return F.coalesce(F.when(F.year(plain) >= 1000, plain), _other_timestamp(F.trim(text), order))


def _other_timestamp(t: Column, order: str) -> Column:
    short = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})(.*)$"
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    first, second = part(short, 1), part(short, 2)
    day_first = _day_first(first, second, order)
    turned = F.concat(part(short, 3), F.lit("-"), F.when(day_first, second).otherwise(first), F.lit("-"), F.when(day_first, first).otherwise(second), part(short, 4))
    long = r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(.*)$"
    compact = r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2}):?(\d{2}):?(\d{2})(\.\d+)?)?Z?$"
    julian = r"^(\d{4})[-.]?(\d{3})(?:[T ](\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?Z?$"
    new_year = F.make_date(F.nullif(part(julian, 1), F.lit("")).cast("int"), F.lit(1), F.lit(1))
    of_year = F.concat_ws(" ", F.date_format(F.date_add(new_year, F.nullif(part(julian, 2), F.lit("")).cast("int") - 1), "yyyy-MM-dd"), F.nullif(part(julian, 3), F.lit("")))
    digits = F.concat(part(compact, 1), F.lit("-"), part(compact, 2), F.lit("-"), part(compact, 3), F.when(part(compact, 4) != "", F.concat(F.lit(" "), part(compact, 4), F.lit(":"), part(compact, 5), F.lit(":"), part(compact, 6), part(compact, 7))).otherwise(""))
    epoch = t.try_cast("double")
    seconds = F.when(epoch < EPOCH_SECONDS_BELOW, epoch).otherwise(epoch / 1000)
    iso = (
        F.when(t.rlike(short), turned)
        .when(t.rlike(long), F.concat_ws("-", part(long, 1), part(long, 2), F.concat(part(long, 3), part(long, 4))))
        .when(t.rlike(compact), digits)
        .when(t.rlike(julian), of_year)
    )
    iso = F.regexp_replace(iso, r"(\.\d{3})\d+", "$1")
    whole = F.when(t.rlike(r"^\d{9,13}(\.\d+)?$"), F.timestamp_millis(F.floor(seconds * 1000))).otherwise(iso.try_cast("timestamp"))
    return F.when(F.year(whole) >= 1000, whole)


def timestamp_of_parts(year: Column, month: Column, day: Column, hour: Column | None = None, minute: Column | None = None, second: Column | None = None) -> Column:
    """A time from numbers in columns of their own; null without a year, month and day. Seconds are rounded to milliseconds."""
    zero = F.lit(0)
    whole = lambda c: zero if c is None else F.coalesce(number(c).cast("int"), zero)
    s = F.lit(0.0) if second is None else F.coalesce(number(second), F.lit(0.0))
    at = F.try_make_timestamp(number(year).cast("int"), number(month).cast("int"), number(day).cast("int"), whole(hour), whole(minute), F.lit(0))
    return F.timestamp_micros(F.unix_micros(at) + F.floor(s * 1000 + 0.5) * 1000)
