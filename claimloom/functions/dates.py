"""Months and ranges of months as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.text import once, strip

# Words for an end that has not come.
ONGOING = (
    "present", "current", "currently", "now", "ongoing", "to date", "todate", "till date", "tilldate", "to present", "date",
)
# Names of months and days, and words that say nothing in a date.
MONTHS = (
    "jan", "january", "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july", "aug", "august",
    "sep", "sept", "september", "oct", "october", "nov", "november", "dec", "december",
)
DAYS = ("mon", "monday", "tue", "tuesday", "wed", "wednesday", "thu", "thursday", "fri", "friday", "sat", "saturday", "sun", "sunday")
FILLERS = (" ", ".", ",", ";", "-", "/", "'", "at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th")

_FIRST_THREE = "jan feb mar apr may jun jul aug sep oct nov dec"
#: A time of day, with half of the day and zone or offset behind it.
_ZONE = r"(?:\s*(?:(?!(?:JAN|FEB|MAR|APR|MAY|JUNE?|JULY?|AUG|SEPT?|OCT|NOV|DEC|MON|TUE|WED|THU|FRI|SAT|SUN)\b)[A-Z]{1,5}|z|utc|gmt)(?![A-Za-z]))?(?:\s*[+-]\d{2}:?(?:\d{2})?(?!\d))?"
_CLOCK = rf"(?<![\d.:])(?i:(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,]\d+)?)?(?:\s*([ap])m\b)?){_ZONE}(?!\d)"
_HALF = r"(?i)(?<![\d.:/-])(\d{1,2})\s*[ap]m\b"
#: Numbers that a dot or comma makes a fraction.
_FRACTION = r"(?<![\d.,])(?:\d+\.\d+|\d{2,},\d+)(?![.,]?\d)"
_TOKEN = r"[a-z]+|\d+|[^a-z\d]"


def _timeless(text: Column) -> Column:
    """A text without its time of day; null where that is no time."""
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(text, _CLOCK, k), F.lit("")), F.lit("99")).cast("int")
    half = F.try_to_number(F.nullif(F.regexp_extract(text, _HALF, 1), F.lit("")), F.lit("99")).cast("int")
    told = F.regexp_extract(text, _CLOCK, 4) != ""
    fits = (part(1) <= F.when(told, 12).otherwise(23)) & (part(2) < 60) & (F.coalesce(part(3), F.lit(0)) < 60)
    return (
        F.when(F.contains(text, F.lit(":")), F.when(fits, F.regexp_replace(text, _CLOCK, " ")))
        .when(half.isNotNull(), F.when(half <= 12, F.regexp_replace(text, _HALF, " ")))
        .otherwise(text)
    )


def _slot(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("int").alias("value"))


def _slots(tokens: Column) -> Column:
    """What each token says: month M, number N, four-digit year Y, nothing (empty), or that this is no date (X)."""
    number = lambda t, start, n: F.substring(t, start, n)

    def told(t: Column, i: Column) -> Column:
        following = F.get(tokens, i + 1)
        day_before_word = ~F.coalesce(following.rlike("^[a-z]"), F.lit(False)) | following.isin(*FILLERS) | (F.length(t) < 3)
        # a dash, slash or dot behind a number joins it to a number or month
        joined = following.isin("-", "/", ".") & F.coalesce(F.get(tokens, i + 2).rlike("^[a-z]") & ~F.get(tokens, i + 2).isin(*FILLERS, *MONTHS), F.lit(False))
        month = (F.instr(F.lit(_FIRST_THREE), F.substring(t, 1, 3)) + 3) / 4
        return (
            F.when(t.rlike(r"^\d") & joined, F.array(_slot("X", F.lit(None))))
            .when(t.isin(*FILLERS, *DAYS), F.array().cast("array<struct<kind:string,value:int>>"))
            .when(t.isin(*MONTHS), F.array(_slot("M", month)))
            .when(t.rlike(r"^(?:\d{8}|\d{12}|\d{14})$"), F.array(_slot("Y", number(t, 1, 4)), _slot("N", number(t, 5, 2)), _slot("N", number(t, 7, 2))))
            .when(t.rlike(r"^\d{4}$") & day_before_word, F.array(_slot("Y", t)))
            .when(t.rlike(r"^\d{1,2}$"), F.array(_slot("N", t)))
            .otherwise(F.array(_slot("X", F.lit(None))))
        )

    return F.flatten(F.transform(tokens, told))


def _resolved(s: Column) -> Column:
    """``YYYY-MM`` of the slots of a date: a month's name and a year hold, numbers are month, day, year unless they can't be."""
    value = lambda k: F.get(s, F.lit(k))["value"]
    is_name = lambda k: F.coalesce(F.get(s, F.lit(k))["kind"] == "M", F.lit(False))
    a, b, c = value(0), value(1), value(2)
    one = F.lit(1)
    date = lambda year, month, day: F.struct(year.alias("y"), month.alias("m"), day.alias("d"))
    two = (
        F.when(is_name(0), date(b, a, one)).when(is_name(1), date(a, b, one)).when(a > 31, date(a, b, one)).otherwise(date(b, a, one))
    )
    three = (
        F.when(is_name(0), F.when(b > 31, date(b, a, c)).otherwise(date(c, a, b)))
        .when(is_name(1), F.when(a > 31, date(a, b, c)).otherwise(date(c, b, a)))
        .when(is_name(2), F.when(b > 31, date(b, c, a)).otherwise(date(a, c, b)))
        .when(a > 31, date(a, b, c))
        .when(a > 12, date(c, b, a))
        .otherwise(date(c, a, b))
    )
    # a fourth number of two or four digits is a time without colon
    fourth = F.get(s, F.lit(3))
    clock = F.when(fourth["kind"] == "Y", (fourth["value"] <= 2359) & (fourth["value"] % 100 < 60)).otherwise((fourth["kind"] == "N") & (fourth["value"] < 24))
    n = F.size(s)
    whole = F.when(n == 1, date(a, one, one)).when(n == 2, two).when((n == 3) | ((n == 4) & clock), three)
    only = F.slice(s, 1, 3)
    names = F.size(F.filter(only, lambda x: x["kind"] == "M"))
    years = F.size(F.filter(only, lambda x: x["kind"] == "Y"))
    good = (n > 0) & ~F.exists(s, lambda x: x["kind"] == "X") & (names <= 1) & (years == 1)

    def told(d: Column) -> Column:
        text = F.concat(F.lpad(d["y"].cast("string"), 4, "0"), F.lit("-"), F.lpad(d["m"].cast("string"), 2, "0"))
        real = F.try_to_timestamp(F.concat(text, F.lit("-"), F.lpad(d["d"].cast("string"), 2, "0")), F.lit("yyyy-MM-dd"))
        return F.when(d["y"].between(1900, 2100) & d["m"].between(1, 12) & d["d"].between(1, 31) & real.isNotNull(), text)

    return F.when(good, once(whole, told))


def year_month(c: Column) -> Column:
    """``YYYY-MM`` of one date in free form; January where only a year is given; null for anything else and outside 1900 to 2100.

    A text is tokens of months, days, numbers and fillers in any order, with a time and zone that are left aside; one of its
    numbers must be a year of four digits (or the first four of a run of 8, 12 or 14).
    """

    def read(text: Column) -> Column:
        # only what holds four digits in a row can name a year: anything else ends here
        free = F.when(~F.lower(text).isin(*ONGOING) & text.rlike(r"\d{4}"), _timeless(text))
        plain = F.when(~free.rlike(_FRACTION), F.lower(free))
        return once(F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0)), lambda tokens: once(_slots(tokens), _resolved))

    return once(strip(c), read)


def date_range(c: Column) -> Column:
    """struct(start, end) of a range of dates; a single date is a start."""
    text = F.regexp_replace(strip(c), "[–—−‐‒]", "-")
    compact = r"(?i)\A(\d{4})\s*-\s*(\d{4}|present|current|now)\z"

    def read(t: Column) -> Column:
        cut = F.when(t.rlike(compact), F.split(t, "-")).otherwise(F.split(t, r"(?i)\s+(?:-|to|through|until)\s+", 2))
        return F.transform(cut, year_month)

    both = F.transform(F.array(text), read)
    return F.get(F.transform(both, lambda d: F.struct(F.get(d, F.lit(0)).alias("start"), F.get(d, F.lit(1)).alias("end"))), F.lit(0))
