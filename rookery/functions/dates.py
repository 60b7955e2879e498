"""Dates, ages and pay. "Today" and "now" are always parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """YYYY-MM-DD as it stands, else the day of a date, a time stamp or a long form such as 3 May 2026; null if none fits."""
    trimmed = F.trim(text)
    forms = ["yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d-MMM-yyyy", "yyyy/MM/dd"]
    parsed = F.coalesce(*(F.date_format(F.try_to_timestamp(trimmed, F.lit(f)), "yyyy-MM-dd") for f in forms))
    return F.when(trimmed.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), trimmed).otherwise(parsed)


def epoch(value: Column) -> Column:
    """A time stamp from seconds or, from 10^12 on, milliseconds; null for 0 and less."""
    return F.when(value <= 0, None).when(value < 1e12, F.timestamp_seconds(value)).otherwise(F.timestamp_millis(value.cast("long")))


_UNITS = {"hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}


def relative_day(text: Column, today: Column) -> Column:
    """The day of "Posted 3 Days Ago", "yesterday", "about 1 month ago"; null for open ends such as 30+ days."""
    lower = F.lower(text)
    n = F.coalesce(F.nullif(F.regexp_extract(lower, r"([0-9]+)\s+(?:hour|day|week|month|year)", 1), F.lit("")).cast("int"), F.when(lower.rlike(r"\ban?\s+(?:hour|day|week|month|year)"), 1))
    unit = F.regexp_extract(lower, r"(hour|day|week|month|year)s?", 1)
    days = F.coalesce(*(F.when(unit == u, n * d) for u, d in _UNITS.items()))
    return (
        F.when(lower.rlike(r"[0-9]\+"), None)
        .when(lower.contains("yesterday"), F.date_sub(today, 1))
        .when(lower.rlike(r"\b(today|just now|just posted)\b"), today)
        .when(days.isNotNull(), F.date_sub(today, days))
    )


def sheet_date(text: Column) -> Column:
    """A spreadsheet's date: ISO, Y/M/D, M/D/Y, or D/M/Y if the first number is above 12; null out of range."""
    t = F.trim(text)
    part = lambda p, g: F.regexp_extract(t, p, g).try_cast("int")
    ymd, xxy = r"^([0-9]{4})[/-]([0-9]{1,2})[/-]([0-9]{1,2})", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    day = lambda y, m, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    return (
        F.when(t.rlike(ymd), day(part(ymd, 1), part(ymd, 2), part(ymd, 3)))
        .when(t.rlike(xxy) & (part(xxy, 1) > 12), day(part(xxy, 3), part(xxy, 2), part(xxy, 1)))
        .when(t.rlike(xxy), day(part(xxy, 3), part(xxy, 1), part(xxy, 2)))
    )


def age_days(start: Column, end: Column) -> Column:
    """Whole days between two time stamps, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil((end.cast("double") - start.cast("double")) / 86_400)).cast("int")


def age_label(day: Column, today: Column) -> Column:
    days = F.datediff(today, day)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit("d")))


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def annual_pay(text: Column) -> Column:
    """(low, high) a year from "$120K - $150k", "120,000 to 150,000", "$50/hr"; null without a number of money."""
    pattern = r"\$?\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([kK])?(?:\s?(?:-|–|to)\s?\$?\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([kK])?)?"
    number = lambda g: F.nullif(F.replace(F.regexp_extract(text, pattern, g), F.lit(","), F.lit("")), F.lit("")).try_cast("double")
    kilo = lambda *gs: F.when(F.greatest(*(F.length(F.regexp_extract(text, pattern, g)) for g in gs), F.lit(0)) > 0, 1_000).otherwise(1)
    times = F.when(F.lower(text).rlike(r"/\s?(hr|hour)|per hour|hourly"), 2_080).when(F.lower(text).rlike(r"/\s?mo|per month|monthly"), 12).otherwise(1)
    low, high = number(1) * kilo(2, 4) * times, F.coalesce(number(3), number(1)) * kilo(4, 2) * times
    return F.when(low.isNotNull(), F.struct(low.alias("low"), high.alias("high")))
