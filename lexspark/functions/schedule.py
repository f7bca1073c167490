"""Column expressions over times of a day: minutes since midnight, labels, countdowns, the next entry of a timetable."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.text import eastern_digits

DAY_MINUTES, DAY_SECONDS = 1440, 86_400
#: Largest correction of a time, in minutes, and how long an entry counts as current, in seconds.
LARGEST_SHIFT, CURRENT_S = 10, 1200


def minutes_of(text: Column) -> Column:
    """Minutes since midnight of a text that begins with a time; null if it doesn't, or for a time that isn't of a day."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^(\d{1,2}):(\d{2})", i).try_cast("int")
    return F.when((part(1) < 24) & (part(2) < 60), part(1) * 60 + part(2))


def shifted(minutes: Column, shift: Column) -> Column:
    """A time moved by whole minutes, at most LARGEST_SHIFT either way, around midnight too; a null shift is 0."""
    whole = F.greatest(F.lit(-LARGEST_SHIFT), F.least(F.lit(LARGEST_SHIFT), F.floor(F.coalesce(shift, F.lit(0)) + 0.5)))
    return F.pmod(minutes + whole, F.lit(DAY_MINUTES)).cast("int")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def time_label(minutes: Column, twelve: bool = True, arabic: bool = False) -> Column:
    """A time as shown; a dash for null."""
    whole = F.pmod(F.floor(minutes + 0.5), F.lit(DAY_MINUTES)).cast("int")
    hour, minute = F.floor(whole / 60).cast("int"), whole % 60
    digits = eastern_digits if arabic else lambda c: c
    if twelve:
        early, late = ("ص", "م") if arabic else ("AM", "PM")
        of_half = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
        label = F.concat(
            digits(F.concat(of_half.cast("string"), F.lit(":"), _two(minute))),
            F.when(hour < 12, f" {early}").otherwise(f" {late}")
        )
    else:
        label = digits(F.concat(_two(hour), F.lit(":"), _two(minute)))
    return F.coalesce(label, F.lit("—"))


def countdown(seconds: Column) -> Column:
    """Hours, minutes and seconds, without the hours if there are none; never below zero, null is zero."""
    s = F.greatest(F.lit(0), F.floor(F.coalesce(seconds, F.lit(0)))).cast("long")
    hours = F.floor(s / 3600)
    tail = F.concat(_two(F.floor(s % 3600 / 60)), F.lit(":"), _two(s % 60))
    return F.when(
        hours > 0, F.concat(F.when(hours < 100, _two(hours)).otherwise(hours.cast("string")), F.lit(":"), tail)
    ).otherwise(tail)


def local_time(ts: Column, zone: str) -> tuple[Column, Column]:
    """Date and second of the day of a moment in a zone."""
    there = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    return F.to_date(there), (F.hour(there) * 3600 + F.minute(there) * 60 + F.second(there)).cast("long")


def local_time_in(ts: Column, zone: Column, fallback: str) -> tuple[Column, Column]:
    """The same with a zone for each row; one that isn't known, or null, is the fallback."""
    known = F.when(F.array_contains(F.lit(sorted(available_timezones())), zone), zone).otherwise(fallback)
    there = F.from_utc_timestamp(ts.cast("timestamp"), known)
    return F.to_date(there), (F.hour(there) * 3600 + F.minute(there) * 60 + F.second(there)).cast("long")


def next_entry(now: Column, timetable: list[tuple[str, int]], first_tomorrow: int, current_s: int = CURRENT_S) -> Column:
    """Struct of the next entry after a second of the day.

    timetable: names and minutes, ascending; it's a part of the plan. next, seconds_until, tomorrow,
    current (null if none began at most current_s ago) and progress from the entry before to the
    next. After the last entry comes tomorrow's first; before the first one, yesterday's last.
    """
    at = [(name, 60 * m) for name, m in timetable]
    pick = lambda cases, last: F.coalesce(*[F.when(c, v) for c, v in cases], last)
    later, begun = [(now < s, (n, s)) for n, s in at], [(now >= s, (n, s)) for n, s in reversed(at)]
    next_s = pick([(c, F.lit(s)) for c, (_, s) in later], F.lit(DAY_SECONDS + 60 * first_tomorrow))
    before = pick([(c, F.lit(s)) for c, (_, s) in begun], F.lit(at[-1][1] - DAY_SECONDS))
    name = pick([(c, F.lit(n)) for c, (n, _) in begun], F.lit(None).cast("string"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (now - before) / (next_s - before)))
    return F.when(now.isNotNull(), F.struct(
        pick(
            [(c, F.lit(n)) for c, (n, _) in later], F.lit(at[0][0])
        ).alias("next"), (next_s - now).cast("long").alias("seconds_until"), (now >= at[-1][1]).alias("tomorrow"),
        F.when(now - before <= current_s, name).alias("current"), share.alias("progress"),
    ))


def age_bucket(days: Column) -> Column:
    """How long ago, in words: today, yesterday, days, one week, weeks or months, with the number of these."""
    case = lambda unit, n: F.struct(F.lit(unit).alias("unit"), n.cast("int").alias("n"))
    return (
        F.when(days <= 0, case("today", F.lit(0))).when(days == 1, case("yesterday", F.lit(1))).when(days < 7, case("days", days))
        .when(days < 14, case("week", F.lit(1))).when(
            days < 30, case("weeks", F.floor(days / 7))
        ).otherwise(case("months", F.floor(days / 30)))
    )


def row_of_day(day: Column, n: int) -> Column:
    """The row, of n, that a day shows."""
    return F.pmod(F.dayofyear(day) * 379 + F.year(day) * 7, F.lit(n))


def rounded(x: Column) -> Column:
    """Three decimals, halves upwards."""
    return F.floor(x * 1000 + 0.5) / 1000


def row_at(fraction: Column, n: int) -> Column:
    """The row that is reached after a fraction of n rows."""
    return F.least(F.lit(n), F.greatest(F.lit(1), F.ceil(fraction * n))).cast("int")


def place_label(parts: list[Column], country: Column, sep: str = ", ") -> Column:
    """The first part that isn't empty, and the country."""
    full = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(sep, F.coalesce(*map(full, parts)), full(country))


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def api_path(day: Column) -> Column:
    return F.date_format(day, "dd-MM-yyyy")


def gregorian_label(day: Column) -> Column:
    """Weekday, month, day and year in English."""
    return F.date_format(day, "EEEE, MMMM d, yyyy")


def hijri_parts(day: Column, month_ar: Column, month_en: Column, year: Column) -> Column:
    """Struct of a date's parts, month names standing in for each other; null without a day, a year or a month."""
    full = lambda c: F.nullif(c, F.lit(""))
    ar, en = F.coalesce(full(month_ar), full(month_en)), F.coalesce(full(month_en), full(month_ar))
    return F.when(
        full(day).isNotNull() & full(year).isNotNull() & ar.isNotNull(),
        F.struct(day.alias("day"), ar.alias("month_ar"), en.alias("month_en"), year.alias("year"))
    )


def hijri_label(parts: Column, arabic: bool) -> Column:
    """The date as shown; empty for null parts."""
    if arabic:
        shown = F.concat(
            eastern_digits(parts["day"]), F.lit(" "), parts["month_ar"], F.lit(" "), eastern_digits(parts["year"]), F.lit("هـ")
        )
    else:
        shown = F.concat_ws(" ", parts["day"], parts["month_en"], parts["year"], F.lit("AH"))
    return F.when(parts.isNotNull(), shown).otherwise("")


def updated_label(ms: Column, zone: str, twelve: bool = True) -> Column:
    """The time of the day at which something was last updated; empty if it never was."""
    _, second = local_time(F.timestamp_millis(ms), zone)
    return F.when(ms > 0, time_label(F.floor(second / 60), twelve)).otherwise("")
