"""Days of a schedule service, from its JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import schedule as sc
from lexspark.operators.state import TIMES

ANSWER = (
    "code int, data struct<timings: map<string,string>, date: struct<hijri: struct<day: string, month: struct<number: int, en: "
    "string, ar: string>, year: string>>, "
    "meta: struct<timezone: string, method: struct<id: int, name: string>, school: string>>"
)


def request_of(day: Column, city: Column, country: Column, latitude: Column, longitude: Column, method: Column, school: Column) -> Column:
    """Path and query of a request for a day: by coordinates if both are there, else by city and country; null if one of these is blank or null.

    To be put after the service's address, as a key of ``json_urls``.
    """
    date, written = F.date_format(day, "dd-MM-yyyy"), lambda c: F.replace(F.url_encode(F.trim(c)), F.lit("+"), F.lit("%20"))
    common = F.concat(F.lit("&method="), method.cast("string"), F.lit("&school="), school.cast("string"), F.lit("&iso8601=false"))
    there = latitude.isNotNull() & longitude.isNotNull()
    at = F.concat(F.lit("timings/"), date, F.lit("?latitude="), latitude.cast("string"), F.lit("&longitude="), longitude.cast("string"), common)
    named = (F.trim(city) != "") & (F.trim(country) != "")
    of = F.concat(F.lit("timingsByCity/"), date, F.lit("?city="), written(city), F.lit("&country="), written(country), common)
    return F.when(there, at).when(named, of)


def day_of(body: Column) -> Column:
    """Struct of times (map of minutes by name), timezone, method_name and hijri; null unless the code is 200 and all six times can be read."""
    a = F.from_json(body, ANSWER)
    minutes = F.map_from_entries(F.transform(
        F.lit(TIMES),
        lambda t: F.struct(t.alias("k"), sc.minutes_of(F.try_element_at(a["data"]["timings"], F.initcap(t))).alias("m"))
    ))
    hijri = a["data"]["date"]["hijri"]
    parts = sc.hijri_parts(hijri["day"], hijri["month"]["ar"], hijri["month"]["en"], hijri["year"])
    meta = a["data"]["meta"]
    good = (a["code"] == 200) & F.forall(F.map_values(minutes), lambda m: m.isNotNull())
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.when(
        good,
        F.struct(
            minutes.alias("times"), text(meta["timezone"]).alias("timezone"), text(meta["method"]["name"]).alias("method_name"),
            parts.alias("hijri")
        )
    )


def days(answers: DataFrame) -> DataFrame:
    """key, day and the fields of ``day_of`` of the answers that are whole. answers: key, day (date), body."""
    return answers.select("key", "day", day_of(F.col("body")).alias("d")).where("d IS NOT NULL").select("key", "day", "d.*")


def with_tomorrow(whole: DataFrame) -> DataFrame:
    """Each day with the next day's times, null where that isn't there."""
    after = whole.select("key", F.date_sub("day", 1).alias("day"), F.col("times").alias("tomorrow"))
    return whole.join(after, ["key", "day"], "left")
