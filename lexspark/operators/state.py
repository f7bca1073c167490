"""What a user's rows come to: upserts and patches by key, settings with defaults, guards of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions import schedule as sc
from lexspark.operators import events as ev

KEPT_READINGS, KEPT_MESSAGES = 60, 80
# The times of a day in order, which of them are moved by hand, the methods that may be chosen, and the settings where nothing is stored.
TIMES = ["fajr", "sunrise", "dhuhr", "asr", "maghrib", "isha"]
MOVED = ["fajr", "dhuhr", "asr", "maghrib", "isha"]
METHODS = [3, 5, 4, 1, 8, 9, 10, 13, 15]
DEFAULT_METHOD, DEFAULT_SCHOOL, DEFAULT_FORMAT, FORMATS = 3, 0, "system", ["12h", "24h", "system"]
CACHE_VERSION, STALE_MS = 2, 300_000
SPEEDS = [1.0, 1.25, 1.5, 2.0, 0.75]


def upserts(events: DataFrame, key: list[str], order: list[str], note: str) -> DataFrame:
    """key and note of each key's last event, trimmed; a last note that is empty or null removes the key."""
    last = events.groupBy(*key).agg(F.max_by(F.coalesce(F.trim(note), F.lit("")), F.struct(*order)).alias(note))
    return last.where(F.col(note) != "")


def patched(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of their patch where it has a value. Patches are distinct by key; those of no row are left out."""
    new = patches.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns])
    return rows.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def since_cleared(events: DataFrame, key: str, order: list[str], clears: Column) -> DataFrame:
    """The events of each key after its last one that clears."""
    at = F.struct(*order)
    last = events.where(clears).groupBy(key).agg(F.max(at).alias("_cleared"))
    return events.join(last, key, "left").where(F.col("_cleared").isNull() | (at > F.col("_cleared"))).drop("_cleared")


def readings(events: DataFrame, key: str, order: list[str], what: str, at_most: int = KEPT_READINGS) -> DataFrame:
    """The newest readings of each key, neighbours of one value as one: the first of them stays."""
    return ev.newest(ev.consecutive_distinct(events, key, order, what), key, [F.desc(c) for c in order], at_most)


def merged_settings(previous: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """key, method, school, adjustments (map) and refetch: whether method or school changed. Both sides: key, method, school, adjustments."""
    new = patch.select(key, *[F.col(c).alias(f"_{c}") for c in ("method", "school", "adjustments")])
    none = F.create_map().cast("map<string,int>")
    own, other = F.coalesce("adjustments", none), F.coalesce("_adjustments", none)
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(other, k))
    method, school = F.coalesce("_method", "method"), F.coalesce("_school", "school")
    both = previous.join(new, key, "left")
    return both.select(
        key, method.alias("method"), school.alias("school"), F.map_concat(kept, other).alias("adjustments"),
        (~method.eqNullSafe(F.col("method")) | ~school.eqNullSafe(F.col("school"))).alias("refetch"),
    )


def checked_settings(stored: Column) -> Column:
    """Struct of the settings in a JSON text; each field that doesn't hold a valid value has its default, as all have for no JSON."""
    at = lambda path: F.get_json_object(stored, f"$.{path}")
    method = at("methodId").try_cast("int")
    moved = [F.coalesce(
        F.greatest(
            F.lit(-sc.LARGEST_SHIFT), F.least(F.lit(sc.LARGEST_SHIFT), F.floor(at(f"adjustments.{t}").try_cast("double") + 0.5))
        ),
        F.lit(0)
    ).cast("int").alias(t) for t in MOVED]
    return F.struct(
        F.when(method.isin(METHODS), method).otherwise(DEFAULT_METHOD).alias("method"),
        F.when(at("school") == "1", 1).otherwise(DEFAULT_SCHOOL).alias("school"),
        F.when(at("timeFormat").isin(FORMATS), at("timeFormat")).otherwise(DEFAULT_FORMAT).alias("format"), *moved,
    )


def adjusted_times(times: Column, moves: Column) -> Column:
    """Map of the times of a day, moved by hand; sunrise never is. Both are maps by name."""
    return F.transform_values(times, lambda k, m: F.when(k == "sunrise", m).otherwise(sc.shifted(m, F.get(F.array(moves[k]), 0))))


def is_day(date_key: Column, times: Column) -> Column:
    """Whether a stored day has a date and all its times."""
    return F.coalesce(date_key.isNotNull() & F.forall(F.lit(TIMES), lambda t: times[t].isNotNull()), F.lit(False))


def cached_days(cache: DataFrame) -> DataFrame:
    """Caches of the current version with a valid today and a place; an invalid tomorrow is null. cache: id, version, label, today, tomorrow (structs of date_key and times)."""
    good = cache.where((F.col("version") == CACHE_VERSION) & F.col("label").isNotNull() & is_day(
        F.col("today.date_key"), F.col("today.times")
    ))
    return good.withColumn("tomorrow", F.when(is_day(F.col("tomorrow.date_key"), F.col("tomorrow.times")), F.col("tomorrow")))


def must_fetch(now_ms: Column, fetched_ms: Column, today: Column, cached_day: Column) -> Column:
    """Whether a cached day is too old: some minutes have passed, or the place's date is another one."""
    return (now_ms - fetched_ms > STALE_MS) | F.coalesce(today != cached_day, F.lit(False))


def stored_messages(values: DataFrame, at_most: int = KEPT_MESSAGES) -> DataFrame:
    """key, id, role, text of the valid messages in a JSON array, the last ones; none for a value that isn't one. values: key, value."""
    each = values.select(
        "key", F.posexplode(F.from_json("value", "array<struct<id: string, role: string, text: string>>")).alias("i", "m")
    )
    valid = each.where(F.col("m.id").isNotNull() & F.col("m.text").isNotNull() & F.col("m.role").isin("user", "bot"))
    return ev.newest(valid, "key", [F.desc("i")], at_most).select("key", "m.id", "m.role", "m.text")


def sought(position: Column, step: Column, duration: Column) -> Column:
    return F.greatest(F.lit(0), F.least(duration, position + step))


def track_seconds(n_verses: Column) -> Column:
    return F.greatest(F.lit(60), n_verses * 22)


def speed_after(clicks: Column) -> Column:
    """The speed after so many clicks through the speeds."""
    return F.get(F.lit(SPEEDS), F.pmod(clicks, F.lit(len(SPEEDS))).cast("int"))


def stored_bookmarks(values: DataFrame, key: str) -> DataFrame:
    """key, id, surah, ayah, place of the valid bookmarks in a JSON array, in order of chapter and verse; none for a value that isn't one. values: key, value."""
    each = values.select(
        key, F.explode(F.from_json("value", "array<struct<id: string, surahNumber: int, ayahNumber: int>>")).alias("m")
    )
    valid = each.select(
        key, "m.id", F.col("m.surahNumber").alias("surah"), F.col("m.ayahNumber").alias("ayah")
    ).dropna(subset=["id", "surah", "ayah"])
    return valid.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("surah", "ayah")))


def as_values(rows: DataFrame, key: str) -> DataFrame:
    """key and value: each row's other columns as a JSON text, for a store of values by key. A null column is left out of the text."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("value"))


def from_values(values: DataFrame, key: str, schema: str, required: list[str]) -> DataFrame:
    """The rows of such texts that are JSON of the schema and have the required columns; others are left out."""
    read = values.select(key, F.from_json("value", schema).alias("_v"))
    return read.where(F.forall(F.array(*[F.col(f"_v.{c}").isNotNull() for c in required]), lambda x: x)).select(key, "_v.*")
