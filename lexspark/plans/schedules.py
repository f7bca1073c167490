"""Queries over times of a day, on the timestamps of events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import schedule as sc
from lexspark.functions import text as fx
from lexspark.plans.catalogue import query
from lexspark.sources.tables import table

TIMETABLE, FIRST_TOMORROW = [("fajr", 270), ("dhuhr", 750), ("asr", 960), ("maghrib", 1140), ("isha", 1230)], 272
ZONE, ZONE_HOURS = "Asia/Riyadh", 3
TODAY = "1998-08-02"


def _seconds(c):
    return (F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)).cast("long")


_S = "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)"


def _case(cases: list[tuple[str, object]], last: object) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v!r}" for c, v in cases) + f" ELSE {last} END"


_LATER, _BEGUN = [(f"s < {60 * m}", (n, 60 * m)) for n, m in TIMETABLE], [
    (f"s >= {60 * m}", (n, 60 * m)) for n, m in reversed(TIMETABLE)
]
_NEXT = _case([(c, v[1]) for c, v in _LATER], 86400 + 60 * FIRST_TOMORROW)
_BEFORE = _case([(c, v[1]) for c, v in _BEGUN], 60 * TIMETABLE[-1][1] - 86400)


@query(
    f"WITH e AS (SELECT event_id, {_S} AS s FROM events), a AS (SELECT *, {_NEXT} AS n, {_BEFORE} AS b FROM e) SELECT "
    f"event_id, {_case([(c, v[0]) for c, v in _LATER], repr(TIMETABLE[0][0]))} AS next, CAST(n - s AS BIGINT) AS seconds_until, "
    f"s >= {60 * TIMETABLE[-1][1]} AS tomorrow, CASE WHEN s - b <= {sc.CURRENT_S} "
    f"THEN {_case([(c, v[0]) for c, v in _BEGUN], 'NULL')} END AS current, least(1.0, greatest(0.0, (s - b) / (n - b))) AS "
    f"progress FROM a"
)
def schedule_next(spark, d):
    return table(spark, d, "events").select(
        "event_id", sc.next_entry(_seconds(F.col("ts")), TIMETABLE, FIRST_TOMORROW).alias("_n")
    ).select("event_id", "_n.*")


@query(f"SELECT event_id, strftime(ts, '%H:%M') || ' (+03)' AS raw, hour(ts) * 60 + minute(ts) AS minutes, (hour(ts) * 60 + "
    f"minute(ts) + least(10, greatest(-10, user_id % 31 - 15)) + 1440) % 1440 AS shifted, strftime(ts, '%H:%M') AS label, CASE "
    f"WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || strftime(ts, ':%M') || CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' "
    f"PM' END AS label_12, CASE WHEN hour(ts) > 0 THEN strftime(ts, '%H:') ELSE '' END || strftime(ts, '%M:%S') AS countdown "
    f"FROM events")
def time_labels(spark, d):
    t = F.col("ts")
    raw = F.concat(F.date_format(t, "HH:mm"), F.lit(" (+03)"))
    m = sc.minutes_of(raw)
    return table(spark, d, "events").select(
        "event_id", raw.alias("raw"), m.alias("minutes"), sc.shifted(m, F.col("user_id") % 31 - 15).alias("shifted"),
        sc.time_label(m, twelve=False).alias("label"), sc.time_label(m).alias("label_12"),
        sc.countdown(_seconds(t)).alias("countdown")
    )


@query(f"WITH z AS (SELECT event_id, ts + INTERVAL {ZONE_HOURS} HOUR AS ts FROM events) SELECT event_id, CAST(ts AS DATE) AS "
    f"day, {_S} AS second_of_day FROM z")
def zoned_now(spark, d):
    day, second = sc.local_time(F.col("ts"), ZONE)
    return table(spark, d, "events").select("event_id", day.alias("day"), second.alias("second_of_day"))


_D = f"date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}')"


@query(f"WITH o AS (SELECT {_D} AS d FROM orders), u AS (SELECT CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN "
    f"d < 7 THEN 'days' WHEN d < 14 THEN 'week' WHEN d < 30 THEN 'weeks' ELSE 'months' END AS unit, CASE WHEN d <= 0 THEN 0 "
    f"WHEN d = 1 THEN 1 WHEN d < 7 THEN d WHEN d < 14 THEN 1 WHEN d < 30 THEN d // 7 ELSE d // 30 END AS n FROM o) SELECT unit, "
    f"CAST(n AS INT) AS n, count(*) AS n_orders FROM u GROUP BY ALL")
def age_buckets(spark, d):
    days = F.date_diff(F.lit(TODAY).cast("date"), F.to_date("o_orderdate"))
    return table(spark, d, "orders").select(sc.age_bucket(days).alias("_b")).select("_b.*").groupBy("unit", "n").agg(F.count(F.lit(1)).alias("n_orders"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, (dayofyear(o_orderdate) * 379 + year(o_orderdate) * 7) % 6236 AS "
    "row_number FROM orders")
def row_of_day(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(day.alias("day")).distinct().select(
        "day", sc.row_of_day(F.col("day"), 6236).alias("row_number")
    )


@query("SELECT c_custkey, floor(c_acctbal / 1e4 * 1000 + 0.5) / 1000 AS rounded, CAST(least(7, greatest(1, ceil(c_acctbal / 1e4 "
    "* 7))) AS INT) AS row_reached FROM customer")
def rounded_and_reached(spark, d):
    x = F.col("c_acctbal") / 1e4
    return table(spark, d, "customer").select("c_custkey", sc.rounded(x).alias("rounded"), sc.row_at(x, 7).alias("row_reached"))


@query("WITH e AS (SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INT) AS k FROM events) SELECT event_id, CASE WHEN k "
    "BETWEEN 18 AND 40 THEN k ELSE 26 END AS size FROM e")
def settings_with_defaults(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").select("event_id", F.when(k.between(18, 40), k).otherwise(26).alias("size"))


@query("WITH s AS (SELECT c_mktsegment, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer GROUP BY 1) SELECT "
    "c_mktsegment, 1 AS place, 'least' AS key, least AS value FROM s UNION ALL SELECT c_mktsegment, 2, 'most', most FROM s")
def unpivoted_rows(spark, d):
    s = table(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most")
    )
    return s.select("c_mktsegment", F.expr("stack(2, 1, 'least', least, 2, 'most', most) AS (place, key, value)"))


@query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, CASE WHEN max(n) OVER () = 0 "
    "THEN 0.0 ELSE greatest(4.0, n / max(n) OVER () * 100) END AS bar FROM s")
def bar_scaling(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    top = s.agg(F.max("n").alias("_top"))  # one row
    return s.crossJoin(F.broadcast(top)).select(
        "source", F.when(F.col("_top") == 0, 0.0).otherwise(F.greatest(F.lit(4.0), F.col("n") / F.col("_top") * 100)).alias("bar")
    )


@query("SELECT s_suppkey, concat_ws(', ', n_name, r_name) AS place, CASE WHEN n_nationkey = n_regionkey THEN CAST(n_nationkey "
    "AS VARCHAR) ELSE n_regionkey || '–' || n_nationkey END AS keys FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN "
    "region ON n_regionkey = r_regionkey")
def place_labels(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", sc.place_label([F.col("n_name")], F.col("r_name")).alias("place"),
        fx.range_label(F.col("n_regionkey"), F.col("n_nationkey")).alias("keys")
    )
