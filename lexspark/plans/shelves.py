"""Queries over lists, lookups and stored state: on the driver's tables where these have the like, else on small tables of the query."""

from __future__ import annotations

import uuid

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions import text as fx
from lexspark.operators import events as ev
from lexspark.operators import lookups as lk
from lexspark.operators import state as st
from lexspark.operators.store import DELETE, PATCH, PUT, KeyedStore
from lexspark.plans.catalogue import NORM, query
from lexspark.plans.inline import CHAPTERS, PASSAGES, VERSES, Inline, with_tables
from lexspark.sources import shared
from lexspark.sources.tables import table


def norm_sql(x: str) -> str:
    return NORM.replace("(t,", f"({x},")


def ints(values: list[int]) -> str:
    return ", ".join(map(str, values))


SEARCHES = Inline("searches", "id int, query string, kind int", [
    (1, "", 0), (2, None, 1), (3, "", 2), (4, "البقرة", 0), (5, "بقره", 2), (6, "2", 0), (7, "٣٠٥", 0), (8, "604", 1),
    (9, "an", 0), (10, "AL", 0), (11, "1", 2), (12, "ناس ", 0), (13, "zz", 0),
])
_KIND = f"CASE WHEN number IN ({ints(lk.MEDINAN)}) THEN 'medinan' ELSE 'meccan' END"


@query(
    with_tables(SEARCHES, CHAPTERS) + f", s AS (SELECT *, {norm_sql('trim(coalesce(query, chr(32)))')} AS q, kind AS wanted "
        f"FROM searches) SELECT s.id, c.number FROM s, chapters c "
    f"WHERE (wanted = 0 OR {_KIND} = CASE wanted WHEN 1 THEN 'meccan' ELSE 'medinan' END) AND (q = '' OR CASE WHEN "
    f"regexp_full_match(q, '[0-9]+') "
    f"THEN number = TRY_CAST(q AS INT) OR first_page = TRY_CAST(q AS INT) ELSE contains({norm_sql('c.name')}, q) OR "
    f"contains(lower(english), q) END)"
)
def chapter_list(spark, d):
    return lk.listed_chapters(SEARCHES.df(spark), CHAPTERS.df(spark))


@query(
    with_tables(SEARCHES, CHAPTERS) + f", s AS (SELECT *, {norm_sql('coalesce(query, chr(32))')} AS q FROM searches) SELECT "
        f"s.id, c.number FROM s, chapters c "
    f"WHERE q = '' OR contains({norm_sql('c.name')}, q) OR contains(lower(english), lower(trim(coalesce(query, '')))) OR "
    f"contains(CAST(number AS VARCHAR), q)"
)
def chapter_jump_list(spark, d):
    return lk.jump_list(SEARCHES.df(spark), CHAPTERS.df(spark))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'small')")
def label_search(spark, d):
    return table(spark, d, "part").where(F.col("p_name").contains("small")).select("p_partkey", "p_name")


NAMES = Inline(
    "given", "id int, name string",
    [(1, "سورة البقرة"), (2, "البقرة"), (3, "ناس"), (4, "سُورَةُ مريم"), (5, "في سورة الفاتحة هنا"), (6, "xyz"), (7, None)]
)


@query(
    with_tables(NAMES, CHAPTERS) + ", n AS (SELECT id, name, trim(regexp_replace(regexp_replace(name, '^\\s*سُورَةُ?\\s+', ''), "
        "'^\\s*سورة\\s+', '')) AS clean FROM given) "
    "SELECT n.id, min(c.number) AS number FROM n LEFT JOIN chapters c ON c.name = n.name OR contains(c.name, clean) OR "
    "contains(clean, regexp_replace(c.name, '^سورة\\s*', '')) GROUP BY n.id"
)
def chapter_numbers_by_name(spark, d):
    return lk.chapter_by_name(NAMES.df(spark), CHAPTERS.df(spark))


_ELSE = "regexp_replace(regexp_replace(replace(o, ' ', ''), '^(al|as|at|an|ar|ad|az)', ''), '^$', '')"


@query(
    with_tables(CHAPTERS) + f", c AS (SELECT number, {norm_sql('name')} AS a, {norm_sql('english')} AS o FROM chapters), "
    "b AS (SELECT *, replace(o, ' ', '') AS one, CASE WHEN regexp_matches(replace(o, ' ', ''), '^a[lstdrzn]') THEN CASE WHEN "
    "substring(replace(o, ' ', ''), 2, 1) = substring(replace(o, ' ', ''), 3, 1) "
    "THEN substring(replace(o, ' ', ''), 4) ELSE substring(replace(o, ' ', ''), 3) END ELSE replace(o, ' ', '') END AS x FROM "
    "c), "
    "d AS (SELECT *, regexp_replace(x, '^al', '') AS bare FROM b), v AS (SELECT number, unnest([a, CASE WHEN starts_with(a, "
    "'ال') AND length(a) > 4 THEN substring(a, 3) END, o, one, "
    "CASE WHEN length(bare) > 3 THEN bare END, CASE WHEN length(bare) > 3 AND ends_with(bare, 'h') THEN regexp_replace(bare, "
    "'h$', '') END]) AS variant FROM d) "
    "SELECT variant, min(number) AS number FROM v WHERE variant <> '' GROUP BY variant"
)
def chapter_name_table(spark, d):
    return lk.name_table(CHAPTERS.df(spark))


PLACES = Inline(
    "asked", "id int, surah int, ayah int", [(1, 1, 1), (2, 1, 6), (3, 112, 4), (4, 112, 9), (5, 3, 1), (6, 114, 3), (7, None, 2)]
)
_INSIDE = "asked LEFT JOIN passages p ON p.surah = asked.surah AND asked.ayah BETWEEN ayah_start AND ayah_end"


@query(with_tables(PLACES, PASSAGES, VERSES) + f", i AS (SELECT asked.id, min(idx) AS idx FROM {_INSIDE} GROUP BY asked.id) "
    f"SELECT id, idx, coalesce(text, '') AS text FROM i JOIN asked USING (id) LEFT JOIN verses USING (surah, ayah)")
def passage_and_verse(spark, d):
    asked = PLACES.df(spark)
    verse = lk.verse_of(asked, VERSES.df(spark)).select("id", "text")
    return lk.passage_of(asked, PASSAGES.df(spark)).join(verse, "id")


@query(
    with_tables(PLACES, PASSAGES, VERSES) + ", h AS (SELECT asked.id, asked.surah, asked.ayah, min_by(ayah_start, idx) AS a, "
        "min_by(ayah_end, idx) AS b "
    f"FROM {_INSIDE.replace('LEFT JOIN', 'JOIN')} GROUP BY ALL) SELECT h.id, v.ayah FROM h JOIN verses v ON v.surah = h.surah "
    f"AND v.ayah BETWEEN a AND b AND v.ayah <> h.ayah QUALIFY row_number() OVER (PARTITION BY h.id ORDER BY v.ayah) <= 3"
)
def related_verses(spark, d):
    return lk.related(PLACES.df(spark), VERSES.df(spark), PASSAGES.df(spark), 3)


TOPICS = Inline(
    "topics", "topic string, place int, surah int, ayah int",
    [("ناس", i, 114, i + 1) for i in range(6)] + [("حمد", 0, 1, 2), ("حمد", 1, 55, 1), ("حمد", 2, 1, 3)]
)


@query(with_tables(TOPICS, VERSES) + " SELECT topic, place, surah, ayah, text FROM topics JOIN verses USING (surah, ayah) WHERE "
    "place < 4")
def topic_references(spark, d):
    return lk.topic_verses(TOPICS.df(spark), VERSES.df(spark), 4)


NOTES = Inline(
    "notes", "key string, note string", [("1:2", "a"), ("112:1", "b"), ("7:x", "c"), ("", "d"), (None, "e"), ("114:6:9", "f")]
)


@query(with_tables(NOTES, VERSES) + ", n AS (SELECT key, note, TRY_CAST(split_part(key, ':', 1) AS INT) AS surah, "
    "TRY_CAST(split_part(key, ':', 2) AS INT) AS ayah FROM notes) SELECT key, note, coalesce(text, '') AS text FROM n LEFT JOIN "
    "verses USING (surah, ayah)")
def notes_with_verses(spark, d):
    surah, ayah = lk.note_key(F.col("key"))
    return lk.verse_of(
        NOTES.df(spark).withColumns({"surah": surah, "ayah": ayah}), VERSES.df(spark)
    ).select("key", "note", "text")


POSITIONS = Inline(
    "positions", "id int, page int, position_name string, surah int, ayah int",
    [(1, 1, "مريم", 1, 7), (2, 604, None, 112, 1), (3, 99, "سورة مريم", 19, 49), (4, 98, None, 5, 5), (5, None, "x", None, None)]
)
PAGES = Inline(
    "layout", "page int, juz int, first string, second string",
    [
        (1, 1, "سُورَةُ الفاتحة", None), (604, 30, "سورة الإخلاص", "سورة الناس"), (305, 16, "مريم", None), (306, 16, None, None),
        (2, 0, None, None)
    ]
)


def _pages(spark):
    return PAGES.df(spark).select("page", "juz", F.filter(F.array("first", "second"), lambda x: x.isNotNull()).alias("surahs"))


_BARE = "trim(regexp_replace(regexp_replace({}, '^\\s*سُورَةُ?\\s+', ''), '^\\s*سورة\\s+', ''))"


@query(with_tables(POSITIONS, PAGES) + " SELECT id, " + _BARE.format("coalesce(first, position_name, 'الفاتحة')") + " AS label FROM positions LEFT JOIN layout ON layout.page = coalesce(positions.page, 1)")
def continue_reading(spark, d):
    return lk.continue_label(POSITIONS.df(spark), _pages(spark), "الفاتحة")


@query(with_tables(POSITIONS, CHAPTERS) + " SELECT id, coalesce(ayah / greatest(1, n_verses), 0.0) AS progress FROM positions "
    "LEFT JOIN chapters ON number = surah")
def chapter_progress(spark, d):
    return lk.progress_in_chapter(POSITIONS.df(spark), CHAPTERS.df(spark)).select("id", "progress")


TYPED = Inline(
    "typed", "id int, text string",
    [(1, "12"), (2, "٦٠٤"), (3, "605"), (4, "0"), (5, " 7 "), (6, "x"), (7, None), (8, ""), (9, "1"), (10, "582"), (11, "581")]
)
_TYPED = f"TRY_CAST(nullif(translate(trim(text), '{fx.DIGITS}', '{fx.WESTERN}'), '') AS INT)"


@query(
    with_tables(TYPED, PAGES) + f", t AS (SELECT id, CASE WHEN {_TYPED} BETWEEN 1 AND 604 THEN {_TYPED} END AS page FROM typed) "
    f"SELECT id, t.page, CASE WHEN t.page < 604 THEN t.page + 1 END AS after, CASE WHEN t.page > 1 THEN t.page - 1 END AS "
    f"before, CASE WHEN t.page IS NOT NULL THEN CAST(len(list_filter([{ints(lk.PART_PAGES)}], lambda p: p <= t.page)) AS INT) "
    f"END AS part, "
    "juz, concat_ws('|', first, second) AS surahs FROM t LEFT JOIN layout ON layout.page = t.page"
)
def page_navigation(spark, d):
    t = TYPED.df(spark).select("id", lk.typed_page(F.col("text")).alias("page"))
    p = F.col("page")
    return t.join(_pages(spark), "page", "left").select(
        "id", "page", lk.next_page(p).alias("after"), lk.previous_page(p).alias("before"),
        F.when(p.isNotNull(), lk.part_of_page(p)).alias("part"), "juz",
        F.coalesce(F.array_join("surahs", "|"), F.lit("")).alias("surahs"),
    )


@query(with_tables(PAGES) + " SELECT juz, min(page) AS page FROM layout WHERE juz <> 0 GROUP BY juz")
def first_page_of_part(spark, d):
    return lk.first_pages(PAGES.df(spark))


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM "
    "part) AS parts, (SELECT count(*) FROM supplier) AS suppliers")
def collection_counts(spark, d):
    one = lambda t: table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("of"), "n")
    sizes = one("customer").unionByName(one("orders")).unionByName(one("part")).unionByName(one("supplier"))
    return sizes.agg(*[
        F.max(F.when(F.col("of") == t, F.col("n"))).alias(name) for t,
        name in (("customer", "customers"), ("orders", "orders"), ("part", "parts"), ("supplier", "suppliers"))
    ])


@query("SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_nationkey), '|') AS names, count(*) AS n FROM nation GROUP "
    "BY n_regionkey")
def rows_by_group(spark, d):
    held = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("h"))
    return held.select("n_regionkey", F.array_join("h.n_name", "|").alias("names"), F.size("h").cast("long").alias("n"))


@query("SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place, o_custkey, o_orderkey FROM orders WHERE "
    "o_totalprice > 150000 ORDER BY o_custkey, o_orderkey LIMIT 30")
def first_results(spark, d):
    found = table(spark, d, "orders").where("o_totalprice > 150000").select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey").limit(lk.SHOWN_RESULTS)
    return found.withColumn("place", F.row_number().over(W.orderBy("o_custkey", "o_orderkey")).cast("long"))  # of the rows shown


@query("SELECT p_partkey, CAST(list_indexof([22, 25, 27, 30, 34], arg_min(s, abs(s - p_size) * 100 + s)) - 1 AS INT) AS step "
    "FROM part, (SELECT unnest([22, 25, 27, 30, 34]) AS s) GROUP BY p_partkey")
def nearest_steps(spark, d):
    return table(spark, d, "part").select("p_partkey", lk.nearest_step(F.col("p_size"), [22, 25, 27, 30, 34]).alias("step"))


REFERENCES = [
    (
        1, '[{"type":"quran","surah":"البقرة","ayah":"2","text":"a"},{"type":"book","surah":"","ayah":"","text":"b"}]', "[]"
    ), (2, '[{"type":"book","surah":"x","ayah":"1","text":"c"}]', '[{"surah":"مريم","ayah":"3","text":"d"}]'),
    (3, "[]", None), (4, None, None),
]
_REFS = Inline("refs", "id int, legacy string, fresh string", REFERENCES)


@query(
    with_tables(_REFS) + """, u AS (SELECT id, from_json(fresh, '[{"surah":"VARCHAR","ayah":"VARCHAR"}]') AS f, from_json(legacy, '[{"type":"VARCHAR","surah":"VARCHAR","ayah":"VARCHAR"}]') AS l FROM refs)
    SELECT id, coalesce(array_to_string(CASE WHEN len(f) > 0 THEN list_transform(f, lambda r: r.surah || ':' || r.ayah)
    ELSE list_transform(list_filter(l, lambda r: r.type = 'quran'), lambda r: r.surah || ':' || r.ayah) END, ','), '') AS shown FROM u"""
)
def shown_references(spark, d):
    one = "array<struct<surah: string, ayah: string, text: string>>"
    r = _REFS.df(spark).select(
        "id", F.from_json("fresh", one).alias("fresh"),
        F.from_json("legacy", one.replace("<surah", "<type: string, surah")).alias("legacy")
    )
    shown = lk.shown_references(F.col("fresh"), F.col("legacy"))
    return r.select(
        "id",
        F.coalesce(
            F.array_join(F.transform(shown, lambda x: F.concat(x["surah"], F.lit(":"), x["ayah"])), ","), F.lit("")
        ).alias("shown")
    )


@query("SELECT user_id, event_type, trim(CASE WHEN arg_max(value, (ts, event_id)) < 50 THEN '  ' ELSE ' ' || arg_max(event_id, "
    "(ts, event_id)) || ' ' END) AS note FROM events GROUP BY ALL HAVING note <> ''")
def notes_upserted(spark, d):
    note = F.when(F.col("value") < 50, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")))
    return st.upserts(table(spark, d, "events").withColumn("note", note), ["user_id", "event_type"], ["ts", "event_id"], "note")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE c_mktsegment END AS c_mktsegment FROM customer JOIN "
    "nation ON n_nationkey = c_nationkey")
def rows_patched(spark, d):
    c = table(spark, d, "customer")
    patches = c.where("c_custkey % 3 = 0").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.col("n_name").alias("c_mktsegment"))
    return st.patched(c.select("c_custkey", "c_mktsegment"), patches, "c_custkey", ["c_mktsegment"])


@query("WITH l AS (SELECT user_id, max((ts, event_id)) AS cleared FROM events WHERE event_type = 'purchase' GROUP BY user_id) "
    "SELECT e.user_id, count(*) AS n FROM events e LEFT JOIN l USING (user_id) WHERE cleared IS NULL OR (ts, event_id) > "
    "cleared GROUP BY e.user_id")
def events_since_cleared(spark, d):
    left = st.since_cleared(
        table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"],
        F.col("event_type") == "purchase"
    )
    return left.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT *, row_number() OVER o AS n, lag(event_type) OVER o AS b FROM events WINDOW o AS (PARTITION BY "
    "user_id ORDER BY ts, event_id)) SELECT user_id, event_id, event_type FROM w WHERE n = 1 OR b IS DISTINCT FROM event_type "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def reading_log(spark, d):
    return st.readings(
        table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 10
    ).select("user_id", "event_id", "event_type")


PREVIOUS = Inline(
    "previous", "id int, method int, school int, fajr int, asr int",
    [(1, 4, 0, 2, 0), (2, 4, 0, 1, 1), (3, 3, 1, None, None), (4, 5, 0, 5, 5)]
)
PATCHES = Inline(
    "patches", "id int, method int, school int, fajr int, isha int",
    [(1, 3, None, None, None), (2, None, 0, 7, 3), (3, None, 0, None, -2), (9, 1, 1, 1, 1)]
)


def _moves(df, names):
    entries = F.filter(
        F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in names]), lambda e: e["v"].isNotNull()
    )
    return df.select("id", "method", "school", F.map_from_entries(entries).alias("adjustments"))


@query(
    with_tables(PREVIOUS, PATCHES) + " SELECT p.id, coalesce(q.method, p.method) AS method, coalesce(q.school, p.school) AS "
        "school, coalesce(q.fajr, p.fajr) AS fajr, p.asr AS asr, q.isha AS isha, "
    "coalesce(q.method, p.method) IS DISTINCT FROM p.method OR coalesce(q.school, p.school) IS DISTINCT FROM p.school AS "
    "refetch FROM previous p LEFT JOIN patches q ON q.id = p.id"
)
def settings_merged(spark, d):
    both = st.merged_settings(_moves(PREVIOUS.df(spark), ["fajr", "asr"]), _moves(PATCHES.df(spark), ["fajr", "isha"]), "id")
    return both.select(
        "id", "method", "school", *[F.try_element_at("adjustments", F.lit(n)).alias(n) for n in ("fajr", "asr", "isha")],
        "refetch"
    )


SETTINGS = Inline("stored", "id int, value string", [
    (
        1, '{"methodId": 3, "school": 1, "timeFormat": "24h", "adjustments": {"fajr": 2.5, "isha": -30, "asr": "4"}}'
    ), (2, '{"methodId": 999, "school": 2, "timeFormat": "x"}'), (3, "not json"), (4, None), (5, "{}"),
    (6, '{"methodId": 15, "adjustments": {"fajr": "x", "maghrib": 10.4}}'),
])
_J = "(CASE WHEN json_valid(value) THEN CAST(value AS JSON) END)"
_MOVE = "CAST(coalesce(greatest(-10, least(10, floor(TRY_CAST({j}->>'$.adjustments.{t}' AS DOUBLE) + 0.5))), 0) AS INT) AS {t}"


@query(
    with_tables(SETTINGS) + f" SELECT id, CASE WHEN TRY_CAST({_J}->>'$.methodId' AS INT) IN ({ints(st.METHODS)}) THEN "
        f"TRY_CAST({_J}->>'$.methodId' AS INT) ELSE {st.DEFAULT_METHOD} END AS method, "
    f"CASE WHEN {_J}->>'$.school' = '1' THEN 1 ELSE 0 END AS school, CASE WHEN {_J}->>'$.timeFormat' IN ('12h', '24h', "
    f"'system') THEN {_J}->>'$.timeFormat' ELSE 'system' END AS format, "
    + ", ".join(_MOVE.format(j=_J, t=t) for t in st.MOVED) + " FROM stored"
)
def settings_checked(spark, d):
    return SETTINGS.df(spark).select("id", st.checked_settings(F.col("value")).alias("s")).select("id", "s.*")


DAY = Inline("days",
"id int, day string, fajr int, sunrise int, dhuhr int, asr int, maghrib int, isha int, version int, tomorrow int", [
    (
        1, "2026-07-01", 245, 330, 750, 960, 1140, 1230, 2, 250
    ), (2, "2026-07-02", 3, 330, 750, 960, 1140, 1439, 2, None), (3, None, 245, 330, 750, 960, 1140, 1230, 2, 250), (
        4, "2026-07-04", 245, 330, None, 960, 1140, 1230, 2, 250
    ),
    (5, "2026-07-05", 245, 330, 750, 960, 1140, 1230, 1, 250),
])


def _times(first="fajr"):
    return F.create_map(*[x for t in st.TIMES for x in (F.lit(t), F.col(first if t == "fajr" else t))])


@query(with_tables(DAY) + " SELECT id, (fajr - 10 + 1440) % 1440 AS fajr, sunrise, (dhuhr + 0) % 1440 AS dhuhr, (asr + 3) % "
    "1440 AS asr, (maghrib + 0) % 1440 AS maghrib, (isha + 10) % 1440 AS isha FROM days")
def adjusted_day(spark, d):
    moves = F.create_map(*[F.lit(x) for x in ("fajr", -99, "sunrise", 5, "asr", 3, "isha", 44)])
    times = st.adjusted_times(_times(), moves)
    return DAY.df(spark).select("id", *[F.element_at(times, t).alias(t) for t in st.TIMES])


_ALL = "day IS NOT NULL AND " + " AND ".join(f"{t} IS NOT NULL" for t in st.TIMES)


@query(with_tables(DAY) + f" SELECT id, day, CASE WHEN tomorrow IS NOT NULL THEN tomorrow END AS tomorrow_fajr FROM days WHERE "
    f"version = 2 AND {_ALL}")
def cached_days(spark, d):
    one = lambda first: F.struct(F.col("day").alias("date_key"), _times(first).alias("times"))
    cache = DAY.df(spark).select(
        "id", "version", F.lit("here").alias("label"), one("fajr").alias("today"), one("tomorrow").alias("tomorrow")
    )
    return st.cached_days(cache).select(
        "id", F.col("today.date_key").alias("day"), F.element_at("tomorrow.times", "fajr").alias("tomorrow_fajr")
    )


@query("SELECT event_id, value * 10000 > 300000 OR (event_id % 7 = 0 AND CAST(ts AS DATE) <> DATE '2024-01-02') AS stale FROM "
    "events")
def stale_rows(spark, d):
    cached = F.when(F.col("event_id") % 7 == 0, F.lit("2024-01-02").cast("date")).otherwise(F.to_date("ts"))
    return table(spark, d, "events").select(
        "event_id", st.must_fetch(F.col("value") * 10000, F.lit(0.0), F.to_date("ts"), cached).alias("stale")
    )


MESSAGES = Inline("messages", "key string, value string", [
    (
        "a", json.dumps([{"id": str(i), "role": ("user", "bot", "x")[i % 3], "text": f"t{i}"} for i in range(9)])
    ), ("b", "broken ["), (
        "c", '[{"id": "1", "role": "user"}, {"id": "2", "role": "bot", "text": ""}]'
    ), ("d", None), ("e", "[]"),
])


@query(
    with_tables(MESSAGES) + ", e AS (SELECT key, unnest(CAST(value AS JSON)->'$[*]') AS m, generate_subscripts(CAST(value AS "
        "JSON)->'$[*]', 1) AS i FROM messages WHERE json_valid(value)) "
    "SELECT key, m->>'$.id' AS id, m->>'$.role' AS role, m->>'$.text' AS text FROM e WHERE (m->>'$.text') IS NOT NULL AND "
    "(m->>'$.role') IN ('user', 'bot') QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) <= 4"
)
def messages_loaded(spark, d):
    return st.stored_messages(MESSAGES.df(spark), 4)


@query("SELECT event_id, greatest(0, least(300, CAST(user_id % 400 AS INT) + 15)) AS sought, greatest(60, CAST(user_id % 9 AS "
    "INT) * 22) AS seconds, CAST([1.0, 1.25, 1.5, 2.0, 0.75][event_id % 5 + 1] AS DOUBLE) AS speed FROM events")
def playback_rules(spark, d):
    u = F.col("user_id")
    return table(spark, d, "events").select(
        "event_id", st.sought((u % 400).cast("int"), F.lit(15), F.lit(300)).alias("sought"),
        st.track_seconds((u % 9).cast("int")).alias("seconds"), st.speed_after(F.col("event_id")).alias("speed")
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date_key, strftime(o_orderdate, '%d-%m-%Y') AS api_path, "
    "strftime(o_orderdate, '%A, %B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS label FROM orders")
def date_labels(spark, d):
    from lexspark.functions import schedule as sc

    day = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", sc.date_key(day).alias("date_key"), sc.api_path(day).alias("api_path"),
        sc.gregorian_label(day).alias("label")
    )


HIJRI = Inline(
    "hijri", "id int, day string, ar string, en string, year string",
    [
        (1, "8", "صَفَر", "Safar", "1448"), (2, "8", "", "Safar", "1448"), (3, "", "a", "b", "1"), (4, "9", None, None, "1448"),
        (5, "9", "رجب", None, "1448"), (6, None, "x", "y", None)
    ]
)


@query(
    with_tables(HIJRI) + ", p AS (SELECT id, coalesce(day, '') AS day, coalesce(year, '') AS year, coalesce(nullif(ar, ''), en, "
        "'') AS m_ar, coalesce(nullif(en, ''), ar, '') AS m_en FROM hijri) "
    f"SELECT id, CASE WHEN ok THEN translate(day, '0123456789', '{fx.DIGITS[:10]}') || ' ' || m_ar || ' ' || translate(year, "
    f"'0123456789', '{fx.DIGITS[:10]}') || 'هـ' ELSE '' END AS arabic, CASE WHEN ok THEN day || ' ' || m_en || ' ' || year || ' "
    f"AH' ELSE '' END AS english FROM (SELECT *, day <> '' AND year <> '' AND m_ar <> '' AS ok FROM p)"
)
def hijri_labels(spark, d):
    from lexspark.functions import schedule as sc

    parts = sc.hijri_parts(F.col("day"), F.col("ar"), F.col("en"), F.col("year"))
    return HIJRI.df(spark).select(
        "id", sc.hijri_label(parts, True).alias("arabic"), sc.hijri_label(parts, False).alias("english")
    )


@query("SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id "
    "DESC) <= 2")
def newest_two(spark, d):
    return ev.newest(
        table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 2
    ).select("user_id", "ts", "event_id")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0")
def values_kept(spark, d):
    """Suppliers as values of a store and back; every fourth value is broken."""
    values = st.as_values(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey")
    broken = values.withColumn("value", F.when(F.col("s_suppkey") % 4 == 0, F.substring("value", 1, 9)).otherwise(F.col("value")))
    return st.from_values(broken, "s_suppkey", "s_name string, s_acctbal double", ["s_name", "s_acctbal"])


@query(
    "SELECT event_id, CASE WHEN event_id = 0 THEN '' ELSE CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || strftime(ts, ':%M') || "
    "CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' PM' END END AS label FROM events"
)
def last_updated(spark, d):
    from lexspark.functions import schedule as sc

    ms = F.when(F.col("event_id") == 0, F.lit(0)).otherwise(F.unix_millis(F.col("ts").cast("timestamp")))
    return table(spark, d, "events").select("event_id", sc.updated_label(ms, "UTC").alias("label"))


_OPERATIONS = (
    "o AS (SELECT user_id, (event_id % 3) * 1000000000000 + event_id AS pos, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN "
    "'delete' ELSE 'patch' END AS op, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS state, CASE WHEN event_type "
    "IN ('signup', 'click', 'purchase') THEN value END AS value, CASE WHEN event_type IN ('signup', 'view') THEN props END AS props FROM events)"
)


@query(f"WITH {_OPERATIONS}, w AS (SELECT user_id, max(pos) AS since, arg_max(struct_pack(op := op, s := state, v := value, p := props), pos) "
    "AS b FROM o WHERE op <> 'patch' GROUP BY user_id), p AS (SELECT o.user_id, arg_max(state, pos) FILTER (WHERE state IS NOT NULL) AS s, "
    "arg_max(value, pos) FILTER (WHERE value IS NOT NULL) AS v, arg_max(props, pos) FILTER (WHERE props IS NOT NULL) AS p FROM o LEFT JOIN w "
    "USING (user_id) WHERE o.op = 'patch' AND (since IS NULL OR pos > since) GROUP BY o.user_id) SELECT user_id, coalesce(p.s, CASE WHEN "
    "b.op = 'put' THEN b.s END) AS state, coalesce(p.v, CASE WHEN b.op = 'put' THEN b.v END) AS value, coalesce(p.p, CASE WHEN b.op = 'put' "
    "THEN b.p END) AS props FROM w FULL JOIN p USING (user_id) WHERE b.op = 'put' OR p.user_id IS NOT NULL")
def events_stored(spark, d):
    """Events as puts, patches and deletes of users, written to a keyed store in three batches, the first two compacted, and read back."""
    kind, given = F.col("event_type"), lambda c, *types: F.when(F.col("event_type").isin(*types), F.col(c)).alias(c)
    operations = table(spark, d, "events").select(
        "user_id", F.when(kind.isin("signup", "purchase"), kind).alias("state"), given("value", "signup", "click", "purchase"),
        given("props", "signup", "view"), F.when(kind == "signup", PUT).when(kind == "error", DELETE).otherwise(PATCH).alias("op"),
        F.col("event_id").alias("at")
    )
    schema = operations.drop("op", "at").schema
    store = KeyedStore(spark, f"{shared.top(spark)}/events-store-{uuid.uuid4().hex}", "user_id", schema)
    for batch in range(3):
        store.write(operations.where(F.col("at") % 3 == batch), batch)
        if batch == 1:
            store.compact()
    return store.read()
