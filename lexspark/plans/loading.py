"""Queries over what sources give: guarded rows, page layouts and schedule days from JSON."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexspark.functions import schedule as sc
from lexspark.functions import text as fx
from lexspark.operators import state as st
from lexspark.plans.catalogue import query
from lexspark.plans.inline import CHAPTERS, VERSES, Inline, with_tables
from lexspark.plans.shelves import DAY, norm_sql
from lexspark.sources import documents_json as dj
from lexspark.sources import schedules as sd
from lexspark.sources.tables import table


def _page(number=1, juz=1, surahs=("a",), lines=None):
    word = {"textUthmani": "w", "surahNumber": 1, "ayahNumber": 1, "wordNumber": 1}
    return {
        "pageNumber": number, "juz": juz, "surahs": list(surahs),
        "lines": [{"lineNumber": 1, "text": "w", "words": [word]}] if lines is None else lines
    }


_BAD_WORD = [{"lineNumber": 1, "text": "w", "words": [{"textUthmani": "w", "surahNumber": 1, "ayahNumber": 1}]}]
RAW = Inline("raw", "id int, kind string, body string", [
    (1, "page", json.dumps(_page())), (2, "page", json.dumps(_page(lines=_BAD_WORD))), (3, "page", json.dumps(_page(lines=[]))), (
        4, "page", json.dumps(_page(lines=[{"lineNumber": 2, "text": "x"}]))
    ),
    (5, "page", json.dumps(_page() | {"juz": None})), (
        6, "passage",
        json.dumps({"surah": 1, "surah_name": "a", "ayah_start": 1, "ayah_end": 2, "ayah_text": "t", "explanation": "e"})
    ),
    (
        7, "passage", json.dumps({"surah": 1, "surah_name": "a", "ayah_start": 1, "ayah_end": 2, "ayah_text": "t"})
    ), (8, "page", None), (9, "page", "broken"),
])
_B = "(CASE WHEN json_valid(body) THEN CAST(body AS JSON) END)"
_HAVE = lambda j, names: " AND ".join(f"coalesce(json_type({j}, '$.{n}'), 'NULL') <> 'NULL'" for n in names)


@query(
    with_tables(RAW) + f", r AS (SELECT id, kind, {_B} AS j FROM raw), l AS (SELECT id, unnest(j->'$.lines[*]') AS x FROM r), w "
        f"AS (SELECT id, unnest(x->'$.words[*]') AS y FROM l) "
    f"SELECT id, CASE kind WHEN 'passage' "
    f"THEN {_HAVE('j', ['surah', 'surah_name', 'ayah_start', 'ayah_end', 'ayah_text', 'explanation'])} "
    f"ELSE {_HAVE('j', ['pageNumber', 'juz', 'surahs', 'lines'])} "
    f"AND NOT EXISTS (SELECT 1 FROM l WHERE l.id = r.id AND NOT ({_HAVE('x', ['lineNumber', 'text', 'words'])})) AND NOT EXISTS "
    f"(SELECT 1 FROM w WHERE w.id = r.id AND NOT ({_HAVE('y', ['textUthmani', 'surahNumber', 'ayahNumber', 'wordNumber'])})) "
    f"END AS valid FROM r"
)
def guarded_rows(spark, d):
    page, passage = dj.is_page(F.from_json("body", dj.PAGE)), dj.is_passage(F.from_json("body", dj.PASSAGE))
    return RAW.df(spark).select("id", F.when(F.col("kind") == "passage", passage).otherwise(page).alias("valid"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE n_regionkey < 4) AS n_valid, 'partial' AS state FROM nation")
def completeness_state(spark, d):
    return dj.completeness(table(spark, d, "nation"), F.col("n_regionkey") < 4, 25)


ASKED = Inline(
    "given", "id string, question string, answer string, words string",
    [("1", "ما الصبر؟", "كَلِمَة", "الصبر|؟|"), ("2", None, "x", ""), ("3", "q", None, "a"), ("4", "Q?", "A!", None)]
)


@query(
    with_tables(ASKED) + f" SELECT id, {norm_sql('question')} AS norm_question, {norm_sql('answer')} AS norm_answer, "
    f"coalesce(array_to_string(list_filter(list_transform(string_split(words, '|'), lambda t: {norm_sql('t')}), lambda k: k <> "
    f"''), '|'), '') AS words FROM given WHERE question IS NOT NULL AND answer IS NOT NULL"
)
def question_table(spark, d):
    rows = ASKED.df(spark).withColumn("keywords", F.split("words", "\\|"))
    return dj.question_index(rows).select("id", "norm_question", "norm_answer", F.array_join("norm_keywords", "|").alias("words"))


_LOAD = (
    f"trim(regexp_replace(regexp_replace(translate(regexp_replace(text, '{fx.LOAD_MARKS}', '', 'g'), 'إأآٱىة', 'اااايه'), "
    f"'[^\\x{{0600}}-\\x{{06FF}}{fx.WHITE[1:-2]}]', '', 'g'), '{fx.WHITE}', ' ', 'g'))"
)


@query(with_tables(VERSES, CHAPTERS) + f" SELECT surah || ':' || ayah AS id, name, {_LOAD} AS norm, juz, page FROM verses JOIN "
    f"chapters ON number = surah")
def verses_flattened(spark, d):
    verse = F.struct(
        F.col("ayah").alias("numberInSurah"), "text", "juz", "page", F.lit(1).alias("hizbQuarter"),
        F.lit(None).cast("boolean").alias("sajda")
    )
    held = VERSES.df(spark).groupBy("surah").agg(F.collect_list(verse).alias("ayahs"))
    chapters = held.join(CHAPTERS.df(spark), F.col("surah") == F.col("number")).select(
        "number", "name", F.col("english").alias("englishName"), "ayahs"
    )
    nested = chapters.agg(F.collect_list(F.struct(
        "number", "name", "englishName", "ayahs"
    )).alias("surahs")).select(F.struct("surahs").alias("data"))
    return dj.flattened(nested).select("id", "name", "norm", "juz", "page")


@query(with_tables(VERSES, CHAPTERS) + " SELECT surah AS \"surahNumber\", any_value(name) AS name FROM verses JOIN chapters ON "
    "number = surah GROUP BY surah")
def first_chapter_names(spark, d):
    rows = VERSES.df(spark).join(CHAPTERS.df(spark), F.col("surah") == F.col("number")).select(
        (F.col("surah") * 1000 + F.col("ayah")).alias("ord"), F.col("surah").alias("surahNumber"),
        F.col("name").alias("surahNameArabic")
    )
    return dj.first_names(rows)


def _w(text, line, kind="word", position=None):
    return {"text_uthmani": text, "text": "alt" + text, "line_number": line, "position": position, "char_type_name": kind}


WORDS = [  # page, surah, ayah, juz, words as (text, line, kind)
    (
        604, 112, 1, 30,
        [("قُلْ", 1, "word"), ("هُوَ", 1, "word"), ("ٱللَّهُ", 1, "word"), ("أَحَدٌ", 2, "word"), ("١", 2, "end")]
    ), (604, 112, 4, None, [("وَلَمْ", 2, "word"), ("أَحَدٌۢ", 3, "word"), ("٤", 3, "end")]),
    (
        604, 114, 1, 30, [("قُلْ", 4, "word"), ("أَعُوذُ", 4, "word")]
    ), (305, 19, 1, 16, [("كٓهيعٓصٓ", 1, "word"), ("١", 1, "end")]), (305, 20, 1, None, [("طه", 2, "word")]),
]
LAYOUT = Inline("api", "page int, surah int, v int, ayah int, juz int, i int, n int, text string, line int", [
    (p, s, v, a, j, i, len(kept), t, line) for v,
    (p, s, a, j, ws) in enumerate(WORDS) for kept in [[w for w in ws if w[2] != "end"]] for i, (t, line, _) in enumerate(kept)
])


def _api(spark):
    rows = {}
    for p, s, a, j, ws in WORDS:
        rows.setdefault(p, []).append({"verse_key": f"{s}:{a}", "juz_number": j, "words": [_w(*w) for w in ws]})
    bodies = spark.createDataFrame(
        [(p, json.dumps({"verses": vs}, ensure_ascii=False)) for p, vs in rows.items()], "page int, body string"
    )
    return bodies.select("page", F.from_json("body", dj.API_PAGE).alias("b")).select("page", "b.verses")


@query(
    with_tables(LAYOUT, CHAPTERS) + ", h AS (SELECT page, coalesce(arg_max(juz, v) FILTER (WHERE juz IS NOT NULL), 0) AS juz "
        "FROM api GROUP BY page), "
    "s AS (SELECT page, string_agg(nm, '|' ORDER BY first) AS surahs FROM (SELECT page, coalesce(name, CAST(surah AS VARCHAR)) "
    "AS nm, min(v) AS first FROM api LEFT JOIN chapters ON number = surah GROUP BY ALL) GROUP BY page) "
    "SELECT page, line, string_agg(text, ' ' ORDER BY v, i) AS text, count(*) FILTER (WHERE i = n - 1) AS n_ends, h.juz, "
    "s.surahs FROM api JOIN h USING (page) JOIN s USING (page) GROUP BY page, line, h.juz, s.surahs"
)
def layout_lines(spark, d):
    names = CHAPTERS.df(spark).select(F.col("number").alias("surahNumber"), "name")
    each = dj.layout_pages(_api(spark), names).select(
        "page", "juz", F.array_join("surahs", "|").alias("surahs"), F.explode("lines").alias("l")
    )
    return each.select(
        "page", "l.line", "l.text", F.size(F.filter("l.words", lambda w: w["is_end"])).cast("long").alias("n_ends"), "juz",
        "surahs"
    )


@query(
    with_tables(LAYOUT, CHAPTERS) + ", l AS (SELECT page, line, arg_min((surah, ayah, i), (v, i)) AS f, arg_max((surah, ayah, i "
        "= n - 1), (v, i)) AS e, count(*) AS n, count(*) FILTER (WHERE i <> n - 1) AS plain FROM api GROUP BY page, line), "
    "x AS (SELECT page, line, CASE WHEN f[2] = 1 AND f[3] = 0 THEN f[1] END AS starts, coalesce(e[3] AND e[2] = n_verses, "
    "false) AS is_last, CASE WHEN n = 1 THEN 1 ELSE plain END AS n_words FROM l LEFT JOIN chapters ON number = e[1]) "
    "SELECT page, line, starts, is_last, n_words, NOT is_last AND n_words >= 4 AS justified FROM x"
)
def line_flags(spark, d):
    return dj.line_flags(dj.api_words(_api(spark)), CHAPTERS.df(spark))


SOUGHT = Inline("sought", "id int, surah int, ayah int", [(1, 112, 4), (2, 19, 1), (3, 1, 1)])


@query(with_tables(LAYOUT, SOUGHT) + " SELECT id, min(page) AS page FROM sought LEFT JOIN api USING (surah, ayah) GROUP BY id")
def page_of_verse(spark, d):
    return dj.page_of_verse(dj.api_words(_api(spark)), SOUGHT.df(spark))


HAD = Inline("had", "page int, body string", [(1, "old"), (2, "old"), (9, "old")])
GOT = Inline("got", "page int, body string", [(2, "new"), (3, "new"), (4, None), (5, "new")])


@query(with_tables(HAD, GOT) + ", g AS (SELECT * FROM got WHERE page < (SELECT min(page) FROM got WHERE body IS NULL)) SELECT * "
    "FROM g UNION ALL SELECT * FROM had WHERE page NOT IN (SELECT page FROM g)")
def load_resumed(spark, d):
    return dj.resumed(HAD.df(spark), GOT.df(spark))


def _answer(code=200, drop=None, isha="20:30 (+03)", hijri=None):
    timings = {
        "Fajr": "04:05", "Sunrise": "05:30", "Dhuhr": "12:30", "Asr": "16:00", "Maghrib": "19:00", "Isha": isha, "Imsak": "x"
    }
    timings.pop(drop, None)
    return json.dumps(
        {
            "code": code,
            "data": {
                "timings": timings, "date": {"hijri": hijri},
                "meta": {"timezone": "Asia/Riyadh", "method": {"id": 4, "name": "M"}}
            }
        },
        ensure_ascii=False
    )


_HIJRI = {"day": "8", "month": {"number": 2, "en": "Safar", "ar": ""}, "year": "1448"}
ANSWERS = Inline("answers", "key string, day string, body string", [
    (
        "a", "2026-07-01", _answer(hijri=_HIJRI)
    ), (
        "a", "2026-07-02", _answer(isha="20:31")
    ), ("a", "2026-07-03", _answer(code=500)), ("b", "2026-07-01", _answer(drop="Asr")), (
        "b", "2026-07-02", _answer(isha="25:00")
    ),
    ("c", "2026-07-01", "broken"), ("c", "2026-07-02", None), (
        "d", "2026-07-01", _answer(hijri=_HIJRI | {"year": ""})
    ), ("d", "2026-07-02", '{"code": 200}'),
])
_M = "CASE WHEN regexp_matches({t}, '^\\d{{1,2}}:\\d{{2}}') AND CAST(split_part({t}, ':', 1) AS INT) < 24 AND CAST(substring(split_part({t}, ':', 2), 1, 2) AS INT) < 60 THEN CAST(split_part({t}, ':', 1) AS INT) * 60 + CAST(substring(split_part({t}, ':', 2), 1, 2) AS INT) END AS {n}"


@query(
    with_tables(ANSWERS) + f", j AS (SELECT key, CAST(day AS DATE) AS day, {_B} AS j FROM answers), t AS (SELECT key, day, "
        f"j->>'$.data.date.hijri.month.en' AS month, j->>'$.data.date.hijri.year' AS year, "
    + ", ".join(_M.format(
        t=f"(j->>'$.data.timings.{t.capitalize()}')", n=t
    ) for t in st.TIMES) + " FROM j WHERE CAST(j->>'$.code' AS INT) = 200), w AS (SELECT * FROM t WHERE " + " AND ".join(f"{t} IS NOT NULL" for t in st.TIMES)
    + ") SELECT w.key, w.day, w.fajr, w.isha, CASE WHEN w.year <> '' THEN w.month END AS month, n.isha AS tomorrow_isha FROM w "
        "LEFT JOIN w n ON n.key = w.key AND n.day = w.day + 1"
)
def schedule_days(spark, d):
    whole = sd.days(ANSWERS.df(spark).withColumn("day", F.to_date("day")))
    return sd.with_tomorrow(whole).select(
        "key", "day", F.element_at("times", "fajr").alias("fajr"), F.element_at("times", "isha").alias("isha"),
        F.col("hijri.month_en").alias("month"), F.try_element_at("tomorrow", F.lit("isha")).alias("tomorrow_isha")
    )


_LABEL = "lpad(CAST({t} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({t} % 60 AS VARCHAR), 2, '0')"


@query(with_tables(DAY) + " " + " UNION ALL ".join(
    f"SELECT id, {i} AS place, '{t}' AS name, coalesce({_LABEL.format(t=t)}, '—') AS label FROM days" for i,
    t in enumerate(st.MOVED)
))
def day_rows(spark, d):
    each = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(t).alias("name"), sc.time_label(F.col(t), twelve=False).alias("label")) for i,
        t in enumerate(st.MOVED)
    ])
    return DAY.df(spark).select("id", F.explode(each).alias("r")).select("id", "r.*")


ZONES = Inline(
    "zones", "id int, zone string", [(1, "Asia/Riyadh"), (2, "Not/AZone"), (3, None), (4, "America/New_York"), (5, "")]
)


@query(with_tables(ZONES) + " SELECT id, CASE id WHEN 1 THEN DATE '2026-07-02' WHEN 4 THEN DATE '2026-07-01' ELSE DATE "
    "'2026-07-01' END AS day, CAST(CASE id WHEN 1 THEN 3600 + 1800 WHEN 4 THEN 18 * 3600 + 1800 ELSE 22 * 3600 + 1800 END AS "
    "BIGINT) AS second_of_day FROM zones")
def zone_fallback(spark, d):
    day, second = sc.local_time_in(F.lit("2026-07-01 22:30:00").cast("timestamp_ntz"), F.col("zone"), "UTC")
    return ZONES.df(spark).select("id", day.alias("day"), second.alias("second_of_day"))


MARKS = Inline("marks", "user string, value string", [
    (
        "a",
        '[{"id":"2:5","surahNumber":2,"ayahNumber":5},{"id":"1:3","surahNumber":1,"ayahNumber":3},{"id":"x","surahNumber":"a","ayahNumber":1},{"surahNumber":1,"ayahNumber":1}]'
    ), ("b", "{"), ("c", None), ("d", "[]"),
])


@query(
    with_tables(MARKS) + """, e AS (SELECT "user", unnest(from_json(CASE WHEN json_valid(value) THEN value ELSE '[]' END, '[{"id":"VARCHAR","surahNumber":"JSON","ayahNumber":"JSON"}]')) AS m FROM marks)
    SELECT "user", m.id AS id, row_number() OVER (PARTITION BY "user" ORDER BY TRY_CAST(m.surahNumber AS INT), TRY_CAST(m.ayahNumber AS INT)) AS place FROM e WHERE m.id IS NOT NULL AND TRY_CAST(m.surahNumber AS INT) IS NOT NULL AND TRY_CAST(m.ayahNumber AS INT) IS NOT NULL"""
)
def bookmarks_loaded(spark, d):
    return st.stored_bookmarks(MARKS.df(spark), "user").select("user", "id", F.col("place").cast("long").alias("place"))
