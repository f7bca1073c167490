"""Golden values of the question and schedule rules; streaming forms and nested sources on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lexspark.functions import questions as qs
from lexspark.functions import schedule as sc
from lexspark.functions import text as fx
from lexspark.operators import retrieval
from lexspark.plans.schedules import FIRST_TOMORROW, TIMETABLE
from lexspark.sources import documents_json as dj
from lexspark.streaming import events as se

KINDS = [
    ("كم شدة في القرآن؟", "QURAN_STATS"), (
        "كم مرة ذكرت كلمة الله؟", "QURAN_STATS"
    ), ("أين وردت كلمة الصمد؟", "WORD_LOCATION"), ("اشرح آية الكرسي", "TAFSIR_EXPLANATION"),
    ("ما معنى الصمد؟", "WORD_MEANING"), ("آيات عن الصبر", "TOPIC_AYAHS"), (
        "ماذا يقول القرآن عن التوبة؟", "TOPIC_AYAHS"
    ), ("كم عدد آيات سورة البقرة؟", "SURAH_INFO"),
    ("هل سورة الكهف مكية أم مدنية؟", "SURAH_INFO"), (
        "في أي سورة وردت عبارة اهدنا الصراط المستقيم؟", "AYAH_SEARCH"
    ), ("هل يجوز الصيام؟", "FATWA_SAFETY"), ("ما معنى الحكم؟", "WORD_MEANING"),
    ("تفسير سورة الفاتحة", "GENERAL_TAFSIR_SEARCH"), (
        "How many times is «الله» mentioned?", "QURAN_STATS"
    ), ("2:255", "UNKNOWN"), ("؟", "UNKNOWN"), ("", "UNKNOWN"), (None, "UNKNOWN"),
]


def test_kinds(spark):
    rows = spark.createDataFrame(KINDS, "q string, kind string").select(
        "q", "kind", qs.kind(fx.normalize(F.col("q"))).alias("got")
    ).collect()
    assert [(r.q, r.got) for r in rows] == KINDS


def test_tokens(spark):
    rows = spark.createDataFrame(
        [("what is the meaning of mercy 12 x",), ("",)], "t string"
    ).select(qs.tokens(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["mercy"], []]


@pytest.mark.parametrize(
    ("now", "next_", "until", "tomorrow", "current", "progress"),
    [(0, "fajr", 16200, False, None, 0.4375), (16200, "dhuhr", 28800, False, "fajr", 0), (
        17400, "dhuhr", 27600, False, "fajr", 0.041667
    ), (17401, "dhuhr", 27599, False, None, 0.041701),
     (45000, "asr", 12600, False, "dhuhr", 0), (73800, "fajr", 28920, True, "isha", 0), (
         80000, "fajr", 22720, True, None, 0.214385
     ), (86400, "fajr", 16320, True, None, 0.435685)],
)
def test_next_entry(spark, now, next_, until, tomorrow, current, progress):
    r = spark.createDataFrame([(now,)], "n long").select(sc.next_entry(F.col("n"), TIMETABLE, FIRST_TOMORROW).alias("r")).first().r
    assert (r.next, r.seconds_until, r.tomorrow, r.current, round(r.progress, 6)) == (next_, until, tomorrow, current, progress)


def test_scalars(spark):
    row = spark.range(1).select(
        *[sc.minutes_of(F.lit(t)) for t in ("04:30", "04:30 (+03)", "24:00", "7")], sc.minutes_of(F.lit(None).cast("string")),
        sc.shifted(F.lit(3), F.lit(-10)), sc.shifted(F.lit(1435), F.lit(99)),
        sc.countdown(F.lit(5058)), sc.countdown(F.lit(1458)), sc.countdown(F.lit(-5)),
        *[sc.time_label(F.lit(m)) for m in (0, 750, 1439)], sc.time_label(F.lit(None).cast("int")),
        sc.time_label(F.lit(750), arabic=True),
        *[sc.row_at(F.lit(x), 7) for x in (0.0, 0.5, 1.0)], fx.percent(F.lit(0.64)), fx.playback_time(F.lit(252)),
        fx.first_number(F.lit("x ١٢ 3")), fx.first_number(F.lit("x")), fx.contains_arabic(F.lit("؟")),
    ).first()
    assert list(row) == [
        270, 270, None, None, None, 1433, 5, "01:24:18", "24:18", "00:00", "12:00 AM", "12:30 PM", "11:59 PM", "—", "١٢:٣٠ م", 1,
        4, 7, "٦٤٪", "٤:١٢", 12, None, True
    ]


def test_ages_and_names(spark):
    ages = spark.createDataFrame(
        [(d,) for d in (0, 1, 6, 7, 13, 14, 30)], "d int"
    ).select(sc.age_bucket(F.col("d")).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in ages] == [
        ("today", 0), ("yesterday", 1), ("days", 6), ("week", 1), ("week", 1), ("weeks", 2), ("months", 1)
    ]
    names = spark.createDataFrame(
        [("الفاتحة", "Al-Fatihah"), ("النساء", "An-Nisa"), (None, None)], "a string, b string"
    ).select(fx.name_variants(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in names] == [
        ["الفاتحه", "فاتحه", "al fatihah", "alfatihah", "fatihah", "fatiha"], ["النساء", "نساء", "an nisa", "annisa"], []
    ]


def test_highlight(spark):
    r = spark.createDataFrame(
        [("one Two three",), ("one",)], "t string"
    ).select(fx.highlighted(F.col("t"), "two").alias("h")).select("h.*").collect()
    assert [tuple(x) for x in r] == [("one", "Two", "three"), ("one", None, "")]


def test_best_rows_take_the_first_of_ties_and_hold_nulls(spark):
    rows = spark.createDataFrame(
        [(1, "mercy", "x", ["mercy"]), (2, "mercy", "mercy", None), (3, None, None, None)],
        "row_ord long, question string, answer string, keywords array<string>"
    )
    asked = "id string, norm string, tokens array<string>"
    got = retrieval.best_answers(
        rows, spark.createDataFrame([("m", "mercy", ["mercy"]), ("n", "nothing", ["nothing"])], asked)
    ).collect()
    assert [tuple(r) for r in got] == [("m", 1, 109.0)]
    found = retrieval.best_passages_by_rows(
        rows.select("row_ord", F.col("question").alias("heading"), F.col("answer").alias("body")),
        spark.createDataFrame([("q", "mercy day", ["mercy", "day"]), ("none", "", [])], asked)
    ).collect()
    assert [tuple(r) for r in found] == [("q", 2, 7.5)]


def test_streamed_reading_log(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x"), ("a", 5, "x"), ("a", 6, None), ("a", 7, None), (None, 1, "z")]
    spark.createDataFrame(rows, "u string, ms long, v string").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("u string, ms long, v string").json(f"{tmp_path}/in")
    run = se.reading_log(stream, "u", "ms", "v").writeStream.format("memory").queryName("readings").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.u, r.ms, r.value) for r in spark.table("readings").collect())
    assert got == [("a", 1, "x"), ("a", 3, "y"), ("a", 5, "x"), ("a", 6, None), ("b", 1, "x")]


def test_streamed_rate_limit(spark, tmp_path):
    ms = [1000, 1500, 1900, 2800, 3700, 4600, 5500, 6400, 7300, 8200, 15999, 16000, 16900]
    for part in (ms[:5], ms[5:]):  # the state carries over from one batch to the next
        spark.createDataFrame(
            [(1, x) for x in part], "u int, t long"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = se.rate_limited(stream, "u", "t").writeStream.format("memory").queryName("limited").option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert {r.ms for r in spark.table("limited").where("accepted").collect()} == set(ms) - {1500, 8200, 15999}


def test_streamed_days(spark, tmp_path):
    rows = [
        (1, "2024-01-01 01:00:00", "a"), (1, "2024-01-01 02:00:00", "a"), (1, "2024-01-01 03:00:00", "b"),
        (1, "2024-01-09 00:00:00", "a")
    ]
    spark.createDataFrame(rows, "u int, ts string, w string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp, w string").parquet(str(tmp_path / "in"))
    run = se.daily_progress(stream, "u", "ts", "w").writeStream.format("memory").queryName("days").option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert [(r.u, str(r.day), r.n, r.progress) for r in spark.table("days").collect()] == [(1, "2024-01-01", 2, 0.2)]


def test_nested_source(spark, tmp_path):
    verse = {"numberInSurah": 1, "text": "بِسْمِ", "juz": 1, "page": 1, "hizbQuarter": 1}
    (tmp_path / "a.json").write_text(json.dumps({"data": {"surahs": [{
        "number": 1, "name": "n", "englishName": "e", "ayahs": [verse, verse | {"numberInSurah": 2, "sajda": True}]
    }]}}))
    (tmp_path / "b.json").write_text(json.dumps({"other": 1}))
    nested = dj.guarded(spark, str(tmp_path), dj.NESTED, ["data"])
    assert nested.count() == 1
    assert [(r.id, r.norm, r.sajda) for r in dj.flattened(nested).orderBy("id").collect()] == [
        ("1:1", "بسم", False), ("1:2", "بسم", True)
    ]
    assert dj.completeness(dj.flattened(nested), F.col("text").isNotNull(), 2).first().state == "ready"


def test_page_lines_and_merge(spark):
    kind = "page int, line int, position int, verse string, text string, kind string"
    rows = [
        (1, 2, 3, "1:1", "c", "word"), (1, 1, 1, "1:1", "a", "word"), (1, 1, 2, "1:1", "b", None), (1, 2, 4, "1:1", "*", "end")
    ]
    got = dj.page_lines(spark.createDataFrame(rows, kind)).orderBy("line").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a b", ["1:1"], False), (1, 2, "c", ["1:1"], True)]
    with pytest.raises(Exception, match="without a line"):
        dj.page_lines(spark.createDataFrame([(1, None, 1, "1:1", "a", "word")], kind)).collect()
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert sorted(map(tuple, dj.merged(old, new, "k").collect())) == [(1, "a"), (2, "c")]
