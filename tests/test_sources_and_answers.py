"""Sources over files and HTTP, loaders, and answers on small fixtures with gaps."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as fx
from lexspark.operators import assistant as oa
from lexspark.operators import lookups as lk
from lexspark.operators import state as st
from lexspark.plans.assistant import QUESTIONS, passages_of
from lexspark.plans.inline import CHAPTERS
from lexspark.sources import documents_json as dj
from lexspark.sources.json_urls import JsonUrls, keys_of


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        ok = self.path.endswith(("/1", "/2")) and self.headers.get("x-auth-token") == "t"
        self.send_response(200 if ok else 404)
        self.end_headers()
        self.wfile.write(json.dumps({"page": self.path}).encode())

    def log_message(self, *args):
        pass


def test_json_behind_urls(spark, tmp_path):
    assert keys_of("1-3, 7,x ,") == ["1", "2", "3", "7", "x"]
    spark.dataSource.register(JsonUrls)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    read = spark.read.format("json_urls").option("token", "t").option("keysPerPart", "2")
    got = read.option("url", f"http://127.0.0.1:{server.server_port}/{{key}}").option("keys", "1-3").load()
    assert sorted((r.key, r.status, r.error) for r in got.collect()) == [("1", 200, None), ("2", 200, None), ("3", 404, "http")]
    assert json.loads(got.where("key = '2'").first().body) == {"page": "/2"}
    server.shutdown()
    (tmp_path / "5.json").write_text('{"a": 1}')
    files = read.option("url", f"file://{tmp_path}/{{key}}.json").option("keys", "5,6").load()
    assert sorted((r.key, r.status, r.body, r.error) for r in files.collect()) == [
        ("5", 200, '{"a": 1}', None), ("6", None, None, "network")
    ]
    assert read.option("url", "file:///{key}").option("keys", "").load().count() == 0


def test_loaders_leave_out_what_is_not_whole(spark, tmp_path):
    good = {"surah": 1, "surah_name": "a", "ayah_start": 1, "ayah_end": 1, "ayah_text": "t", "explanation": "e"}
    (tmp_path / "p.json").write_text(json.dumps([
        good, good | {"surah": "x"}, {k: v for k, v in good.items() if k != "explanation"}
    ]))
    assert dj.load_passages(spark, str(tmp_path / "p.json")).count() == 1
    verse = dict.fromkeys(
        ("id", "surahNameArabic", "surahNameEnglish", "textUthmani", "textSimple", "textNormalized"), "x"
    ) | dict.fromkeys(("surahNumber", "ayahNumber", "juz", "page"), 1)
    (tmp_path / "v.json").write_text(json.dumps([verse, verse | {"page": None}]))
    assert dj.load_verses(spark, str(tmp_path / "v.json")).count() == 1
    (tmp_path / "l.json").write_text(json.dumps([{"pageNumber": 1, "juz": 1, "surahs": [], "lines": []}, {"pageNumber": 2}]))
    assert dj.load_pages(spark, str(tmp_path / "l.json")).count() == 1


def test_layout_without_lines_or_verses_fails(spark):
    words = [{"text": "a", "line_number": None, "position": 1, "char_type_name": "word"}]
    for verses in ([{"verse_key": "1:1", "juz_number": 1, "words": words}], []):
        pages = spark.createDataFrame(
            [(1, json.dumps({"verses": verses}))], "page int, body string"
        ).select("page", F.from_json("body", dj.API_PAGE).alias("b")).select("page", "b.verses")
        with pytest.raises(Exception, match="a word without a line|no verses"):
            dj.api_words(pages).collect()


def test_answers_without_data(spark):
    passages, verses = dj.passage_index(passages_of(spark).limit(0))
    known = dj.question_index(spark.createDataFrame([], dj.QUESTION)).withColumn("ord", F.lit(1))
    got = {r.id: r for r in oa.answers(QUESTIONS.df(spark), passages, verses, known).collect()}
    assert len(got) == len(QUESTIONS.rows) and not [r for r in got.values() if r.refs or r.text]
    assert oa.answers(QUESTIONS.df(spark).limit(0), passages, verses, known).count() == 0


def test_requests_in_blocks_find_the_same(spark, monkeypatch):
    passages, verses = dj.passage_index(passages_of(spark))
    requests = oa.analytics_requests(oa.read_questions(QUESTIONS.df(spark)), lk.name_table(oa.chapters_of(passages)))
    whole = sorted(map(str, oa.passage_totals(requests, passages).collect()))
    monkeypatch.setattr(oa, "BLOCK", 7)
    assert sorted(map(str, oa.passage_totals(requests, passages).collect())) == whole


def test_large_lists_are_not_broadcast(spark):
    with pytest.raises(ValueError, match="too many"):
        lk.small(spark.range(1001))


def test_ties_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, " "), ("b", 1, None), ("c", 1, " y "), (None, 1, "z")], "k string, at int, note string"
    )
    assert {tuple(r) for r in st.upserts(rows, ["k"], ["at"], "note").collect()} == {("c", "y"), (None, "z")}
    assert st.upserts(rows.limit(0), ["k"], ["at"], "note").count() == 0
    assert lk.listed_chapters(spark.createDataFrame([], "id int, query string, kind int"), CHAPTERS.df(spark)).count() == 0
    one = spark.range(1).select(
        fx.loose_key(F.lit("كتاب الله ا اا")).alias("a"), lk.nearest_step(F.lit(26), [22, 25, 27]).alias("b"),
        fx.extract(F.lit(""), 5).alias("c")
    ).first()
    assert tuple(one) == ("كتب الله ا ا", 1, "") and fx.loose("كتاب الله ا اا") == "كتب الله ا ا"
