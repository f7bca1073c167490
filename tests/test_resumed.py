"""Loading by keys from a server that fails, is slow to recover, and is killed half way: each key is fetched once."""

import http.server
import json
import threading
import time
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexspark.sources import resumed as rs
from lexspark.sources import schedules as sd
from lexspark.sources.json_urls import JsonUrls


class Host(http.server.ThreadingHTTPServer):
    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.served, self.asked, self.times, self.broken, self.first = Counter(), Counter(), [], set(), {}
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}/{{key}}"


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        key, host = self.path[1:], self.server
        host.asked[key] += 1
        host.times.append(time.monotonic())
        status = host.first[key].pop(0) if host.first.get(key) else 404 if key in host.broken else 200
        host.served[key] += status == 200
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps({"key": key}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def host():
    one = Host()
    yield one
    one.shutdown()


def keys_of(spark, n):
    rows = [(f"k{i:02d}", i) for i in range(n)]
    return spark.createDataFrame([*rows, rows[0], (None, 3)], "key string, ord long")


def test_a_run_goes_on_where_the_last_one_stopped(spark, host, tmp_path):
    folder, keys = f"file://{tmp_path}/s", keys_of(spark, 20)
    host.broken = {"k09", "k11"}
    assert rs.load(keys, host.url, folder, per_batch=6) == rs.Loaded(10, 10, "k09")  # k00-k11 but for two
    assert not host.asked["k12"]
    assert rs.load(keys, host.url, folder, per_batch=6) == rs.Loaded(4, 6, "k09")  # the rest of the first failed batch goes on
    host.broken = set()
    assert rs.load(keys, host.url, folder, per_batch=6) == rs.Loaded(6, 0, None)
    assert rs.load(keys, host.url, folder, per_batch=6) == rs.Loaded(0, 0, None)
    assert set(host.served.values()) == {1}
    rows = rs.store(spark, folder).read().collect()
    assert sorted((r.key, json.loads(r.body)["key"]) for r in rows) == [(f"k{i:02d}",) * 2 for i in range(20)]


def test_a_batch_without_commit_is_fetched_again(spark, host, tmp_path, monkeypatch):
    folder, keys = f"file://{tmp_path}/s", keys_of(spark, 9)
    real, count = rs.KeyedStore._commit, []

    def dies(self, name):
        count.append(name)
        if len(count) == 2:
            raise KeyboardInterrupt
        real(self, name)

    monkeypatch.setattr(rs.KeyedStore, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        rs.load(keys, host.url, folder, per_batch=4)
    monkeypatch.undo()
    assert rs.store(spark, folder).read().count() == 4
    assert rs.load(keys, host.url, folder, per_batch=4) == rs.Loaded(5, 0, None)
    assert sorted(r.key for r in rs.store(spark, folder).read().collect()) == [f"k{i:02d}" for i in range(9)]
    assert {k for k, n in host.served.items() if n > 1} == {"k04", "k05", "k06", "k07"}


def test_retries_and_rate(spark, host):
    spark.dataSource.register(JsonUrls)
    host.first = {"a": [503, 429], "b": [500] * 9, "c": [404]}
    read = spark.read.format("json_urls").option("url", host.url).option("retries", "2").option("pause", "0.05")
    got = {r.key: (r.status, r.error) for r in read.option("keys", "a,b,c").load().collect()}
    assert got == {"a": (200, None), "b": (500, "http"), "c": (404, "http")}
    assert host.asked == {"a": 3, "b": 3, "c": 1}
    host.times.clear()
    spark.read.format("json_urls").option("url", host.url).option("keys", "1-12").option("perSecond", "8").option("lanes", "2").load().collect()
    assert len(host.times) == 12
    assert max(host.times) - min(host.times) >= 1.2  # each of two lanes makes four requests a second


def test_requests_for_days(spark):
    rows = [
        (" Mecca ", "Saudi Arabia", None, 1.0), ("x", "y", 21.4, -39.8), ("", "y", None, None), (None, "y", 1.5, None)
    ]
    df = spark.createDataFrame(rows, "city string, country string, lat double, lon double")
    made = df.select(sd.request_of(
        F.lit(date(2026, 3, 1)), F.col("city"), F.col("country"), F.col("lat"), F.col("lon"), F.lit(4), F.lit(0)
    ))
    assert [r[0] for r in made.collect()] == [
        "timingsByCity/01-03-2026?city=Mecca&country=Saudi%20Arabia&method=4&school=0&iso8601=false",
        "timings/01-03-2026?latitude=21.4&longitude=-39.8&method=4&school=0&iso8601=false", None, None
    ]
