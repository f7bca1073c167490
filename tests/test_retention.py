"""Newest rows of a stream: as the batch operator has them, kept in a store, and gone when a key is quiet."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import events as ev
from lexspark.operators.store import KeyedStore
from lexspark.streaming import retention as rt

DAY = 86_400
SCHEMA = "u string, rows array<struct<ms: long, value: string>>"


@pytest.fixture
def lists(spark):
    name, value = rt.STATE_STORE
    spark.conf.set(name, value)
    yield spark
    spark.conf.unset(name)


def run(spark, folder, store, at_most, quiet="1 day"):
    stream = spark.readStream.schema("u string, s long, v string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept = rt.newest(stream.withColumn("ts", F.timestamp_seconds("s")), "u", "ts", "v", at_most, quiet)
    query = kept.writeStream.foreachBatch(lambda b, n: store.write(rt.as_operations(b, "u"), n) and None).outputMode("update").option(
        "checkpointLocation", f"{folder}/c"
    ).trigger(availableNow=True).start()
    assert query.awaitTermination(150)
    return query


def put(spark, folder, rows):
    spark.createDataFrame(rows, "u string, s long, v string").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_stream_and_batch_agree(lists, tmp_path):
    spark, folder = lists, f"file://{tmp_path}"
    given = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("user_id").cast("string").alias("u"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.col("event_type").alias("v")
    )
    rows = [tuple(r) for r in given.orderBy("s").collect()]
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :], [("nothing", None, "x"), (None, rows[-1][1], "x")]):
        put(spark, folder, part)
    store = KeyedStore(spark, f"{folder}/store", "u", spark.createDataFrame([], SCHEMA).schema)
    run(spark, folder, store, 5, "3650 days")
    got = {r.u: [(x.ms // 1000, x.value) for x in r.rows] for r in store.read().collect()}
    want: dict = {}
    for r in ev.newest(given, "u", [F.desc("s"), F.asc_nulls_last("v")], 5).collect():
        want.setdefault(r.u, []).append((r.s, r.v))
    assert len(got) > 5
    assert got == {u: sorted(x, key=lambda r: (-r[0], r[1] is None, r[1] or "")) for u, x in want.items()}


def test_quiet_keys_have_no_state(lists, tmp_path):
    spark, folder = lists, f"file://{tmp_path}"
    store = KeyedStore(spark, f"{folder}/store", "u", spark.createDataFrame([], SCHEMA).schema)
    put(spark, folder, [("quiet", 10, "a"), ("quiet", 20, None), ("busy", 10, "a")])
    run(spark, folder, store, 2)
    assert {r.u: [tuple(x) for x in r.rows] for r in store.read().collect()} == {
        "quiet": [(20_000, None), (10_000, "a")], "busy": [(10_000, "a")]
    }
    for day in (1, 2, 3):  # the stream goes on where it was; watermarks pass the quiet key's end
        put(spark, folder, [("busy", day * DAY, "b"), ("busy", day * DAY, "a")])
    query = run(spark, folder, store, 2)
    assert {r.u: [tuple(x) for x in r.rows] for r in store.read().collect()} == {"busy": [(3 * DAY * 1000, "a"), (3 * DAY * 1000, "b")]}
    put(spark, folder, [("busy", 4 * DAY, "c")])
    query = run(spark, folder, store, 2)
    state = spark.read.format("statestore").option("stateVarName", "rows").option("path", f"{folder}/c").load()
    assert {r.key.u for r in state.select("key").collect()} == {"busy"}
    assert query.exception() is None
