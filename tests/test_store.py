"""The keyed store against a plain dictionary; retried and unfinished batches do no harm."""

import random

import pytest
from pyspark.sql import types as T

from lexspark.operators.store import KeyedStore
from lexspark.sources import shared

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
OPS = "k string, a int, b string, op string, at long, other string"


def by_hand(batches):
    now = {}
    for ops in batches:
        for k, a, b, op, _, _ in sorted(ops, key=lambda o: o[4]):
            if op == "put":
                now[k] = (a, b)
            elif op == "delete":
                now.pop(k, None)
            else:
                old = now.get(k, (None, None))
                now[k] = (old[0] if a is None else a, old[1] if b is None else b)
    return now


@pytest.fixture(scope="module")
def batches():
    rng = random.Random(2)
    out = []
    for n in (200, 80, 1, 0, 150):
        ats = rng.sample(range(10_000), n)
        out.append([(rng.choice(["hot", "hot", None, *"abcdefgh"]), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), rng.choice(["put", "patch", "patch", "patch", "delete"]), t, "clash") for t in ats])
    return out


def state(store):
    rows = store.read().collect()
    assert len(rows) == len({r.k for r in rows})
    return {r.k: (r.a, r.b) for r in rows}


@pytest.mark.parametrize("compact_after", [(), (0,), (1, 3)])
def test_store(spark, batches, tmp_path, compact_after):
    store = KeyedStore(spark, f"file://{tmp_path}/s", "k", SCHEMA)
    assert store.read().columns == ["k", "a", "b"] and state(store) == {} and store.compact() == -1
    for i, ops in enumerate(batches):
        assert store.write(spark.createDataFrame(ops, OPS).repartition(3), i)
        if i in compact_after:
            assert store.compact() == i
    assert state(store) == by_hand(batches)
    # a batch that is committed, or under the snapshot, isn't written again
    assert not any(store.write(spark.createDataFrame(batches[0], OPS), i) for i in range(len(batches)))
    assert state(KeyedStore(spark, f"file://{tmp_path}/s", "k", SCHEMA)) == by_hand(batches)


def test_unfinished_batch_is_not_read(spark, batches, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", "k", SCHEMA)
    store.write(spark.createDataFrame(batches[0], OPS), 0)
    store.write(spark.createDataFrame(batches[1], OPS), 1)
    shared.delete(spark, f"file://{tmp_path}/s/commits/batch-1")  # as if the run had ended before its commit
    assert state(store) == by_hand(batches[:1])
    assert store.write(spark.createDataFrame(batches[1], OPS), 1) and state(store) == by_hand(batches[:2])


def test_store_of_a_stream(spark, batches, tmp_path):
    """Each micro-batch is a batch of the store; one that is run again changes nothing."""
    for i, ops in enumerate(batches[:2]):
        spark.createDataFrame(ops, OPS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    store, seen = KeyedStore(spark, f"file://{tmp_path}/s", "k", SCHEMA), []

    def put(df, i):
        seen.append(store.write(df, i))
        seen.append(store.write(df, i))

    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    run = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert seen == [True, False] * 2
    assert state(store) in (by_hand(batches[:2]), by_hand(batches[1::-1]))
