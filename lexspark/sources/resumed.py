"""Loading of JSON documents by keys that goes on where it stopped: what has been fetched is committed to a keyed store, batch by batch."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.operators.store import PUT, KeyedStore
from lexspark.sources.json_urls import JsonUrls
from lexspark.sources.shared import saved

KEYS_PER_BATCH = 10_000
SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("body", T.StringType())])


class Loaded(NamedTuple):
    """How many keys this run has fetched, how many are still missing, and the first of its batch that failed."""

    fetched: int
    missing: int
    stopped_at: str | None


def store(spark: SparkSession, folder: str) -> KeyedStore:
    return KeyedStore(spark, folder, "key", SCHEMA)


def load(keys: DataFrame, url: str, folder: str, per_batch: int = KEYS_PER_BATCH, **options: str) -> Loaded:
    """Fetch the documents of ``keys`` (key, ord) that ``folder`` doesn't have yet, in the order of ord; stops after the first batch with a failure.

    What a batch has fetched is committed before the next one begins, also that of a batch that
    stops, so another run asks only for keys that have no body yet. A run that is killed within a
    batch leaves nothing of it, and asks for it again. A key that is given twice is asked for once,
    a null one never; a null ord comes first, and keys have no line ends. ``options`` go to ``json_urls``: retries, pause, perSecond, lanes, timeout,
    token. The driver holds the keys of one batch at a time; nothing else passes through it.
    """
    spark = keys.sparkSession
    spark.dataSource.register(JsonUrls)
    kept = store(spark, folder)
    given = keys.where("key IS NOT NULL").groupBy("key").agg(F.min("ord").alias("ord"))
    line = saved(given.join(kept.read().select("key"), "key", "left_anti"), "keys-to-load")
    missing, fetched, after = line.count(), 0, None
    while True:
        rest = line if after is None else line.where(F.struct("ord", "key") > F.struct(
            F.lit(after[0]).cast(line.schema["ord"].dataType).alias("ord"), F.lit(after[1]).alias("key")
        ))
        part = [(r.ord, r.key) for r in rest.orderBy("ord", "key").limit(per_batch).collect()]
        if not part:
            return Loaded(fetched, missing - fetched, None)
        after = part[-1]
        asked = spark.read.format("json_urls").options(**options).option("url", url).option("keylist", "\n".join(k for _, k in part)).load()
        answers = saved(asked, "answers")
        upto, done = kept.commits()
        good = answers.where("error IS NULL AND body IS NOT NULL").select("key", "body", F.lit(PUT).alias("op"), F.lit(0).cast("long").alias("at"))
        kept.write(good, max([upto, *done]) + 1)
        fetched += good.count()
        bad = {r.key for r in answers.where("error IS NOT NULL OR body IS NULL").select("key").collect()}
        if bad:
            return Loaded(fetched, missing - fetched, next(k for _, k in part if k in bad))
