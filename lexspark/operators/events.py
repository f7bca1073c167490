"""Operators over events of users, in order of time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.operators.ordered import LEAST, Line

GAP_MS, SPAN_MS, PER_SPAN = 900, 15_000, 8
DAILY_GOAL = 10


def rate_limited(
    events: DataFrame, key: str, ms: str, gap: int = GAP_MS, span: int = SPAN_MS, per_span: int = PER_SPAN, least: int = LEAST
) -> DataFrame:
    """key, n_events, n_accepted: an event is accepted ``gap`` after the last accepted one at the earliest, and with fewer than ``per_span`` accepted in the ``span`` before it.

    Where a key is quiet for a span nothing is carried on, so its events fall into stretches that
    are taken apart, in as many tasks. A stretch of one event is accepted, one of few is folded in
    its row. A long one streams by, sorted on disk where memory is short; what is carried is at
    most ``per_span`` times. An event without a time doesn't count; a null key is a key of its own.
    ``least``: see ``ordered.LEAST``.
    """
    given = events.select(F.col(key).alias("_of"), F.col(ms).cast("long").alias("_t"))
    line = Line(given, "_of", ["_t"], least)
    quiet = F.col("_t") - F.col("_b._t") >= span
    begins = line.lag("_b", "_t").withColumn("_start", (F.col("_t").isNotNull() & (F.col("_b._t").isNull() | quiet)).cast("long"))
    stretches = Line(begins, "_of", ["_t"], least, line).running_sum("_s", F.col("_start"))
    of_one = W.partitionBy("_of", "_s")
    nearest = F.min(F.when(F.col("_start") == 0, F.col("_t") - F.col("_b._t"))).over(of_one)
    sized = stretches.select("_of", "_s", "_t", (
        (F.count("_t").over(of_one) <= per_span) & F.coalesce(nearest >= gap, F.lit(True))
    ).alias("_all"))
    whole = sized.where("_all").groupBy("_of").agg(F.count("_t").alias("n_events"), F.count("_t").alias("n_accepted"))
    many = _folded(sized.where("NOT _all").select("_of", "_s", "_t"), gap, span, per_span)
    return whole.unionByName(many).groupBy(F.col("_of").alias(key)).agg(F.sum("n_events").alias("n_events"), F.sum("n_accepted").alias("n_accepted"))


def _folded(rows: DataFrame, gap: int, span: int, per_span: int) -> DataFrame:
    """_of, n_events, n_accepted of stretches (_of, _s), each in order of _t."""
    made = T.StructType([
        rows.schema["_of"], T.StructField("n_events", T.LongType()), T.StructField("n_accepted", T.LongType())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, accepted, queue = None, 0, 0, None  # queue is None before the first stretch
        for batch in batches:
            keys, n_events, n_accepted = [], [], []
            for k, s, t in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if queue is None or (k, s) != now:
                    if queue is not None:
                        keys.append(now[0]), n_events.append(seen), n_accepted.append(accepted)
                    now, seen, accepted, queue = (k, s), 0, 0, []
                seen += 1
                queue = [a for a in queue if t - a < span]
                if len(queue) < per_span and (not queue or t - queue[-1] >= gap):
                    queue.append(t)
                    accepted += 1
            of_key = batch.schema.field(0).type
            yield _counts(of_key, keys, n_events, n_accepted)
        if queue is not None:
            yield _counts(of_key, [now[0]], [seen], [accepted])

    return rows.where("_t IS NOT NULL").repartition("_of", "_s").sortWithinPartitions("_of", "_s", "_t").mapInArrow(run, made)


def _counts(kind: pa.DataType, keys: list, n_events: list[int], n_accepted: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, kind), pa.array(n_events, pa.int64()), pa.array(n_accepted, pa.int64())],
        names=["_of", "n_events", "n_accepted"]
    )


def daily_progress(events: DataFrame, key: str, ts: str, what: str, goal: int = DAILY_GOAL) -> DataFrame:
    """Distinct values of each key and day, and the share of the goal that they make. Null values don't count; a null key or day is one of its own."""
    days = events.groupBy(key, F.to_date(ts).alias("day")).agg(F.count_distinct(what).alias("n"))
    return days.withColumn("progress", F.least(F.lit(1.0), F.col("n") / goal))


def consecutive_distinct(events: DataFrame, key: str, order: list[str], what: str, least: int = LEAST) -> DataFrame:
    """Events whose value differs from that of the key's event before; the first one always stays. Nulls are equal to each other, a null key is a key of its own, and ``order`` must settle ties."""
    before = Line(events, key, order, least).lag("_before", what)
    return before.where(F.col("_before").isNull() | ~F.col(what).eqNullSafe(F.col(f"_before.{what}"))).drop("_before")


def newest(events: DataFrame, key: str, order: list[F.Column], at_most: int) -> DataFrame:
    """The newest events of each key, ``at_most`` of them however many are equal in ``order``; a null key is a key of its own. A group limit runs in each task before the shuffle."""
    return events.withColumn(
        "_n", F.row_number().over(W.partitionBy(key).orderBy(*order))
    ).where(F.col("_n") <= at_most).drop("_n")


def toggled_on(events: DataFrame, *keys: str) -> DataFrame:
    """Keys that were toggled an odd number of times; repeated rows are toggles of their own, a null is a key like others."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select(*keys)
