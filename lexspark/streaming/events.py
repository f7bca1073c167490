"""Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexspark.operators.events import DAILY_GOAL, GAP_MS, PER_SPAN, SPAN_MS


def rate_limited(
    events: DataFrame, key: str, ms: str, gap: int = GAP_MS, span: int = SPAN_MS, per_span: int = PER_SPAN
) -> DataFrame:
    """key, ms, accepted of each event of a stream, by the rule of the batch operator; events of a batch are taken in order of time.

    A key's state is the times accepted last, per_span at most. An event earlier than one already
    judged is judged when it comes.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queue = list(state.get[0]) if state.exists else []
        times = sorted(int(t) for f in frames for t in f["ms"])
        taken = []
        for t in times:
            queue = [a for a in queue if t - a < span]
            ok = len(queue) < per_span and (not queue or t - queue[-1] >= gap)
            taken.append(ok)
            if ok:
                queue.append(t)
        state.update((queue,))
        yield pd.DataFrame({key: k[0], "ms": times, "accepted": taken})

    kind = dict(events.dtypes)[key]
    given = events.select(key, F.col(ms).cast("long").alias("ms")).dropna()
    return given.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, ms long, accepted boolean", "queue array<long>", "append", GroupStateTimeout.NoTimeout
    )


def daily_progress(events: DataFrame, key: str, ts: str, what: str, late: str = "1 day", goal: int = DAILY_GOAL) -> DataFrame:
    """Distinct values of each key and day, and the share of the goal; a day is given out once the watermark has passed its end."""
    marked = events.withWatermark(ts, late)
    day = F.window(ts, "1 day")
    once = marked.select(key, ts, what, day.alias("_day")).dropDuplicates([key, what, "_day"])
    counts = once.groupBy("_day", key).agg(F.count(what).alias("n"))
    return counts.select(key, F.to_date("_day.start").alias("day"), "n", F.least(F.lit(1.0), F.col("n") / goal).alias("progress"))


def reading_log(events: DataFrame, key: str, ms: str, what: str) -> DataFrame:
    """key, ms and value of the events of a stream whose value differs from that of the key's event before; a key's state is its last value.

    Events of a batch are taken in order of time, and of value at one time; a null value differs from all others.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = sorted((int(t), "" if v is None else f"={v}", v) for f in frames for t, v in zip(f["ms"], f["value"], strict=True))
        last, kept = (state.get[0] if state.exists else None), []
        for t, mark, v in rows:
            if mark != last:
                kept.append((t, v))
            last = mark
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), "ms": [t for t, _ in kept], "value": [v for _, v in kept]})

    kind = dict(events.dtypes)[key]
    given = events.select(key, F.col(ms).cast("long").alias("ms"), F.col(what).cast("string").alias("value")).dropna(subset=[key, "ms"])
    return given.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ms long, value string", "last string", "append", GroupStateTimeout.NoTimeout)
