"""The newest rows of each key of a stream, kept as state that goes away when a key is quiet.

The session needs the state store that has lists and timers: see ``STATE_STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexspark.operators.store import DELETE, PUT

#: The setting, and its value, under which a session's streams can have lists and timers as state.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


class _Newest(StatefulProcessor):
    """State of a key: its newest rows, newest first, and the time of its timer."""

    def __init__(self, key: str, at_most: int, quiet_ms: int) -> None:
        self.key, self.at_most, self.quiet_ms = key, at_most, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "ms long, value string")
        self.due = handle.getValueState("due", "due long")

    def _out(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        kept = [{"ms": t, "value": v} for t, v in rows]
        return pd.DataFrame({self.key: [key[0]], "rows": [kept], "gone": [not rows]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [(int(t), v) for t, v in self.rows.get()] if self.rows.exists() else []
        for frame in rows:  # a frame is merged before the next one comes, so a hot key needs no more than one
            kept += [(int(t), None if pd.isna(v) else v) for t, v in zip(frame["ms"], frame["value"], strict=True)]
            kept = sorted(kept, key=lambda r: (-r[0], r[1] is None, r[1] or ""))[: self.at_most]
        if not kept:
            return
        self.rows.put(kept)
        due = kept[0][0] + self.quiet_ms
        before = self.due.get()[0] if self.due.exists() else None
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.due.update((due,))
        yield self._out(key, kept)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        self.due.clear()
        yield self._out(key, [])

    def close(self) -> None:
        pass


def newest(events: DataFrame, key: str, ts: str, what: str, at_most: int, quiet: str = "1 day", late: str = "1 hour") -> DataFrame:
    """key, rows (ms, value; newest first), gone: what a key of a stream has, after each batch that changes it; output mode update.

    Of rows of equal time those of smaller value come first, nulls last. ``ts`` is a timestamp; rows
    later than ``late`` behind the newest of all aren't taken. A key that has no row newer than
    ``quiet`` before the watermark is given out once more, gone and without rows, and has no state
    from then on. Rows without a time or a key are left out.
    """
    spark = events.sparkSession
    quiet_ms = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {quiet})").first()[0]
    given = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).withWatermark(ts, late).select(
        key, ts, F.unix_millis(ts).alias("ms"), F.col(what).cast("string").alias("value")
    )
    kind = dict(events.dtypes)[key]
    return given.groupBy(key).transformWithStateInPandas(
        _Newest(key, at_most, quiet_ms), f"{key} {kind}, rows array<struct<ms: long, value: string>>, gone boolean",
        "Update", "EventTime"
    )


def as_operations(changes: DataFrame, key: str) -> DataFrame:
    """The changes of a batch as operations of a ``KeyedStore`` with the fields key and rows, for ``foreachBatch``: a key that is gone is deleted.

    A key that goes and comes back in one batch stays: what has rows goes before what has none.
    """
    at = F.when(F.col("gone"), 0).otherwise(1).cast("long")
    return changes.select(key, "rows", F.when(F.col("gone"), F.lit(DELETE)).otherwise(F.lit(PUT)).alias("op"), at.alias("at"))
