"""Neighbours, running sums and later values of rows in the order of a key, also where one key has a large part of all rows.

A key with very many rows is cut into parts at quantiles of its order. Windows run over the parts,
and what a part takes over from those before or after it comes from one summary row of each.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key is cut if it has more than one in SHARE of all rows, so at most SHARE keys are, and more than LEAST rows; into PARTS parts.
SHARE, LEAST, PARTS = 1000, 1_000_000, 64


class Line:
    """Rows in the order of each value of ``key``, by ``order`` ascending with nulls first.

    ``order`` starts with a number or a time, and settles ties where these matter; rows with equal
    values of its first column are never cut apart. A null key is a key like others. The parts of
    the cut keys are at most SHARE * PARTS, so their summaries go to every task; without cut keys
    the plan is that of a plain window. ``like``: a line of the same keys and order that has been
    cut already.
    """

    def __init__(self, rows: DataFrame, key: str, order: list[str], least: int = LEAST, like: Line | None = None) -> None:
        self.key, self.order = key, order
        self.cut = like.cut if like else self._cut(rows, least)
        if self.cut is not None:
            met = rows.join(F.broadcast(self.cut), rows[key].eqNullSafe(F.col("_line_key")), "left").drop("_line_key")
            part = F.coalesce(F.size(F.filter("_line_bounds", lambda b: F.col(order[0]) > b)), F.lit(0))
            rows = met.withColumn("_line_part", part).drop("_line_bounds")
        self.rows, self.by = rows, [key, "_line_part"] if self.cut is not None else [key]

    def _cut(self, rows: DataFrame, least: int) -> DataFrame | None:
        """_line_key, _line_bounds of the keys that are cut; None if there are none."""
        counts = rows.groupBy(F.col(self.key).alias("_line_key")).agg(F.count(F.lit(1)).alias("_n"))
        large = counts.where(F.col("_n") > least)
        total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
        if most is None or most <= least or most * SHARE <= total:
            return None
        large = large.where(F.col("_n") * SHARE > total).select("_line_key")
        met = rows.join(F.broadcast(large), rows[self.key].eqNullSafe(F.col("_line_key")))
        at = [i / PARTS for i in range(1, PARTS)]
        return met.groupBy("_line_key").agg(F.array_distinct(F.percentile_approx(self.order[0], at, 100 * PARTS)).alias("_line_bounds"))

    @cached_property
    def window(self) -> W:
        return W.partitionBy(*self.by).orderBy(*self.order)

    def _carried(self, summary: Column, carry: Column, forward: bool) -> DataFrame:
        """The rows with ``_line_carry``: ``carry`` of the summaries of the parts before (or after) a row's own, null in the outermost."""
        line = W.partitionBy("_line_key").orderBy("_line_part" if forward else F.desc("_line_part"))
        parts = self.rows.join(F.broadcast(self.cut.select("_line_key")), self.rows[self.key].eqNullSafe(F.col("_line_key"))).groupBy(
            "_line_key", "_line_part"
        ).agg(summary.alias("_line_summary"))
        over = parts.select("_line_key", F.col("_line_part").alias("_line_of"), carry.over(line.rowsBetween(W.unboundedPreceding, -1)).alias("_line_carry"))
        rows = self.rows
        return rows.join(
            F.broadcast(over), rows[self.key].eqNullSafe(F.col("_line_key")) & (rows["_line_part"] == F.col("_line_of")), "left"
        ).drop("_line_key", "_line_of")

    def _shown(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.withColumn(name, value).drop("_line_carry", "_line_part")

    def lag(self, name: str, *columns: str) -> DataFrame:
        """The rows with a struct of the columns of the row before; null without one."""
        return self._beside(name, columns, True)

    def lead(self, name: str, *columns: str) -> DataFrame:
        """The same of the row after."""
        return self._beside(name, columns, False)

    def _beside(self, name: str, columns: tuple[str, ...], forward: bool) -> DataFrame:
        held = F.struct(*columns)
        inner = (F.lag if forward else F.lead)(held).over(self.window)
        if self.cut is None:
            return self._shown(self.rows, name, inner)
        edge = (F.max_by if forward else F.min_by)(held, F.struct(*self.order))
        return self._shown(self._carried(edge, F.last("_line_summary"), forward), name, F.coalesce(inner, F.col("_line_carry")))

    def running_sum(self, name: str, value: Column) -> DataFrame:
        """The rows with the sum of a number, not null, up to each; equal rows of ``order`` count one by one."""
        inner = F.sum(value).over(self.window.rowsBetween(W.unboundedPreceding, 0))
        if self.cut is None:
            return self._shown(self.rows, name, inner)
        carried = self._carried(F.sum(value), F.sum("_line_summary"), True)
        return self._shown(carried, name, inner + F.coalesce("_line_carry", F.lit(0)))

    def least_later(self, name: str, value: Column) -> DataFrame:
        """The rows with the least value of the rows that come later by the first column of ``order``, which is a long and not null; null without one."""
        back = W.partitionBy(*self.by).orderBy(F.desc(self.order[0])).rangeBetween(W.unboundedPreceding, -1)
        inner = F.min(value).over(back)
        if self.cut is None:
            return self._shown(self.rows, name, inner)
        return self._shown(self._carried(F.min(value), F.min("_line_summary"), False), name, F.least(inner, F.col("_line_carry")))
