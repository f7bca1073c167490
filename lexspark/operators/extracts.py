"""Extracts of a group: the first sentences of its first rows, without gathering the group's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions import text as fx

#: Rows of a group that are shown, characters of each, and what stands between them.
PARTS, PART_CHARS, BETWEEN = 6, 160, " … "


def first_rows(rows: DataFrame, group: str, order: str, text: str, at_most: int = PARTS) -> DataFrame:
    """group, place (from 1), text of the first rows of each group in ``order``, ``at_most`` of them.

    The ranks are found without the texts: a group limit runs in each task before the shuffle, so a
    task sends ``at_most`` narrow rows of a group, however many it has. Texts are then read of the
    rows up to the last place only. Rows of equal order stand in the order of their texts; a null
    order or text is less than any other, and a null group is one of its own.
    """
    one = W.partitionBy("_g").orderBy("_o")
    narrow = rows.select(F.col(group).alias("_g"), F.struct(F.col(order).alias("o")).alias("_o"))
    last = narrow.withColumn("_n", F.row_number().over(one)).where(F.col("_n") <= at_most).groupBy("_g").agg(F.max("_o").alias("_upto"))
    told = rows.select(F.col(group).alias("_of"), F.struct(F.col(order).alias("o")).alias("_o"), F.col(text).alias("_t"))
    near = told.join(last, told["_of"].eqNullSafe(last["_g"]) & (told["_o"] <= last["_upto"]))
    placed = near.withColumn("place", F.row_number().over(W.partitionBy("_of").orderBy("_o", "_t")))
    return placed.where(F.col("place") <= at_most).select(F.col("_of").alias(group), "place", F.col("_t").alias(text))


def extracts(rows: DataFrame, group: str, order: str, text: str, parts: int = PARTS, chars: int = PART_CHARS) -> DataFrame:
    """group, n_rows, n_shown, extract: of each of the group's first rows the first sentences that fit in ``chars``, joined by an ellipsis.

    A row's first sentence is shown in any case, a text without sentences as far as ``chars``. A null
    text counts as a row and shows nothing. An empty table has no groups.
    """
    shown = first_rows(rows, group, order, text, parts).groupBy(F.col(group).alias("_s")).agg(
        F.count(F.lit(1)).alias("n_shown"),
        F.array_sort(F.collect_list(F.struct("place", fx.extract(F.col(text), chars).alias("part")))).alias("_p")
    )
    sizes = rows.groupBy(F.col(group)).agg(F.count(F.lit(1)).alias("n_rows"))
    met = sizes.join(shown, sizes[group].eqNullSafe(F.col("_s")))
    return met.select(group, "n_rows", "n_shown", F.array_join("_p.part", BETWEEN).alias("extract"))
