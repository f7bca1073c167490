"""Exact duplicates by a tree of merges of sorted runs of digests.

Every task sorts the digests of its rows into a run. In each round 2 ** ROUND_BITS runs exchange
slices: a run keeps, and gets, the digests of its own slice only, and merges what it gets. After the
last round a run holds one range of digests from all tasks. Equal digests become one row at each
merge, so copies of one text are met in steps and a large group is never gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import hot_join, read, saved, width

#: A round merges up to two to the power of so many runs.
ROUND_BITS = 3

ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, digest (SHA-256 of the text's UTF-8), check (its length and a second hash), row (tells equal rows apart), run (that of the row's task)."""
    given = F.coalesce(F.col(text).cast("string"), F.lit(""))
    octets = F.encode(normalise(given) if normalise else given, "UTF-8")
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(octets, 256)).alias("digest"),
        F.struct(F.length(octets).alias("size"), F.xxhash64(octets).alias("hash")).alias("check"),
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run")
    )


def _merged(runs: DataFrame, run: Column) -> DataFrame:
    """One row for each run and digest; rows of one digest whose checks differ stop the job."""
    best = F.when(F.min("check") == F.max("check"), F.max("best")).otherwise(
        F.raise_error(F.lit("different texts have one digest")).cast(runs.schema["best"].dataType)
    )
    return runs.withColumn("run", run).groupBy("run", "digest").agg(
        best.alias("best"), F.sum("n").alias("n"), F.max("check").alias("check")
    )


def merge_runs(rows: DataFrame, largest: bool = True, parts: int | None = None) -> DataFrame:
    """digest, keep_id, keep_row, n of each digest of ``digests``: the row that stays, and how many there are.

    The row with the largest (or smallest) id stays; a null id comes after all others, and of
    rows that repeat the id that of the largest ``row``. ``parts`` is the number of runs after the
    first round, rounded up to a power of two; the cluster's number of shuffle partitions by default.
    """
    bits = max(2, ((parts or width(rows.sparkSession)) - 1).bit_length())
    place = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - bits).cast("int")
    rank = F.col("doc_id") if largest else -F.col("doc_id")
    runs = rows.select(
        F.col("run").bitwiseAND(F.lit((1 << bits) - 1)).alias("run"), "digest", "check", F.lit(1).cast("long").alias("n"),
        F.struct(F.col("doc_id").isNotNull().alias("known"), rank.alias("rank"), "row", "doc_id").alias("best")
    )
    top = bits
    while top > 0:
        low = max(0, top - ROUND_BITS)
        slice_of = ((1 << top) - 1) & ~((1 << low) - 1)
        to = F.col("run").bitwiseAND(F.lit(~slice_of)).bitwiseOR(place.bitwiseAND(F.lit(slice_of)))
        if top == bits:  # a task's own copies meet before the first exchange
            runs = _merged(runs, to)
        else:  # runs have no copies of their own: whole slices move to the task of their run
            runs = _merged(runs.withColumn("run", to).repartitionById(1 << bits, F.col("run")), F.col("run"))
        top = low
    return runs.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n")


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise: Callable[[Column], Column] | None = None,
    largest: bool = True
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when their UTF-8 is, after ``normalise``; a null text is an empty one. One row
    of each group stays: that with the largest (or smallest) id, a row without an id only where no
    row has one, and one of those that repeat the id that stays. Other columns are ignored, an empty
    table gives an empty result. The rows are kept as a table of digests, so texts are read once;
    rows of the largest groups get their group's row by broadcast (at most common.HOT_KEYS).
    """
    rows = saved(digests(docs, doc_id, text, normalise), "digests")
    groups = saved(merge_runs(rows, largest), "digest-groups")
    return hot_join(rows, groups.withColumn("group_size", F.col("n")), "digest", "n").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one of each group of equal texts is left. Ids must tell rows apart; see ``exact_groups``."""
    kept = exact_groups(docs, doc_id, text).where("kept").select(F.col("doc_id").alias(doc_id))
    return docs.join(kept, docs[doc_id].eqNullSafe(kept[doc_id]), "left_semi")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents; see ``exact_groups`` for nulls, ties, repeated rows and empty tables."""
    return exact_groups(read(spark, sf_dir, "documents"))
