"""Operators over a corpus: rows with ``group_key``, ``row_ord`` (a number that orders them), ``text`` and ``norm``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as fx
from lexspark.sources import shared

SHOWN_GROUPS, SHOWN_LOCATIONS = 5, 15


def as_corpus(table: DataFrame, group: str, ordinal: str, text: str) -> DataFrame:
    """Any table as a corpus, without ``norm``; a null text is empty."""
    return table.select(
        F.col(group).alias("group_key"), F.col(ordinal).alias("row_ord"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over all cores, if they come in fewer parts, as a small table of one row group does."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def normalized(corpus: DataFrame) -> DataFrame:
    """The corpus with ``norm``, made once for each row: filters stay above a generator. For many queries see ``word_index``."""
    return spread(corpus).withColumn("norm", F.explode(F.array(fx.normalize(F.col("text")))))


def count_by_group(corpus: DataFrame, counter: Column) -> DataFrame:
    """group_key, first_row, n of the groups where the counter's sum isn't 0; sums are made before the shuffle."""
    return corpus.select("group_key", "row_ord", counter.alias("_n")).where("_n > 0").groupBy("group_key").agg(
        F.min("row_ord").alias("first_row"), F.sum("_n").cast("long").alias("n")
    )


def top_groups(counts: DataFrame, at_most: int = SHOWN_GROUPS) -> DataFrame:
    """The groups with most, those seen first among equal ones."""
    return counts.orderBy(F.desc("n"), "first_row", "group_key").limit(at_most)


def total(corpus: DataFrame, **counters: Column) -> DataFrame:
    return corpus.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for name, c in counters.items()])


def containing(corpus: DataFrame, phrase: str) -> DataFrame:
    """Rows whose normal or loose form has the phrase's."""
    return corpus.where(fx.has_phrase(F.col("norm"), phrase))


def locations(found: DataFrame, at_most: int = SHOWN_LOCATIONS) -> DataFrame:
    """The first of the rows found, each with how many there are in all and whether more are left out.

    The keys of the rows found are written, so that the texts are read once.
    """
    rows = shared.saved(found.select("group_key", "row_ord"), "locations")
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))  # one row
    return rows.orderBy("row_ord").limit(at_most).join(total, F.lit(True)).withColumn("truncated", F.col("total") > at_most)


def phrase_totals(corpus: DataFrame, phrase: str) -> DataFrame:
    """n_rows and n: rows with the phrase, and its occurrences in them."""
    counted = corpus.select(fx.phrase_count(F.col("norm"), phrase).alias("_n")).where("_n > 0")
    return counted.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n"))


def first_last(corpus: DataFrame, phrase: str) -> DataFrame:
    return containing(corpus, phrase).agg(
        F.min("row_ord").alias("first_row"), F.max("row_ord").alias("last_row"), F.count(F.lit(1)).alias("n_rows")
    )


def longest_shortest(corpus: DataFrame) -> DataFrame:
    """The longest and the shortest row by characters of the raw text; the first of equal ones."""
    n = F.length("text")
    return corpus.agg(
        F.max_by("row_ord", F.struct(n, -F.col("row_ord"))).alias("longest_row"), F.max(n).cast("long").alias("longest"),
        F.min_by("row_ord", F.struct(n, F.col("row_ord"))).alias("shortest_row"), F.min(n).cast("long").alias("shortest"),
    )


def largest_smallest_group(corpus: DataFrame) -> DataFrame:
    groups = corpus.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.min("row_ord").alias("f"))
    return groups.agg(
        F.max_by("group_key", F.struct("n", -F.col("f"))).alias("largest_group"), F.max("n").alias("largest"),
        F.min_by("group_key", F.struct("n", F.col("f"))).alias("smallest_group"), F.min("n").alias("smallest"),
    )


def keyword_rank(corpus: DataFrame, terms: list[str], at_most: int = 10, most: int = 6) -> DataFrame:
    """Rows by how often they have the terms, each term counted up to ``most`` times, and how many of the terms they have. Rows with equally many are in order of ``row_ord``; rows without any are left out, and an empty table gives none."""
    hits = [F.least(F.lit(most), fx.count_of(F.col("norm"), t)) for t in terms]
    scored = corpus.select(
        "group_key", "row_ord", sum(hits[1:], hits[0]).cast("long").alias("hits"),
        sum([(h > 0).cast("long") for h in hits[1:]], (hits[0] > 0).cast("long")).alias("n_terms")
    )
    return scored.where("hits > 0").orderBy(F.desc("n_terms"), F.desc("hits"), "row_ord").limit(at_most)
