"""A written index of a corpus by words: phrases and tokens are looked for in the vocabulary, and only blocks of rows that have such words are read.

Normal forms have single spaces between words, so a phrase without its first and last word is whole
words, and a token without spaces occurs within words only. The index has four tables:

- ``rows``: row, block, the corpus's columns and its fields (normal forms); a block is BLOCK_ROWS rows that stand together
- ``postings``: field, word, block, most (the most that a row has), rows (row, row_ord, n of each row with the word)
- ``words``: field, word, n_blocks
- ``grams``: gram, field, word: all stretches of two and three characters of a word, and of its loose form
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import text as fx
from lexspark.sources import shared

#: Two to the power of this is the number of rows in a block.
BLOCK_BITS = 5
#: Up to so many blocks are handed to the scan, as at most so many ranges.
NAMED_BLOCKS, RANGES = 4096, 64

_POSTINGS = "field string, word string, block long, most int, rows array<struct<row: long, row_ord: long, n: int>>"
_ROW = pa.struct([("row", pa.int64()), ("row_ord", pa.int64()), ("n", pa.int32())])


class WordIndex(NamedTuple):
    rows: DataFrame
    postings: DataFrame
    words: DataFrame
    grams: DataFrame


def write_rows(corpus: DataFrame, folder: str) -> DataFrame:
    """The first table alone: a corpus (row_ord, its fields, any other columns but row and block) in the order in which it is read, without a shuffle. Many queries need no more."""
    made = corpus.withColumn("row", F.monotonically_increasing_id())
    return shared.written(
        made.withColumn("block", F.shiftright("row", BLOCK_BITS)), f"{folder}/rows", **{"parquet.page.row.count.limit": "128"}
    )


def write(rows: DataFrame, folder: str, fields: list[str]) -> WordIndex:
    """Write the other tables, from ``write_rows``'s.

    Every row is indexed, also those that repeat a ``row_ord``. Null and empty fields have no words.
    Postings are dealt by word and stretch of blocks, so a word that all rows have is dealt over all
    tasks.
    """
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each block; a block that two tasks read has postings from both."""
        now, held = None, None
        for batch in batches:
            for block, row, row_ord, *texts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if block != now:
                    if held:
                        yield _posted(now, held)
                    now, held = block, defaultdict(list)
                for field, text in zip(fields, texts, strict=True):
                    for word, n in Counter((text or "").split(" ")).items():
                        if word:
                            held[field, word].append((row, row_ord, n))
        if held:
            yield _posted(now, held)

    found = rows.select("block", "row", F.col("row_ord").cast("long"), *fields).mapInArrow(run, _POSTINGS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = shared.written(
        found.repartition(n, "word", F.shiftright("block", 10)).sortWithinPartitions("word", "field", "block"),
        f"{folder}/postings", **{"parquet.page.row.count.limit": "512"}
    )
    words = shared.written(
        postings.groupBy("field", "word").agg(F.count_distinct("block").alias("n_blocks")), f"{folder}/words"
    )
    loose = fx.loose_key(F.col("word"))
    every = F.when(loose == F.col("word"), _grams(F.col("word"))).otherwise(F.array_union(_grams(F.col("word")), _grams(loose)))
    grams = words.select(F.explode(every).alias("gram"), "field", "word")
    shared.written(
        grams.repartition(n, "gram", F.pmod(F.xxhash64("word"), F.lit(16))).sortWithinPartitions("gram", "field", "word"),
        f"{folder}/grams", **{"parquet.page.row.count.limit": "2048"}
    )
    return read(spark, folder)


def _grams(word: Column) -> Column:
    """All stretches of two and three characters."""
    return F.array_union(*[F.regexp_extract_all(word, F.lit(f"(?s)(?=({'.' * k}))"), F.lit(1)) for k in (2, 3)])


def _posted(block: int, held: dict[tuple[str, str], list[tuple]]) -> pa.RecordBatch:
    row, row_ord, n = zip(*[x for rows in held.values() for x in rows], strict=True)
    ends = [0]
    for rows in held.values():
        ends.append(ends[-1] + len(rows))
    flat = pa.StructArray.from_arrays([pa.array(row, pa.int64()), pa.array(row_ord, pa.int64()), pa.array(n, pa.int32())], fields=list(_ROW))
    return pa.RecordBatch.from_arrays([
        pa.array([f for f, _ in held]), pa.array([w for _, w in held]), pa.array([block] * len(held), pa.int64()),
        pa.array([max(x[2] for x in rows) for rows in held.values()], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    ], names=["field", "word", "block", "most", "rows"])


def read(spark: SparkSession, folder: str) -> WordIndex:
    return WordIndex(*[spark.read.parquet(f"{folder}/{t}") for t in WordIndex._fields])


def _folder(table: DataFrame, name: str) -> str:
    return f"{shared.top(table.sparkSession)}/{name}-{shared.state_of(table)}"


def rows_standing(table: DataFrame, name: str) -> DataFrame | None:
    """The rows that stand in the shared folder for the table's files as they are now; None if there are none."""
    spark, folder = table.sparkSession, _folder(table, name)
    return spark.read.parquet(f"{folder}/rows") if shared.exists(spark, f"{folder}/rows/_SUCCESS") else None


def rows_for(table: DataFrame, corpus: DataFrame, name: str) -> DataFrame:
    """The rows of a corpus that is made from a table: those which stand, or else new ones. Other sessions find them too."""
    rows = rows_standing(table, name)
    return write_rows(corpus, _folder(table, name)) if rows is None else rows


def standing(table: DataFrame, name: str) -> WordIndex | None:
    """The whole index, as far as its last table stands."""
    spark, folder = table.sparkSession, _folder(table, name)
    return read(spark, folder) if shared.exists(spark, f"{folder}/grams/_SUCCESS") else None


def for_table(table: DataFrame, corpus: DataFrame, fields: list[str], name: str) -> WordIndex:
    """The same with the tables of words; they are complete once the last one is."""
    index = standing(table, name)
    return write(rows_for(table, corpus, name), _folder(table, name), fields) if index is None else index


def occurrences(word: Column, token: Column) -> Column:
    """Occurrences of a token in a word, from left to right."""
    return ((F.length(word) - F.length(F.replace(word, token, F.lit("")))) / F.length(token)).cast("int")


def words_with(index: WordIndex, tokens: DataFrame) -> DataFrame:
    """token, field, word, occurs: the words that have each of the tokens (distinct, two characters or more, without spaces)."""
    asked = tokens.select("token", F.substring("token", 1, 3).alias("gram"))
    return index.grams.join(asked, "gram").where(F.col("word").contains(F.col("token"))).select(
        "token", "field", "word", occurrences(F.col("word"), F.col("token")).alias("occurs")
    )


def _fits(form: Column, phrase: str) -> list[tuple[str, Column]]:
    """For each piece of a phrase that can be looked up: its gram, and whether a word, in some form, may stand for it."""
    pieces, out = phrase.split(" "), []
    for i, p in enumerate(pieces):
        if len(p) > 1:
            first, last = i == 0, i == len(pieces) - 1
            fits = form.contains(p) if first and last else form.endswith(p) if first else form.startswith(p) if last else form == p
            out.append((p[:3], fits))
    return out


def blocks_with(index: WordIndex, phrase: str, field: str = "norm", loosely: bool = False) -> DataFrame | None:
    """The blocks that can have a phrase in a field, and ``loosely`` also those that can have its loose form in the field's; None if all can.

    A block of these needn't have it, since words may stand apart; one of the others hasn't. Each
    piece of the phrase is a bit, and a block has the bits of its words.
    """
    ways = [_fits(F.col("word"), phrase)]
    if loosely:
        ways.append(_fits(fx.loose_key(F.col("word")), fx.loose(phrase)))
    if not all(ways) or sum(map(len, ways)) > 62:
        return None
    looked, bits, full, at = sorted({g for way in ways for g, _ in way}), [], [], 0
    for way in ways:
        bits += [F.when((F.col("gram") == g) & fits, F.lit(1 << at + i)).otherwise(0).cast("long") for i, (g, fits) in enumerate(way)]
        full.append((1 << len(way)) - 1 << at)
        at += len(way)
    mask = reduce(lambda a, b: a.bitwiseOR(b), bits)
    words = index.grams.where((F.col("field") == field) & F.col("gram").isin(looked)).select("word", mask.alias("mask")).where(
        "mask <> 0"
    ).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    met = index.postings.where(F.col("field") == field).select("word", "block").join(words, "word")
    whole = reduce(lambda a, b: a | b, [F.col("mask").bitwiseAND(F.lit(f)) == f for f in full])
    return met.groupBy("block").agg(F.bit_or("mask").alias("mask")).where(whole).select("block")


def rows_of(index: WordIndex, blocks: DataFrame | None) -> DataFrame:
    """The rows of some blocks. Up to NAMED_BLOCKS are named to the scan, which passes over pages and files without them; more are not worth it, and all rows are read."""
    if blocks is None:
        return index.rows
    named = sorted(r.block for r in blocks.limit(NAMED_BLOCKS + 1).collect())
    if not named:
        return index.rows.where("false")
    if len(named) > NAMED_BLOCKS:
        return index.rows
    gaps = sorted(range(1, len(named)), key=lambda i: named[i - 1] - named[i])[:RANGES - 1]
    starts = [0, *sorted(g for g in gaps if named[g] > named[g - 1] + 1)]
    ranges = [(named[a], named[b - 1]) for a, b in zip(starts, [*starts[1:], len(named)], strict=True)]
    block = F.col("block")
    return index.rows.where(reduce(lambda x, y: x | y, [(block >= a) & (block <= b) for a, b in ranges]))


def having(index: WordIndex, phrase: str, field: str = "norm") -> DataFrame:
    """The rows whose field has the phrase, or whose loose form has the phrase's; see ``functions.text.has_phrase``."""
    return rows_of(index, blocks_with(index, phrase, field, loosely=True)).where(fx.has_phrase(F.col(field), phrase))


def containing(index: WordIndex, part: str, field: str = "norm") -> DataFrame:
    """The rows whose field has the string."""
    return rows_of(index, blocks_with(index, part, field)).where(F.col(field).contains(part))


def counts_of_terms(index: WordIndex, terms: DataFrame, group: str = "group_key", field: str = "norm") -> DataFrame:
    """``counts_in_rows`` of an index."""
    return counts_in_rows(index.rows, terms, group, field)


def counts_in_rows(rows: DataFrame, terms: DataFrame, group: str = "group_key", field: str = "norm") -> DataFrame:
    """term, the group, n: how often each of a table of terms occurs in a field, by a column of the rows, where it does.

    Terms (column ``term``) have two characters or more and no spaces; repeated ones count once. A
    term occurs where a word has it, also more than once. Words are counted by group before they
    meet the terms, so what is shuffled grows with the vocabulary of the groups and not with the
    texts, of which none is written. A word meets terms by its stretches of two or three characters
    that begin a term.
    """
    asked = terms.where((F.length("term") > 1) & ~F.col("term").contains(" ")).select(
        "term", F.substring("term", 1, 3).alias("_gram")
    ).distinct()
    words = rows.select(F.col(group), F.explode(F.split(field, " ")).alias("_word")).where(F.length("_word") > 1)
    by_group = words.groupBy("_word", group).agg(F.count(F.lit(1)).alias("_n"))
    told = by_group.select("*", F.explode(_grams(F.col("_word"))).alias("_gram"))
    met = told.join(asked, "_gram").where(F.col("_word").contains(F.col("term")))
    return met.groupBy("term", group).agg(F.sum(F.col("_n") * occurrences(F.col("_word"), F.col("term"))).alias("n"))
