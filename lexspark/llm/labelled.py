"""A bounded sample of labelled documents, for the models of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: F.Column, folds: int) -> F.Column:
    """crc32 of the id as text, modulo folds; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, at_most: int) -> DataFrame:
    """text and y of at most ``at_most`` labelled documents outside the held-out fold.

    Ids are taken in the order of their hash, so the sample doesn't follow the order of the table;
    only those with a hash under a threshold, some tenth more than are wanted, are put in order.
    Labels that are null or name no document are left out; where an id has several labels the
    largest counts, and of several documents of one id the least text. The sampled ids are at most
    ``at_most`` rows, which is why they may be broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held))
    ids = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    if (total := ids.count()) > at_most:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
        ids = ids.where(place < int(1.1 * at_most / total * (1 << 40))).orderBy(place, "doc_id").limit(at_most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")
