"""Five stages over documents, from raw text to packed windows.

Each stage takes what its predecessor kept. All but the last return the columns of documents; the
last returns pieces of windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexspark.llm import minhash, packing, quality_classifier, quality_rules, substrings
from lexspark.llm.common import forget, read, saved


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes them."""
    return quality_rules.keep_good(docs)


def drop_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return minhash.one_of_each(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that are found twice."""
    return substrings.without_repeats(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of tokens."""
    import public_tokenizers

    return packing.contract(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", drop_by_rules),
    ("quality_classifier", drop_by_classifier),
    ("minhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_passages),
    ("packing", pack_windows),
]
#: SQL can't express the trained classifier; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them the documents are a table in the shared folder."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        forget(*before)  # nothing reads the predecessor's table any more
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
