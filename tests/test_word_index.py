"""The word index: what it finds is what a scan finds, and what it needn't read isn't read."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.functions import text as fx
from lexspark.operators import corpus as cp
from lexspark.operators import retrieval
from lexspark.operators import word_index as wi
from lexspark.sources import shared

COMMON = ["the", "of", "and", "كتاب", "باب"]


def prose(rng, n):
    rare = lambda: "".join(rng.choices("abcdeاب", k=rng.randint(2, 6)))
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else rare() for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = [prose(rng, rng.randint(0, 60)) for _ in range(1500)]
    out[700] += " needle in hay"
    out[701] += " xneedle inside"
    return [*out, None, "", "   ", "x" * 60_000, "needle " * 3000, out[5]]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('words')}"
    rows = spark.createDataFrame([("g", i % 1450, t) for i, t in enumerate(texts)], "g string, i long, t string").repartition(2)
    rows.write.parquet(f"{folder}/t")
    table = spark.read.parquet(f"{folder}/t")
    corpus = cp.normalized(cp.as_corpus(table, "g", "i", "t")).withColumn("heading", fx.normalize(F.substring("text", 1, 30)))
    return wi.for_table(table, corpus, ["norm", "heading"], "words-of-a-test")


@pytest.mark.parametrize("phrase", ["needle", "needle in", "eedle in ha", "the of", "كتاب", "كتب", "a", "zzzz", "of the and", "e", "needle needle", "x" * 500])
def test_found_like_by_a_scan(index, phrase):
    keys = lambda rows: sorted(r.row for r in rows.select("row").collect())
    assert keys(wi.having(index, phrase)) == keys(cp.containing(index.rows, phrase))
    assert keys(wi.containing(index, phrase)) == keys(index.rows.where(F.col("norm").contains(phrase)))


def test_blocks_without_the_words_are_not_read(spark, index):
    few = wi.blocks_with(index, "needle in")
    assert few.count() < index.rows.select("block").distinct().count() / 4
    plan = wi.containing(index, "needle in")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block" in plan  # the scan gets the ranges
    took = lambda df: df.select("row", "norm").count()
    assert took(wi.rows_of(index, few)) < took(index.rows) / 2
    assert wi.rows_of(index, wi.blocks_with(index, "zzzz")).count() == 0
    assert wi.blocks_with(index, "a") is None  # too short to look up: all rows are read


def test_scan_reads_fewer_pages(index):
    """Pages outside the ranges aren't decoded: the reader itself gives fewer rows, below the filter."""
    given = []
    for df in (index.rows, wi.rows_of(index, wi.blocks_with(index, "needle in"))):
        run = df.select("norm", "block")._jdf.queryExecution()
        run.toRdd().count()
        given.append(run.executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value())
    assert 0 < given[1] < given[0] / 2


def test_index_follows_the_files(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "g string, i long, t string").write.mode("overwrite").parquet(f"file://{tmp_path}/t")
    read = lambda: spark.read.parquet(f"file://{tmp_path}/t")
    corpus = lambda: cp.normalized(cp.as_corpus(read(), "g", "i", "t"))
    put([("a", 1, "A. b"), ("b", 2, None)])
    one = wi.rows_for(read(), corpus(), "files-of-a-test")
    assert sorted((r.row_ord, r.text, r.norm) for r in one.collect()) == [(1, "A. b", "a b"), (2, "", "")]
    assert wi.rows_for(read(), corpus(), "files-of-a-test").inputFiles() == one.inputFiles()
    put([("a", 1, "other and longer")])
    assert [r.norm for r in wi.rows_for(read(), corpus(), "files-of-a-test").collect()] == ["other and longer"]


def by_hand(rows, asked):
    """The best row by the rules, every question on every row."""
    out = {}
    for qid, tokens in asked:
        best = None
        for r in rows:
            n = [r.norm.count(t) for t in tokens]
            h = [t in r.heading for t in tokens]
            score = sum(5 * x + (2 + 0.5 * min(c, 5) if c else 0) for c, x in zip(n, h, strict=True))
            phrase = " ".join(tokens)
            if len(tokens) > 1:
                score += 12 if phrase in r.heading else 8 if phrase in r.norm else 0
            if tokens and score >= 5 and sum(bool(c) or x for c, x in zip(n, h, strict=True)) >= -(-len(tokens) // 2):
                best = max(best or (0, 0), (score, -r.row_ord))
        if best:
            out[qid] = (-best[1], best[0])
    return out


def test_best_passages(spark, index):
    rows = index.rows.collect()
    rng = random.Random(3)
    asked = [(i, [w for w in rng.choice(rows).norm.split(" ")[:rng.randint(1, 25)] if len(w) > 1]) for i in range(25)]
    asked += [(100, []), (101, ["zzzz", "qqqq"]), (102, ["needle", "in", "hay"]), (103, ["the", "the", "of"]), (104, ["no", "needle"])]
    questions = spark.createDataFrame(asked, "id long, tokens array<string>")
    want = by_hand(rows, asked)
    search = retrieval.Passages(index, questions)
    got = search.best()
    assert {r.id: (r.row_ord, r.score) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # blocks that can't give a question's best are passed over
    blocks = search.blocks()
    bars = spark.createDataFrame([(i, 0, s) for i, (_, s) in want.items()], "id long, row_ord long, score double")
    every = len(asked) * index.rows.select("block").distinct().count()
    opened = search.able(blocks, bars)
    assert opened.count() < blocks.count() < every
    assert search.rows(opened).count() < len(asked) * len(rows) / 20


def test_nothing_indexed_or_asked(spark, index, tmp_path):
    kind = index.rows.schema
    rows = wi.write_rows(spark.createDataFrame([], kind).drop("row", "block"), f"file://{tmp_path}/none")
    empty = wi.write(rows, f"file://{tmp_path}/none", ["norm", "heading"])
    asked = spark.createDataFrame([(1, ["needle"])], "id long, tokens array<string>")
    assert retrieval.best_passages(empty, asked).collect() == [] and wi.having(empty, "needle").collect() == []
    assert retrieval.best_passages(index, asked.where("false")).collect() == []
    assert shared.exists(spark, f"file://{tmp_path}/none/grams")


def test_best_passages_by_scan(spark, index):
    """Without an index: every question, in one scan that shuffles no texts."""
    rows = index.rows.collect()
    rng = random.Random(5)
    asked = [(i, [w for w in rng.choice(rows).norm.split(" ")[:rng.randint(1, 25)] if len(w) > 1]) for i in range(25)]
    asked += [(100, []), (101, ["zzzz", "qqqq"]), (102, ["needle", "in", "hay"]), (103, ["the", "the", "of"]), (104, ["no", "needle"]), (105, ["th"]), (106, ["xx", "xxx"])]
    questions = spark.createDataFrame(asked, "id long, tokens array<string>")
    got = retrieval.best_passages_by_scan(index.rows, questions)
    assert {r.id: (r.row_ord, r.score) for r in got.collect()} == by_hand(rows, asked)
    assert "norm" not in got._jdf.queryExecution().executedPlan().toString().split("Exchange")[1].split("MapInArrow")[0]
    assert retrieval.best_passages_by_scan(index.rows, questions.where("false")).collect() == []
