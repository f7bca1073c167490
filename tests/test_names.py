"""Names in texts, and counts of very many terms, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import names as nm
from lexspark.operators import word_index as wi

LONG = "one two three four five six seven eight nine ten"


def longest(text, names):
    have = [n for n in names if n and f" {n} " in f" {text or ''} "]
    return min(have, key=lambda n: (-len(n), n), default=None)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    words = ["ab", "abc", "b", "the", "of", "كتاب", "x"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", f"z {LONG} z", "one two three four five six seven eight nine", "the " * 20_000 + "rare", "the of"] + ["the of ab"] * 100
    names = list({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)}) + [LONG, "rare", "missing", "", None, "the the"]
    return texts, names


def test_longest_name(spark, corpus):
    texts, names = corpus
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, norm string").repartition(4)
    table = spark.createDataFrame([(n, i, "clash") for i, n in enumerate(names)], "name string, id int, other string")
    got = {r.row: r.name for r in nm.longest_name(rows, table).collect()}
    assert got == {i: n for i, t in enumerate(texts) if (n := longest(t, names))}
    met = nm.found_names(rows, table)
    assert met.columns == ["row", "name", "id", "other"]
    want = {(i, n) for i, t in enumerate(texts) for n in names if n and f" {n} " in f" {t or ''} "}
    assert {(r.row, r.name) for r in met.collect()} == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert nm.longest_name(rows, table.where("false")).collect() == [] and nm.longest_name(rows.where("false"), table).collect() == []


def test_ties_by_number(spark):
    rows = spark.createDataFrame([(1, "aa bb")], "row long, norm string")
    names = spark.createDataFrame([("bb", 2), ("aa", 5), ("bb", 9)], "name string, number int")
    assert nm.longest_name(rows, names, tie="number").first().number == 2


def test_a_hundred_thousand_names(spark):
    """Names of any number: every one is found where it stands."""
    names = spark.range(100_000).select(F.concat(F.lit("name "), F.hex("id"), F.lit(" of"), F.hex("id")).alias("name"), "id")
    rows = spark.range(0, 100_000, 50).select(F.col("id").alias("row"), F.concat(F.lit("a name "), F.hex("id"), F.lit(" of"), F.hex("id"), F.lit(" b")).alias("norm"))
    got = nm.longest_name(rows, names)
    assert got.count() == 2000 and got.where("row <> id").count() == 0


def test_counts_of_terms(spark, corpus, tmp_path):
    texts, _ = corpus
    rows = wi.write_rows(spark.createDataFrame([(f"g{i % 3}" if i % 7 else None, i, t) for i, t in enumerate(texts)], "group_key string, row_ord long, norm string"), f"file://{tmp_path}/i")
    index = wi.write(rows, f"file://{tmp_path}/i", ["norm"])
    terms = ["ab", "abc", "th", "he", "كت", "zz", "the of", "a", "", None, "ab", "rare"]
    got = wi.counts_of_terms(index, spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {}
    for i, t in enumerate(texts):
        for w in {x for x in terms if x and len(x) > 1 and " " not in x}:
            if n := (t or "").count(w):
                key = w, f"g{i % 3}" if i % 7 else None
                want[key] = want.get(key, 0) + n
    assert {(r.term, r.group_key): r.n for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_texts_do_not_go_along_with_their_stretches(spark):
    """What is shuffled grows with the words of a text, not with their square; a long name must stand in one text in whole."""
    words = [f"w{i}" for i in range(8000)]
    name = " ".join(words[100:121])
    rows = spark.createDataFrame([
        (1, " ".join(words)), (2, " ".join(words[100:112])), (2, " ".join(["z"] * 12 + words[112:121])), (3, " ".join(words[100:120])),
        (4, f"a {name} b"), (5, f"{name}x"), (5, " ".join(words[100:108] + words[100:121]))
    ], "row long, norm string")
    names = spark.createDataFrame([(name, 1), (name, 2), (" ".join(words[7992:]), 3), ("w5", 4)], "name string, id int")
    got = nm.found_names(rows, names)
    assert sorted((r.row, r.id) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (4, 1), (4, 2), (5, 1), (5, 2)]
    plan = got._jdf.queryExecution().optimizedPlan()
    above = lambda node: [node, *[x for i in range(node.children().size()) for x in above(node.children().apply(i))]]
    outs = [n.output().mkString(",") for n in above(plan) if n.nodeName() == "Generate"]
    assert outs and not any("norm" in o for o in outs)
