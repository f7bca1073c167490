"""Extracts by group against plain Python; a hot group's texts stay where they are."""

import random
import re

import pytest

from lexspark.operators import extracts as ex

WORDS = ["one", "two.", "three!", "four؟", "five\n", "six"]


def by_hand(text, chars):
    if text is None:
        return None
    out = ""
    for s in filter(None, re.split(r"(?<=[.؟!])\s+|\n+", text)):
        if out and len(out) + len(s) > chars:
            break
        out += (" " if out else "") + s
        if len(out) >= chars:
            break
    return out or text[:chars]


@pytest.fixture(scope="module")
def given():
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "\n\n", " ".join(rng.choices(WORDS, k=rng.randint(1, 60))), "no end " * 50])
    rows = [(rng.choice(["hot", "hot", "hot", None, *"abc"]), rng.choice([None, *range(40)]), text(), "clash") for _ in range(400)]
    return rows + rows[:20] + [("one", 1, "A long text. " * 20_000, "clash")]


def test_extracts(spark, given):
    df = spark.createDataFrame(given, "g string, o int, t string, n_rows string").repartition(5)
    got = {r.g: tuple(r)[1:] for r in ex.extracts(df.select("g", "o", "t"), "g", "o", "t", 4, 30).collect()}
    assert got == {r.g: tuple(r)[1:] for r in ex.extracts(df, "g", "o", "t", 4, 30).collect()}
    low = lambda v: (v is not None, v if v is not None else 0)
    for g in {r[0] for r in given}:
        own = sorted((r for r in given if r[0] == g), key=lambda r: (low(r[1]), r[2] is not None, (r[2] or "").encode()))
        parts = [p for p in (by_hand(r[2], 30) for r in own[:4]) if p is not None]
        assert got[g] == (len(own), min(4, len(own)), ex.BETWEEN.join(parts)), g
    assert ex.extracts(df.limit(0), "g", "o", "t").count() == 0


def test_ranks_do_not_carry_texts(spark, tmp_path):
    spark.range(1000).selectExpr("'hot' AS g", "id AS o", "repeat('x', 10) AS t").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    plan = ex.first_rows(rows, "g", "o", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # before and after both shuffles
    assert "ReadSchema: struct<g:string,o:bigint>" in plan
