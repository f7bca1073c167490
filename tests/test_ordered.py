"""Neighbours, running sums and later values where one key has a third of all rows, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.operators import events as ev
from lexspark.operators import ordered
from lexspark.operators.ordered import Line

KIND = "k string, at long, i int, v int, _n int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [("hot", rng.choice([None, *range(40)]) if rng.random() < 0.1 else rng.randrange(100_000), 0, rng.choice([None, 1, 2, 3]), 0) for _ in range(900)]
    out += [(None, rng.randrange(300), 0, rng.randrange(5), 0) for _ in range(400)]
    out += [(rng.choice("abcdefgh"), rng.randrange(50), 0, rng.randrange(5), 0) for _ in range(300)]
    return [(k, at, n, v, None) for n, (k, at, _, v, _) in enumerate(out)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(5).cache()


def lines(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return {k: sorted(x, key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for k, x in by.items()}


@pytest.mark.parametrize("least", [10, 350, 10_000])
def test_neighbours_and_sums(rows, table, least):
    line = Line(table, "k", ["at", "i"], least)
    assert (line.cut is None) == (least == 10_000)
    if line.cut is not None:
        cut = {r._line_key: len(r._line_bounds) for r in line.cut.collect()}
        assert {"hot", None} <= set(cut) and cut["hot"] > 30
    before, after, total = {}, {}, {}
    for of in lines(rows).values():
        n = 0
        for i, r in enumerate(of):
            before[r[2]] = of[i - 1][3:4] if i else None
            after[r[2]] = of[i + 1][1:4:2] if i + 1 < len(of) else None
            total[r[2]] = n = n + (r[3] or 0)
    assert {r.i: r.b and tuple(r.b) for r in line.lag("b", "v").collect()} == before
    assert {r.i: r.b and tuple(r.b) for r in line.lead("b", "at", "v").collect()} == after
    summed = line.running_sum("s", F.coalesce("v", F.lit(0)))
    assert {r.i: r.s for r in summed.collect()} == total
    assert summed.columns == [*table.columns, "s"]


@pytest.mark.parametrize("least", [10, 10_000])
def test_least_later(rows, table, least):
    timed = table.where("at IS NOT NULL")
    got = {r.i: r.s for r in Line(timed, "k", ["at"], least).least_later("s", F.when(F.col("v") == 1, F.col("at"))).collect()}
    want = {}
    for of in lines([r for r in rows if r[1] is not None]).values():
        for r in of:
            want[r[2]] = min((x[1] for x in of if x[1] > r[1] and x[3] == 1), default=None)
    assert got == want


def test_a_hot_key_has_many_tasks(spark, table):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        tasks = lambda least: Line(table, "k", ["at", "i"], least).lag("b", "v").where("k = 'hot'").select(
            "b", F.spark_partition_id().alias("p")
        ).groupBy("p").agg(F.count(F.lit(1)).alias("count"), F.count("b.v")).collect()
        one, many = tasks(10_000), tasks(100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(one) == 1 and one[0]["count"] == 900
    assert len(many) > 15 and max(r["count"] for r in many) < 250


def test_empty_and_single(spark, table):
    none = Line(table.where("false"), "k", ["at"], 0)
    assert none.cut is None and none.lag("b", "v").collect() == []
    same = spark.createDataFrame([("x", 5, n, n, 0) for n in range(50)], KIND)
    assert Line(same, "k", ["at", "i"], 10).running_sum("s", F.lit(1)).agg(F.max("s")).first()[0] == 50


def test_consecutive_values_of_a_hot_key(rows, table):
    want = set()
    for of in lines(rows).values():
        want |= {r[2] for i, r in enumerate(of) if not i or of[i - 1][3] != r[3]}
    for least in (10, 10_000):
        assert {r.i for r in ev.consecutive_distinct(table, "k", ["at", "i"], "v", least).collect()} == want


@pytest.mark.parametrize("least", [20, 10_000])
@pytest.mark.parametrize("step", [300, 3_000, 40_000])
def test_rate_limit_of_a_hot_key(spark, step, least):
    """Stretches are cut at quiet times only, so dense events give long ones and sparse events single ones."""
    rng, t, rows = random.Random(step), 0, []
    for _ in range(600):
        t += rng.randint(0, step)
        rows.append((rng.choice(["hot", "hot", None, "x"]), t))
    rows += [("hot", None), ("none", None), ("x", 7), ("x", 7)]
    want = {}
    for u in {u for u, _ in rows}:
        times, queue, n = sorted(t for v, t in rows if v == u and t is not None), [], 0
        for t in times:
            queue = [a for a in queue if t - a < 15_000]
            if len(queue) < 8 and (not queue or t - queue[-1] >= 900):
                queue.append(t)
                n += 1
        want[u] = (len(times), n)
    got = ev.rate_limited(spark.createDataFrame(rows, "u string, ms long").repartition(3), "u", "ms", least=least)
    assert {r.u: (r.n_events, r.n_accepted) for r in got.collect()} == want


def test_shares_bound_what_is_broadcast():
    assert ordered.SHARE * ordered.PARTS <= 1 << 16
