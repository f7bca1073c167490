"""Every query with SQL gives the rows of its SQL; text rules and event folds on small fixtures."""

import os
import random
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexspark.functions import text as fx
from lexspark.operators import events as ev
from lexspark.operators import word_index as wi
from lexspark.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(v, 6) if isinstance(v := r[i], float) else v) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "norm"),
    [
        ("كم شدة في القرآن؟", "كم شده في القران"), ("البقرة آية ١٥٣", "البقره ايه 153"), ("2:255", "2 255"), ("؟", ""),
        ("A  b\t(C)", "a b c"), ("", ""), (None, None)
    ],
)
def test_normal_form(spark, text, norm):
    assert one(spark, fx.normalize(F.lit(text).cast("string"))) == norm


@pytest.mark.parametrize(
    ("text", "word", "standalone", "plain_n", "all_n"),
    [
        ("الله ولله بالله لله", "الله", 1, 2, 4), ("الرحمن للرحمن الرحمن", "الرحمن", 2, 2, 3),
        ("الله الله الله", "الله", 2, 3, 3), ("النار وبالنار للنار نار", "النار", 1, 2, 3)
    ],
)
def test_counts(spark, text, word, standalone, plain_n, all_n):
    t = F.lit(text)
    assert (
        one(spark, fx.count_standalone(t, word)), one(spark, fx.count_of(t, word)), one(spark, fx.count_target(t, word))
    ) == (standalone, plain_n, all_n)


def test_overlaps_letters_and_cuts(spark):
    assert one(spark, fx.count_unless_after(F.lit("aaaa"), "aa", "")) == 3
    assert one(spark, fx.count_of(F.lit("aaaa"), "aa")) == 2
    assert one(spark, fx.letter_count(F.lit("ءـي"))) == 3
    assert one(spark, fx.word_count(F.lit(""))) == 0
    assert len(one(spark, fx.sanitize(F.lit("a" * 600)))) == 500
    assert one(spark, fx.sanitize(F.lit("‏a\t b"))) == "a b"


def test_rate_limit(spark):
    ms = [1000, 1500, 1900, 2800, 3700, 4600, 5500, 6400, 7300, 8200, 15999, 16000, 16900]
    rows = ev.rate_limited(spark.createDataFrame([(1, x) for x in ms] + [(2, 5)], "u int, ms long"), "u", "ms").collect()
    assert {(r.u, r.n_events, r.n_accepted) for r in rows} == {(1, 13, 10), (2, 1, 1)}


def test_rate_limit_gathers_no_user(spark):
    """Events stream by in order: no plan step holds all events of a user, and the counts are those of a plain fold."""
    rng = random.Random(4)
    rows = [(
        rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(0, 400_000, 50)])
    ) for _ in range(3000)] + [("none", None)]
    want = {}
    for u in {u for u, _ in rows}:
        times, queue, n = sorted(t for v, t in rows if v == u and t is not None), [], 0
        for t in times:
            queue = [a for a in queue if t - a < 15_000]
            if len(queue) < 8 and (not queue or t - queue[-1] >= 900):
                queue.append(t)
                n += 1
        want[u] = (len(times), n)
    got = ev.rate_limited(spark.createDataFrame(rows, "u string, ms long").repartition(5), "u", "ms")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert {r.u: (r.n_events, r.n_accepted) for r in got.collect()} == want and got.count() == len(want)
    assert ev.rate_limited(spark.createDataFrame([], "u string, ms long"), "u", "ms").count() == 0


def test_entry_has_every_query():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_normal_form_of_all_gaps(spark):
    """Every character below U+3100 and U+FEFF between letters, alone, twice and beside spaces, as the plain rules have it."""
    white, drop = r"[\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", re.sub(r"\\x\{(\w+)\}", r"\\u\1", fx.MARKS[:-1] + fx.TATWEEL + "]")
    gaps = re.compile(f"[{white[1:-2]}{fx.PUNCTUATION[1:-1]}]+")

    def plain_rules(t):
        bare = re.sub(drop, "", t).translate(str.maketrans(fx.DIGITS + fx.FOLDED, fx.WESTERN + fx.FOLDS))
        return gaps.sub(" ", bare.lower()).strip(" ")

    chars = [c for c in map(chr, [*range(1, 0x3100), 0xFEFF]) if c.lower() == c and unicodedata.category(c) != "Cn"]
    texts = [f"{c}A{c}b {c}c{c} d {c} e{c}{c}f {c}" for c in chars] + ["", " ", " . ", "a  b", "A.\u2014b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fx.normalize(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n) for r in rows if r.n != plain_rules(r.t)] == []


def test_one_pass_writes_no_table(spark, tmp_path):
    """Totals of a table without an index leave nothing in the shared folder; they need one scan."""
    folder = f"file://{tmp_path}/d"
    spark.createDataFrame([("a", 1, "A. b", "x"), ("b", 2, None, "y")], "source string, doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    assert catalogue.QUERIES["corpus_totals"](spark, folder).collect() == [(2, 2, 2, 4)]
    assert wi.rows_standing(spark.read.parquet(f"{folder}/documents.parquet"), "documents-index") is None


@pytest.mark.parametrize("name", ["row_search", "term_locations", "terms_by_group"])
def test_one_search_writes_no_index(spark, tmp_path, name):
    """One search of a table without an index reads it once; with an index the rows are the same."""
    folder = f"file://{tmp_path}/d"
    spark.createDataFrame([
        ("a", 1, "Licensed de la vida", "x"), ("b", 2, None, "y"), ("a", 3, "unlicensed; de la", "x"), (None, 4, "dé la", "y")
    ], "source string, doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("licensed LA, vida x",)], "text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = lambda: plain((got := catalogue.QUERIES[name](spark, folder)).collect(), got.columns)
    alone = rows()
    assert wi.standing(spark.read.parquet(f"{folder}/documents.parquet"), "documents-index") is None and len(alone) > 1
    catalogue.document_index(spark, folder)
    assert rows() == alone


def test_sums_in_the_order_of_rows(spark, tmp_path):
    """Sums of doubles that end in a half are those of the SQL, though a customer's orders stand in many files."""
    rng, rows = random.Random(4), []
    for k in range(400):
        cents = [rng.randrange(100_000, 50_000_000) for _ in range(23)]
        cents.append(10_000_000 + (50 - sum(cents)) % 100)
        rows += [(i, k, c / 100) for i, c in enumerate(cents)]
    rows.sort()
    folder = f"{tmp_path}/d/orders.parquet"
    for i in range(8):
        part = spark.createDataFrame(rows[i * 1200:(i + 1) * 1200], "n int, o_custkey long, o_totalprice double").coalesce(1)
        part.drop("n").write.parquet(f"file://{folder}/part={i}")
    c = duckdb.connect()
    c.execute(f"SET threads=1; CREATE VIEW orders AS SELECT o_custkey, o_totalprice FROM read_parquet('{folder}/*/*.parquet') ")
    got = __spark_entry__.queries()["grouped_thousands"](spark, f"file://{tmp_path}/d")
    assert plain(got.collect(), ["k", "t"]) == plain(c.sql(__spark_entry__.oracle_sql()["grouped_thousands"]).fetchall(), ["k", "t"])
