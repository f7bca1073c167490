"""Exact copies, product codes and ranked search against brute force, with awkward rows."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import exact_dedup, packing, quality_classifier, ranked_search, registry, vector_codes
from lexspark.llm.common import read

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, digest string, run int, n_chars long, kept string, term string, shard long"
TERM = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_vector_codes", "op13_ranked_search"])
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = c.sql(registry.ORACLES[name]), registry.QUERIES[name](spark, DATA)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    line = lambda rows: sorted(map(repr, rows))
    assert line(tuple(r) for r in got.select(names).collect()) == line(want.select(*names).fetchall())


def documents(spark, texts, ids=None, parts=5):
    ids = ids or [i * 3 for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "clash", 1, 0, None, "x", 2) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(parts)


# --- exact copies


def awkward():
    rng = random.Random(5)
    out = ["", None, "", "a", "A", "a ", "long " * 40_000, "long " * 40_000, "é", "é", "日本 \U0001f600"]
    return out + ["same for a third"] * 60 + [f"text {rng.randint(0, 40)}" for _ in range(110)]


def groups_by_hand(rows):
    """Ids by text; one row stays: the largest id, nulls last."""
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts,width", [(1, 2), (7, 16), (40, 64)])
def test_exact_groups(spark, parts, width):
    texts = awkward()
    ids = [i * 3 if i % 11 else None for i in range(len(texts))]
    ids[20:24] = [5000, 5000, 5000, 5000]  # the same id and text
    docs = documents(spark, texts, ids, parts)
    rows = exact_dedup.saved(exact_dedup.digests(docs))
    groups = exact_dedup.merge_runs(rows, parts=width)
    assert groups.select("digest").distinct().count() == groups.count() == len({t or "" for t in texts})
    got = exact_dedup.exact_groups(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    found = got.collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], key=repr) == groups_by_hand(list(zip(ids, texts, strict=True)))
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found})  # one of each, also where ids repeat
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_groups_smallest_and_normalised(spark):
    docs = documents(spark, ["One", "one", "two", "ONE", None], [4, 2, 3, 9, None])
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, normalise=F.lower, largest=False).collect()}
    assert [got[i].keep_id for i in (4, 2, 9, 3)] == [2, 2, 2, 3] and got[None].keep_id is None and got[None].kept
    assert [got[i].kept for i in (4, 2, 9)] == [False, True, False]
    assert sorted(r.doc_id for r in exact_dedup.keep_one(documents(spark, ["x", "x", "y"])).collect()) == [3, 6]
    assert exact_dedup.exact_groups(docs.where("false")).collect() == []


def test_runs_meet_in_rounds(spark):
    """Copies of a hot text are spread over runs by their tasks until the last round, and no exchange is by digest alone."""
    docs = documents(spark, ["hot"] * 300, parts=16)
    rows = exact_dedup.saved(exact_dedup.digests(docs))
    plan = exact_dedup.merge_runs(rows, parts=64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1 and "SortAggregate" in plan and "Python" not in plan
    assert exact_dedup.merge_runs(rows, parts=64).collect()[0].n == 300


def test_unequal_texts_of_one_digest_stop_the_job(spark):
    rows = exact_dedup.digests(documents(spark, ["a", "b", "a"])).withColumn("digest", F.unhex(F.sha2(F.lit(b"x"), 256)))
    with pytest.raises(Exception, match="different texts have one digest"):
        exact_dedup.merge_runs(rows, parts=16).collect()


# --- product codes


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error and the codebooks; every entry is compared."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    size = len(kept[0][2]) // parts
    cut = lambda v: [v[p * size:(p + 1) * size] for p in range(parts)]
    books = [list(p) for p in zip(*[cut(v) for _, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]], strict=True)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min(range(len(books[p])), key=lambda k: (far(x, books[p][k]), k))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, _, v in kept:
            for p, x in enumerate(cut(v)):
                members[p, near(p, x)].append(x)
        for (p, k), xs in members.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, label, v in kept:
        chosen = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, label, bytes(chosen).hex(), sum(far(x, books[p][k]) for p, (x, k) in enumerate(zip(cut(v), chosen, strict=True)))))
    return out, books


VECTORS = "vec_id long, embedding array<float>, label int, code string, v string, key string"


def test_vector_codes(spark):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(64)], i % 3 if i % 4 else None) for i in range(150)]
    rows += [rows[3]] * 40 + [(None, rows[5][1], 7)]  # a hot vector, a null id
    rows += [(900, None, 1), (901, [1.0] * 63 + [None], 1), (902, [float("nan")] + [0.0] * 63, 1), (903, [float("inf")] * 64, 1)]
    rows += [(1000 + i, [0.5] * 64, 2) for i in range(3)]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS).repartition(4)
    want, books = codes_by_hand(rows)
    by_label = collections.Counter()
    for _, label, _, error in want:
        by_label[label] += error
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    got = vector_codes.compressed(df).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == sorted(
        ((i, code, error, by_label[label]) for i, label, code, error in want), key=repr
    )
    assert {r.codebooks_sha256 for r in got} == {sha}


def test_vector_codes_few_none_and_odd_lengths(spark):
    rows = [(1, [0.1] * 16, 1), (2, [0.1] * 16, None)]
    df = lambda r: spark.createDataFrame([(*x, "", "", "") for x in r], VECTORS)
    got = {r.vec_id: r for r in vector_codes.compressed(df([*rows, (0, [0.2] * 5, 1)])).collect()}
    assert got[1].code == "00" * 16 == got[2].code and got[1].error == got[1].label_error == 0
    assert got[0].code is None and got[0].error is None  # not of the commonest length
    assert vector_codes.compressed(df(rows).where("false")).collect() == []
    odd = vector_codes.compressed(df([(1, [0.1] * 17, 1)])).first()
    assert odd.code is None and odd.codebooks_sha256 is None and odd.label_error == 0
    huge = vector_codes.compressed(df([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)])).collect()
    assert all(r.error == 0 for r in huge)  # set to the largest integers, and entries of their own


@pytest.mark.parametrize("size,spread", [(1, 5), (2, 3), (4, 200), (6, 40), (16, 100), (32, 1 << 24)])
def test_bounds_keep_the_nearest(size, spread):
    rng = np.random.default_rng(size)
    x, c = rng.integers(-spread, spread, (400, size)), rng.integers(-spread, spread, (64, size))
    c[9] = c[3]  # a tie goes to the lower index
    x[0] = c[3]
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    index, far, taken = vector_codes.nearest(x, c)
    assert (index == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()
    assert taken <= full.size + 800
    if spread >= 40:  # near their entries, most others are passed over without an exact distance
        close = c[rng.integers(0, 64, 400)] + rng.integers(-1, 2, (400, size))
        assert vector_codes.nearest(close, c)[2] < full.size / 8


# --- ranked search


def ranked_by_hand(docs, items, top=50):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    counts = [(i, collections.Counter(TERM.findall(low(t)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(low(t)))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * c.total() * n // max(1, total)
            if (s := sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])) > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    common = ["the", "of", "and", "Ünder", "x1"]
    rare = ["".join(rng.choices("abcdeé", k=rng.randint(1, 3))) for _ in range(300)]
    out = [" ".join(rng.choices(common, k=rng.randint(0, 30)) + rng.choices(rare, k=rng.randint(0, 12))) for _ in range(n)]
    return [*out, "", None, "   ", "THE the tHe", "a" * 100_000, "word " * 30_000, "日本-日本 \U0001f600", *[out[7]] * 90]


@pytest.mark.parametrize("shard", [(50, 1000), (1 << 20, 7), (1 << 20, 1 << 15)])
def test_ranked_search(spark, shard):
    texts = corpus()
    ids = [(i * 37) % 997 if i % 13 else None for i in range(len(texts))]
    items = [(1, "the of, a bé"), (2, "zzz"), (3, None), (4, ""), (5, texts[7]), (5, "日本"), (None, "x1 THE"), (6, "ünder Ünder"), (7, "a" * 100_000)]
    docs = documents(spark, texts, ids, 4)
    asks = spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, term string, shard long")
    made = ranked_search.index(docs, postings=shard[0], documents=shard[1])
    want = ranked_by_hand(list(zip(ids, texts, strict=True)), items)
    assert sorted((tuple(r) for r in ranked_search.search(made, asks).collect()), key=repr) == want
    few = ranked_by_hand(list(zip(ids, texts, strict=True)), items, top=3)
    assert sorted((tuple(r) for r in ranked_search.search(made, asks, top=3).collect()), key=repr) == few
    assert made.where("term IS NOT NULL").agg(F.sum("df")).first()[0] == sum(len(set(TERM.findall((t or "").replace("THE the tHe", "the")))) for t in texts)


def test_ranked_search_of_nothing(spark):
    docs, asks = documents(spark, ["a b", None]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    empty = ranked_search.index(docs.where("false"))
    assert ranked_search.search(empty, asks).collect() == []
    assert ranked_search.search(ranked_search.index(docs), asks.where("false")).collect() == []
    assert ranked_search.search(ranked_search.index(docs.where("text IS NULL")), asks).collect() == []


def test_numbers_pack():
    rng = random.Random(4)
    x = np.array([0, 1, 127, 128, 16383, 16384, (1 << 35) - 1, *[rng.randrange(1 << rng.randint(1, 35)) for _ in range(500)]])
    octets, size = ranked_search.packed(x)
    assert (ranked_search.unpacked(octets.tobytes()) == x).all() and size.sum() == len(octets)
    assert len(ranked_search.unpacked(b"")) == 0


def test_lists_that_cannot_win_are_not_walked(monkeypatch):
    """A frequent light term is only looked up once the best are heavier than it."""
    looked = []
    real = ranked_search.heapreplace
    monkeypatch.setattr(ranked_search, "heapreplace", lambda h, x: looked.append(x) or real(h, x))
    m = np.full(20_000, 100)
    make = lambda at, w: ranked_search._List(ranked_search.packed(np.stack([np.diff(np.r_[0, at]), np.ones(len(at), int)], axis=1).ravel())[0].tobytes(), w, m)
    light, heavy = make(np.arange(20_000), 5), make(np.arange(0, 20_000, 100), 5000)
    got = ranked_search.best([light, heavy], 10)
    assert [p for _, p in got] == list(range(0, 1000, 100)) and len(looked) < 3000


# --- packing by sums of squares, and the classifier's fit


def test_packing_follows_the_sum_of_squares():
    """Every placement is that of least squared counts, the fullest of equal ones, by trying all."""
    rng, window = random.Random(1), 64
    packer, held = packing.Packer(window, 0), []
    for doc in range(600):
        r = rng.randint(1, window - 1)
        counts = collections.Counter(map(sum, held))
        costs = {}
        for h in {0, *counts}:
            if h + r <= window:
                after = collections.Counter(counts)
                after[h] -= h > 0
                after[h + r] += h + r < window
                costs[h] = sum(n * n for n in after.values())
        least = max(h for h, c in costs.items() if c == min(costs.values()))
        if least:
            to = next(i for i in range(len(held) - 1, -1, -1) if sum(held[i]) == least)
            now = [*held.pop(to), r]
        else:
            now = [r]
        if sum(now) < window:
            held.append(now)
        packer.place((doc, 0, np.arange(r, dtype=np.uint32), r), r)
        assert {h: int(n) for h, n in enumerate(packer.level) if n} == dict(collections.Counter(map(sum, held)))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 400])
def test_packing_keeps_what_is_placed(n):
    """The closing step fills the fullest windows from the least full ones; most pieces stay where they were placed."""
    rng, window = random.Random(n), 64
    packer = packing.Packer(window, 7)
    for doc in range(n):
        packer.add(doc, np.arange(rng.randint(1, 150), dtype=np.uint32))
    before = {h: [[p[:2] for p in w] for w in ws] for h, ws in packer.open.items()}
    total, closed = sum(len(ws) for ws in before.values()), len(packer.done)
    packer.finish()
    by, ids = collections.defaultdict(list), collections.defaultdict(list)
    for doc, start, length, octets, tokens, sequence, offset in packer.done:
        by[sequence].append((offset, length))
        ids[doc].append((start, np.frombuffer(octets, "<u4").tolist()))
        assert len(octets) == 4 * length and length > 0
    assert all(sum(x for _, x in sorted(v)[:i]) == o for v in by.values() for i, (o, _) in enumerate(sorted(v)))
    assert sum(sum(x for _, x in v) < window for v in by.values()) <= 1
    assert all([x for _, xs in sorted(v) for x in xs] == list(range(sum(len(xs) for _, xs in v))) for v in ids.values())
    if n == 400:
        kept = sum(len(ws) for ws in before.values()) - packer.cut
        assert total > 20 and kept > 0 and packer.cut < len(packer.done) - closed


def test_gradients_add_up_over_blocks(monkeypatch):
    """All passages enter the fit, those of long documents too, and blocks change nothing but rounding."""
    rng = np.random.default_rng(3)
    counts = np.array([1, 700, 3, 1, 40, 2, 900, 5] * 6)
    first = np.append(0, np.cumsum(counts))
    x = rng.normal(size=(first[-1], quality_classifier.FEATURES)).astype(np.float32)
    y = (np.arange(len(counts)) % 2).astype(np.float64)
    monkeypatch.setattr(quality_classifier, "STEPS", 5)
    whole = []
    for block in (1 << 30, 500):
        monkeypatch.setattr(quality_classifier, "BLOCK", block)
        whole.append(quality_classifier.fit(x, first, y).scores(x.astype(float), first))
    assert np.allclose(*whole, atol=1e-9)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"y": [1, 0], "text": ["word " * 20_000, ""]})
    made = [r for b in quality_classifier._bags(iter([batch])) for r in b.to_pylist()]
    assert [r["n"] for r in made] == [-(-20_000 // quality_classifier.PASSAGE_WORDS), 1]
