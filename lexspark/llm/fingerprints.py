"""SimHash fingerprints of texts, in DataFrame functions only.

The terms of a text, pairs of words that follow each other, are hashed; each hash votes on every
bit of the fingerprint, for or against, with the weight of its term. Fingerprints within a Hamming
radius of each other are found through tables of permuted blocks.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.llm.common import read, saved, width

BITS = 128
#: The longest weight of a term: its characters, up to so many; longer words say more about a text.
HEAVIEST = 16
#: The chosen radius, and the blocks that fingerprints are cut into: two of the blocks are equal in any two fingerprints within it.
RADIUS, BLOCKS = 6, 8
#: Parts that the rows of a block's value are dealt over; each query goes to all of them.
SALTS = 8
_LOW = 0xFFFFFFFF


def words_of(text: F.Column) -> F.Column:
    """Stretches without white space, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def votes(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, fp_hi and fp_lo (two longs) of each key; rows that share a key must share the text.

    A term is a word and the word after it, hashed together; its weight, the characters of both up
    to HEAVIEST, travels less one in the low four bits of the hash.
    Every term adds to 64 sums of two 32-bit lanes each, a lane for each bit, so a text of up to
    2**27 words can't overflow. The sums are made as the terms are read, before any shuffle. A
    text without words has fingerprint 0. Rows that repeat vote twice, which changes no majority.
    """
    words = rows.select(*key, words_of(F.col(text)).alias("_w"))
    after = lambda i: F.get(F.col("_w"), i + 1)
    weight = lambda w, i: F.least(F.lit(HEAVIEST), F.length(w) + F.coalesce(F.length(after(i)), F.lit(0))) - 1
    marked = F.transform("_w", lambda w, i: F.xxhash64(w, after(i)).bitwiseAND(F.lit(-16)).bitwiseOR(weight(w, i).cast("long")))
    term = words.select(*key, F.explode_outer(marked).alias("_t"))
    hashed = term.select(
        *key, F.when(F.col("_t").isNotNull(), F.xxhash64("_t")).otherwise(0).alias("_h"), F.xxhash64("_t", F.lit(1)).alias("_g"),
        F.coalesce(F.col("_t").bitwiseAND(F.lit(15)) + 1, F.lit(0)).alias("_weight")
    )
    lane = lambda h, i: F.sum(F.shiftrightunsigned(F.col(h), i).bitwiseAND(F.lit(0x100000001)) * F.col("_weight"))
    sums = hashed.groupBy(*key).agg(
        F.sum("_weight").alias("_all"), *[lane(h, i).alias(f"{h}{i}") for h in ("_h", "_g") for i in range(32)]
    )
    bit = lambda value, i: F.when(
        2 * value > F.col("_all"), F.lit(_signed(1 << i))
    ).otherwise(F.lit(0).cast("long"))
    low, high = (lambda c: F.col(c).bitwiseAND(F.lit(_LOW))), (lambda c: F.shiftrightunsigned(F.col(c), 32))
    packed = lambda h: reduce(
        lambda a, b: a.bitwiseOR(b), [bit(half(f"{h}{i}"), i + at) for half, at in ((low, 0), (high, 32)) for i in range(32)]
    )
    return sums.select(*key, packed("_h").alias("fp_hi"), packed("_g").alias("fp_lo"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hex128(hi: str = "fp_hi", lo: str = "fp_lo") -> F.Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a: str, b: str) -> F.Column:
    """Hamming distance of the fingerprints in columns a_hi, a_lo and b_hi, b_lo, for prefixes a and b."""
    return F.bit_count(F.col(f"{a}_hi").bitwiseXOR(F.col(f"{b}_hi"))) + F.bit_count(F.col(f"{a}_lo").bitwiseXOR(F.col(f"{b}_lo")))


def likeness(a: str, b: str) -> F.Column:
    """The share of equal bits: 1 for equal fingerprints, about a half for texts without a common term."""
    return 1 - distance(a, b) / F.lit(float(BITS))


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, the text of the next row (the first row after the last), and the row's place (_b, _rn), in descending doc_id.

    Rows with one id are ordered by text, a null id comes last, and a null text is empty. Also the
    first rows of each bucket again, where the bucket before needs them: they have _own false.

    The ids alone are read first, for boundaries of buckets with equally many rows; what the
    driver gets is bounded by the number of buckets. Then the texts move once.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = 4 * width(spark)
    bounds = sorted(set(base.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []))
    if bounds:
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
        table = F.lit(bounds).cast("array<bigint>")
        # how many boundaries the id is not under, by halving
        found = F.aggregate(
            steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= F.col("doc_id"), at + s).otherwise(at)
        )
        bucket = F.lit(len(bounds)) - found
    else:
        bucket = F.lit(0)
    placed = base.withColumn("_b", F.coalesce(bucket, F.lit(len(bounds))).cast("int"))
    tops = sorted(placed.groupBy("_b").agg(F.max("doc_id").alias("top")).collect())
    before = [-1] * (len(bounds) + 1)
    top = [None] * (len(bounds) + 1)
    for i, (b, highest) in enumerate(tops):
        before[b], top[b] = tops[i - 1][0], highest
    leads = F.col("doc_id").eqNullSafe(F.get(
        F.lit(top).cast("array<bigint>") if any(x is not None for x in top) else F.array(*[F.lit(None).cast("bigint")] * len(top)),
        F.col("_b")
    ))
    to = F.when(
        leads,
        F.array(
            F.struct(F.col("_b"), F.lit(True).alias("_own")),
            F.struct(F.get(F.lit(before).cast("array<int>"), F.col("_b")).alias("_b"), F.lit(False).alias("_own"))
        )
    ).otherwise(F.array(F.struct(F.col("_b"), F.lit(True).alias("_own"))))
    sent = placed.withColumn("_to", F.explode(to)).select(
        "doc_id", "text", F.col("_to._b").alias("_b"), F.col("_to._own").alias("_own")
    )
    line = W.partitionBy("_b").orderBy(F.col("_own").desc(), F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return sent.select(
        "_b", "_own", "doc_id", "text", F.lead("text").over(line).alias("next_text"), F.row_number().over(line).alias("_rn")
    )


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp_*, edited_* and next_* (fingerprints as two longs) of each row.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many (or
    all) of the next row's text; see ``in_order`` for what is next, nulls and ties. Repeated rows
    give a row each; an empty text has fingerprint 0; other columns don't matter; an empty table
    gives an empty result.
    """
    rows = in_order(docs, doc_id, text)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left(F.coalesce("next_text", F.lit("")), half))
    both = rows.select("_b", "_rn", F.posexplode(F.array("text", edited)).alias("_v", "_text"))
    found = votes(both, ["_b", "_rn", "_v"], "_text")
    side = found.groupBy("_b", "_rn").agg(*[
        F.max(F.when(F.col("_v") == v, F.col(f"fp_{x}"))).alias(f"{name}_{x}") for v,
        name in ((0, "fp"), (1, "edited")) for x in ("hi", "lo")
    ])
    line = W.partitionBy("_b").orderBy("_rn")
    side = side.select("*", *[F.lead(f"fp_{x}").over(line).alias(f"next_{x}") for x in ("hi", "lo")])
    shown = rows.where("_own").select(
        "_b", "_rn", "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256")
    )
    return shown.join(side, ["_b", "_rn"]).drop("_b", "_rn")


def near(queries: DataFrame, rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs of a query's fingerprint and a different one of rows within the radius: q_hi, q_lo, fp_hi, fp_lo, distance.

    Both sides have fp_hi and fp_lo. Each distinct fingerprint counts once, so copies are not
    paired; join the result to the rows for its members. A fingerprint goes to one table for each
    two blocks, under the values of these; within a radius of ``blocks`` - 2 two blocks at least are
    equal. A pair is taken from the first table that has it. Nulls are left out. Queries are few
    beside the rows: they are repeated for each of SALTS parts of a table, so that a group of near
    fingerprints is no hot key. The join is by shuffle at every size: the queries grow with the rows.
    """
    if not 0 <= radius <= blocks - 2 or BITS % blocks:
        raise ValueError(f"with {blocks} blocks the radius is 0 to {blocks - 2}")
    size = BITS // blocks
    if size > 31 or 64 % size:
        raise ValueError("blocks must divide 64 bits into at most 31 each")
    pairs = list(combinations(range(blocks), 2))
    per = 64 // size
    block = lambda p, k: F.shiftrightunsigned(
        F.col(f"{p}_hi" if k < per else f"{p}_lo"), (k % per) * size
    ).bitwiseAND(F.lit((1 << size) - 1))
    keys = lambda p: F.posexplode(F.array(*[
        F.shiftleft(block(p, i), size).bitwiseOR(block(p, j)) for i, j in pairs
    ])).alias("_t", "_k")
    ask = queries.select(F.col("fp_hi").alias("q_hi"), F.col("fp_lo").alias("q_lo")).dropna().distinct()
    has = rows.select("fp_hi", "fp_lo").dropna().distinct()
    a = ask.select("*", keys("q")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    b = has.select("*", keys("fp"), F.pmod(F.xxhash64("fp_hi", "fp_lo"), F.lit(SALTS)).cast("int").alias("_salt"))
    same = reduce(
        lambda x, y: x.bitwiseOR(y),
        [F.when(block("q", k) == block("fp", k), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(blocks)]
    )
    passed = F.get(F.lit([sum(1 << k for k in range(j) if k != i) for i, j in pairs]), F.col("_t"))
    far = distance("q", "fp")
    return a.join(b.hint("merge"), ["_t", "_k", "_salt"]).where((far > 0) & (far <= radius) & (same.bitwiseAND(passed) == 0)).select(
        "q_hi", "q_lo", "fp_hi", "fp_lo", far.alias("distance")
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the columns of the contract, n_near: for the rows whose id is divisible by 100, how many other fingerprints are within RADIUS of theirs; null for the rest."""
    found = saved(fingerprints(read(spark, sf_dir, "documents")), "fingerprints")
    asks = F.col("doc_id") % 100 == 0
    asked = found.where(asks)
    counts = near(asked, found).groupBy(
        F.col("q_hi").alias("fp_hi"), F.col("q_lo").alias("fp_lo")
    ).agg(F.count(F.lit(1)).alias("n"))
    counted = asked.join(counts, ["fp_hi", "fp_lo"], "left").withColumn(
        "n_near", F.coalesce("n", F.lit(0)).cast("long")
    ).drop("n")
    rest = found.where(~F.coalesce(asks, F.lit(False))).withColumn("n_near", F.lit(None).cast("long"))
    return counted.unionByName(rest).select(
        "doc_id", "n_chars", "edited_sha256", hex128("fp_hi", "fp_lo").alias("fingerprint"),
        hex128("edited_hi", "edited_lo").alias("edited_fingerprint"),
        likeness("fp", "edited").alias("near_edited"), likeness("fp", "next").alias("near_next"), "n_near",
    )
