"""Product codes of vectors, with entries found through lower bounds from segment means.

A vector of integers is cut into equal parts, and each part is told by the nearest entry of that
part's codebook. Of a block of components, with sums s and lengths r of what is left without the
mean, the squared distance of x and c is at least (s_x - s_c)^2 / n + (r_x - r_c)^2. The bound of the
whole part passes over most entries, that of halves, quarters and so on over most of the rest;
what survives gets its exact integer distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import emit, hot_join, read, saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components go from minus this to this, so that squared distances fit in 64 bits; larger ones are set to it.
LARGEST = 1 << 26
#: Rows that are compared with a codebook at once.
ROWS = 1024
#: More than what rounding adds to a bound, relative to the lengths that it is made of.
SLACK = 1e-11

_CODED = pa.schema([
    ("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())
])
_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


def levels(size: int) -> list[int]:
    """Block sizes from coarse to fine: the part itself and its halvings, without single components."""
    out = [size]
    while out[-1] % 2 == 0 and out[-1] > 2:
        out.append(out[-1] // 2)
    return out


def summary(x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and block: the sum over the root of the block's size, and the length of what is left without the mean."""
    cut = x.reshape(len(x), -1, block).astype(np.float64)
    total = cut.sum(axis=2)
    rest = cut - (total / block)[:, :, None]
    return total / np.sqrt(block), np.sqrt((rest * rest).sum(axis=2))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and exact squared distance of each row's nearest entry (the first of equal ones), and how many exact distances it took.

    x: rows of integers; entries: at least one. The entry of the least coarse bound gives a first
    distance, that of the least finer bound a better one; an entry whose bound is larger, by more than
    rounding may make of it, can't be nearer.
    """
    if x.size == 0:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    size = x.shape[1]
    blocks = levels(size)
    mean, rest = summary(x, size)
    mean_c, rest_c = summary(entries, size)
    low = (mean - mean_c.T) ** 2 + (rest - rest_c.T) ** 2
    scale = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] + (entries.astype(np.float64) ** 2).sum(axis=1)[None, :]
    low -= SLACK * scale
    exact = lambda i, k: ((x[i] - entries[k]) ** 2).sum(axis=1)
    starts = lambda i: np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    found = exact(np.arange(len(x)), low.argmin(axis=1))
    taken = len(x)
    i, k = np.nonzero(low <= found[:, None])
    for block in blocks[1:]:
        (mean, rest), (mean_c, rest_c) = summary(x, block), summary(entries, block)
        bound = ((mean[i] - mean_c[k]) ** 2 + (rest[i] - rest_c[k]) ** 2).sum(axis=1) - SLACK * scale[i, k]
        at = starts(i)  # each row is still there: that of its nearest entry is among its bounds
        likely = np.flatnonzero(bound == np.repeat(np.minimum.reduceat(bound, at), np.diff(np.r_[at, len(i)])))
        far = exact(i[likely], k[likely])
        taken += len(likely)
        found = np.minimum(found, np.minimum.reduceat(far, starts(i[likely])))
        stays = bound <= found[i]
        i, k = i[stays], k[stays]
    far, at = exact(i, k), starts(i)
    least = np.minimum.reduceat(far, at)
    tie = np.where(far == np.repeat(least, np.diff(np.r_[at, len(i)])), k, len(entries))
    return np.minimum.reduceat(tie, at), least, taken + len(i)


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, label (as text), v (integers) of the rows whose vector is there and has finite components only; floor(scale * x), within LARGEST."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    edge = float(LARGEST)
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-edge), F.least(F.lit(edge), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))
    return vectors.where(F.col(vector).isNotNull() & ~bad).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), whole.alias("v")
    )


def _matrix(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have vectors of the size, and these as a matrix."""
    v = batch.column("v")
    fits = np.diff(v.offsets.to_numpy()) == size
    of_size = v.filter(pa.array(fits))
    return fits, of_size.flatten().to_numpy().astype(np.int64).reshape(int(fits.sum()), size)


def _parts(matrix: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """From row, part, the part's rows, indices and distances, by chunks of rows."""
    size = books.shape[2]
    for at in range(0, len(matrix), ROWS):
        chunk = matrix[at:at + ROWS]
        for p in range(len(books)):
            x = chunk[:, p * size:(p + 1) * size]
            index, far, _ = nearest(x, books[p])
            yield at, p, x, index, far


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry becomes the floor of the mean of the parts nearest to it; one without any stays.

    A task adds up what it reads, so what is shuffled is one row for each entry and task, and what
    reaches the driver is as large as the codebooks.
    """
    parts, entries, size = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, p, x, index, _ in _parts(_matrix(batch, parts * size)[1], books):
                np.add.at(total[p], index, x)
                n[p] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(n)
        yield emit(_SUMS, part=part.astype(np.int32), entry=entry.astype(np.int32), n=n[part, entry], total=list(total[part, entry]))

    sums = vectors.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("total", i)).alias(f"t{i}") for i in range(size)]
    )
    out = books.copy()
    for row in sums.collect():  # a row for each entry of a part at most
        out[row.part, row.entry] = [row[f"t{i}"] // row.n for i in range(size)]
    return out


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) of ``integers``: they start as the parts of the vectors with the smallest ids, and are refined in rounds over all vectors.

    Vectors count that have the commonest length (the least of equally common ones); rows of one id
    are in order of their components, those without an id come last. None without vectors, or if
    that length can't be cut into equal parts. The entries are the bounded part that the driver holds.
    """
    length = vectors.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if length is None or length.length % parts:
        return None
    first = vectors.where(F.size("v") == length.length).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds):
        books = refined(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray | None) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances, summed over parts); a vector of another length has null for both."""
    size = -1 if books is None else books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, matrix = _matrix(batch, size) if books is not None else (np.zeros(batch.num_rows, bool), np.zeros((0, 0), np.int64))
            codes = np.zeros((len(matrix), 0 if books is None else len(books)), np.uint8)
            error = np.zeros(len(matrix), np.int64)
            for at, p, x, index, far in _parts(matrix, books) if books is not None else ():
                codes[at:at + len(x), p] = index
                error[at:at + len(x)] += far
            told, errors = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            told[fits], errors[fits] = [row.tobytes().hex() for row in codes], error
            yield emit(
                _CODED, vec_id=batch.column("vec_id"), label=batch.column("label"), code=pa.array(told, pa.string()),
                error=pa.array(errors, pa.int64())
            )

    return vectors.mapInArrow(run, "vec_id long, label string, code string, error long")


def digest(books: np.ndarray | None) -> str | None:
    """SHA-256 of all entries' components, by part, entry and position."""
    return None if books is None else hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    fit: Callable[[DataFrame], np.ndarray | None] = train
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the rows that ``integers`` keeps.

    label_error is the error of all rows of an equal label, nulls together; the labels that very
    many rows have get theirs by broadcast. Repeated rows have a row each; a null id is coded like
    others; an empty table gives an empty result; other columns are ignored. Vectors that differ
    from the commonest length have a null code and a null error, which counts for nothing.
    """
    kept = saved(integers(vectors, vec_id, vector, label), "vectors")
    books = fit(kept)
    coded = saved(encode(kept, books).withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))), "codes")
    sums = coded.groupBy("key").agg(
        F.coalesce(F.sum("error"), F.lit(0)).alias("label_error"), F.count(F.lit(1)).alias("n")
    )
    return hot_join(coded, sums, "key", "n").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).cast("string").alias("codebooks_sha256")
    )


def _round_sql(k: int) -> str:
    """SQL of one assignment to codebook k, and of the codebook after it."""
    return f"""
a{k} AS (SELECT vec_id, label, part, arg_min(struct_pack(e := entry, d := d), d * {ENTRIES} + entry) AS r FROM (
    SELECT p.*, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM p JOIN b{k} USING (part)) GROUP BY ALL),
u{k} AS (SELECT part, entry, list(c ORDER BY i) AS c FROM (
    SELECT p.part, r.e AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n, (s - ((s % n) + n) % n) // n AS c
    FROM a{k} JOIN p USING (vec_id, part), range(1, len(x) + 1) AS q(i) GROUP BY p.part, r.e, i) GROUP BY part, entry),
b{k + 1} AS (SELECT part, entry, coalesce(u{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN u{k} USING (part, entry)),"""


ORACLE_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
    len(embedding) // {PARTS} AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * w + 1:part * w + w] AS x FROM k, range({PARTS}) AS q(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < {ENTRIES}),
{"".join(_round_sql(k) for k in range(ROUNDS + 1))}
s AS (SELECT string_agg(array_to_string(c, ','), ',' ORDER BY part, entry) AS all_entries FROM b{ROUNDS}),
o AS (SELECT vec_id, label, string_agg(lower(printf('%02x', r.e)), '' ORDER BY part) AS code, CAST(sum(r.d) AS BIGINT) AS error
    FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha256(all_entries) AS codebooks_sha256
FROM o, s
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings; see ``compressed`` for nulls, repeated rows, odd lengths and empty tables."""
    return compressed(read(spark, sf_dir, "embeddings"))
