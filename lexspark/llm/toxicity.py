"""Toxicity by a factorization machine over hashed terms.

Besides a weight for each term the model has a short vector; the product of two terms' vectors is
the weight of their meeting in one text, which a sum of single weights can't express.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm import labelled
from lexspark.llm.arrays import MARKS, U, Chunk, chunks, word_hashes, words
from lexspark.llm.common import emit, read, with_column_type

BUCKETS = 1 << 20
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
THRESHOLD = 0.5
FACTORS, STEPS, RATE, DECAY = 4, 200, 0.05, 1e-4
#: Pull of weights to 0, in standard errors of their gradient; decay of vectors, in distinct terms of a mean text for each text.
PULL, SHRINK = 1.0, 1.0


def terms(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, in runs, and where each text's run begins (with the end).

    A term is a run of letters and digits, A to Z as a to z.
    """
    w = words(c, MARKS)
    bucket = (word_hashes(c, w, lower=True) >> U(44)).astype(np.int64)
    both = np.unique(w.text * BUCKETS + bucket)
    return both % BUCKETS, np.searchsorted(both, np.arange(len(w.first)) * BUCKETS)


@dataclass
class Machine:
    """bias + sum of w over the terms + sum over pairs of v_i . v_j; slot: place of a bucket, -1 if it has no weight."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    buckets: np.ndarray

    def logits(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.full(len(first) - 1, self.bias)
        if not len(self.buckets) or not len(bucket):
            return out
        slot = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
        hit = self.buckets[slot] == bucket
        slot, first = slot[hit], np.append(0, np.cumsum(hit))[first]
        out += sums((self.w - 0.5 * (self.v**2).sum(1))[slot], first)
        for v in self.v.T:
            out += 0.5 * sums(v[slot], first) ** 2
        return out

    def scores(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(bucket, first), -30, 30)))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each run of values (or of rows of values); first: where each begins (and the end)."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out


def fit(bucket: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Full-batch Adam on the log loss; every term has a weight and a vector, which decay.

    A term's weight and vector stand side by side, so that each term of a text is one look-up in memory.
    """
    n, positive = len(y), float(y.sum()) if len(y) else 0.0
    if n == 0 or positive in (0, n):  # nothing to tell apart: the same score for all
        return Machine(
            float(np.log((positive + 1) / (n - positive + 1))), np.zeros(0), np.zeros((0, FACTORS)), np.zeros(0, np.int64)
        )
    known, slot = np.unique(bucket, return_inverse=True)
    k, slot = len(known), slot.astype(np.int32)
    # the texts of each term in runs, too, so that sums go along memory in both directions
    text = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))[np.argsort(slot, kind="stable")]
    of_slot = np.append(0, np.cumsum(np.bincount(slot, minlength=k)))
    # what chance alone does to a term's gradient, and one text to the vectors of its terms, is held down
    share, df = positive / n, np.diff(of_slot)
    pull = (PULL * np.sqrt(share * (1 - share) * df * (n - df) / n) / n).astype(np.float32)
    shrink = np.float32(SHRINK * len(slot) / n**2)
    rng = np.random.default_rng(seed)
    bias, p = np.log(positive / (n - positive)), np.zeros((k, 1 + FACTORS), np.float32)  # weight, vector
    p[:, 1:] = rng.normal(0, 0.05, (FACTORS, k)).T
    m, s, own, grad = np.zeros_like(p), np.zeros_like(p), np.empty_like(p), np.empty_like(p)
    m_bias = s_bias = 0.0
    for step in range(1, STEPS + 1):
        own[:, 1:] = p[:, 1:]
        own[:, 0] = p[:, 0] - 0.5 * np.einsum("ij,ij->i", p[:, 1:], p[:, 1:])
        total = sums(np.take(own, slot, axis=0), first).astype(np.float64)
        logit = bias + total[:, 0] + 0.5 * (total[:, 1:] ** 2).sum(1)
        err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        total[:, 0] = 1
        back = sums(np.take((err[:, None] * total).astype(np.float32), text, axis=0), of_slot)
        np.multiply(p[:, 1:], back[:, :1], out=grad[:, 1:])
        grad[:, 1:] = back[:, 1:] - grad[:, 1:] + shrink * p[:, 1:]
        grad[:, 0] = back[:, 0] + np.float32(DECAY) * p[:, 0] + pull * np.sign(p[:, 0])
        rate, even, odd = RATE * (1 - step / (STEPS + 1)), 1 - 0.9**step, 1 - 0.999**step
        m_bias, s_bias = 0.9 * m_bias + 0.1 * err.sum(), 0.999 * s_bias + 0.001 * err.sum() ** 2
        bias -= rate * (m_bias / even) / (np.sqrt(s_bias / odd) + 1e-8)
        m += np.float32(0.1) * (grad - m)
        s += np.float32(0.001) * (grad * grad - s)
        p -= np.float32(rate / even) * m / (np.sqrt(s / np.float32(odd)) + np.float32(1e-8))
    return Machine(float(bias), p[:, 0].copy(), p[:, 1:].copy(), known)


_BAG = pa.schema([("y", pa.int32()), ("terms", pa.binary())])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ys = batch.column("y").to_pylist()
        for c in chunks(batch.column("text")):
            bucket, first = terms(c)
            yield emit(
                _BAG, y=ys[c.lo : c.hi],
                terms=[bucket[a:b].astype(np.int32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            )


def train(docs: DataFrame, labels: DataFrame, at_most: int = SAMPLE) -> Machine:
    """Fit on the terms of at most ``at_most`` labelled documents, the only rows that reach the driver."""
    rows = labelled.sample(docs, labels, "toxic", 5, 0, at_most).mapInArrow(_bags, "y int, terms binary").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["terms"])))
    bags = [np.frombuffer(r["terms"], np.int32) for r in rows]
    bucket = np.concatenate([np.zeros(0, np.int32), *bags]).astype(np.int64)
    return fit(
        bucket, np.append(0, np.cumsum([len(b) for b in bags])).astype(np.int64), np.array([r["y"] for r in rows], np.float64)
    )


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "_score") -> DataFrame:
    """All columns and the score under ``name``, which must be free: nothing but the text enters. A null text counts as empty; rows are scored one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [machine.scores(*terms(c)) for c in chunks(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())],
                names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, with_column_type(docs, name, T.DoubleType()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. Null texts are scored as empty, repeated rows alike; a null id is not held out. Without labels of both kinds all scores are equal."""
    docs = read(spark, sf_dir, "documents")
    machine = train(docs, read(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), machine).drop("text")
    return scored.select(
        "doc_id", (labelled.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted")
    )
