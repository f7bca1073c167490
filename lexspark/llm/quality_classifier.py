"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its words, hashed to signed buckets,
and from figures of their shape; a gated attention learned from the
documents' labels weighs the passages; the weighted sum of their encodings is scored.
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
from lexspark.llm.arrays import U, Chunk, chunks, word_hashes, words
from lexspark.llm.common import emit, free_name, read, with_column_type

PASSAGE_WORDS = 64
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 2_000
#: Passages whose gradients are added up at once, about: the fit goes through the documents in blocks.
BLOCK = 4096
THRESHOLD = 0.7
HIDDEN, GATE, STEPS, RATE, DECAY = 16, 8, 150, 0.02, 3e-3

# byte classes: 0 lower, 1 upper, 2 digit, 3 beyond ASCII, 4 blank, 5 line end, 6 sentence mark, 7 shout, 8 pipe, 9 symbol, 10 other
_CLASS = np.full(256, 10, np.uint8)
for _i, _chars in enumerate((
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "", " \t\r\x0b\x0c", "\n", ".,;:?'\"-", "!", "|",
    "#*$%&<>@=_~^{}[]()/\\+`"
)):
    _CLASS[[ord(x) for x in _chars]] = _i
_CLASS[128:] = 3
_KINDS = 11
#: Buckets that the words of a passage are hashed to; each word adds or takes away one.
BUCKETS = 128
FEATURES = _KINDS + 9 + BUCKETS


def passages(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of PASSAGE_WORDS words, and each text's first passage (with the end).

    A text without words has one passage of zeros, so no bag is empty.
    """
    w = words(c)
    count = np.maximum(1, -(-w.counts // PASSAGE_WORDS))
    first = np.append(0, np.cumsum(count))
    text = np.repeat(np.arange(len(count)), count)
    begin = np.minimum(w.first[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * PASSAGE_WORDS, w.first[1:][text])
    end = np.minimum(begin + PASSAGE_WORDS, w.first[1:][text])
    n = (end - begin).astype(np.float64)
    if not len(w.start):
        return np.zeros((first[-1], FEATURES), np.float32), first
    of_word = np.repeat(np.arange(len(n)), end - begin)
    length = (w.end - w.start).astype(np.float64)
    h = word_hashes(c, w)
    per = lambda x: np.bincount(of_word, x, len(n)) / np.maximum(n, 1)
    top = _CLASS[c.data[w.start]]
    last = _CLASS[c.data[w.end - 1]]
    again = lambda k: np.append(
        h[k:] == h[:-k], np.zeros(min(k, len(h)), bool)
    ) if len(h) > k else np.zeros(len(h), bool)
    mean = per(length)
    words_part = np.stack(
        [
            n / PASSAGE_WORDS, mean / 10, np.sqrt(np.maximum(per(length**2) - mean**2, 0)) / 10, per((length <= 3) * 1.0),
            per((top == 1) * 1.0), per((last == 6) * 1.0), per((last >= 7) * 1.0), per(again(1) * 1.0), per(again(2) * 1.0)
        ],
        1
    )
    live = np.flatnonzero(n)
    at = w.start[begin[live]]
    span = np.diff(np.append(at, len(c.data)))
    idx = np.repeat(live * _KINDS, span) + _CLASS[c.data[at[0] :]]
    kinds = np.bincount(idx, minlength=len(n) * _KINDS).reshape(-1, _KINDS)
    share = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)
    low = word_hashes(c, w, lower=True)
    bucket, sign = (low & U(BUCKETS - 1)).astype(np.int64), 1.0 - 2.0 * ((low >> U(40)) & U(1)).astype(np.float64)
    hashed = np.bincount(
        of_word * BUCKETS + bucket, sign, len(n) * BUCKETS
    ).reshape(-1, BUCKETS) / np.sqrt(np.maximum(n, 1))[:, None]
    return np.concatenate([share, words_part, hashed], 1).astype(np.float32), first


@dataclass
class Model:
    """h = tanh(We x + be); attention softmax of a . (tanh(V h) * sigmoid(U h)); score sigmoid(c . sum + b)."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        w = self.w
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["We"] + w["be"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        attention = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(attention[:, None] * h, first[:-1], axis=0)
        return {
            "x": x, "h": h, "t": t, "g": g, "bag": bag, "attention": attention, "z": z,
            "score": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        }

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["score"]


def _gradients(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss of some bags."""
    w, f = model.w, model.forward(x, first)
    err = (f["score"] - y) * weight
    dz = err[:, None] * w["c"]
    bag, att, h, t, g = f["bag"], f["attention"], f["h"], f["t"], f["g"]
    datt = (dz[bag] * h).sum(1)
    de = att * (datt - np.add.reduceat(att * datt, first[:-1])[bag])
    dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
    dh = att[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T
    dpre = dh * (1 - h * h)
    return {
        "We": f["x"].T @ dpre, "be": dpre.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": f["z"].T @ err,
        "b": err.sum(keepdims=True)
    }


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Full-batch Adam on the log loss of the bags, classes weighted alike; gradients are added up over blocks of whole bags."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    w = {
        "We": draw(d, HIDDEN), "be": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE),
        "c": draw(HIDDEN), "b": np.zeros(1)
    }
    mean, std = (x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)) if len(x) else (np.zeros(d), np.ones(d))
    model = Model(mean, std + 1e-2, w)
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart: the same score for all
        model.w["c"][:] = 0
        model.w["b"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    cuts = np.unique(np.append(np.searchsorted(first[:-1], np.arange(0, len(x), BLOCK)), len(y)))
    for step in range(1, STEPS + 1):
        grad = {k: np.zeros_like(p) for k, p in w.items()}
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            block = first[lo : hi + 1]
            part = _gradients(model, x[block[0] : block[-1]].astype(np.float64), block - block[0], y[lo:hi], weight[lo:hi])
            for k, g in part.items():
                grad[k] += g
        for k, p in w.items():
            q = grad[k] + DECAY * p * (k not in ("be", "b"))
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.999 * v[k] + 0.001 * q * q
            p -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


_BAG = pa.schema([("y", pa.int32()), ("n", pa.int32()), ("x", pa.binary())])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ys = batch.column("y").to_pylist()
        for c in chunks(batch.column("text")):
            x, first = passages(c)
            yield emit(_BAG, y=ys[c.lo : c.hi], n=np.diff(first).astype(np.int32), x=[p.tobytes() for p in np.split(x, first[1:-1])])


def train(docs: DataFrame, labels: DataFrame, at_most: int = SAMPLE) -> Model:
    """Fit on all passages of at most ``at_most`` labelled documents, the only rows that reach the driver: half as many bytes more than their texts have."""
    rows = labelled.sample(docs, labels, "quality", 4, 2, at_most).mapInArrow(_bags, "y int, n int, x binary").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["x"])))
    x = np.concatenate([
        np.zeros((0, FEATURES), np.float32), *[np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    ])
    return fit(
        x, np.append(0, np.cumsum([r["n"] for r in rows])).astype(np.int64),
        np.array([r["y"] for r in rows], np.float64)
    )


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "_score") -> DataFrame:
    """All columns and the score under ``name``, which must be free: nothing but the text enters. A null text counts as empty; rows are scored one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.scores(*passages(c)) for c in chunks(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())],
                names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, with_column_type(docs, name, T.DoubleType()))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with their own columns."""
    name = free_name(docs, "_score")
    return score(docs, model, name=name).where(F.col(name) >= threshold).drop(name)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. Null texts are scored as empty, repeated rows alike; a null id is not held out. Without labels of both kinds all scores are equal."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model).drop("text")
    return scored.select(
        "doc_id", (labelled.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted")
    )
