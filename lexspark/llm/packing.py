"""Sum-of-squares online packing of documents into token windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.arrays import chunks
from lexspark.llm.bpe import encoder
from lexspark.llm.common import emit, read

WINDOW = 1024
END_ID = 0

_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64())
])
_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_FLUSH = 4 << 20


class Packer:
    """Windows of one stream of documents.

    ``level[h]`` counts the open windows that hold h tokens. A document's last piece goes to the
    level h (0: a new window) for which the sum of the squared counts ends up least; among equal
    ones, to the fullest. Only open windows are held.
    """

    def __init__(self, window: int, first_id: int):
        self.window, self.next = window, first_id
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.done: list[tuple] = []
        self.bytes = self.cut = 0

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, tokens in pieces:
            self.done.append((doc, start, len(ids), ids.astype("<u4").tobytes(), tokens, self.next, at))
            at += len(ids)
        self.bytes += 4 * at
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for start in range(0, n - w + 1, w):
            self.close([(doc, start, ids[start : start + w], n)])
        if r := n % w:
            self.place((doc, n - r, ids[n - r :].copy(), n), r)

    def place(self, piece: tuple, r: int) -> None:
        level, w = self.level, self.window
        cost = 2 * level[r : w + 1] + 1  # of the level that gains a window, for h from 0
        cost[-1] = 0  # a full window is no longer open
        cost[1:] -= np.where(level[1 : w - r + 1] > 0, 2 * level[1 : w - r + 1] - 1, -(1 << 40))
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        pieces = self.open[h].pop() if h else []
        level[h] -= h > 0
        pieces.append(piece)
        if h + r == w:
            self.close(pieces)
        else:
            self.open.setdefault(h + r, []).append(pieces)
            level[h + r] += 1

    def finish(self) -> None:
        """At the stream's end open windows stay as they are, the fullest first, and are filled up with what the least full ones hold, cut to fit, so that at most one window is padded.

        ``cut`` counts the pieces that are moved so.
        """
        windows = [pieces for h in sorted(self.open, reverse=True) for pieces in self.open[h]]
        free = [self.window - h for h in sorted(self.open, reverse=True) for _ in self.open[h]]
        lo, hi = 0, len(windows) - 1
        while lo < hi:
            doc, start, ids, tokens = windows[hi].pop()
            self.cut += 1
            while len(ids) and lo < hi:
                take = min(len(ids), free[lo])
                windows[lo].append((doc, start, ids[:take], tokens))
                start, ids = start + take, ids[take:]
                free[lo] -= take
                if not free[lo]:
                    self.close(windows[lo])
                    lo += 1
            if len(ids):  # the last window is the only one left, and what was taken from it goes back
                windows[hi].append((doc, start, ids, tokens))
            elif not windows[hi]:
                hi -= 1
        if lo == hi and windows[lo]:
            self.close(windows[lo])
        self.open.clear()


def _rows(done: list[tuple]) -> pa.RecordBatch:
    return emit(_SCHEMA, **{f.name: pa.array([x[i] for x in done], f.type) for i, f in enumerate(_SCHEMA)})


def pack(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents, placed in windows: see the columns of _SCHEMA; ids are little-endian unsigned 32-bit.

    A document is the ids of its text (a null or empty one has none) and end_id. Whole windows
    are cut off its front; the rest is placed online. Each input partition is a stream of its own,
    so nothing is shuffled, no task holds more than its open windows, and at most one window of
    a partition is padded. Repeated rows are documents of their own. An empty table gives no piece.
    path: a vocabulary file of the tokenizers library, present on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        end = np.array([end_id], np.uint32)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            docs_of = batch.column(0).to_pylist()
            for c in chunks(batch.column(1)):
                for doc, ids in zip(docs_of[c.lo : c.hi], known.encode(c), strict=True):
                    packer.add(doc, np.concatenate([ids, end]))
                    if packer.bytes >= _FLUSH:
                        yield _rows(packer.done)
                        packer.done, packer.bytes = [], 0
        del known
        encoder.cache_clear()  # the worker outlives the task, and serves other stages
        packer.finish()
        yield _rows(packer.done)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _DDL)


def contract(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum for their ids; one row for each, with a null doc_id where the document has none."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``pack``: a null text is empty, repeated rows are documents of their own, an empty table gives no piece. Equal costs go to the fullest level."""
    import public_tokenizers

    return contract(pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
