"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

Nothing here starts Spark; operators call it inside ``mapInArrow`` tasks. A chunk holds whole
texts, so memory follows the chunk (a few MB) or one very long text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)  # masks of the first n bytes of eight
#: Words of more bytes than this are digested by the standard library.
_LONG_WORD = 64


def joined(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name of each pair of names, in order. No sum over places is involved, so names of names stay apart, too."""
    return mix(a * U(0xA0761D6478BD642B) + b, 101 + seed)


@dataclass
class Chunk:
    """Texts lo..hi of a batch: their bytes end to end, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow string column, a few MB at a time; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(
        column.buffers()[1], np.int64 if wide else np.int32
    )[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """start, end: byte range of each word; first: index of the first word of each text, and the end."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


#: All ASCII characters but letters and digits; for terms rather than words.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(c: Chunk, apart: np.ndarray = _SPACE) -> Words:
    """Runs of bytes that are not in the table ``apart``; white space unless given."""
    solid = ~apart[c.data]
    n = len(solid)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(c.at), np.int64))
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    before[c.at[c.at < n]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    after[c.at[(c.at > 0) & (c.at < n)] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    return Words(start, end, np.searchsorted(start, c.at))


def word_hashes(c: Chunk, w: Words, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes (A to Z as a to z where lower).

    Eight bytes at a time go through a mixing chain; a word of up to eight bytes shares its hash with
    none of the same length. Very long words are digested by BLAKE2.
    """
    size = w.end - w.start
    h = mix(size.astype(U), 7 + seed)
    if not len(size):
        return h
    raw = np.zeros(len(c.data) + 16, np.uint8)
    raw[: len(c.data)] = _LOWER[c.data] if lower else c.data
    eight = np.ndarray((len(c.data) + 9,), "<u8", raw, strides=(1,))
    live = np.flatnonzero(size <= _LONG_WORD)
    for k in range(0, _LONG_WORD, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = mix(h[live] ^ (eight[w.start[live] + k] & _FIRST[np.minimum(size[live] - k, 8)]), 17 + seed)
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        h[i] = int.from_bytes(
            hashlib.blake2b(raw[w.start[i] : w.end[i]].tobytes(), digest_size=8, key=b"%d" % seed).digest(), "little"
        )
    return h


def gram_hashes(h: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the n values of h from each index in at; all must lie within h. Names of runs of 1, 2, 4, ... values are joined."""
    level, size, done, out = h, 1, 0, None
    while True:
        if n & size:
            out = level[at + done] if out is None else joined(out, level[at + done], seed)
            done += size
        if 2 * size > n:
            return mix(out, n)
        level = joined(level[: max(len(level) - size, 0)], level[size:], seed)
        size *= 2


def word_sequences(c: Chunk, lower: bool = False) -> list[bytes]:
    """The words of each text, joined by one space: texts of equal words give equal bytes."""
    raw = c.data.tobytes()
    texts = (raw[a:b] for a, b in zip(c.at[:-1].tolist(), c.at[1:].tolist(), strict=True))
    return [b" ".join((t.lower() if lower else t).split()) for t in texts]


def inside(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of n words fits: index of its first word, and of its text."""
    fits = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(fits)), fits)
    before = np.cumsum(fits) - fits
    return np.arange(fits.sum()) - before[text] + first[:-1][text], text
