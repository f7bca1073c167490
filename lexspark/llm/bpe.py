"""Byte-level BPE ids of many texts at once.

The splitting rule is worked out on byte arrays, and each distinct piece of a chunk is encoded
once; a table of pieces seen before serves the next chunks of the worker. Texts with characters
for which the array rule isn't written are encoded whole by the library.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from lexspark.llm.arrays import U, Chunk, mix

#: The control string that the vocabulary file names; in a text it becomes its id, as the library does by default.
SPECIAL = "<|endoftext|>"
LETTER, NUMBER, SPACE, OTHER, ODD = range(1, 6)
#: Pieces held at once, some 250 bytes each.
KNOWN_PIECES = 500_000
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)  # masks of the first n bytes of eight


def _class(cp: int) -> int:
    if cp in (0x20, *range(9, 14)):
        return SPACE
    if cp < 0x20 or 0x7F <= cp <= 0xA0:
        return ODD
    return {"L": LETTER, "N": NUMBER, "C": ODD}.get(unicodedata.category(chr(cp))[0], OTHER)


_LOW = np.array([_class(cp) for cp in range(0x800)], np.uint8)


@lru_cache(maxsize=2)
def encoder(path: str) -> "Encoder":
    """One for each worker and vocabulary file (the JSON of the tokenizers library)."""
    return Encoder(path)


class Known:
    """Ids of the pieces seen so far in this process, by 64-bit key."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def learn(self, flat: np.ndarray, lengths: np.ndarray, keys: list[int]) -> None:
        """Keep the ids of new pieces, given end to end; they take the next places in order."""
        i, n = len(self.index), len(keys)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while i + n > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin[i : i + n] = self.used + np.cumsum(lengths) - lengths
        self.length[i : i + n] = lengths
        self.used += len(flat)
        self.index.update(zip(keys, range(i, i + n), strict=True))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it is new."""
        return np.fromiter((self.index.get(k, -1) for k in keys.tolist()), np.int64, len(keys))

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places, end to end, and how many there are up to each one's end."""
        length = np.where(slot < 0, 0, self.length[slot])
        done = np.cumsum(length)
        return self.pool[np.repeat(self.begin[slot] - (done - length), length) + np.arange(done[-1] if len(done) else 0)], done

    @staticmethod
    def keys(raw: bytes, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """64-bit keys of pieces, good within this process."""
        eight = np.ndarray((len(raw) + 9,), "<u8", raw + bytes(16), strides=(1,))
        h = mix((eight[begin] & _FIRST[np.minimum(length, 8)]) ^ (length.astype(U) * U(0x9E3779B97F4A7C15)))
        longer = np.flatnonzero(length > 8)
        h[longer] = mix(h[longer] + mix(eight[begin[longer] + 8] & _FIRST[np.minimum(length[longer] - 8, 8)], 1))
        for i in np.flatnonzero(length > 16).tolist():
            h[i] = hash(raw[begin[i] : begin[i] + length[i]]) & 0xFFFFFFFFFFFFFFFF
        return h


class Encoder(Known):
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        vocabulary = given["model"]["vocab"]
        special = next(x["id"] for x in given["added_tokens"] if x["content"] == SPECIAL)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t != SPECIAL}
        self.bytes_of = {i: b for b, i in ranks.items()} | {special: SPECIAL.encode()}
        self.whole = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: special}
        )
        super().__init__()

    def table(self) -> list[bytes]:
        """The bytes of each id."""
        return [self.bytes_of[i] for i in range(len(self.bytes_of))]

    def encode(self, c: Chunk, special: bool = True) -> list[np.ndarray]:
        """The ids of each text of the chunk; unless special, the control string is ordinary text."""
        data, at, n = c.data, c.at, len(c.data)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * (len(at) - 1)
        if not n:
            return out
        kind = _LOW[data & 0x7F]
        wide = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        kind[wide] = _LOW[((data[wide].astype(np.int64) & 0x1F) << 6) | (data[wide + 1] & 0x3F)]
        kind[wide + 1] = kind[wide]
        bad = (kind == ODD) | (data >= 0xE0)
        quote = np.flatnonzero(data[:-1] == 0x27)
        bad[quote[kind[quote + 1] == LETTER]] = True
        odd = np.zeros(len(at) - 1, bool)
        odd[np.searchsorted(at, np.flatnonzero(bad), "right") - 1] = True
        head = np.zeros(n, bool)
        head[at[at < n]] = True
        start = head.copy()
        start[1:] |= kind[1:] != kind[:-1]
        after_space = np.flatnonzero(start[1:] & ~head[1:] & (kind[:-1] == SPACE)) + 1
        start[after_space - 1] = True
        start[after_space[data[after_space - 1] == 0x20]] = False
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        raw = data.tobytes()
        there = raw.find(SPECIAL.encode()) if special else -1
        while there >= 0:
            i = int(np.searchsorted(at, there, "right")) - 1
            if there + len(SPECIAL) <= at[i + 1]:
                odd[i] = True
            there = raw.find(SPECIAL.encode(), there + 1)
        allowed = {SPECIAL} if special else set()
        h = self.keys(raw, begin, end - begin)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.index) > KNOWN_PIECES:
            self.forget()
        found = self.places(keys)
        sure = ~odd[np.searchsorted(at, begin[first], "right") - 1]  # pieces of odd texts may not be pieces, or not be UTF-8
        new = np.flatnonzero((found < 0) & sure)
        found[new] = len(self.index) + np.arange(len(new))

        def learn(places: list[int], keys: list[int]) -> None:
            ids = [self.whole.encode_ordinary(raw[begin[j] : end[j]].decode("utf-8")) for j in places]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.learn(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths, keys)

        learn(first[new].tolist(), keys[new].tolist())
        slot = found[back]
        lone = np.flatnonzero(slot < 0)  # a piece whose first place was in an odd text
        for j in lone[~odd[np.searchsorted(at, begin[lone], "right") - 1]].tolist():
            if (k := int(h[j])) not in self.index:
                learn([j], [k])
            slot[j] = self.index[k]
        ids, done = self.gather(slot)
        edges = np.append(0, done)[np.searchsorted(begin, at)]
        for i in range(len(out)):
            out[i] = np.array(
                self.whole.encode(raw[at[i] : at[i + 1]].decode("utf-8"), allowed_special=allowed, disallowed_special=()),
                np.uint32
            ) if odd[i] else ids[edges[i] : edges[i + 1]]
        return out
