"""Removal of repeated passages, by recompression.

Every round shortens all texts alike: first each run of one symbol becomes a
symbol, named by what it repeats and how often; then two symbols that follow each other become one
where the first is a left and the second a right symbol, by a bit of their names. A name follows
from what it stands for, so it is the same in all tasks, and equal passages get equal symbols inside,
whatever stands around them. Stretches of a few symbols of the last round, and runs too long to be
symbols, are looked up in the whole corpus: those that it has twice reveal where a repeated window
can be, and the windows there are then compared themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.arrays import Chunk, U, Words, chunks, gram_hashes, inside, joined, mix, word_hashes, word_sequences, words
from lexspark.llm.common import emit, read, saved, width

WINDOW = 35
#: Words that a run has at most to stay a symbol that others may join, for each round; a longer run is looked up itself.
RUNS = (2, 2)
#: Words of a pair at most, for each round; and the words that a stretch has at least.
PAIRS, PHRASE = (2, 4), 8
#: Occurrences that a task looks over together before it sends them.
TOGETHER = 1 << 20
#: Texts with more than one in so many of all rows as their copies are told to every task.
HOT_TEXTS = 1000


class Symbols:
    """Symbols of many texts, end to end: name, number of words, and whether other symbols may join it; first: each text's first symbol (and the end)."""

    def __init__(self, name: np.ndarray, size: np.ndarray, free: np.ndarray, first: np.ndarray):
        self.name, self.size, self.free, self.first = name, size, free, first

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def at(self) -> np.ndarray:
        """The first word of each symbol, counted in its text."""
        done = np.append(0, np.cumsum(self.size))
        return done[:-1] - np.repeat(done[self.first[:-1]], np.diff(self.first))

    def keep(self, head: np.ndarray, name: np.ndarray, free: np.ndarray) -> "Symbols":
        """Symbols that begin where head is set; each takes in those up to the next."""
        if not len(head):
            return self
        begin = np.flatnonzero(head)
        return Symbols(name[begin], np.add.reduceat(self.size, begin), free[begin], np.append(0, np.cumsum(head))[self.first])


def name_runs(s: Symbols, r: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Runs of equal symbols become one, named by symbol and length; also, which of them are too long for others to join, and what these repeat."""
    n = len(s.name)
    if not n:
        return s, np.zeros(0, np.int64), np.zeros(0, U)
    head = np.ones(n, bool)
    head[1:] = s.name[1:] != s.name[:-1]
    head[s.first[:-1][s.first[:-1] < n]] = True
    begin = np.flatnonzero(head)
    length = np.diff(np.append(begin, n))
    name = s.name.copy()
    several = length > 1
    name[begin[several]] = joined(s.name[begin[several]], length[several].astype(U), 11 + r)
    free = s.free.copy()
    long = several & (length * s.size[begin] > RUNS[r])
    free[begin] &= ~long
    return s.keep(head, name, free), np.flatnonzero(long), s.name[begin[long]]


def name_pairs(s: Symbols, r: int) -> Symbols:
    """Left and right symbols that meet become one, if they have few enough words."""
    n = len(s.name)
    if n < 2:
        return s
    right = (mix(s.name, 71 + r) & U(1)).astype(bool)
    joins = ~right[:-1] & right[1:] & s.free[:-1] & s.free[1:] & (s.size[:-1] + s.size[1:] <= PAIRS[r])
    inner = s.first[1:-1]
    joins[inner[(inner > 0) & (inner < n)] - 1] = False
    i = np.flatnonzero(joins)
    name = s.name.copy()
    name[i] = joined(s.name[i], s.name[i + 1], 21 + r)
    return s.keep(np.append(True, ~joins), name, s.free)


def reach() -> tuple[int, int]:
    """Words at either end of a window that rounds may have named by what lies outside it; and words of a symbol at most."""
    spoilt, most = 0, 1
    for run, pair in zip(RUNS, PAIRS, strict=True):
        # a run cut by the window's end, of no more words than stay a symbol (a longer one is looked up); then a symbol beside it
        spoilt += run + min(max(most, run), pair - 1)
        most = max(most, run, pair)
    return spoilt, most


def phrases(s: Symbols, window: int = WINDOW, least: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names and texts of the stretches of symbols that are looked up, and the windows that each stands for: the last start, and how many starts before it.

    Every window has one stretch of its own, unless a long run or the like leaves none: ``reach``
    words at either end aside, equal windows without a long run have the same symbols. A stretch has
    ``least`` words or a symbol more; of those that begin in the first ``around`` words after the
    spoilt ones, which end within the window for sure, its own is the one with the least name. So
    equal windows have stretches of one name.
    """
    spoilt, most = reach()
    around = window - 2 * spoilt - (least + most - 1) + 1
    if around < most:
        raise ValueError("the window is too short for so many rounds and words")
    none = np.zeros(0, np.int64)
    k = len(s.name)
    if not k:
        return np.zeros(0, U), none, none, none
    done = np.append(0, np.cumsum(s.size))  # words before each symbol, in all texts
    stop = np.searchsorted(done, done[:-1] + least)  # the symbol after the stretch, if there are enough
    text = s.text
    bars = np.append(0, np.cumsum(~s.free))
    fits = (stop <= s.first[text + 1]) & (bars[np.minimum(stop, k)] == bars[:-1])
    i, stop, text = np.flatnonzero(fits), stop[fits], text[fits]
    if not len(i):
        return np.zeros(0, U), none, none, none
    name, live, step = s.name[i], np.arange(len(i)), 1
    while len(live := live[i[live] + step < stop[live]]):
        name[live] = joined(name[live], s.name[i[live] + step], 31)
        step += 1
    at = done[i]
    # the least name among the stretches beginning in each ``around`` words; the place in the low bits
    n = int(done[-1])
    bits = max(len(i).bit_length(), 1)
    far = U(0xFFFFFFFFFFFFFFFF)
    low = np.full(n, far)
    low[at] = (mix(name, 64) >> U(bits) << U(bits)) | np.arange(len(i)).astype(U)
    wide, best = 1, low
    while wide * 2 <= around:
        best = np.minimum(best[:-wide], best[wide:])
        wide *= 2
    if wide < around:
        best = np.minimum(best[: len(best) - (around - wide)], best[around - wide :])
    first_word = done[s.first]
    start, row = inside(first_word, window)
    got = best[start + spoilt]
    own = got != far
    chosen, start, row = (got[own] & U((1 << bits) - 1)).astype(np.int64), start[own], row[own]
    head = np.flatnonzero(np.append(np.ones(min(len(chosen), 1), bool), chosen[1:] != chosen[:-1]))
    size = np.diff(np.append(head, len(chosen)))
    return name[chosen[head]], start[head] + size - 1 - first_word[row[head]], size - 1, row[head]


def run_places(
    begin: np.ndarray, size: np.ndarray, least: int, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that hold ``least`` words of a run or more: which run, the last start, and how many starts before it; at most 32 together."""
    lo, hi = np.maximum(begin + least - window, 0), begin + size - least
    parts = (hi - lo) // 32 + 1
    which = np.repeat(np.arange(len(parts)), parts)
    top = hi[which] - 32 * (np.arange(len(which)) - (np.cumsum(parts) - parts)[which])
    return which, top, np.minimum(top - lo[which], 31)


_ROUND = pa.schema([
    ("text", pa.int64()), ("text2", pa.int64()), ("names", pa.binary()), ("sizes", pa.binary()), ("free", pa.binary()),
    ("runs", pa.binary())
])
_OCCURS = pa.schema([
    ("name", pa.int64()), ("more", pa.int64()), ("text", pa.int64()), ("text2", pa.int64()), ("place", pa.int64()),
    ("known", pa.int8())
])
_OCCURS_DDL = "name long, more long, text long, text2 long, place long, known byte"
_PLACES = pa.schema([("text", pa.int64()), ("text2", pa.int64()), ("place", pa.int64())])
_PLACES_DDL = "text long, text2 long, place long"
NEW, KNOWN, TELLS = 0, 1, 2
#: A place is 64 times the last start of a window and the number of starts before it that count, too.
_SPAN = 64
#: A run that is looked up: name, last start, starts before it.
_RUN = np.dtype([("name", "<u8"), ("top", "<i8"), ("span", "<i8")])


def _keys(digests: list[bytes]) -> np.ndarray:
    """128 bits of each digest, as two columns."""
    return np.frombuffer(b"".join([d[:16] for d in digests]), U).reshape(-1, 2)


def _text_keys(c) -> np.ndarray:
    """What tells the word sequences of a chunk's texts apart: 128 bits of their SHA-256."""
    return _keys([hashlib.sha256(t).digest() for t in word_sequences(c)])


def _fresh(key: np.ndarray, seen: set) -> np.ndarray:
    """Which texts are new to the task."""
    out = np.zeros(len(key), bool)
    for i, k in enumerate(map(tuple, key.tolist())):
        if k not in seen:
            seen.add(k)
            out[i] = True
    return out


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different text of the task that is long enough for a window, with its words as symbols."""
    seen: set = set()
    for batch in batches:
        for c in chunks(batch.column("text")):
            w = words(c)
            key = _text_keys(c)
            h = word_hashes(c, w)
            ok = np.flatnonzero(_fresh(key, seen) & (w.counts >= WINDOW))
            part = lambda x: [
                x[a:b].tobytes() for a, b in zip(w.first[ok].tolist(), w.first[ok + 1].tolist(), strict=True)
            ]
            one = np.ones(len(h), np.int32)
            yield emit(
                _ROUND, text=key[ok, 0].view(np.int64), text2=key[ok, 1].view(np.int64), names=part(h), sizes=part(one),
                free=part(one.astype(bool)), runs=[b""] * len(ok)
            )


def _symbols(batch: pa.RecordBatch) -> Symbols:
    names = batch.column("names").to_pylist()
    first = np.append(0, np.cumsum([len(x) // 8 for x in names])).astype(np.int64)
    flat = lambda col, kind: np.frombuffer(b"".join(batch.column(col).to_pylist()), kind)
    return Symbols(np.frombuffer(b"".join(names), U), flat("sizes", np.int32).astype(np.int64), flat("free", bool), first)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, so few at a time that their symbols take some MB, or one row."""
    for batch in batches:
        size = np.append(0, np.cumsum(pc.binary_length(batch.column("names")).to_numpy(zero_copy_only=False).astype(np.int64)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + (4 << 20), "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _round(r: int):
    """One round: runs get their names, then pairs. Runs too long to be symbols are noted, to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some(batches):
            s, long, repeats = name_runs(_symbols(batch), r)
            which, top, span = run_places(s.at[long], s.size[long], RUNS[r] + 1)
            noted = np.empty(len(which), _RUN)
            noted["name"], noted["top"], noted["span"] = joined(repeats, np.full(len(repeats), 41 + r, U))[which], top, span
            edge = np.searchsorted(s.text[long][which], np.arange(batch.num_rows + 1))
            runs = [
                old + noted[a:b].tobytes() for old, a,
                b in zip(batch.column("runs").to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)
            ]
            s = name_pairs(s, r)
            part = lambda x, s=s: [
                x[a:b].tobytes() for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True)
            ]
            yield emit(
                _ROUND, text=batch.column("text"), text2=batch.column("text2"), names=part(s.name),
                sizes=part(s.size.astype(np.int32)), free=part(s.free), runs=runs
            )

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the stretches and long runs of the last round, by half of the text's key: what is taken for another text's is only looked at in vain."""
    sender = _Sender()
    for batch in _some(batches):
        key = batch.column("text").to_numpy().view(U)
        name, top, span, text = phrases(_symbols(batch))
        runs = batch.column("runs").to_pylist()
        noted = np.frombuffer(b"".join(runs), _RUN)
        of = np.repeat(np.arange(len(runs)), [len(x) // _RUN.itemsize for x in runs])
        place = np.concatenate([top * _SPAN + span, noted["top"] * _SPAN + noted["span"]])
        name = np.concatenate([name, noted["name"]])
        whose = np.zeros((len(name), 2), U)
        whose[:, 0] = key[np.concatenate([text, of])]
        sender.add(name, np.zeros(len(name), U), whose, place)
        yield from sender.flush(TOGETHER)
    yield from sender.flush()


def _rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rounds, one behind the other, and what they reveal. As stages of Spark's own they would each have a Python worker beside the others in every task."""
    symbols = _spell(batches)
    for r in range(len(RUNS)):
        symbols = _round(r)(symbols)
    yield from _looked_up(symbols)


def _sent(name: np.ndarray, more: np.ndarray, text: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Occurrences on their way to where their name's occurrences meet.

    Those of a name that is there twice already are known to be repeated: they go anywhere, and
    one of them tells the others elsewhere. So a frequent name sends one row from each batch.
    """
    order = np.argsort(name, kind="stable")
    same = np.append(False, name[order[1:]] == name[order[:-1]]) if len(order) else np.zeros(0, bool)
    alike = same | np.append(same[1:], False) if len(order) else same
    alone, rest = order[~alike], order[alike]
    rest = rest[np.lexsort((place[rest], text[rest, 1], text[rest, 0], more[rest], name[rest]))]
    changed = lambda *xs: np.append(
        np.ones(min(len(xs[0]), 1), bool), np.logical_or.reduce([x[1:] != x[:-1] for x in xs])
    )
    cols = (name[rest], more[rest], text[rest, 0], text[rest, 1], place[rest])
    once = changed(*cols)
    rest, cols = rest[once], [x[once] for x in cols]
    head = changed(*cols[:2])
    several = np.diff(np.append(np.flatnonzero(head), len(rest)))[np.cumsum(head) - 1] > 1 if len(rest) else head
    tells = rest[several & head]
    take = np.concatenate([alone, rest, tells])
    known = np.concatenate([
        np.full(len(alone), NEW, np.int8), np.where(several, KNOWN, NEW).astype(np.int8), np.full(len(tells), TELLS, np.int8)
    ])
    # those of a text stand together, in which form they take less room
    back = np.argsort(take, kind="stable")
    take, known = take[back], known[back]
    of = lambda x: x[take].view(np.int64)
    return emit(
        _OCCURS, name=of(name), more=of(more), text=of(np.ascontiguousarray(text[:, 0])),
        text2=of(np.ascontiguousarray(text[:, 1])), place=place[take], known=known
    )


class _Sender:
    """Gathers occurrences until there are enough to look over together."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, name: np.ndarray, more: np.ndarray, text: np.ndarray, place: np.ndarray) -> None:
        self.parts.append((name, more, text, place))
        self.n += len(name)

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if self.parts and self.n >= least:
            yield _sent(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.parts, self.n = [], 0


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of names with two occurrences or more; rows come in order of name, text and place."""
    held, hot = None, None  # the last row, not yet sent; the last name if it is repeated
    for batch in batches:
        cols = [batch.column(f.name).to_numpy() for f in _OCCURS]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.append(h, x) for h, x in zip(held, cols, strict=True)]
        name, more, text, text2, place, known = cols
        new = np.append(True, (name[1:] != name[:-1]) | (more[1:] != more[:-1]))
        other = np.append(True, new[1:] | (text[1:] != text[:-1]) | (text2[1:] != text2[:-1]) | (place[1:] != place[:-1]))
        group = np.cumsum(new) - 1
        twice = np.bincount(group, other) > 1
        if hot is not None and (name[0], more[0]) == hot:
            twice[0] = True
        out = (known == KNOWN) | (twice[group] & (known == NEW))
        hot = (name[-1], more[-1]) if twice[-1] else None
        last = known[-1] if not out[-1] and hot is None else TELLS  # what is sent is not sent again
        held = (name[-1], more[-1], text[-1], text2[-1], place[-1], np.int8(last))
        if last == NEW:
            out[-1] = False
        yield emit(_PLACES, text=text[out], text2=text2[out], place=place[out])


def repeated(occurrences: DataFrame, n: int) -> DataFrame:
    """text, text2, place of the occurrences whose name has two; they may come more than once."""
    route = F.when(F.col("known") == KNOWN, F.xxhash64("text", "place")).otherwise(F.col("name"))
    return occurrences.repartition(n, route).sortWithinPartitions(
        "name", "more", "text", "text2", "place"
    ).mapInArrow(_repeated, _PLACES_DDL)


_TEXTS = pa.schema([("text", pa.int64()), ("text2", pa.int64()), ("body", pa.binary())])
_TEXTS_DDL = "text long, text2 long, body binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different text of the task that is long enough for a window, compressed: it is what moves most."""
    seen: set = set()
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for c in chunks(batch.column("text")):
            key = _text_keys(c)
            ok = np.flatnonzero(_fresh(key, seen) & (words(c).counts >= WINDOW))
            raw = c.data.tobytes()
            yield emit(
                _TEXTS, text=key[ok, 0].view(np.int64), text2=key[ok, 1].view(np.int64),
                body=[pack(raw[c.at[i] : c.at[i + 1]]) for i in ok.tolist()]
            )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Rows with the chunk of their texts, some hundred at a time. A text that several tasks have sent is taken once by each task that gets it."""
    unpack = zstandard.ZstdDecompressor().decompress
    seen: set = set()
    for whole in batches:
        key = np.stack([whole.column(x).to_numpy() for x in ("text", "text2")], 1)
        whole = whole.filter(pa.array(_fresh(key, seen)))
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            for c in chunks(pa.array([unpack(x) for x in batch.column("body").to_pylist()], pa.large_binary())):
                yield batch.slice(c.lo, c.hi - c.lo), c


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin (with the end)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _starts(first: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distinct words (of the whole chunk) from which windows start, for ranges begin <= start <= end within texts ``row``."""
    begin = first[row] + np.maximum(begin, 0)
    end = np.minimum(first[row] + end, first[row + 1] - WINDOW)
    step = np.zeros(first[-1] + 2, np.int64)
    ok = end >= begin
    np.add.at(step, begin[ok], 1)
    np.add.at(step, end[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(step) > 0)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the windows around what is repeated; two names of each, by hashes that don't depend on each other, make 128 bits."""
    sender = _Sender()
    for batch, c in _unpacked(batches):
        keys = np.stack([batch.column(x).to_numpy().view(U) for x in ("text", "text2")], 1)
        w = words(c)
        places, first = _flat(batch.column("places"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        last, before = places // _SPAN, places % _SPAN
        start = _starts(w.first, last - before, last, row)
        text = np.searchsorted(w.first, start, "right") - 1
        name, more = (gram_hashes(word_hashes(c, w, seed=k), start, WINDOW, seed=k) for k in range(2))
        sender.add(name, more, keys[text], start - w.first[text])
        yield from sender.flush(TOGETHER)
    yield from sender.flush()


_CUT = pa.schema([("text", pa.int64()), ("text2", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _cut(as_is: bool):
    """What is left of each text without the words of its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, c in _unpacked(batches):
            w: Words = words(c)
            starts, first = _flat(batch.column("places"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            step = np.zeros(w.first[-1] + 1, np.int64)
            np.add.at(step, w.first[row] + starts, 1)
            np.add.at(step, w.first[row] + starts + WINDOW, -1)
            gone = np.cumsum(step)[:-1] > 0
            kept = []
            raw = c.data.tobytes()
            for i in range(batch.num_rows):
                mine = slice(w.first[i], w.first[i + 1])
                if as_is:
                    kept.append(_around(raw, c.at[i], c.at[i + 1], w.start[mine], w.end[mine], gone[mine]).decode())
                else:
                    of = raw[c.at[i] : c.at[i + 1]].split()
                    kept.append(b" ".join([of[j] for j in np.flatnonzero(~gone[mine]).tolist()]).decode())
            yield emit(
                _CUT, text=batch.column("text"), text2=batch.column("text2"),
                n_removed=np.add.reduceat(np.append(gone, 0), w.first[:-1]), kept=kept
            )

    return run


def _around(raw: bytes, lo: int, hi: int, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """The bytes lo..hi but those from the first to the last word of each run of words that are gone; none if all are."""
    if gone.all():
        return b""
    head, last = gone & ~np.append(False, gone[:-1]), gone & ~np.append(gone[1:], False)
    return b"".join([raw[a:b] for a, b in zip([lo, *end[last].tolist()], [*start[head].tolist(), hi], strict=True)])


_ROWS = pa.schema([("text", pa.int64()), ("text2", pa.int64()), ("n_words", pa.int64()), ("whole", pa.string())])


def _rows(digest: bool, as_is: bool):
    """Each row's key, number of words, and text (its words, or their digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                said = word_sequences(c)
                digests = [hashlib.sha256(x) for x in said]
                key = _keys([d.digest() for d in digests])
                if digest:
                    whole = [d.hexdigest() for d in digests]
                elif as_is:
                    raw = c.data.tobytes()
                    whole = [raw[a:b].decode() for a, b in zip(c.at[:-1].tolist(), c.at[1:].tolist(), strict=True)]
                else:
                    whole = [x.decode() for x in said]
                made = emit(
                    _ROWS, text=key[:, 0].view(np.int64), text2=key[:, 1].view(np.int64), n_words=words(c).counts, whole=whole
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(c.lo, c.hi - c.lo), *made.columns], names=["_id", *made.schema.names]
                )

    return run


_KEY = pa.schema([("text", pa.int64()), ("text2", pa.int64())])


def _keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text")):
            key = _text_keys(c)
            yield emit(_KEY, text=key[:, 0].view(np.int64), text2=key[:, 1].view(np.int64))


def cut_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False, as_is: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, kept of each row: the words left, joined by one space (their SHA-256 where digest).
    as_is: the words left keep what stands between them; of the text only the bytes from the first
    to the last word of each removed run go.

    Words are stretches without white space. A word goes if a window of WINDOW words that covers
    it has the same words as a window starting elsewhere, in the same or another row; windows are
    judged on the input. A null or empty text has no words; shorter texts lose none; rows that
    repeat lose all words if they have a window. Other columns don't matter, and an empty table
    gives an empty result. Word sequences are told apart by 128 bits of their SHA-256, windows by
    128 bits of two mixing hashes; what stretches of symbols reveal is never trusted by itself.

    Equal texts move once from each task and are judged once; one that keeps some words and loses
    others has no copy, so what stands between its words is its own. The texts move once in all: both
    joins read the same shuffle. Rows of a text with very many copies are known beforehand (there
    are at most HOT_TEXTS such texts, which every task is told) and need no partner, so they go anywhere.
    """
    n = width(docs.sparkSession)
    named = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("_id", docs.schema[doc_id].dataType),
        *[T.StructField(x, T.LongType()) for x in ("text", "text2", "n_words")], T.StructField("whole", T.StringType())
    ])
    body = named.select("text")
    rows = named.mapInArrow(_rows(digest, as_is), schema)
    texts = body.mapInArrow(_texts, _TEXTS_DDL)
    found = repeated(body.mapInArrow(_rounds, _OCCURS_DDL), n)
    key = ["text", "text2"]
    # both joins go by half of the key, so that they read one shuffle of the texts; the other half is compared where it is known
    listed = lambda df: texts.join(
        df.groupBy("text").agg(F.collect_set(F.struct(F.col("text2").alias("other"), "place")).alias("p")), "text"
    )
    windows = repeated(listed(found).select(*key, "body", F.col("p.place").alias("places")).mapInArrow(_windows, _OCCURS_DDL), n)
    mine = F.filter("p", lambda x: x["other"] == F.col("text2"))["place"]
    cut = listed(windows).select(*key, "body", mine.alias("places")).mapInArrow(
        _cut(as_is), "text long, text2 long, n_removed long, kept string"
    )
    cut = cut.select(*key, "n_removed", (F.sha2(F.encode("kept", "UTF-8"), 256) if digest else F.col("kept")).alias("kept"))
    cut = cut.groupBy(*key).agg(F.max("n_removed").alias("n_removed"), F.any_value("kept").alias("kept"))
    counts = saved(
        body.mapInArrow(_keys_only, "text long, text2 long").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "copies"
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * HOT_TEXTS > total).select(*key, F.lit(True).alias("_hot")))
    # a row of a hot text gets a second half of its key that no text has
    apart = rows.join(hot, key, "left").withColumn(
        "text2", F.when(F.col("_hot"), F.xxhash64(F.col("_id").cast("string"))).otherwise(F.col("text2"))
    )
    all_gone = (F.col("n").isNotNull() | F.col("_hot").isNotNull()) & (F.col("n_words") >= WINDOW)
    nothing = hashlib.sha256(b"").hexdigest() if digest else ""
    return (
        apart.join(counts, key, "left").join(cut, key, "left")
        .select(
            F.col("_id").alias(doc_id), "n_words",
            F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(all_gone, F.lit(nothing)).otherwise(F.coalesce("kept", "whole")).alias("kept"),
        )
    )


def without_repeats(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All rows and columns, with the text cut and its characters counted anew; see ``cut_repeats``.

    All bytes outside the removed passages stay, so a text that loses nothing is the same as before.
    A text that loses all words is empty, as is a null one.
    """
    rest = [c for c in docs.columns if c not in (text, n_chars)]
    named = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text).alias("text"))
    cut = cut_repeats(named, "row", as_is=True)
    new = {text: F.col("kept"), n_chars: F.length("kept").cast("long")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``cut_repeats`` for nulls, short and repeated texts and empty tables."""
    return cut_repeats(read(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), wins AS (
  SELECT rid, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM wins) WHERE n > 1
), gone AS (
  SELECT DISTINCT rid, i + k AS j FROM twice, range(0, 35) AS t(k)
), kept AS (
  SELECT w.rid, string_agg(w.w, ' ' ORDER BY w.j) AS t
  FROM (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS j FROM d) w LEFT JOIN gone ON gone.rid = w.rid AND gone.j = w.j
  WHERE gone.rid IS NULL GROUP BY w.rid
), lost AS (
  SELECT rid, count(*) AS n FROM gone GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.rid = d.rid LEFT JOIN lost ON lost.rid = d.rid
"""
