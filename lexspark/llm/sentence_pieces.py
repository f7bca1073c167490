"""SentencePiece encoding with seeded merge-dropout, and decoding.

The merges of a BPE model are done by agenda: the best candidate pair first. Each candidate that
comes up is skipped if its keyed hash falls under the dropout rate, so a text has many
segmentations; each one decodes to the same text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.arrays import Chunk, U, chunks, mix
from lexspark.llm.bpe import KNOWN_PIECES, Known
from lexspark.llm.common import emit, read

DROPOUT, SEED = 0.1, 7
_SPACE = "▁"
#: Stretches of more characters than this have an agenda of their own, and with dropout are never kept.
LONG = 40
#: A merge is written as its place (under LONG) and, in so many low bits, its piece.
PIECE_BITS = 21
#: Bytes of text that are encoded together, and rows that are decoded together; some 100 bytes of working memory for each byte.
AT_ONCE, ROWS = 512 << 10, 256


@lru_cache(maxsize=4)
def pieces(path: str, dropout: float, seed: int) -> "Pieces":
    """One for each worker, model file and way of dropping."""
    return Pieces(path, dropout, seed)


class Pieces(Known):
    """Encoder and decoder of one model: BPE with byte fallback, a space in front, nothing normalised away.

    With dropout 0 the ids are those of the sentencepiece library, but for a U+2581 in a text,
    which is written as its bytes here, as it couldn't be told from a space otherwise.
    """

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(len(names))]
        byte = [model.is_byte(i) for i in range(len(names))]
        self.byte_ids = np.array(
            [i for i, _ in sorted(((i, n) for i, n in enumerate(names) if byte[i]), key=lambda x: x[1])], np.uint32
        )
        ids = {n: i for i, n in enumerate(names) if not byte[i] and not special[i]}
        self.bytes = [
            b"" if special[i] else bytes([int(n[3:5], 16)]) if byte[i] else n.replace(_SPACE, " ").encode() for i,
            n in enumerate(names)
        ]
        symbol = lambda part: ids.get(part, len(names) + ord(part) if len(part) == 1 else -1)
        order = np.array([-model.get_score(i) for i in range(len(names))])
        self.rank = np.argsort(np.argsort(order, kind="stable"), kind="stable").astype(np.int64)
        made = {
            (symbol(n[:k]) << 21) | symbol(n[k:]): i for n,
            i in ids.items() for k in range(1, len(n)) if symbol(n[:k]) >= 0 and symbol(n[k:]) >= 0
        }
        self.made = made
        self.pair = np.array(sorted(made), np.int64)
        self.merged = np.array([made[k] for k in self.pair.tolist()], np.int64)
        self.size = len(names)
        self.of_char = np.arange(0x110000, dtype=np.int64) + len(names)  # a character that is no piece stands for its bytes
        for n, i in ids.items():
            if len(n) == 1 and n != _SPACE:
                self.of_char[ord(n)] = i
        self.of_char[0x20] = ids[_SPACE]
        self.dropout, self.seed = min(dropout, 1.0), seed
        super().__init__()

    def forget(self) -> None:
        super().forget()
        self.merges, self.merges_used = np.empty(1 << 16, np.uint32), 0
        self.merges_begin, self.merges_length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def keep(self, flat: np.ndarray, lengths: np.ndarray, keys: list[int], of: np.ndarray, merges: np.ndarray) -> None:
        """Keep the ids of new segmentations and the merges that were done for them; of: whose merge each is."""
        i, n = len(self.index), len(keys)
        while self.merges_used + len(of) > len(self.merges):
            self.merges = np.concatenate([self.merges, np.empty_like(self.merges)])
        while i + n > len(self.merges_begin):
            self.merges_begin, self.merges_length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.merges_begin, self.merges_length))
        size = np.bincount(of, minlength=n)
        self.merges[self.merges_used : self.merges_used + len(of)] = merges[np.argsort(of, kind="stable")]
        self.merges_begin[i : i + n] = self.merges_used + np.cumsum(size) - size
        self.merges_length[i : i + n] = size
        self.merges_used += len(of)
        self.learn(flat, lengths, keys)

    def merges_of(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of the segmentations at these places, and which of the places each belongs to."""
        size = self.merges_length[slot].astype(np.int64)
        of = np.repeat(np.arange(len(slot)), size)
        return self.merges[np.arange(len(of)) + (self.merges_begin[slot] - (np.cumsum(size) - size))[of]].astype(np.int64), of

    def candidates(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 if none."""
        key = (left << 21) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.merged[at], -1)

    def skipped(self, salt: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the keyed hash of a candidate (where it starts, what it would make) falls under the rate."""
        return (mix(salt ^ (place.astype(U) * U(0xD6E8FEB86659FD93) + piece.astype(U) * U(0xA0761D6478BD642F))) >> U(11)).astype(np.float64) < self.dropout * 2.0**53

    def segment(self, symbols: np.ndarray, salt: np.uint64) -> list[int]:
        """The symbols that one stretch ends up with, by agenda. A skipped candidate comes up again only if a neighbour's merge offers it anew."""
        part = symbols.tolist()
        n, salt, least = len(part), int(salt), self.dropout * 2.0**53
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        made = self.candidates(symbols[:-1], symbols[1:])
        agenda = [(
            int(self.rank[made[i]]), i, i + 1, int(made[i]), part[i], part[i + 1]
        ) for i in np.flatnonzero(made >= 0).tolist()]
        heapify(agenda)

        def offer(i: int, j: int) -> None:
            m = self.made.get((part[i] << 21) | part[j])
            if m is not None:
                heappush(agenda, (int(self.rank[m]), i, j, m, part[i], part[j]))

        while agenda:
            _, i, j, m, a, b = heappop(agenda)
            if part[i] != a or right[i] != j or part[j] != b:
                continue
            if self.dropout and _mixed(salt ^ (i * 0xD6E8FEB86659FD93 + m * 0xA0761D6478BD642F & _ALL)) >> 11 < least:
                continue
            part[i], part[j] = m, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                offer(i, k)
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in part if p >= 0]

    def segments(
        self, symbols: np.ndarray, first: np.ndarray, salt: np.ndarray, forced: np.ndarray | None = None, done: list | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The same for many stretches: first has where each begins (and the end).

        Each round takes the best candidate of every stretch that still has one; long stretches
        have an agenda of their own. forced: instead of what the salts say, just these candidates of
        the short stretches are skipped (stretch and merge in one number, in order). done: takes
        stretch and merge of all merges of the short stretches.
        """
        size = np.diff(first)
        out: list[tuple[np.ndarray, np.ndarray]] = []  # (stretch, symbol), in order within each stretch
        for i in np.flatnonzero(size > LONG).tolist():
            got = np.array(self.segment(symbols[first[i] : first[i + 1]], salt[i]), np.int64)
            out.append((np.full(len(got), i), got))
        of = np.repeat(np.arange(len(size)), size)
        keep = size[of] <= LONG
        of, sym = of[keep], symbols[keep]
        place = np.arange(len(symbols))[keep] - first[:-1][of]
        blocked = np.zeros(len(of), bool)
        made = np.full(len(of), -1)
        if len(of) > 1:
            made[:-1] = np.where(of[:-1] == of[1:], self.candidates(sym[:-1], sym[1:]), -1)
        never = np.int64(1 << 40)
        while len(of):
            cost = np.where((made >= 0) & ~blocked, self.rank[made] * (LONG + 1) + place, never)
            head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            best = np.minimum.reduceat(cost, head)
            live = best < never
            if not live.all():
                spent = np.repeat(~live, np.diff(np.append(head, len(of))))
                out.append((of[spent], sym[spent]))
                of, sym, place, blocked, made, cost = (x[~spent] for x in (of, sym, place, blocked, made, cost))
                best = best[live]
                if not len(of):
                    break
                head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            at = np.flatnonzero(cost == np.repeat(best, np.diff(np.append(head, len(of)))))
            if forced is None and self.dropout:
                skip = self.skipped(salt[of[at]], place[at], made[at])
                blocked[at[skip]] = True
                at = at[~skip]
            elif forced is not None and len(forced):
                asked = (((of[at] << 6) | place[at]) << PIECE_BITS) | made[at]
                skip = forced[np.minimum(np.searchsorted(forced, asked), len(forced) - 1)] == asked
                blocked[at[skip]] = True
                at = at[~skip]
            if done is not None:
                done.append((of[at], (place[at] << PIECE_BITS) | made[at]))
            sym[at] = made[at]
            rest = np.ones(len(of), bool)
            rest[at + 1] = False
            changed = np.zeros(len(of), bool)
            changed[at] = True
            before = at[at > 0] - 1
            changed[before] = True
            of, sym, place, blocked, made, changed = (x[rest] for x in (of, sym, place, blocked, made, changed))
            # the last symbol before a merged pair keeps its place: only a removed one shifts the rest
            new = np.flatnonzero(changed)
            inner = new[new + 1 < len(of)]
            made[new] = -1
            made[inner] = np.where(of[inner] == of[inner + 1], self.candidates(sym[inner], sym[inner + 1]), -1)
            blocked[new] = False
        of = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in out]])
        sym = np.concatenate([np.zeros(0, np.int64), *[x for _, x in out]])
        order = np.argsort(of, kind="stable")
        return sym[order], np.bincount(of, minlength=len(size))

    def spelled(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols; those that are no pieces give the pieces of their bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols.astype(np.uint32), lengths
        raw = [chr(x).encode() for x in (symbols[odd] - self.size).tolist()]
        size = np.ones(len(symbols), np.int64)
        size[odd] = [len(x) for x in raw]
        flat = np.repeat(symbols, size)
        flat[np.repeat(symbols >= self.size, size)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        of = np.repeat(np.arange(len(lengths)), lengths)
        return flat.astype(np.uint32), np.bincount(of, size, len(lengths)).astype(np.int64)

    def encode(self, c: Chunk, keys: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of the chunk; keys: one 64-bit key for each text, from which the skips of its merges are drawn.

        A stretch begins at each run of spaces and at each control character; no piece of the
        model spans such a place, so stretches are encoded apart. Every occurrence of a stretch
        draws for every merge that comes up in it. What a stretch becomes if just some given
        merges are skipped is worked out once and kept, with the merges then done: an occurrence
        that skips none of them is settled, any other goes on with those it skips besides.
        """
        size = np.diff(c.at)
        at = c.at + np.cumsum(np.append(0, size > 0))  # a space goes before each text that isn't empty
        data = np.full(at[-1], 0x20, np.uint8)
        body = np.ones(len(data), bool)
        body[at[:-1][size > 0]] = False
        data[body] = c.data
        n = len(data)
        if not n:
            return [np.zeros(0, np.uint32)] * len(size)
        start = np.zeros(n, bool)
        blank, control = data == 0x20, data < 0x20
        start[at[at < n]] = True
        start[1:] |= (blank[1:] & ~blank[:-1]) | control[1:] | control[:-1]
        begin = np.flatnonzero(start)
        length = np.diff(np.append(begin, n))
        raw = data.tobytes()
        lead = np.cumsum(np.append(0, (data & 0xC0) != 0x80))
        n_chars = lead[begin + length] - lead[begin]

        def symbols(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bare = b"".join([
                raw[x:y] for x, y in zip(begin[which].tolist(), (begin + length)[which].tolist(), strict=True)
            ]).decode()
            return self.of_char[np.frombuffer(bare.encode("utf-32-le"), np.uint32)], np.append(0, np.cumsum(n_chars[which]))

        if len(self.index) > KNOWN_PIECES:
            self.forget()
        salt = self.salts(keys, np.maximum.accumulate(np.searchsorted(at, begin, "right") - 1), begin, at)
        own = np.flatnonzero(n_chars > LONG) if self.dropout else np.zeros(0, np.int64)
        slot = np.full(len(begin), -1)
        name = self.keys(raw, begin, length)  # of the stretch and the merges that its occurrence skips
        of = np.delete(np.arange(len(begin)), own)
        skips = np.zeros((2, 0), np.int64)  # occurrence, merge
        while len(of):
            distinct, first, back = np.unique(name[of], return_index=True, return_inverse=True)
            found = self.places(distinct)
            new = np.flatnonzero(found < 0)
            found[new] = len(self.index) + np.arange(len(new))
            if len(new):
                which = of[first[new]]
                row = np.full(len(begin), -1)
                row[which] = np.arange(len(which))
                held = skips[:, row[skips[0]] >= 0]
                done: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
                made = self.segments(
                    *symbols(which), salt[which], np.sort((row[held[0]] << (6 + PIECE_BITS)) | held[1]),
                    done if self.dropout else None
                )
                self.keep(*self.spelled(*made), distinct[new].tolist(), *(np.concatenate(x) for x in zip(*done, strict=True)))
            slot[of] = found[back]
            if not self.dropout:
                break
            merge, whose = self.merges_of(slot[of])
            skip = np.flatnonzero(self.skipped(salt[of[whose]], merge >> PIECE_BITS, merge & ((1 << PIECE_BITS) - 1)))
            whose, merge = of[whose[skip]], merge[skip]
            np.add.at(name, whose, mix(merge.astype(U), 5))
            of = np.unique(whose)
            going = np.zeros(len(begin), bool)
            going[of] = True
            skips = np.concatenate([skips[:, going[skips[0]]], [whose, merge]], axis=1)
        if len(own):
            extra, extra_size = self.spelled(*self.segments(*symbols(own), salt[own]))
        else:
            extra, extra_size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        kept = self.gather(np.delete(slot, own))[0]
        size_of = np.where(slot < 0, 0, self.length[slot])
        size_of[own] = extra_size
        done_of = np.cumsum(size_of)
        ids = kept
        if len(own):
            mine = np.zeros(len(begin), bool)
            mine[own] = True
            mine = np.repeat(mine, size_of)
            ids = np.empty(len(mine), np.uint32)
            ids[mine], ids[~mine] = extra, kept
        edges = np.append(0, done_of)[np.searchsorted(begin, at)]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def salts(self, keys: np.ndarray, text: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One number for each occurrence of a stretch, from the seed, its text's key and its place among the text's stretches."""
        place = np.arange(len(begin)) - np.searchsorted(begin, at)[text]
        return mix(keys[text] + place.astype(U), self.seed)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, without the space in front that encoding adds."""
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()])[1:].decode("utf-8", "replace")


_ALL = 0xFFFFFFFFFFFFFFFF


def _mixed(x: int) -> int:
    """The same as ``mix`` of one number."""
    x = (x + 0x9E3779B97F4A7C15) & _ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return x ^ (x >> 31)


_IDS = pa.schema([("n_tokens", pa.int64()), ("ids", pa.binary())])


def encode(
    docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, n_tokens and ids (little-endian unsigned 32-bit) of each text.

    Whether a candidate merge is skipped follows from the seed, the row's key, the place of its
    stretch in the text, its place in the stretch and its piece; nothing else enters, and equal
    rows get equal ids. A null text counts as empty and has no ids; a null key is a key of its own. Other
    columns don't matter, and an empty table gives an empty result. path: a BPE model file of the
    sentencepiece library, present on the executors.
    """
    named = docs.select(
        F.col(key).alias("_key"), F.xxhash64(F.col(key).cast("string")).alias("_hash"), F.col(text).alias("_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, dropout, seed)
        for batch in batches:
            hashes = batch.column("_hash").to_numpy().view(U)
            for c in chunks(batch.column("_text"), AT_ONCE):
                ids = model.encode(c, hashes[c.lo : c.hi])
                made = emit(_IDS, n_tokens=[len(x) for x in ids], ids=[x.astype("<u4").tobytes() for x in ids])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").slice(c.lo, c.hi - c.lo), *made.columns], names=["_key", *made.schema.names]
                )
        model.forget()  # the worker outlives the task

    kind = docs.schema[key].dataType.simpleString()
    return named.mapInArrow(run, f"_key {kind}, n_tokens long, ids binary").withColumnRenamed("_key", key)


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of each row of ids; null ids give an empty text. Any dropout decodes alike."""
    named = rows.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, 0.0, 0)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            texts = [model.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(texts, pa.string())], names=["_key", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return named.mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document with dropout, decode it again: counts, digest of the ids and of the text that comes back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(read(spark, sf_dir, "documents"), path)
    # the ids go through the decoder beside the other columns, so nothing is joined
    packed = coded.select(F.struct("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")).alias("row"), "ids")
    back = decode(packed, path, key="row")
    return back.select(
        "row.*", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256")
    )
