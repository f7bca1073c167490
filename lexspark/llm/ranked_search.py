"""Ranked lexical search over an index of compressed postings, document at a time.

A task cuts its documents into shards. A shard has, for each term, its documents in order of
doc_id and how often they have it, as variable-length gaps. A query walks the postings of its terms
in one shard at once: a heap of cursors gives the next document, a bounded heap keeps the best by
score, then doc_id, and lists that can't lift a document into it leave the heap of cursors and are
only looked up. The best of all shards are merged at the end.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.llm.common import read, saved

TOP = 50
#: A shard is closed when it has so many postings or so many documents; a single document may have more.
SHARD_POSTINGS, SHARD_DOCUMENTS = 1 << 21, 1 << 15
#: Items that walk through a shard in one group, about.
ITEMS = 256
#: Characters that are no part of a term, and the case that is folded.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Octets of UTF-8 as they are searched: other characters than those of terms are blanks. All octets of a character beyond ASCII belong to a term.
_OCTETS = bytes(
    c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)
_INDEX = pa.schema([
    ("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int32()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32()))
])
_INDEX_SQL = "shard long, term binary, df int, postings binary, doc_ids array<long>, lengths array<int>"
_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "item_id long, doc_id long, score long"


def terms(octets: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return octets.translate(_OCTETS).split()


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2^35 as variable-length octets, low sevenths first, and how many octets each takes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << (7 * k)
    ends = np.cumsum(size)
    out, at = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8), ends - size
    for k in range(5):
        has = size > k
        out[at[has] + k] = (values[has] >> (7 * k)) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, size


def unpacked(octets: bytes) -> np.ndarray:
    """The numbers that ``packed`` made."""
    x = np.frombuffer(octets, np.uint8)
    last = x < 128
    number = np.cumsum(last) - last
    starts = np.flatnonzero(np.r_[True, last[:-1]]) if len(x) else np.zeros(0, np.int64)
    place = np.arange(len(x)) - starts[number]
    return np.bincount(number, weights=(x & 127).astype(np.float64) * np.exp2(7 * place)).astype(np.int64)


class _Shard:
    """Documents that a task has read since the last shard: a number for each term, and flat lists of who has what how often."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int | None] = []
        self.lengths, self.distinct = array("l"), array("l")
        self.term, self.times = array("l"), array("l")

    def add(self, doc_id: int | None, octets: bytes | None) -> None:
        counts = Counter(terms(octets or b""))
        self.ids.append(doc_id)
        self.lengths.append(counts.total())
        self.distinct.append(len(counts))
        self.term.extend(map(self.vocabulary.__getitem__, counts))
        self.times.extend(counts.values())

    def rows(self, shard: int) -> pa.RecordBatch:
        """One row of all documents, and one of each term."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0, self.lengths[i]))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        who = rank[np.repeat(np.arange(n), np.array(self.distinct, np.int64))]
        term, times = np.array(self.term, np.int64), np.array(self.times, np.int64)
        line = np.argsort(term * n + who)
        term, who, times = term[line], who[line], times[line]
        first = np.r_[True, term[1:] != term[:-1]] if len(term) else np.zeros(0, bool)
        gap = np.where(first, who, who - np.r_[0, who[:-1]]) if len(term) else who
        octets, size = packed(np.stack([gap, times], axis=1).ravel())
        names = list(self.vocabulary)  # numbers were given in this order
        df = np.bincount(term, minlength=len(names))
        ends = np.cumsum(np.bincount(term, weights=size.reshape(-1, 2).sum(axis=1), minlength=len(names))).astype(np.int32)
        lists = pa.Array.from_buffers(
            pa.binary(), len(names), [None, pa.py_buffer(np.r_[np.int32(0), ends].astype(np.int32).tobytes()), pa.py_buffer(octets.tobytes())]
        )
        none = len(names)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(none + 1, shard)), pa.array([None, *names], pa.binary()),
            pa.concat_arrays([pa.nulls(1, pa.int32()), pa.array(df.astype(np.int32))]),
            pa.concat_arrays([pa.nulls(1, pa.binary()), lists]),
            pa.concat_arrays([pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())), pa.nulls(none, pa.list_(pa.int64()))]),
            pa.concat_arrays([pa.array([[self.lengths[i] for i in order]], pa.list_(pa.int32())), pa.nulls(none, pa.list_(pa.int32()))]),
        ], schema=_INDEX)


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", postings: int = SHARD_POSTINGS, documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """The index of all rows, written to the shared folder: shard, term, df, postings, and one row a shard with doc_ids and lengths.

    Every row is a document of its own; a null text has no terms; a row without a doc_id comes after
    all others. Terms may be as long as texts are. A task holds one shard at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, now = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            for doc, octets in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                now.add(doc, octets)
                if len(now.term) >= postings or len(now.ids) >= documents:
                    yield now.rows((part << 32) + made)
                    made, now = made + 1, _Shard()
        if now.ids:
            yield now.rows((part << 32) + made)

    return saved(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, _INDEX_SQL), "postings")


class _List:
    """The postings of one term in one shard, with what each adds to a score."""

    def __init__(self, octets: bytes, w: int, m: np.ndarray) -> None:
        pairs = unpacked(octets).reshape(-1, 2)
        self.at = np.cumsum(pairs[:, 0])
        tf = pairs[:, 1]
        self.adds = w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.at]))
        self.most = int(self.adds.max())
        self.walk: tuple[list[int], list[int]] | None = None

    def cursor(self) -> tuple[list[int], list[int]]:
        if self.walk is None:
            self.walk = self.at.tolist(), self.adds.tolist()
        return self.walk


def best(lists: list[_List], top: int) -> list[tuple[int, int]]:
    """(score, place) of the documents of one shard with the highest scores above 0, earlier places first among equal ones.

    Lists are in order of the most they can add. Those whose sum can't lift a document over the
    least of ``top`` kept ones don't give documents any more; each step takes the next document
    from the heap of the others, adds up what these have of it, and goes on to the lists without
    cursors only as long as the document may still win.
    """
    lists = sorted((x for x in lists if x.most > 0), key=lambda x: x.most)
    reach, total = [], 0  # what the lists up to here can add together
    for x in lists:
        total += x.most
        reach.append(total)
    kept: list[tuple[int, int]] = []  # score and minus the place; the least is on top
    least, idle = 0, 0  # lists before ``idle`` have no cursors
    walks = [x.cursor() for x in lists]
    ends = [len(w[0]) for w in walks]
    cursor = [0] * len(lists)
    k_of = len(lists)
    heap = [w[0][0] * k_of + k for k, w in enumerate(walks)]
    heapify(heap)
    while heap:
        place = heap[0] // k_of
        score, on = 0, True
        while heap and (head := heap[0]) // k_of == place:
            k = head - place * k_of
            if k < idle:
                heappop(heap)
                continue
            i = cursor[k]
            score += walks[k][1][i]
            cursor[k] = i = i + 1
            if i < ends[k]:
                heapreplace(heap, walks[k][0][i] * k_of + k)
            else:
                heappop(heap)
            on = False
        if on:
            continue
        for k in range(idle - 1, -1, -1):
            if score + reach[k] <= least:
                break
            where, adds = walks[k]
            i = cursor[k] = bisect_left(where, place, cursor[k])
            if i < ends[k] and where[i] == place:
                score += adds[i]
        else:
            if score > least:
                if len(kept) < top:
                    heappush(kept, (score, -place))
                else:
                    heapreplace(kept, (score, -place))
                if len(kept) == top:
                    least = kept[0][0]
                    while idle < k_of and reach[idle] <= least:
                        idle += 1
    return sorted(((s, -p) for s, p in kept), key=lambda x: (-x[0], x[1]))


def items_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term of each distinct term; rows of one item_id are one item."""
    folded = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    return items.select(
        F.col(item_id).cast("long").alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)))).alias("t")
    ).select("item_id", F.encode("t", "UTF-8").alias("term")).distinct()


def weight(n: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def search(
    postings: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of an ``index`` with the highest scores above 0 for each item.

    Equal scores are in order of doc_id, a null id last; repeated rows have a rank each. Rows of one
    item_id are one item, and a null one is an item like others; an item without terms, or an index
    without documents, gives nothing. Items go through a shard in blocks of ITEMS or so, with the
    postings of their terms only; of each task's shards no more than ``top`` rows of an item go on.
    """
    shards = postings.where("term IS NULL").select("shard", "doc_ids", "lengths")
    size = shards.select(
        F.aggregate("lengths", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("l")), lambda a, x: F.struct(
            (a["n"] + (x > 0).cast("long")).alias("n"), (a["l"] + x).alias("l")
        )).alias("s")
    ).agg(F.sum("s.n").alias("n"), F.sum("s.l").alias("l")).first()
    n_docs, n_terms = size.n or 0, size.l or 0
    blocks = max(1, -(-items.count() // ITEMS))
    asked = items_terms(items, item_id, text).withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    asked = saved(asked.groupBy("term", "block").agg(F.collect_list(F.struct("item_id")).alias("items")), "asked-terms")
    of_terms = postings.where("term IS NOT NULL").select("shard", "term", "df", "postings")
    df = of_terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("_df"))
    # a table, so that its size is known: the postings are shuffled for the join only if it is large
    asked = saved(asked.join(df, "term").select("term", "block", "items", weight(F.lit(n_docs), F.col("_df")).alias("w")), "asked-weights")
    hits = of_terms.join(asked, "term").select(
        "shard", "block", "postings", "w", F.col("items.item_id").alias("items"), F.lit(None).cast("array<long>").alias("doc_ids"),
        F.lit(None).cast("array<int>").alias("lengths")
    )
    heads = shards.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("binary").alias("postings"),
        F.lit(None).cast("long").alias("w"), F.lit(None).cast("array<long>").alias("items"), "doc_ids", "lengths"
    )

    def run(table: pa.Table) -> pa.Table:
        """The best documents of one shard for the items of one block."""
        of_item, doc_ids, lengths, mine = defaultdict(list), None, None, []
        for batch in table.to_batches():
            for o, w, i, d, x in zip(*[batch.column(c).to_pylist() for c in ("postings", "w", "items", "doc_ids", "lengths")], strict=True):
                if o is None:
                    doc_ids, lengths = d, x
                else:
                    mine.append((o, w, i))
        m = np.array([50 + 50 * x * n_docs // max(1, n_terms) for x in lengths], np.int64)
        for o, w, of in mine:
            one = _List(o, w, m)
            for i in of:
                of_item[i].append(one)
        out = [(i, doc_ids[p], s) for i, lists in of_item.items() for s, p in best(lists, top)]
        return pa.Table.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], schema=_FOUND)

    found = hits.unionByName(heads).groupBy("shard", "block").applyInArrow(run, _FOUND_SQL)
    line = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


_TERMS_SQL = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, unnest({_TERMS_SQL}) AS t FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS t FROM benchmark),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, g GROUP BY t, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
    FROM q JOIN f USING (t) JOIN w USING (t) JOIN n USING (doc_id), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s
WHERE score > 0 QUALIFY rank <= {TOP}
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that fit each item of benchmark best; see ``index`` and ``search`` for nulls, ties, repeated rows and empty tables."""
    return search(index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
