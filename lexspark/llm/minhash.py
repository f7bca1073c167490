"""Near-duplicate documents by SetSketch registers.

A document's set of shingles is sketched by registers: minima of exponential variates, truncated
to whole steps of an exponential scale. Documents that share a band of registers are candidates;
the similarity of candidates is estimated jointly by likelihood from all registers and the sizes;
likely ones are verified on their full sets. Verified links make components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.llm.arrays import Chunk, U, chunks, gram_hashes, inside, mix, word_hashes, word_sequences, words
from lexspark.llm.common import emit, forget, free_name, hot_join, read, saved, width
from lexspark.llm.components import components

SHINGLE = 5
#: Two documents are linked where 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bands of four registers each: a pair of similarity 0.85 misses all bands once in 10**9, one of 0.8 four times in 10**7.
BANDS, ROWS = 28, 4
REGISTERS = BANDS * ROWS
#: The scale: base, rate of the exponential variates, highest value. 16 bits hold a register.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Candidates whose estimate lies so many standard errors under the threshold are not verified.
MARGIN = 5.0
#: Members of a group that are verified against its leader in one run.
RUN = 64
#: Parts that the members of a component are dealt over where they learn its smallest id.
SALTS = 32

_ODD = mix(np.arange(REGISTERS, dtype=U), 31) | U(1)


def shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, sorted, and where each text's begin (with the end)."""
    w = words(c)
    h = word_hashes(c, w, lower=True)
    at, text = inside(w.first, SHINGLE)
    g = gram_hashes(h, at, SHINGLE)
    few = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    for n in range(1, SHINGLE):
        of = few[w.counts[few] == n]
        text, g = np.concatenate([text, of]), np.concatenate([g, gram_hashes(h, w.first[of], n)])
    if len(few):
        order = np.argsort(text, kind="stable")
        text, g = text[order], g[order]
    n = len(w.counts)
    first = np.searchsorted(text, np.arange(n + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        g[a:b].sort()
    new = np.append(np.ones(min(len(g), 1), bool), (g[1:] != g[:-1]) | (text[1:] != text[:-1]))
    return g[new], np.append(0, np.cumsum(new))[first]


def shingle_set(text: bytes) -> set[tuple[bytes, ...]]:
    """The shingles themselves; not for a text without words."""
    w = text.lower().split()
    return set(zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else {tuple(w)}


def sequence_keys(c: Chunk) -> list[bytes]:
    """128 bits of the SHA-256 of each text's words in lower case; texts that share them have one set."""
    return [hashlib.sha256(t).digest()[:16] for t in word_sequences(c, lower=True)]


def sketches(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers: one row for each text, zeros if it has no shingle."""
    n = len(first) - 1
    live = np.flatnonzero(np.diff(first))
    registers = np.zeros((n, REGISTERS), "<u2")
    if len(live):
        begin = first[:-1][live]
        for i in range(REGISTERS):
            least = np.minimum.reduceat(g * _ODD[i], begin)
            x = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-64) / RATE
            registers[live, i] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP)
    return registers


def likeliest(lower: np.ndarray, higher: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity under which so many registers of a are lower and higher than b's, given the sizes of both sets."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    share = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    equal = REGISTERS - lower - higher

    def worth(j: np.ndarray) -> np.ndarray:
        above, under = share(u - v * j), share(v - u * j)
        return higher * np.log(above) + lower * np.log(under) + equal * np.log(np.maximum(1 - above - under, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one top
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = worth(a) > worth(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


_DOCS = pa.schema([("n", pa.int64()), ("key", pa.binary()), ("registers", pa.binary())])
_TEXTS = pa.schema([("key", pa.binary()), ("text", pa.string())])
_BUCKETS = pa.schema([("key", pa.int64()), ("node", pa.int64())])
_COMPARED = pa.schema([
    ("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("linked", pa.bool_()),
    ("apart", pa.list_(pa.int64()))
])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column("text")):
            g, first = shingles(c)
            made = emit(_DOCS, n=np.diff(first), key=sequence_keys(c), registers=[x.tobytes() for x in sketches(g, first)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(c.lo, c.hi - c.lo), *made.columns], names=["doc_id", *made.schema.names]
            )


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bands = np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u8").reshape(-1, BANDS)
        keys = np.stack([mix(bands[:, i], 51 + i) for i in range(BANDS)], 1).ravel()
        yield emit(_BUCKETS, key=pa.array(keys.view(np.int64)), node=pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)))


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = percent / 100 - MARGIN * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
        for batch in batches:
            n_a, n_b = (batch.column(x).to_numpy().astype(np.float64) for x in ("n_a", "n_b"))
            r_a, r_b = (np.frombuffer(
                b"".join(batch.column(x).to_pylist()), "<u2"
            ).reshape(-1, REGISTERS) for x in ("r_a", "r_b"))
            # a lower minimum is a higher register
            j = likeliest((r_a < r_b).sum(1), (r_a > r_b).sum(1), n_a, n_b) if len(n_a) else np.zeros(0)
            yield batch.select(["a", "b"]).filter(pa.array((j >= least) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))))

    return run


def _compare(percent: int, apart: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come as runs: the leader's text, then its members'. What the hashed sets call similar is confirmed on the shingles themselves."""
        leader, held, raw_held, full = None, np.zeros(0, U), b"", None
        for batch in batches:
            a, b, lead = (batch.column(x).to_pylist() for x in ("a", "b", "lead"))
            for c in chunks(batch.column("text")):
                out: dict[str, list] = {f.name: [] for f in _COMPARED}
                g, first = shingles(c)
                for i in range(c.lo, c.hi):
                    mine = g[first[i - c.lo] : first[i - c.lo + 1]]
                    raw = c.data[c.at[i - c.lo] : c.at[i - c.lo + 1]]
                    if lead[i]:
                        leader, held, raw_held, full = a[i], mine.copy(), raw.tobytes(), None
                        continue
                    if leader != a[i]:
                        raise ValueError("a member without its leader")
                    both = len(np.intersect1d(held, mine, assume_unique=True))
                    linked = 100 * both >= (percent - 1) * (len(held) + len(mine) - both)
                    if linked:
                        full = full or shingle_set(raw_held)
                        other = shingle_set(raw.tobytes())
                        shared = len(full & other)
                        linked = 100 * shared >= percent * (len(full) + len(other) - shared)
                    if linked or apart:
                        row = (
                            a[i], b[i], len(held), len(mine), linked,
                            np.setxor1d(held, mine, assume_unique=True).view(np.int64) if apart else None
                        )
                        for x, v in zip(out.values(), row, strict=True):
                            x.append(v)
                yield emit(_COMPARED, **out)

    return run


def compared(pairs: DataFrame, texts: DataFrame, percent: int, apart: bool = False) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, linked; where apart, the others too, and what lies in one set of a pair only.

    texts: node, text. A member's text goes to its leader's run, the leader's text to each run of
    at most about RUN members, so a leader of very many is no hot key and isn't copied for each.
    """
    spark = pairs.sparkSession
    salted = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("runs")), "a")
    members = salted.select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("runs")).alias("run")
    ).join(texts.withColumnRenamed("node", "b"), "b").select("a", "run", F.lit(False).alias("lead"), "b", "text")
    leaders = salted.select("a", "runs").distinct().select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run")
    ).join(texts.withColumnRenamed("node", "a"), "a").select(
        "a", "run", F.lit(True).alias("lead"), F.lit(None).cast("long").alias("b"), "text"
    )
    runs = members.unionByName(leaders).repartition(width(spark), "a", "run").sortWithinPartitions("a", "run", F.col("lead").desc())
    return runs.select("a", "b", "lead", "text").mapInArrow(
        _compare(percent, apart), "a long, b long, n_a long, n_b long, linked boolean, apart array<long>"
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    A set has the distinct SHINGLE-word shingles, words being stretches without white space with
    A to Z in lower case; a text of fewer words is one shingle, one without words an empty set,
    linked with nothing. component_id is the smallest doc_id reachable over links, kept whether it
    is the row's own. Repeated rows are copies of each other, and rows that share an id are judged
    by their texts; a null id is its own smallest only if its component has no other. Other
    columns don't matter, and an empty table gives an empty result.

    Texts of the same words become one node first (told by 128 bits of SHA-256), so copies are
    never paired. The nodes of a bucket (those that share a band) are compared with its first node,
    and where that doesn't make them one component, with its best linked node, too. Of what is then
    left, two nodes can only be linked if they differ from the leader in the same shingles, and are
    found by the rarest of these; so no link between nodes of a bucket is lost, and a large group is
    not paired out. Links are confirmed on the words of both texts.
    """
    return _judged(docs, percent, doc_id, text).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """The same with each row's key, and its component: null for an empty set."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = saved(named.mapInArrow(_sketch, "doc_id long, n long, key binary, registers binary"), "sketches")
    full = sketched.where("n > 0")
    sets = full.groupBy("key").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("rows")
    )
    nodes = saved(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written once, so the numbers hold
    used: list[DataFrame] = []
    groups = components(_links(named, nodes, percent, used))
    forget(*used)
    placed = nodes.select("key", "node", "least", "rows").join(groups, "node", "left")
    # the members of a component are dealt over some parts, and each part learns the smallest id
    grouped = placed.where("component IS NOT NULL")
    heads = grouped.groupBy("component").agg(F.min("least").alias("component_id")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    of_group = grouped.withColumn(
        "_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    ).join(heads, ["component", "_salt"]).select("key", "component", "component_id", "rows")
    of_set = saved(of_group.unionByName(placed.where("component IS NULL").select(
        "key", F.col("node").alias("component"), F.col("least").alias("component_id"), "rows"
    )), "sets")
    # rows of a text that very many share stay where they are
    joined = hot_join(full.select("doc_id", "n", "key"), of_set, "key", "rows").select(
        "doc_id", F.col("n").alias("n_shingles"), "key", "component", "component_id"
    )
    empty = sketched.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), "key", F.lit(None).cast("long").alias("component"),
        F.col("doc_id").alias("component_id")
    )
    return joined.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with its own columns: of those with the smallest id that of one text, and one of its repeated rows.

    Empty texts are linked with nothing, so of these one row stays for each id.
    """
    key, one = free_name(docs, "_key"), free_name(docs, "_one")
    judged = _judged(docs, percent, doc_id, text).where("kept")
    kept = saved(
        judged.groupBy("component", "doc_id").agg(F.min("key").alias(key)).select(F.col("doc_id").alias(one), key), "kept"
    )
    body = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text")
    )
    kind = T.StructType([
        T.StructField("row", body.schema["row"].dataType), T.StructField("doc_id", T.LongType()),
        T.StructField("key", T.BinaryType())
    ])
    told = body.mapInArrow(_told, kind)
    rows = told.join(kept, told["doc_id"].eqNullSafe(kept[one]) & (told["key"] == kept[key]), "left_semi")
    return rows.dropDuplicates(["doc_id", "key"]).select("row.*")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row beside its id and key."""
    for batch in batches:
        keys = [k for c in chunks(batch.column("text")) for k in sequence_keys(c)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(keys, pa.binary())], names=["row", "doc_id", "key"]
        )


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different text of the task, with its key."""
    seen: set[bytes] = set()
    for batch in batches:
        for c in chunks(batch.column("text")):
            keys = sequence_keys(c)
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            yield emit(
                _TEXTS, key=[keys[i] for i in new],
                text=batch.column("text").slice(c.lo, c.hi - c.lo).take(pa.array(new, pa.int64())).cast(pa.string())
            )


def _links(named: DataFrame, nodes: DataFrame, percent: int, used: list[DataFrame]) -> DataFrame:
    """Verified edges (a, b) between nodes, enough of them for the components; the tables that they are read from go to ``used``."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(saved(df, name))
        return used[-1]

    keys = kept(nodes.select("node", "registers").mapInArrow(_buckets, "key long, node long"), "bands")
    shared = kept(keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("first")
    ).where("size > 1"), "shared-bands")
    live = kept(hot_join(keys, shared, "key", "size").select("key", "node", "first"), "buckets")
    # one text of each node that shares a bucket
    wanted = live.select("node").distinct().join(nodes.select("node", "key"), "node")
    holds = named.select("text").mapInArrow(_distinct_texts, "key binary, text string").join(wanted, "key")
    texts = kept(holds.groupBy("node").agg(F.any_value("text").alias("text")), "texts")
    sizes = nodes.select("node", "n", "registers")

    def likely(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sizes.toDF("a", "n_a", "r_a"), "a").join(sizes.toDF("b", "n_b", "r_b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
        return kept(both.mapInArrow(_likely(percent), "a long, b long"), "likely")

    stars = live.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    edges = kept(compared(likely(stars), texts, percent).select("a", "b"), "links")
    group = kept(components(edges), "groups")
    # buckets that are not in one component, and the best linked node of each
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    placed = kept(live.select("key", "node").join(group, "node", "left").join(degree, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree")
    ), "placed")
    best = kept(placed.groupBy("key").agg(
        F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.max_by("node", F.struct("degree", "node")).alias("a"),
        F.count(F.lit(1)).alias("size")
    ).where("_lo <> _hi").select("key", "a", "size"), "leaders")
    frames = hot_join(placed.select("key", "node"), best, "key", "size").where("node <> a").select(
        "a", F.col("node").alias("b")
    ).distinct()
    framed = kept(compared(frames, texts, percent, apart=True), "frames")
    edges = edges.unionByName(framed.where("linked").select("a", "b"))
    group = kept(components(edges), "groups")
    rest = _apart(framed, group, percent)
    return edges.unionByName(compared(likely(rest), texts, percent).select("a", "b"))


def _apart(framed: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, among the nodes compared with one leader.

    Sets x and y with n and m shingles are linked if they differ in at most d = (n + m) * c
    shingles, c = (1 - t) / (1 + t). Both are told by what sets them apart from the leader, X and
    Y: x and y differ in what only one of X and Y has, so X and Y must share
    o = (|X| + |Y| - d) / 2 at least. Ordered alike, rarest first, the leading |X| - o + 1 of X and
    |Y| - o + 1 of Y then have one in common (prefix filtering), and these are d / 2 + 1 or so:
    a node's own edits, as a rule, which no other node has. As one of the two, x, isn't linked
    with the leader (of l shingles), |X| > (n + l) * c; with that and ||X| - |Y|| <= d, a node's
    own figures bound what it must send.
    """
    c = (100 - percent) / (100 + percent)
    of = group.toDF("b", "component")
    sides = framed.join(of, "b", "left").select(
        "a", "b", F.coalesce("component", "b").alias("component"), "n_a", "n_b", "linked", "apart", F.size("apart").alias("s")
    )
    tokens = sides.select("a", F.explode("apart").alias("token"))
    often = tokens.groupBy("a", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    kept = sides.select(
        "a", "b", "component", "n_a", "n_b", "linked", "s", F.explode("apart").alias("token")
    ).join(often, ["a", "token"])
    # those that no other node has come first, and match nothing
    line = W.partitionBy("a", "b").orderBy("df", "token")
    place = F.col("s") - F.count(F.lit(1)).over(W.partitionBy("a", "b")) + F.row_number().over(line)
    least = lambda share: F.col("s") - F.greatest(F.lit(1), F.ceil(share - 1e-6)) + 1
    widest = F.col("n_b") * (c * (1 + 100 / percent))
    ranked = kept.select("*", place.alias("_place")).withColumns({
        "_any": F.col("_place") <= least(F.greatest((F.col("s") + (F.col("n_a") - F.col("n_b")) * c) / 2, F.col("s") - widest)),
        "_lone": ~F.col("linked") & (F.col("_place") <= least(F.col("s") - widest)),
    })
    x = ranked.where("_lone").select(
        "a", "token", F.col("b").alias("x"), F.col("component").alias("cx"), F.col("s").alias("sx"), F.col("n_b").alias("nx"),
        F.col("_place").alias("px")
    )
    y = ranked.where("_any").select(
        "a", "token", F.col("b").alias("y"), F.col("component").alias("cy"), F.col("s").alias("sy"), F.col("n_b").alias("ny"),
        F.col("_place").alias("py"), F.col("linked").alias("ly")
    )
    d = (F.col("nx") + F.col("ny")) * c
    share = F.greatest(F.lit(1), F.ceil((F.col("sx") + F.col("sy") - d) / 2 - 1e-6))
    able = (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (F.abs(F.col("sx") - F.col("sy")) <= d + 1e-6)
    leading = (F.col("px") <= F.col("sx") - share + 1) & (F.col("py") <= F.col("sy") - share + 1)
    met = x.join(y, ["a", "token"]).where((F.col("cx") != F.col("cy")) & (F.col("ly") | (F.col("x") < F.col("y"))) & able & leading)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``near_duplicates`` for nulls, empty texts, repeated rows and empty tables; ties can't occur, as a link is a matter of two texts alone."""
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)
