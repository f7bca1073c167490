"""Chat formatting over a prefix tree.

Conversations that share their first turns share those turns' nodes. The tokens of each node are
written once, depth first; a node has the position of its first token on the path from the root,
and the intervals of the stream that its ancestors take, to which its tokens may attend.

Positions and intervals count tokens of a byte-level vocabulary. A turn's head, text and end are
tokenized apart, so that the loss mask covers the text's tokens and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.llm.arrays import chunks
from lexspark.llm.bpe import encoder
from lexspark.llm.common import checkpoint, emit, hot_join, read, saved, width

HEAD, STOP, TRAINED = "### ", "</turn>", "assistant"
#: Tokens of a block of the stream; a conversation is read back block by block.
BLOCK = 1024
_END = f"{STOP}\n".encode()

_TURNS = pa.schema([
    ("conv", pa.string()), ("k", pa.int64()), ("node", pa.binary()), ("role", pa.string()), ("text", pa.string())
])
_TURNS_DDL = "conv string, k long, node binary, role string, text string"
_NODES = pa.schema([
    ("node", pa.binary()), ("branch", pa.string()), ("k", pa.int64()), ("ids", pa.binary()), ("tokens", pa.int64()),
    ("loss_from", pa.int64()), ("loss_to", pa.int64())
])
_NODES_DDL = "node binary, branch string, k long, ids binary, tokens long, loss_from long, loss_to long"
_READ = pa.schema([
    ("conv", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())
])
_READ_DDL = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: F.Column) -> F.Column:
    r"""A backslash before each backslash and before each control string, so none is left bare."""
    return F.replace(
        F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(HEAD.strip()), F.lit("\\" + HEAD.strip())), F.lit(STOP),
        F.lit("\\" + STOP)
    )


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\", "") for p in parts)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    line = turn.index("\n")
    if not turn.startswith(HEAD) or not turn.endswith(f"{STOP}\n"):
        raise ValueError("a turn without its marks")
    role = unescape(turn[len(HEAD) : line - 1]).replace("%0A", "\n").replace("%25", "%")
    return role, unescape(turn[line + 1 : len(turn) - len(STOP) - 1])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordinal and node of each turn, from rows that come in order of conversation and turn.

    A node's name is the SHA-256 of its parent's name, role and text. Only the name of the last
    turn is held, however long a conversation is.
    """
    conv, k, name = None, 0, b""
    for batch in batches:
        ks, names = [], []
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text")), strict=True):
            if c != conv:
                conv, k, name = c, 0, b""
            h = hashlib.sha256(name)
            for part in (role.encode(), text.encode()):
                h.update(len(part).to_bytes(8, "little") + part)
            name = h.digest()
            ks.append(k)
            names.append(name)
            k += 1
        yield emit(
            _TURNS, conv=batch.column("conv").cast(pa.string()), k=ks, node=names, role=batch.column("role").cast(pa.string()),
            text=batch.column("text").cast(pa.string())
        )


def _tokenized(path: str):
    """The ids of each node's turn, and which of them are under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            parts = [[ids for c in chunks(batch.column(x)) for ids in known.encode(c, special=False)] for x in ("head", "body", "tail")]
            loss = batch.column("loss").to_pylist()
            begin = np.array([len(x) if yes else 0 for x, yes in zip(parts[0], loss, strict=True)], np.int64)
            end = begin + np.array([len(x) if yes else 0 for x, yes in zip(parts[1], loss, strict=True)], np.int64)
            ids = [np.concatenate(x).astype("<u4") for x in zip(*parts, strict=True)]
            yield emit(
                _NODES, node=batch.column("node"), branch=batch.column("branch").cast(pa.string()), k=batch.column("k"),
                ids=[x.tobytes() for x in ids], tokens=[len(x) for x in ids], loss_from=begin, loss_to=end
            )
        del known
        encoder.cache_clear()

    return run


class _Reader:
    """What one conversation says, from its tokens and their loss mask, piece by piece; only the turn at hand is held."""

    def __init__(self):
        self.pending, self.masked = bytearray(), bytearray()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.scanned = 0

    def unmask(self) -> None:
        text = unescape(self.masked.decode())
        self.loss_chars += len(text)
        self.loss.update(text.encode())
        self.masked.clear()

    def add(self, ids: np.ndarray, mask: np.ndarray, table: list[bytes]) -> None:
        edge = np.flatnonzero(np.append(True, mask[1:] != mask[:-1]))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True):
            said = b"".join([table[i] for i in ids[a:b].tolist()])
            self.pending += said
            if mask[a]:
                self.masked += said
            elif self.masked:
                self.unmask()
        begin, at = 0, max(0, self.scanned - len(_END) + 1)
        while (at := self.pending.find(_END, at)) >= 0:
            slashes = at
            while slashes > begin and self.pending[slashes - 1] == 0x5C:
                slashes -= 1
            at += 1
            if (at - 1 - slashes) % 2:  # escaped: a part of the text
                continue
            turn = self.pending[begin : at - 1 + len(_END)].decode()
            role, text = parse(turn)
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            self.chars += len(turn)
            begin = at - 1 + len(_END)
        del self.pending[:begin]
        self.scanned = len(self.pending)

    def close(self) -> tuple:
        if self.masked:
            self.unmask()
        if self.pending:
            raise ValueError("a conversation that doesn't end with a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(path: str):
    """Read each conversation's stretches of the stream, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(path).table()
        conv, reader = None, None
        out: dict[str, list] = {f.name: [] for f in _READ}

        def close() -> None:
            if reader is not None:
                for c, v in zip(out, (conv, *reader.close()), strict=True):
                    out[c].append(v)

        for batch in batches:
            for c, ids, mask in zip(*(batch.column(x).to_pylist() for x in ("conv", "ids", "mask")), strict=True):
                if reader is None or c != conv:
                    close()
                    conv, reader = c, _Reader()
                reader.add(np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8) & 1, table)
            if len(out["conv"]) > 5000:
                yield emit(_READ, **out)
                for v in out.values():
                    v.clear()
        close()
        encoder.cache_clear()
        yield emit(_READ, **out)

    return run


def prefix_tree(
    conversations: DataFrame, path: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(nodes, turns) of the tree.

    nodes: node, branch (the first conversation that has it), k (its depth), ids (the tokens of the
    formatted turn, little-endian unsigned 32-bit), tokens, stream_start (its place in the stream,
    depth first), position (of its first token on its path), attends (array of [from, to) in the
    stream: its ancestors' tokens; its own before each one come on top), loss_from and loss_to
    (its tokens under the loss mask, equal if none).
    turns: conv, k, node, branch; one row for each input row.
    path: a vocabulary file of the tokenizers library, present on the executors.

    A null role or text is empty; a null conversation is one of its own; a null turn comes first.
    Turns that repeat a number follow each other by role and text, and repeated rows are turns
    of their own. Other columns are ignored. An empty table gives empty results.

    A conversation passes through one task as a sorted run, never held whole, since its names are
    a chain. Turns that very many conversations share are few, and joined by broadcast.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("null"))
    rows = conversations.select(
        key.alias("conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    run = rows.repartition(
        width(conversations.sparkSession), "conv"
    ).sortWithinPartitions("conv", "_turn", "role", "text").select("conv", "role", "text")
    turns = checkpoint(run.mapInArrow(_chain, _TURNS_DDL))
    # the owner of a node: the first conversation through it; owners rise along a path, and each one's nodes are a run
    owners = checkpoint(turns.groupBy("node").agg(F.min("conv").alias("branch"), F.count(F.lit(1)).alias("n")))
    placed = checkpoint(hot_join(turns.select("conv", "k", "node"), owners, "node", "n"))
    head = F.concat(
        F.lit(HEAD), escape(F.replace(F.replace(F.col("role"), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))),
        F.lit(":\n")
    )
    owned = turns.join(owners.select("node", F.col("branch").alias("conv")), ["node", "conv"], "left_semi")
    said = owned.select(
        "node", F.col("conv").alias("branch"), "k", head.alias("head"), escape(F.col("text")).alias("body"),
        F.lit(f"{STOP}\n").alias("tail"), (F.col("role") == TRAINED).alias("loss")
    )
    along = W.partitionBy("branch").orderBy("k")
    nodes = said.mapInArrow(_tokenized(path), _NODES_DDL)
    nodes = checkpoint(nodes.withColumn(
        "_within", F.coalesce(F.sum("tokens").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ))
    # a branch's path: its ancestors' branches and the depth at which each forks off, deepest fork first among siblings
    forks = placed.groupBy("conv", "branch").agg(F.min("k").alias("k"))
    own = forks.where(F.col("conv") == F.col("branch")).select("conv")
    paths = forks.join(own, "conv", "left_semi").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(F.col("k"), F.col("branch")))).alias("path"))
    sizes = nodes.groupBy(F.col("branch").alias("conv")).agg(F.sum("tokens").alias("size"))
    order = F.transform("path", lambda s: F.struct((-s["k"]).alias("up"), s["branch"].alias("branch")))
    branches = starts(paths.join(sizes, "conv").withColumn("order", order))
    # each ancestor branch gives one interval: from where it starts to where the path leaves it
    step = checkpoint(branches.select("conv", F.posexplode("path").alias("i", "s"), "path").select(
        "conv", "i", F.col("s.branch").alias("branch"), F.expr("get(path, i + 1).k").alias("leaves")
    ).where("leaves IS NOT NULL"))
    place = F.struct("branch", "leaves")
    asked = step.groupBy(place.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    upto = nodes.select(
        F.struct("branch", (F.col("k") + 1).alias("leaves")).alias("at"), (F.col("_within") + F.col("tokens")).alias("upto"),
        "branch"
    )
    reach = upto.join(
        branches.select(F.col("conv").alias("branch"), F.col("start").alias("from")), "branch"
    ).join(asked, "at").select("at", "upto", "from", "n")
    passed = hot_join(step.select("conv", "i", place.alias("at")), checkpoint(reach), "at", "n")
    above = passed.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("i", F.col("from"), (F.col("from") + F.col("upto")).alias("to")))).alias("spans"),
        F.sum("upto").alias("depth")
    )
    per_branch = branches.select(F.col("conv").alias("branch"), "start").join(
        above.withColumnRenamed("conv", "branch"), "branch", "left"
    )
    spans = F.transform(
        F.coalesce("spans", F.array().cast("array<struct<i:int,from:bigint,to:bigint>>")),
        lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"))
    )
    mine = F.when(
        F.col("_within") > 0, F.array(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("_within")).alias("to")))
    ).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>"))
    tree = nodes.join(per_branch, "branch").select(
        "node", "branch", "k", "ids", "tokens",
        (F.col("start") + F.col("_within")).alias("stream_start"),
        (F.coalesce("depth", F.lit(0)) + F.col("_within")).alias("position"),
        F.concat(spans, mine).alias("attends"), "loss_from", "loss_to",
    )
    return saved(tree, "tree"), placed


def stream(tree: DataFrame) -> DataFrame:
    """The output itself: block, ids, mask (a digit for each token, 1 under the loss mask), BLOCK tokens a row."""
    one = lambda lo, hi: F.repeat(F.lit("1"), (hi - lo).cast("int"))
    none = lambda lo, hi: F.repeat(F.lit("0"), (hi - lo).cast("int"))
    mask = F.concat(
        none(F.lit(0), F.col("loss_from")), one(F.col("loss_from"), F.col("loss_to")), none(F.col("loss_to"), F.col("tokens"))
    )
    last = F.col("stream_start") + F.col("tokens") - 1
    cut = tree.select(
        "stream_start", "tokens", "ids", mask.alias("mask"),
        F.explode(F.sequence(F.floor(F.col("stream_start") / BLOCK), F.floor(last / BLOCK))).alias("block")
    )
    lo = F.greatest(F.col("stream_start"), F.col("block") * BLOCK)
    n = (F.least(F.col("stream_start") + F.col("tokens"), (F.col("block") + 1) * BLOCK) - lo).cast("int")
    at = (lo - F.col("stream_start")).cast("int")
    pieces = cut.select(
        "block",
        F.struct(
            lo.alias("at"), F.substring("ids", 4 * at + 1, 4 * n).alias("ids"), F.substring("mask", at + 1, n).alias("mask")
        ).alias("p")
    )
    held = pieces.groupBy("block").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return held.select(
        "block", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.array_join("p.mask", "").alias("mask")
    )


def starts(branches: DataFrame) -> DataFrame:
    """Add ``start``: the sum of size over the branches before, in order of ``order``.

    Ranges of the order are summed apart; only one sum for each partition meets in one place.
    """
    spark = branches.sparkSession
    ranged = branches.repartitionByRange(width(spark), "order").withColumn("_part", F.spark_partition_id())
    ranged = checkpoint(ranged)
    parts = ranged.groupBy("_part").agg(F.sum("size").alias("_sum"))
    before = parts.select("_part", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum("size").over(W.partitionBy("_part").orderBy("order")) - F.col("size")
    return ranged.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(
        "start", F.col("_before") + F.col("_within")
    ).drop("_part", "_within", "_before")


def read_back(tree: DataFrame, turns: DataFrame, path: str) -> DataFrame:
    """What each conversation says, read from the stream through the intervals of its last turn: see the columns of _READ.

    Of the tree only the last turn's intervals are asked for; all text comes out of the stream's
    tokens, in the order of the intervals.
    """
    leaves = checkpoint(turns.groupBy("conv").agg(F.max_by("node", "k").alias("node")))
    asked = leaves.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    own = F.array(F.struct(F.col("stream_start").alias("from"), (F.col("stream_start") + F.col("tokens")).alias("to")))
    ends = checkpoint(tree.select("node", F.concat("attends", own).alias("spans")).join(asked, "node"))
    spans = hot_join(leaves, ends, "node", "n").select("conv", F.posexplode("spans").alias("i", "s"))
    wanted = saved(
        spans.select(
            "conv", "i", "s.*",
            F.explode(F.sequence(F.floor(F.col("s.from") / BLOCK), F.floor((F.col("s.to") - 1) / BLOCK))).alias("block")
        ),
        "spans"
    )
    blocks = saved(stream(tree).join(wanted.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block"), "stream")
    full = hot_join(wanted, blocks, "block", "n")
    lo = F.greatest(F.col("from"), F.col("block") * BLOCK)
    n = (F.least("to", (F.col("block") + 1) * BLOCK) - lo).cast("int")
    at = (lo - F.col("block") * BLOCK).cast("int")
    mask = F.encode(F.substring("mask", at + 1, n), "UTF-8")
    cut = full.select("conv", "i", "block", F.substring("ids", 4 * at + 1, 4 * n).alias("ids"), mask.alias("mask"))
    run = cut.repartition(width(tree.sparkSession), "conv").sortWithinPartitions("conv", "i", "block").select("conv", "ids", "mask")
    return run.mapInArrow(_digest(path), _READ_DDL)


def op5_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See ``prefix_tree`` for nulls, repeated turns and empty tables."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], table.schema)
    tree, turns = prefix_tree(table.unionByName(extra), path)
    return read_back(tree, turns, path).select(
        F.expr("try_cast(substr(conv, 2) AS BIGINT)").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
        "formatted_chars"
    )
