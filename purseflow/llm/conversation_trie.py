"""Prefix trie of conversations by range-partitioned paths and a skeleton of splitter paths."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from purseflow.session import staged

# A turn on a path: 16 bytes of a hash of role and text, then the text's length in UTF-8 bytes.
_HASH = 16
_TURN = 20
# Conversations that share a beginning, and the longest beginning that one takes over.
GROUP = 5
LONGEST_HEAD = 8
# Paths sampled per shard to place the splitters.
SAMPLE_PER_SHARD = 32
_PIECE = 1 << 16
_NO_MEMBERS = hashlib.sha256(b"").hexdigest()

_OUT = (
    "kind int, skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard int, piece long, "
    "ids binary"
)
_LOCAL, _PARTIAL, _ENDS = 0, 1, 2


def own_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) from (conv_id, turn, role, text): each conversation's turns in order.

    Ordered by turn, null first, then by the turn's path bytes. Null role or text counts as empty;
    rows without conv_id belong to no conversation. Only hashes and lengths are shuffled.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.sha2(head.cast("binary"), 256), 1, 2 * _HASH)
    size = F.lpad(F.hex(F.octet_length(text)), 2 * (_TURN - _HASH), "0")
    step = F.unhex(F.concat(digest, size)).alias("step")
    entries = F.sort_array(F.collect_list(F.struct("turn", "step")))
    return (
        turns.filter(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", step)
        .groupBy("conv_id")
        .agg(F.unhex(F.array_join(F.transform(entries, lambda e: F.hex(e["step"])), "")).alias("path"))
    )


def with_shared_heads(own: DataFrame, group: int = GROUP, longest: int = LONGEST_HEAD) -> DataFrame:
    """(conv_id, path) where conversation c begins with h turns of conversation c - c % group.

    h is crc32 of c in decimal, modulo ``longest`` + 1. It takes all turns of that conversation if
    it has fewer and none if it is absent, then its own turns after its first h.
    """
    heads = own.filter(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("first_id"), F.substring("path", 1, longest * _TURN).alias("head")
    )
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1) * _TURN
    return (
        own.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % group)
        .withColumn("taken", taken.cast("int"))
        .join(heads, "first_id", "left")
        .select(
            "conv_id",
            F.concat(
                F.coalesce(F.expr("substring(head, 1, taken)"), F.lit(b"")),
                F.expr("substring(path, taken + 1)"),
            ).alias("path"),
        )
    )


def common_turns(a: bytes, b: bytes) -> int:
    """Number of turns that two paths have in common from the start."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // _TURN
    x = np.frombuffer(a, np.uint8, size)
    return int(np.argmax(x != np.frombuffer(b, np.uint8, size))) // _TURN


class Skeleton:
    """The trie of the splitter paths; node 0 is the root, parents come before their children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.parent, self.depth, self.bytes = [-1], [0], [0]
        self.child: dict[tuple[int, bytes], int] = {}
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), _TURN):
                step = path[at : at + _TURN]
                known = self.child.get((node, step))
                if known is None:
                    known = self.child[node, step] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                    self.bytes.append(int.from_bytes(step[_HASH:], "big"))
                node = known

    def shard_of(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


def choose_splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 (path, conv_id) that cut the sorted paths into even runs.

    They are chosen from a sample of about SAMPLE_PER_SHARD paths a shard. The driver and later
    each task hold so many paths, however many conversations there are.
    """
    wanted, count = SAMPLE_PER_SHARD * shards, paths.count()
    some = paths if count <= wanted else paths.sample(wanted / count, seed=1)
    found = sorted((bytes(r["path"]), r["conv_id"]) for r in some.select("path", "conv_id").collect())
    cuts = {len(found) * k // shards for k in range(1, shards)} - {0}
    return [found[k] for k in sorted(cuts)]


class _Node:
    """An open node on the path of the row at hand."""

    __slots__ = ("skeleton", "least", "convs", "children", "leaves", "saved", "bytes", "ends", "ids",
                 "held")

    def __init__(self, skeleton: int, size: int):
        self.skeleton, self.bytes = skeleton, size
        self.least = None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends = None
        self.ids: list[int] = []
        self.held: list[tuple] = []


class _Shard:
    """Walks one shard's rows in order, holding the nodes on the current path.

    A node that is no splitter's prefix lies within the shard: it is finished when the path leaves
    it. Finished children of such a node wait for its smallest member; those of a skeleton node
    leave at once with its number. Skeleton nodes leave partial aggregates.
    """

    def __init__(self, skeleton: Skeleton, shard: int):
        self.trie, self.shard = skeleton, shard
        self.path = b""
        self.open = [_Node(0, 0)]
        self.out: list[tuple] = []
        self.pieces = 0

    def add(self, path: bytes, conv_id: int) -> None:
        self._close_to(common_turns(path, self.path))
        for at in range((len(self.open) - 1) * _TURN, len(path), _TURN):
            step, above = path[at : at + _TURN], self.open[-1].skeleton
            known = self.trie.child.get((above, step), -1) if above >= 0 else -1
            self.open.append(_Node(known, int.from_bytes(step[_HASH:], "big")))
        self.path = path
        top = self.open[-1]
        top.convs += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.ids.append(conv_id)
        if len(top.ids) >= _PIECE // 8:
            self._flush(top)

    def _flush(self, node: _Node) -> None:
        text = ",".join(map(str, node.ids)).encode()
        node.ids = []
        if node.skeleton >= 0:
            self._emit(kind=_ENDS, skeleton=node.skeleton, piece=self.pieces, ids=text)
            self.pieces += 1
        elif node.ends is None:
            node.ends = hashlib.sha256(text)
        else:
            node.ends.update(b"," + text)

    def _emit(self, kind, skeleton=None, conv_id=None, depth=None, parent=None, convs=None,
              children=None, leaves=None, saved=None, ends=None, piece=None, ids=None) -> None:
        self.out.append(
            (kind, skeleton, conv_id, depth, parent, convs, children, leaves, saved, ends,
             self.shard, piece, ids)
        )

    def _close_to(self, depth: int) -> None:
        while len(self.open) - 1 > depth:
            self._close(self.open.pop(), self.open[-1])

    def _close(self, node: _Node, above: _Node | None) -> None:
        if node.ids:
            self._flush(node)
        if node.skeleton >= 0:
            self._emit(kind=_PARTIAL, skeleton=node.skeleton, conv_id=node.least, convs=node.convs,
                       children=node.children, leaves=node.leaves, saved=node.saved)
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.convs - 1) * node.bytes
        for row in node.held:
            self._emit(_LOCAL, None, row[0], row[1], node.least, *row[2:])
        ends = node.ends.hexdigest() if node.ends else _NO_MEMBERS
        row = (node.least, len(self.open), node.convs, node.children, leaves, saved, ends)
        if above.skeleton >= 0:
            self._emit(_LOCAL, above.skeleton, row[0], row[1], None, *row[2:])
        else:
            above.held.append(row)
        above.convs += node.convs
        above.least = node.least if above.least is None else min(above.least, node.least)
        above.children += 1
        above.leaves += leaves
        above.saved += saved

    def finish(self) -> None:
        self._close_to(0)
        self._close(self.open.pop(), None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in _OUT.split(", ")]
    arrays = [pa.array(column, kinds[kind]) for column, (_, kind) in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _walk(shared):
    """Nodes, partial aggregates and pieces of member lists out of sorted shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "path", "conv_id"))
            for number, path, conv_id in zip(*columns):
                if shard is None or number != shard.shard:
                    if shard:
                        shard.finish()
                        yield _batch(shard.out)
                    shard = _Shard(shared.value, number)
                shard.add(path, conv_id)
                if len(shard.out) >= 20_000:
                    yield _batch(shard.out)
                    shard.out = []
        if shard:
            shard.finish()
            yield _batch(shard.out)

    return run


def _deal(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, ids = batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()
            of = [shared.value.shard_of(p, c) for p, c in zip(paths, ids)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int32()), batch.column("path"), batch.column("conv_id")],
                names=["shard", "path", "conv_id"],
            )

    return run


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each skeleton node's pieces, which come in order."""
    node, digest, found = None, None, []
    for batch in batches:
        for skeleton, ids in zip(*(batch.column(c).to_pylist() for c in ("skeleton", "ids"))):
            if skeleton == node:
                digest.update(b"," + ids)
                continue
            if digest:
                found.append((node, digest.hexdigest()))
            node, digest = skeleton, hashlib.sha256(ids)
    if digest:
        found.append((node, digest.hexdigest()))
    ids, hashes = zip(*found) if found else ((), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), pa.array(hashes, pa.string())], names=["skeleton", "ends_sha256"]
    )


def finish_skeleton(spark: SparkSession, trie: Skeleton, parts: DataFrame, ends: DataFrame) -> DataFrame:
    """The skeleton's nodes, from partial aggregates that shards and reduction have left.

    As many rows as the splitter paths have prefixes; sums go from children to parents.
    """
    size = len(trie.parent)
    least: list[int | None] = [None] * size
    convs, children, leaves, saved = ([0] * size for _ in range(4))
    for r in parts.collect():
        at = r["skeleton"]
        least[at], convs[at], children[at] = r["conv_id"], r["n_convs"], r["n_children"]
        leaves[at], saved[at] = r["n_leaves"], r["saved_tokens"]
    hashes = {r["skeleton"]: r["ends_sha256"] for r in ends.collect()}
    for at in range(size - 1, -1, -1):
        leaves[at] = leaves[at] or 1
        saved[at] += max(convs[at] - 1, 0) * trie.bytes[at]
        up = trie.parent[at]
        if up >= 0:
            least[up] = least[at] if least[up] is None else min(least[up], least[at])
            convs[up] += convs[at]
            children[up] += 1
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    above = [None if p < 0 else least[p] for p in trie.parent]
    table = pa.table(
        {
            "skeleton": pa.array(range(size), pa.int32()),
            "conv_id": pa.array(least, pa.int64()),
            "depth": pa.array(trie.depth, pa.int64()),
            "parent_conv_id": pa.array(above, pa.int64()),
            "n_convs": pa.array(convs, pa.int64()),
            "n_children": pa.array(children, pa.int64()),
            "n_leaves": pa.array(leaves, pa.int64()),
            "saved_tokens": pa.array(saved, pa.int64()),
            "ends_sha256": pa.array([hashes.get(k, _NO_MEMBERS) for k in range(size)]),
        }
    )
    return spark.createDataFrame(table)


_NODE = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)


def path_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """All nodes of the trie of ``paths`` (conv_id, path), one row per path and conv_id.

    Sampled splitters cut the paths, sorted with conv_id, into shards, so that equal paths spread
    as well. A node that lies in more than one shard is a prefix of a splitter between them. The
    trie of the splitters is broadcast (``shards`` paths at most); each shard finishes all other
    nodes and leaves partial aggregates of the skeleton's, which are combined by reduction.
    """
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    trie = Skeleton(choose_splitters(paths, shards))
    shared = spark.sparkContext.broadcast(trie)
    dealt = (
        paths.select("path", "conv_id")
        .mapInArrow(_deal(shared), "shard int, path binary, conv_id long")
        .repartitionById(len(trie.splitters) + 1, F.col("shard"))
        .sortWithinPartitions("shard", "path", "conv_id")
    )
    found = staged(dealt.mapInArrow(_walk(shared), _OUT), "trie_shards")
    partial = found.filter(F.col("kind") == _PARTIAL)
    parts = partial.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    # A SHA-256 is sequential: a node's pieces, 64 KB each, stream through one task.
    ends = (
        found.filter(F.col("kind") == _ENDS)
        .select("skeleton", "shard", "piece", "ids")
        .repartition("skeleton")
        .sortWithinPartitions("skeleton", "shard", "piece")
        .mapInArrow(_hash_members, "skeleton int, ends_sha256 string")
    )
    top = finish_skeleton(spark, trie, parts, ends)
    above = top.select("skeleton", F.col("conv_id").alias("above"))
    local = found.filter(F.col("kind") == _LOCAL).join(F.broadcast(above), "skeleton", "left")
    local = local.withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return local.select(*_NODE).unionByName(top.filter("n_convs > 0").select(*_NODE))


def conversation_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shards: int | None = None,
) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations, from the textless root on.

    Columns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Conversations are rebuilt as
    ``with_shared_heads`` says, then put into a trie by ``path_trie``.

    Turns are ordered by number, null first, ties by a hash of role and text; repeated rows are
    repeated turns. Null role or text counts as empty. Rows with a null conversation id belong to
    no conversation. A conversation left without turns ends at the root. An empty table has no
    nodes, not even a root. Turns are equal if 128 bits of their SHA-256 and their lengths are. Other
    columns are not looked at. A conversation is one value of 20 bytes a turn in a task; no group of
    conversations is.
    """
    names = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    turns = conversations.select(
        *(F.col("`" + c.replace("`", "``") + "`").alias(a) for a, c in names.items())
    ).withColumn("conv_id", F.col("conv_id").cast("long"))
    own = staged(own_paths(turns), "own_paths")
    paths = staged(with_shared_heads(own), "paths")
    return path_trie(paths, shards).withColumnRenamed("conv_id", conv_col)
