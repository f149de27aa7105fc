"""The prefix trie of conversations, by a skeleton of splitters.

Method: every conversation is the path of its turns' digests, and all are dealt to shards by ranges of (path, id)
whose splitters are conversations themselves. The trie of the splitters' paths, the skeleton, goes to every task.
Only its nodes can have members in several shards: a sorted shard finishes every other node by one walk over its
rows, and gives partial aggregates for skeleton nodes, which a reduction combines.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.plans.durable import durable

#: Shards at most, sampled conversations for each, and turns of a splitter's path: they bound the skeleton to SHARDS x DEEPEST nodes.
SHARDS, SAMPLED, DEEPEST = 1024, 4, 64
#: Bytes of a turn's digest; about so many bytes of ids of one node travel as one row.
DIGEST, CHUNK = 16, 8192


def _turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits of SHA-256 over the role's length, role and text; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, 2 * DIGEST)


def rebuilt_paths(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, path binary, words array<int>): each conversation c of (conv_id, turn, role, text) after it was rebuilt.

    It has the first h turns of conversation c - c % ``family`` (all if fewer, none if absent), then its own after
    its first h; h is the CRC-32 of c in decimal modulo ``most``. Turns come in the order of their number, null first,
    and repeated numbers in that of their digests. Rows without a conv_id belong to no conversation.
    """
    word_count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    one = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn"), _turn_digest(F.col("role"), F.col("text")).alias("digest"), word_count.cast("int").alias("words"))
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    own = durable(own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns")))
    base = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    rows = own.withColumns({"base": base, "h": h}).join(heads, "base", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    begin = F.when(F.col("head").isNull(), none).otherwise(F.slice("head", F.lit(1), F.col("h")))
    whole = F.concat(begin, F.slice("turns", F.col("h") + 1, F.size("turns")))
    return rows.select("conv_id", whole.alias("turns")).select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.words").alias("words"))


def chosen_splitters(paths: DataFrame, shards: int, sampled: int = SAMPLED, deepest: int = DEEPEST) -> list[tuple[bytes, float | int]]:
    """Up to ``shards`` - 1 splitters (path, conv_id), from the ``shards`` x ``sampled`` conversations with the least hashes of their ids.

    They are the same however the rows are dealt. A path over ``deepest`` turns is cut; it then stands before
    all conversations that begin with it, so these stay in one shard.
    """
    head = F.substring("path", 1, DIGEST * deepest)
    rows = paths.orderBy(F.xxhash64("conv_id"), "conv_id").limit(shards * sampled).select("conv_id", head.alias("head"), F.octet_length("path").alias("n")).collect()
    keys = sorted({(bytes(r["head"]), r["conv_id"] if r["n"] <= DIGEST * deepest else float("-inf")) for r in rows})
    return [keys[k * len(keys) // shards] for k in range(1, shards)] if len(keys) >= shards else keys[1:]


class Skeleton:
    """The trie of the splitters' paths: ``down`` finds a child, ``up`` a parent; node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, float | int]]):
        self.down: dict[tuple[int, bytes], int] = {}
        self.up: list[int] = [-1]
        for path, _ in splitters:
            node = 0
            for k in range(0, len(path), DIGEST):
                step = (node, path[k : k + DIGEST])
                if step not in self.down:
                    self.down[step] = len(self.up)
                    self.up.append(node)
                node = self.down[step]


class _Node:
    """An open node of the walk."""

    __slots__ = ("children", "conv", "convs", "ends", "key", "leaves", "pending", "saved", "skeleton", "words")

    def __init__(self, key: int, skeleton: int | None, words: int):
        self.key, self.skeleton, self.words = key, skeleton, words
        self.convs = self.children = self.leaves = self.saved = 0
        self.conv: int | None = None
        self.ends = hashlib.sha256() if skeleton is None else None
        self.pending: list[int] = []  # ids of a skeleton node that end here and still have to be sent


#: kind 0: a finished node; 1: a part of a skeleton node; 2: ids that end in a skeleton node.
PARTS = [("kind", "int"), ("skeleton", "int"), ("key", "long"), ("parent_key", "long"), ("parent_skeleton", "int"), ("depth", "long"), ("conv_id", "long")]
PARTS += [("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("words", "long"), ("ends", "string")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
PARTS_SCHEMA = ", ".join(f"{n} {t}" for n, t in PARTS)


def _common(a: bytes, b: bytes, known: int) -> int:
    """Turns that two paths share at the beginning; the first ``known`` are known to be shared."""
    low, high = known, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST] else (low, middle - 1)
    return low


class Walk:
    """One walk over the rows of shards, sorted by (shard, path, conv_id). Only the nodes of the row at hand are open."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.open, self.rows, self.shard, self.path, self.count = skeleton, [], [], None, b"", 0

    def _enter(self, skeleton: int | None, words: int) -> None:
        self.count += 1
        self.open.append(_Node((self.shard << 40) + self.count, skeleton, words))

    def _send(self, node: _Node) -> None:
        if node.pending:
            self.rows.append((2, node.skeleton, None, None, None, None, node.pending[0], None, None, None, None, None, ",".join(map(str, node.pending))))
            node.pending = []

    def _leave(self) -> None:
        node, depth = self.open.pop(), len(self.open)
        parent = self.open[-1] if self.open else None
        if node.skeleton is not None:
            self._send(node)
            self.rows.append((1, node.skeleton, None, None, None, depth, node.conv, node.convs, node.children, node.leaves, node.saved, node.words, None))
        else:
            node.leaves += node.children == 0
            node.saved += (node.convs - 1) * node.words
            parent.children += 1
            above = (None, parent.skeleton) if parent.skeleton is not None else (parent.key, None)
            self.rows.append((0, None, node.key, *above, depth, node.conv, node.convs, node.children, node.leaves, node.saved, None, node.ends.hexdigest()))
        if parent is not None:
            parent.convs += node.convs
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)

    def close(self) -> None:
        while self.open:
            self._leave()

    def add(self, shard: int, path: bytes, conv: int, words: list[int]) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.path, self.count = shard, b"", 0
            self._enter(0, 0)
        shared = _common(self.path, path, 0)
        while len(self.open) > shared + 1:
            self._leave()
        for k in range(shared, len(path) // DIGEST):
            above = self.open[-1].skeleton
            self._enter(None if above is None else self.skeleton.down.get((above, path[k * DIGEST : (k + 1) * DIGEST])), words[k])
        self.path, node = path, self.open[-1]
        if node.skeleton is not None:
            node.pending.append(conv)
            if len(node.pending) * 8 >= CHUNK:
                self._send(node)
        else:
            node.ends.update((f",{conv}" if node.convs else str(conv)).encode())  # members that end here come before all longer ones
        node.convs += 1
        node.conv = conv if node.conv is None else min(node.conv, conv)

    def taken(self) -> pa.RecordBatch:
        """The rows made so far, as a batch of their own."""
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(PARTS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, PARTS, strict=True)], [n for n, _ in PARTS])


def _walked(batches: Iterator[pa.RecordBatch], splitters: list) -> Iterator[pa.RecordBatch]:
    walk = Walk(Skeleton(splitters))
    for batch in batches:
        for shard, path, conv, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words")), strict=True):
            walk.add(shard, path, conv, words)
            if len(walk.rows) >= 5000:
                yield walk.taken()
    walk.close()
    yield walk.taken()


def _sharded(batches: Iterator[pa.RecordBatch], splitters: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
        shard = [bisect_right(splitters, key) for key in keys]
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *(batch.column(c) for c in ("conv_id", "path", "words"))], ["shard", "conv_id", "path", "words"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the ids of each skeleton node, whose rows come one after the other."""
    node, digest = None, None
    out: list[tuple[int, str]] = []
    for batch in batches:
        for skeleton, ends in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if skeleton != node:
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = skeleton, hashlib.sha256(ends.encode())
            else:
                digest.update(f",{ends}".encode())
    out += [(node, digest.hexdigest())] if node is not None else []
    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int32()), pa.array([d for _, d in out], pa.string())], ["skeleton", "ends_sha256"])


NODE_SCHEMA = "skeleton int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE = [c.split()[0] for c in NODE_SCHEMA.split(", ")][1:]


def skeleton_rows(skeleton: Skeleton, parts: list, ends: dict[int, str]) -> list[tuple]:
    """Rows of NODE_SCHEMA from the reduced parts: children, leaves and saved tokens of skeleton nodes go up their trie."""
    nodes = {r["skeleton"]: r for r in parts}
    children, leaves, saved = (np.zeros(len(skeleton.up), np.int64) for _ in range(3))
    for node in range(len(skeleton.up) - 1, -1, -1):  # a child's number is larger than its parent's
        row, up = nodes[node], skeleton.up[node]
        children[node] += row["n_children"]
        leaves[node] += children[node] == 0
        saved[node] += (row["n_convs"] - 1) * row["words"]
        if up >= 0:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    nothing = hashlib.sha256().hexdigest()
    return [
        (k, r["depth"], r["conv_id"], nodes[skeleton.up[k]]["conv_id"] if k else None, r["n_convs"], int(children[k]), r["n_leaves"] + int(leaves[k]), r["saved_tokens"] + int(saved[k]), ends.get(k, nothing))
        for k, r in sorted(nodes.items())
    ]


def prefix_trie(turns: DataFrame, shards: int | None = None, sampled: int = SAMPLED, deepest: int = DEEPEST) -> DataFrame:
    """One row for each distinct beginning of rebuilt conversations: NODE.

    ``turns`` has conv_id, turn, role and text. Nodes are known by the digests of their turns (16 bytes of SHA-256);
    texts aren't shuffled. Copies of a conversation, however many, spread over shards by their ids.
    The driver holds the splitters and one row for each skeleton node, at most ``shards`` x ``deepest`` of them.
    A node's parent is found by a join of keys: a parent that isn't in the skeleton has all its children
    in one shard, so no key of this join is hot. The ids that end in a skeleton node are hashed in one
    stream, as SHA-256 asks for; they travel as rows of some thousand bytes, and no task holds them.

    Defined cases: null role or text is empty; turns with a null number come first, equal numbers go by digest;
    rows with a null conv_id belong to no conversation; a conversation without turns counts for the root; one
    conversation's digests (20 bytes a turn) stand in one row; an empty table gives an empty table; other
    columns are ignored.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = durable(rebuilt_paths(turns.select("conv_id", "turn", "role", "text")))
    shards = shards or min(SHARDS, parts)
    splitters = chosen_splitters(paths, shards, sampled, deepest)
    dealt = paths.mapInArrow(lambda it: _sharded(it, splitters), "shard int, conv_id long, path binary, words array<int>")
    dealt = dealt.repartitionById(parts, "shard").sortWithinPartitions("shard", "path", "conv_id")
    made = durable(dealt.mapInArrow(lambda it: _walked(it, splitters), PARTS_SCHEMA))

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    reduced = made.where("kind = 1").groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"), *sums).collect()
    ids = made.where("kind = 2").select("skeleton", "conv_id", "ends").repartition(parts, "skeleton").sortWithinPartitions("skeleton", "conv_id")
    ends = {r["skeleton"]: r["ends_sha256"] for r in ids.mapInArrow(_hashed, "skeleton int, ends_sha256 string").collect()}
    top = spark.createDataFrame(skeleton_rows(Skeleton(splitters), reduced, ends) if reduced else [], NODE_SCHEMA)

    local = made.where("kind = 0").withColumnRenamed("ends", "ends_sha256")
    above = made.where("kind = 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    inside = local.where("parent_key is not null").join(above, "parent_key")
    under = local.where("parent_key is null").join(F.broadcast(top.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("parent_conv_id"))), "parent_skeleton")
    return top.select(NODE).unionByName(inside.select(NODE)).unionByName(under.select(NODE))
